"""Timers over streams: the watchdog of a recording and the delayed start of a shortcut, by event time.

A key's state waits for the watermark: what is decided at a moment is decided when no earlier event can come any
more, so the result does not depend on how events were cut into batches and equals that of the tables (sessions.py).
Both take a streaming table with an event-time column `ts` (a timestamp), of which they set the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _micros(ts) -> int:
    return pd.Timestamp(ts).value // 1000


def _stamp(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


def _wait(held: GroupState, until: int) -> None:
    """Wake up when the watermark has passed `until`, in microseconds."""
    held.setTimeoutTimestamp(max(-(-until // 1000), held.getCurrentWatermarkMs() + 1))


def watched(events: DataFrame, key: str = "recording_id", seconds: float = 2.0, late: str = "10 seconds") -> DataFrame:
    """(key, started, failed) of each recording once its time is over: no buffer within `seconds` of its start, interruptions not counted.

    events: key, ts, event (start, buffer), interrupted (seconds, of a start).  The first start counts.
    """

    def run(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        start, off, first, told = json.loads(held.get[0]) if held.exists else (None, 0, None, False)
        for part in parts:
            for ts, event, interrupted in zip(part["ts"], part["event"], part["interrupted"], strict=True):
                at = _micros(ts)
                if event == "start" and (start is None or at < start):
                    start, off = at, 0 if pd.isna(interrupted) else round(interrupted * 1_000_000)
                elif event == "buffer":
                    first = at if first is None else min(first, at)
        rows = []
        if start is not None and not told:
            until = start + off + round(seconds * 1_000_000)
            if held.getCurrentWatermarkMs() * 1000 > until:
                rows, told = [(k[0], _stamp(start), first is None or first > until)], True
            else:
                _wait(held, until + 1000)
        held.update((json.dumps([start, off, first, told]),))
        yield pd.DataFrame(rows, columns=[key, "started", "failed"])

    made = f"`{key}` {events.schema[key].dataType.simpleString()}, started timestamp, failed boolean"
    rows = events.select(key, "ts", "event", "interrupted").withWatermark("ts", late)
    return rows.groupBy(key).applyInPandasWithState(run, made, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def delayed(events: DataFrame, key: str, delay: float, late: str = "10 seconds") -> DataFrame:
    """(key, ts, event_id, mode, at): starts that no stop or other start follows within `delay` seconds; a swap meanwhile makes them toggles.

    events: key, ts, event_id, event (start, swap, stop), mode; of equal times the smaller event_id comes first.
    """
    gap = round(delay * 1_000_000)

    def run(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(held.get[0]) if held.exists else []
        for part in parts:
            known += [[_micros(ts), int(i), event, mode] for ts, i, event, mode in zip(part["ts"], part["event_id"], part["event"], part["mode"], strict=True)]
        known.sort(key=lambda x: x[:2])
        passed = held.getCurrentWatermarkMs() * 1000
        rows, waiting = [], []
        for n, (at, i, event, mode) in enumerate(known):
            if event != "start":
                continue
            if at + gap >= passed:
                waiting.append(at)
                continue
            for then, _, other, _ in known[n + 1 :]:
                if then - at >= gap:
                    break
                if other != "swap":
                    mode = None
                    break
                mode = "toggle"
            if mode is not None:
                rows.append((k[0], _stamp(at), i, mode, _stamp(at + gap)))
        # what is before the watermark and before every start that waits concerns no start that may still come
        held.update((json.dumps([x for x in known if x[0] >= min([passed, *waiting])]),))
        if waiting:
            _wait(held, waiting[0] + gap + 1000)
        yield pd.DataFrame(rows, columns=[key, "ts", "event_id", "mode", "at"])

    made = f"`{key}` {events.schema[key].dataType.simpleString()}, ts timestamp, event_id bigint, mode string, at timestamp"
    rows = events.select(key, "ts", "event_id", "event", "mode").withWatermark("ts", late)
    return rows.groupBy(key).applyInPandasWithState(run, made, "state string", "append", GroupStateTimeout.EventTimeTimeout)
