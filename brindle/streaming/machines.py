"""Keyed state machines: pure transitions, a fold over a table in order, and the same over a stream.

A transition takes (state, event) and returns (state, output or None).  fold() runs it for each key over a
table; stream() runs the same function in a streaming query, so both agree for events in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

Transition = Callable[[dict, dict], tuple[dict, str | None]]


def wake_latch(state: dict, event: dict, cooldown: float = 1.0) -> tuple[dict, str | None]:
    """Emits the phrase once; a later update without a phrase arms it again after the cooldown."""
    if event.get("rearm"):
        return {}, None
    phrase = event["phrase"] if isinstance(event["phrase"], str) else None
    if state.get("off"):
        ready = phrase is None and event["at"] - state["last"] >= cooldown
        return ({} if ready else state), None
    return ({"off": True, "last": event["at"]}, phrase) if phrase else (state, None)


def dictation_session(state: dict, event: dict) -> tuple[dict, str | None]:
    """Hold and toggle sessions: a hold may become a toggle; a toggle stops only after it was released once."""
    kind, mode = event["event"], state.get("mode")
    if mode is None:
        if not event["busy"] and kind in ("holdActivated", "toggleActivated"):
            mode = kind.removesuffix("Activated")
            return {"mode": mode}, f"start:{mode}"
        return state, None
    if mode == "hold":
        if kind == "toggleActivated":
            return {"mode": "toggle"}, "switchedToToggle"
        return ({}, "stop") if kind == "holdDeactivated" else (state, None)
    if kind == "toggleDeactivated":
        return {"mode": "toggle", "armed": True}, None
    return ({}, "stop") if kind == "toggleActivated" and state.get("armed") else (state, None)


def fold(events: DataFrame, key: str, order: list[str], transition: Transition) -> DataFrame:
    """(key, the order columns, output) of events with an output; a key's events pass one task in order."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.select(key, *order).schema) + ", output string"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        state: dict = {}
        rows = []
        for event in group.to_dict("records"):
            state, out = transition(state, event)
            if out is not None:
                rows.append([event[key], *[event[c] for c in order], out])
        return pd.DataFrame(rows, columns=[key, *order, "output"])

    return events.groupBy(key).applyInPandas(run, schema)


def stream(events: DataFrame, key: str, order: list[str], transition: Transition) -> DataFrame:
    """The same over a streaming table: the state of a key is one JSON text; a batch's events are taken in order."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.select(key, *order).schema) + ", output string"

    def run(k: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        rows = []
        for event in pd.concat(list(parts)).sort_values(order).to_dict("records"):
            state, out = transition(state, event)
            if out is not None:
                rows.append([event[key], *[event[c] for c in order], out])
        held.update((json.dumps(state),))
        yield pd.DataFrame(rows, columns=[key, *order, "output"])

    return events.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)


# Fixed values of the level meter, in dB or shares: where it starts, the least span, how fast floor, ceiling and display follow.
START_FLOOR, START_CEILING, LEAST_SPAN, HEADROOM, WHOLE_SPAN = -55.0, -37.0, 18.0, 8.0, 26.0
FALL, RISE, NEAR, ATTACK, RELEASE, UP, DOWN, GATE, MARGIN, LEAST_SHOWN = 0.12, 0.02, 4.0, 0.55, 0.04, 0.45, 0.12, 0.06, 3.0, 0.12

PART = 512  # levels kept in one array while a curve is worked out


def level_curve(loudness: Column) -> Column:
    """Displayed levels (0 to 1) of an ordered array of RMS values: adaptive floor and ceiling in dB, gate and smoothing.

    All arithmetic is in single precision.  Each step works its values out once.
    """
    f = lambda v: F.lit(v).cast("float")
    toward = lambda a, b, t: (a + (b - a) * f(t)).cast("float")

    def step(s: Column, x: Column) -> Column:
        db = (F.log10(F.greatest(x.cast("double"), F.lit(1e-5))) * 20).cast("float")

        def floors(v: Column) -> Column:
            near = F.when(v.low <= s.floor, toward(s.floor, v.low, FALL)).when(v.low <= s.floor + f(NEAR), toward(s.floor, v.low, RISE)).otherwise(s.floor)
            return F.struct(v.db.alias("db"), near.cast("float").alias("floor"))

        def ceilings(v: Column) -> Column:
            least = v.floor + f(LEAST_SPAN)
            high = F.when(v.db >= s.ceiling, toward(s.ceiling, v.db, ATTACK)).otherwise(toward(s.ceiling, F.greatest(v.db, least), RELEASE))
            return F.struct(v.db.alias("db"), v.floor.alias("floor"), F.greatest(high, least).cast("float").alias("ceiling"))

        def raw(v: Column) -> Column:
            share = ((v.db - v.floor) / F.greatest(v.ceiling + f(HEADROOM) - v.floor, f(WHOLE_SPAN))).cast("float")
            return F.struct(v.db.alias("db"), v.floor.alias("floor"), v.ceiling.alias("ceiling"), F.least(F.greatest(share, f(0.0)), f(1.0)).alias("raw"))

        def shown(v: Column) -> Column:
            heard = v.db >= v.floor + f(MARGIN)
            gated = F.when((v.raw < f(GATE)) & (v.db <= v.floor + f(MARGIN)), f(0.0)).when(heard, F.greatest(v.raw, f(LEAST_SHOWN))).otherwise(v.raw)
            level = let(gated, lambda g: F.when(g > s.shown, toward(s.shown, g, UP)).otherwise(toward(s.shown, g, DOWN)))
            return F.struct(v.floor.alias("floor"), v.ceiling.alias("ceiling"), level.cast("float").alias("shown"))

        def kept(v: Column) -> Column:
            full = F.size(s.part) >= PART  # an append copies its array: levels wait in a short one
            part = F.when(full, F.array(v.shown)).otherwise(F.array_append(s.part, v.shown))
            return F.struct(v.floor.alias("floor"), v.ceiling.alias("ceiling"), v.shown.alias("shown"), F.when(full, F.array_append(s.levels, s.part)).otherwise(s.levels).alias("levels"), part.alias("part"))

        first = let(db, lambda d: F.struct(d.alias("db"), F.least(d, s.ceiling - f(LEAST_SPAN)).alias("low")))
        return let(let(let(let(let(first, floors), ceilings), raw), shown), kept)

    start = F.struct(f(START_FLOOR).alias("floor"), f(START_CEILING).alias("ceiling"), f(0.0).alias("shown"), F.array().cast("array<array<float>>").alias("levels"), F.array().cast("array<float>").alias("part"))
    return F.aggregate(loudness, start, step, lambda s: F.flatten(F.array_append(s.levels, s.part)))


def levels(samples: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, the order columns, shown) of samples (key, order, rms, reset): the displayed level of each.

    A reset (true) takes the meter back to its start before its own sample.  What lies between two resets of a key is folded by
    itself, so a long key is cut at its resets; a stretch without any is one array in one task.  A null rms is silence.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = samples.withColumn("_run", F.sum(F.coalesce(F.col("reset"), F.lit(False)).cast("int")).over(w))
    packed = runs.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct(*order, F.coalesce("rms", F.lit(0.0)).alias("rms")))).alias("s"))
    shown = packed.select(key, "s", level_curve(F.transform("s", lambda x: x.rms)).alias("l"))
    return shown.select(key, F.explode(F.arrays_zip("s", "l")).alias("x")).select(key, *[F.col(f"x.s.{c}") for c in order], F.col("x.l").alias("shown"))
