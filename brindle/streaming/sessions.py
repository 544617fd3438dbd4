"""Recordings and sessions over event tables: backlog, final text, watchdog, first sound, delayed start, sources.

All are window, aggregate or join expressions over (recording_id, ts, ...) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, truncate_middle


def _seconds(later: Column, earlier: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1_000_000


def delivered(chunks: DataFrame, sessions: DataFrame, key: str = "recording_id") -> DataFrame:
    """chunks with at: chunks before a session (key, ready, finished) was ready wait for it, those after its end are dropped."""
    met = chunks.join(sessions, key).where(F.col("finished").isNull() | (F.col("ts") <= F.col("finished")))
    return met.where("ready is not null").withColumn("at", F.greatest("ts", "ready")).drop("ready", "finished")


def final_text(fragments: DataFrame, sessions: DataFrame, key: str = "recording_id", seconds: float = 60.0) -> DataFrame:
    """(key, text): fragments (key, seq, ts, text) in order, up to `seconds` after the session's end; trimmed."""
    met = fragments.join(sessions.select(key, "finished"), key).where(F.col("finished").isNull() | (_seconds(F.col("ts"), F.col("finished")) <= seconds))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return met.groupBy(key).agg(strip(F.array_join(F.transform(ordered, lambda x: x.text), "")).alias("text"))


def transcript(streamed: Column, from_file: Column) -> Column:
    """The streamed text, or where it is empty that of the file."""
    return F.coalesce(F.nullif(strip(streamed), F.lit("")), from_file)


def file_budget(duration: Column) -> Column:
    """Seconds that a file's transcription may take."""
    return F.greatest(F.lit(30.0), duration + 30)


def first_done(output: Column, elapsed: Column, budget: Column, cancelled: Column) -> Column:
    """struct(output, failure) of a race between an answer, a timer and a cancellation (seconds, or null)."""
    stopped = cancelled.isNotNull() & (cancelled < F.least(F.coalesce(elapsed, budget), budget))
    failure = F.when(stopped, "cancelled").when(output.isNull() | elapsed.isNull() | (elapsed > budget), "timed out")
    return F.struct(F.when(failure.isNull(), output).alias("output"), failure.alias("failure"))


def watchdog(recordings: DataFrame, buffers: DataFrame, key: str = "recording_id", seconds: float = 2.0) -> DataFrame:
    """recordings (key, started, interrupted seconds) with failed: no buffer (key, ts) within `seconds` of the start, interruptions not counted."""
    first = buffers.groupBy(key).agg(F.min("ts").alias("_first"))
    waited = _seconds(F.col("_first"), F.col("started")) - F.coalesce("interrupted", F.lit(0.0))
    return recordings.join(first, key, "left").withColumn("failed", F.coalesce(waited > seconds, F.lit(True))).drop("_first")


def first_sound(chunks: DataFrame, key: str = "recording_id") -> DataFrame:
    """(key, ts) of each recording's first chunk with a level above 0."""
    return chunks.where("rms > 0").groupBy(key).agg(F.min("ts").alias("ts"))


def debounced(events: DataFrame, key: str, delay: float, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """(key, order, mode, at): starts (event start) that no stop follows within `delay` seconds.

    A swap to toggle while a start waits changes its mode.  events: key, ts, event_id, event (start, swap, stop), mode.
    """
    w = Window.partitionBy(key).orderBy(*order)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    next_end = F.first(F.when(F.col("event").isin("stop", "start"), F.struct("ts", "event")), ignorenulls=True).over(after)
    next_swap = F.first(F.when(F.col("event").isin("swap", "stop", "start"), F.struct("ts", "event")), ignorenulls=True).over(after)
    rows = events.withColumns({"_end": next_end, "_swap": next_swap}).where("event = 'start'")
    gone = F.coalesce(_seconds(F.col("_end.ts"), F.col("ts")) < delay, F.lit(False))
    swapped = F.coalesce((F.col("_swap.event") == "swap") & (_seconds(F.col("_swap.ts"), F.col("ts")) < delay), F.lit(False))
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + int(delay * 1_000_000)).cast("timestamp_ntz")
    return rows.where(~gone).select(key, *order, F.when(swapped, "toggle").otherwise(F.col("mode")).alias("mode"), at.alias("at"))


def carried(events: DataFrame, key: str, value: str, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """events with known: the last value that any event up to it had."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("known", F.last(value, ignorenulls=True).over(w))


def before_caret(value: Column, caret: Column, secure: Column, most: int = 240) -> Column:
    """The text before the caret; null in secure fields, at the start and where it is blank.

    A cut does not fall between a letter and marks that belong to it.
    """
    seen = F.regexp_replace(F.right(F.substr(value, F.lit(1), caret), F.lit(most)), r"\A\p{M}+", "")
    return F.when(~secure & (caret > 0) & (strip(seen) != ""), seen)


def ends_with_target(before: Column, target: Column, selected: Column) -> Column:
    """Whether a text stands right before the caret, but for one blank, and nothing is selected."""
    return (selected == 0) & (target != "") & F.endswith(F.regexp_replace(before, r"(?U)\s\z", ""), target)


def visible_text(accessible: Column, read: Column, enough: int = 120) -> Column:
    """The accessible text if long enough, else the text read from the picture if that is longer."""
    n = F.coalesce(F.length(accessible), F.lit(0))
    return F.when(n >= enough, accessible).when(F.length(read) > n, read).otherwise(accessible)


def screen_text(pieces: DataFrame, key: str, limit: int, least: int = 2) -> DataFrame:
    """(key, text): distinct pieces (key, pos, text) of at least two characters in order, joined and cut in the middle.

    One row a piece and key goes on: repeats meet in the first aggregation.
    """
    clean = pieces.withColumn("text", strip(F.col("text"))).where(F.length("text") >= least)
    first = clean.groupBy(key, "text").agg(F.min("pos").alias("pos"))
    return _joined(first, key, "pos", limit)


def _joined(pieces: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """(key, text): pieces in order, one a line; of three and more new lines two are left."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x.text), "\n")
    whole = pieces.groupBy(key).agg(strip(F.regexp_replace(lines, r"\n{3,}", "\n\n")).alias("text"))
    return whole.withColumn("text", truncate_middle(F.col("text"), limit))


# The roles of elements that hold text, and the bounds of a walk over them.
TEXT_ROLES = ("AXStaticText", "AXTextArea", "AXTextField", "AXHeading")
SCREEN = {"limit": 2400, "depth": 24, "visits": 900}


def screen_tree(elements: DataFrame, key: str, limit: int = SCREEN["limit"], depth: int = SCREEN["depth"], visits: int = SCREEN["visits"], budget: int | None = None, least: int = 2) -> DataFrame:
    """(key, text) of trees of elements (key, id, parent, pos, role, value), read depth-first.

    Each element's path from its root (a row without parent) comes from pointer doubling, so a depth of 24 is 5 joins;
    paths in order are the depth-first walk.  Elements below `depth` are not visited, the walk ends after `visits` more than
    one elements and once the pieces' lengths have used up `budget` (three times the limit).  A piece is a
    trimmed value of a text role with at least two characters, where it comes first.  Elements whose parents lead to no root
    are left out; siblings of one pos are in order of id.
    """
    own = F.array(F.struct("pos", "id"))
    now = elements.select(key, "id", "role", "value", F.col("parent").alias("next"), own.alias("path"))
    links = now.select(key, "id", "next", "path")
    for _ in range(depth.bit_length()):
        above = links.select(key, F.col("id").alias("next"), F.col("next").alias("_next"), F.col("path").alias("_path"))
        up = lambda df: df.join(above, [key, "next"], "left").withColumns({"path": F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")), "next": F.when(F.col("_path").isNull(), F.col("next")).otherwise(F.col("_next"))}).drop("_path", "_next")  # noqa: E731,B023
        now, links = up(now), up(links)
    rooted = now.where(F.col("next").isNull() & (F.size("path") <= depth + 1))
    walk = Window.partitionBy(key).orderBy("path")
    visited = rooted.withColumn("_visit", F.row_number().over(walk)).where(F.col("_visit") <= visits + 1)
    text = F.when(F.col("role").isin(*TEXT_ROLES), strip(F.col("value")))
    pieces = visited.withColumn("text", text).where(F.length("text") >= least)
    first = pieces.withColumn("_n", F.row_number().over(Window.partitionBy(key, "text").orderBy("_visit"))).where("_n = 1")
    used = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy(key).orderBy("_visit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _joined(first.withColumn("_used", used).where(F.col("_used") < (3 * limit if budget is None else budget)), key, "_visit", limit)


def largest_window(windows: DataFrame, key: str) -> DataFrame:
    """(key, id) of the largest window (key, id, width, height, on_screen) on the screen; ties to the smaller id."""
    seen = windows.where("on_screen").groupBy(key).agg(F.max(F.struct((F.col("width") * F.col("height")).alias("area"), (-F.col("id")).alias("n"))).alias("w"))
    return seen.select(key, (-F.col("w.n")).alias("id"))


def volume(main: Column, channels: Column) -> Column:
    """The main element's volume, else the largest of the channels', else null."""
    return F.coalesce(main, F.array_max(channels))


def event_mask(events: DataFrame, by: list[str], bit: str = "bit") -> DataFrame:
    return events.groupBy(*by).agg(F.bit_or(bit).alias("mask"))


def devices(found: DataFrame) -> DataFrame:
    """(uid, name) of devices (uid, name, pos): the first row of each uid, without blank ones, by name whatever its case."""
    fine = found.where((strip(F.col("uid")) != "") & (strip(F.col("name")) != ""))
    return fine.groupBy("uid").agg(F.min_by("name", "pos").alias("name")).orderBy(F.lower("name"), "uid")


def pasted(text: Column) -> Column:
    """A text as it goes to the clipboard: a blank after the end of a sentence."""
    return F.when(text.rlike(r"[.!?]\z"), F.concat(text, F.lit(" "))).otherwise(text)


def may_restore(changes: Column, changes_then: Column, content: Column, written: Column) -> Column:
    """Whether the clipboard still holds what was written to it."""
    return (changes == changes_then) | content.eqNullSafe(written)


def resolved_contexts(stops: DataFrame, captures: DataFrame, key: str = "session_id") -> DataFrame:
    """stops (key, stop_id, at, fallback) with context and tier of each stop.

    captures: key, started, finished (null if never), context.  The newest capture that had finished at the stop is the
    context (captured); else the newest that had started and finished later (in flight), which a stop waits for; else the
    stop's own fallback.  One window over both, by key and time, not a range join: all of a key's rows need an order.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    kind = captures.schema["context"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    row = lambda at, place, done, begun, ends: [key, at.alias("_at"), F.lit(place).alias("_place"), done.alias("_done"), begun.alias("_begun"), ends.alias("_ends")]
    held = F.struct("context")
    stop = F.struct("stop_id", "at", "fallback")
    empty = F.lit(None).cast(f"struct<context:{kind}>")
    no_stop = F.lit(None).cast(stops.select(stop.alias("s")).schema["s"].dataType)
    ended = captures.where("finished is not null").select(*row(micros("finished"), 1, held, empty, none("long")), no_stop.alias("_stop"))
    begun = captures.where("finished is not null").select(*row(micros("started"), 0, empty, held, micros("finished")), no_stop.alias("_stop"))
    asked = stops.select(*row(micros("at"), 2, empty, empty, none("long")), stop.alias("_stop"))
    w = Window.partitionBy(key).orderBy("_at", "_place", F.coalesce("_done", "_begun")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    seen = ended.unionByName(begun).unionByName(asked).withColumns({"_done": last("_done"), "_flight": last(F.when(F.col("_begun").isNotNull(), F.struct("_begun", "_ends")))}).where("_stop is not null")
    flying = F.col("_flight").isNotNull() & (F.col("_flight._ends") > F.col("_at"))
    tier = F.when(F.col("_done").isNotNull(), "captured").when(flying, "in flight").otherwise("fallback")
    context = F.when(F.col("_done").isNotNull(), F.col("_done.context")).when(flying, F.col("_flight._begun.context")).otherwise(F.col("_stop.fallback"))
    return seen.select(key, "_stop.stop_id", "_stop.at", context.alias("context"), tier.alias("tier"))
