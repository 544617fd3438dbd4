"""What a run captures: selections and contexts at its start, recognised lines, recordings by name, and its history row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import activity
from ..functions.text import flatten, truncate_middle
from ..streaming.sessions import SCREEN, before_caret
from . import history

# The activity without an application in front, and the state of pictures, which are never taken.
NO_ACTIVITY = "You are dictating in an unrecognized context."
NO_PICTURE = "Not captured (local-only)"


def selection(focused: Column, whole: Column, raw: bool = False) -> Column:
    """The text selected in the focused element, else in the application; null if neither has one.

    Trimmed and in one line, where blank ones are none; raw ones as they are, where only empty ones are none.
    """
    seen = (lambda c: F.nullif(c, F.lit(""))) if raw else flatten
    return F.coalesce(seen(focused), seen(whole))


def window_title(title: Column, app: Column) -> Column:
    """The focused window's title, else the application's name."""
    return F.coalesce(flatten(title), app)


def snapshot(front: Column, app: Column, bundle: Column, title: Column, focused: Column, whole: Column) -> Column:
    """struct(app, bundle, title, selected) of the application in front, the selection raw; all null where none is (front false or null)."""
    parts = {"app": app, "bundle": bundle, "title": window_title(title, app), "selected": selection(focused, whole, raw=True)}
    return F.struct(*[F.when(front, c).alias(n) for n, c in parts.items()])


def context(front: Column, app: Column, bundle: Column, title: Column, focused: Column, whole: Column, value: Column, caret: Column, secure: Column) -> Column:
    """struct(app, bundle, title, selected, before, activity) of the application in front; without one only the activity, a fixed sentence.

    value, caret, secure: the focused field, of which the text before the caret is taken; the selection is trimmed.
    """
    title, selected = window_title(title, app), selection(focused, whole)
    parts = {"app": app, "bundle": bundle, "title": title, "selected": selected, "before": before_caret(value, caret, secure)}
    told = F.when(front, activity(app, bundle, selected, title)).otherwise(NO_ACTIVITY)
    return F.struct(*[F.when(front, c).alias(n) for n, c in parts.items()], told.alias("activity"))


def recognized(candidates: DataFrame, key: str, limit: int = SCREEN["limit"]) -> DataFrame:
    """(key, text) of readings (key, line, confidence, text) of lines: the surest reading of each, in order of lines, cut in the middle.

    Ties to the smaller text; a line whose readings are all null is left out.  The best reading is an aggregate with
    partial results, so one row a line goes on.
    """
    best = candidates.where("text is not null").groupBy(key, "line").agg(F.min(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("less"), "text")).alias("r"))
    lines = F.array_sort(F.collect_list(F.struct("line", "r.text")))
    whole = best.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x.text), "\n").alias("text"))
    return whole.withColumn("text", truncate_middle(F.col("text"), limit))


def recording_name(*parts: Column) -> Column:
    """A name of the form of a UUID, with .wav, made from parts that name a recording: a task that is run again gives the same."""
    h = F.md5(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.upper(F.concat_ws("-", *cuts)), F.lit(".wav"))


def saved(recordings: DataFrame, parts: list[str], content: str = "content") -> DataFrame:
    """recordings with name: null where there is no content to keep.  Write them as a table (sources.snapshots), not as a file each."""
    return recordings.withColumn("name", F.when(F.col(content).isNotNull(), recording_name(*[F.col(p) for p in parts])))


def without(store: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """The stored recordings but for those named; a name that is not there does nothing."""
    return store.join(names.select(F.col(name).alias("name")).where("name is not null").distinct(), "name", "left_anti").select(*store.columns)


def recorded(runs: DataFrame) -> DataFrame:
    """The 21 columns of a history row of each run.

    runs: id, ts, intent, selected, raw, clean, prompt, system_prompt, status, debug, vocabulary, audio, and context, a struct
    as context() gives it.  A selection belongs to the row only where the intent is a command; pictures and prompts of the
    context are never taken.
    """
    none = F.lit(None).cast("string")
    command = F.coalesce(F.startswith("intent", F.lit("command:")), F.lit(False))
    return runs.select(
        "id", "ts", F.coalesce("intent", F.lit("dictation")).alias("intent"), F.when(command, F.col("selected")).alias("selected"), F.col("context.selected").alias("captured"), "raw", F.coalesce("clean", F.lit("")).alias("clean"),
        "prompt", "system_prompt", F.col("context.activity").alias("context_summary"), none.alias("context_system_prompt"), none.alias("context_prompt"), none.alias("picture_url"), F.lit(NO_PICTURE).alias("picture_status"),
        "status", "debug", "vocabulary", "audio", F.col("context.app").alias("app"), F.col("context.bundle").alias("bundle"), F.col("context.title").alias("title"),
    )


def record(stored: DataFrame, runs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The history (rows as recorded() gives them) after runs came to it and the newest `most` stayed, and the names of the recordings that went."""
    return history.append_returning(stored, recorded(runs), most, "audio")
