"""Selections, contexts, recognised lines, recordings, history rows, and the level meter against a plain loop."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from brindle.operators import captures
from brindle.streaming import machines

FIELDS = "i int, front boolean, app string, bundle string, title string, focused string, whole string, value string, caret int, secure boolean"
CASES = [
    (0, True, "App", "b", " T\nx ", " a\nb ", "w", "hello there", 5, False),
    (1, True, "App", None, "  ", "", " ", "  ", 2, False),
    (2, True, None, None, None, None, " w ", "secret", 3, True),
    (3, False, "App", "b", "T", "a", "w", "hello", 5, False),
    (4, None, "App", "b", "T", "a", "w", "hello", 5, False),
    (5, True, "App", "b", "T", " \n", None, None, None, None),
]


def test_contexts_and_snapshots(spark):
    df = spark.createDataFrame(CASES, FIELDS)
    place = [F.col(c) for c in ("front", "app", "bundle", "title", "focused", "whole")]
    rows = df.select("i", captures.snapshot(*place).alias("s"), captures.context(*place, F.col("value"), F.col("caret"), F.col("secure")).alias("c")).orderBy("i").collect()
    assert [tuple(r.s) for r in rows] == [("App", "b", "T x", " a\nb "), ("App", None, "App", " "), (None, None, None, " w "), (None,) * 4, (None,) * 4, ("App", "b", "T", " \n")]
    assert [tuple(r.c)[:5] for r in rows] == [("App", "b", "T x", "a b", "hello"), ("App", None, "App", None, None), (None, None, None, "w", None), (None,) * 5, (None,) * 5, ("App", "b", "T", None, None)]
    assert [r.c.activity for r in rows][3:5] == [captures.NO_ACTIVITY] * 2 and rows[2].c.activity.startswith("The user is writing in the active application")


def test_recognized_takes_the_surest_reading(spark):
    given = [("a", 1, 0.5, "no"), ("a", 1, 0.9, "yes"), ("a", 0, 0.5, "tie b"), ("a", 0, 0.5, "tie a"), ("a", 2, None, "x"), ("a", 3, 1.0, None), ("b", 0, 1.0, None), ("c", 0, 1.0, "y" * 40)]
    got = captures.recognized(spark.createDataFrame(given, "key string, line int, confidence double, text string"), "key", 20).collect()
    assert {r.key: r.text for r in got} == {"a": "tie a\nyes\nx", "c": "y" * 8 + "\n[…]\n" + "y" * 8}
    assert captures.recognized(spark.createDataFrame([], "key string, line int, confidence double, text string"), "key").count() == 0


def test_recordings_by_name(spark):
    df = spark.createDataFrame([("a", "bc", b"x"), ("ab", "c", b""), (None, "c", b"y"), ("null", "c", b"z"), ("n", "o", None)], "p string, q string, content binary")
    store = captures.saved(df, ["p", "q"])
    names = {(r.p, r.q): r.name for r in store.collect()}
    assert names["n", "o"] is None and len({n for n in names.values() if n}) == 4  # parts are kept apart, and a null is not the word
    assert names == {(r.p, r.q): r.name for r in captures.saved(df.repartition(3), ["p", "q"]).collect()}
    gone = spark.createDataFrame([(names["a", "bc"],), (names["a", "bc"],), (None,), ("none such",)], "name string")
    assert {r.p for r in captures.without(store.where("name is not null"), gone).collect()} == {"ab", None, "null"}


def test_history_rows_are_whole(spark):
    runs = spark.createDataFrame(CASES, FIELDS).select(
        F.col("i").alias("id"), F.timestamp_seconds(F.col("i") * 60).alias("ts"), F.element_at(F.array(F.lit("dictation"), F.lit("command:manual"), F.lit(None).cast("string")), F.col("i") % 3 + 1).alias("intent"), F.lit("sel").alias("selected"), F.lit("raw").alias("raw"), F.lit(None).cast("string").alias("clean"),
        *[F.lit(c).alias(c) for c in ("prompt", "system_prompt", "status", "debug", "vocabulary")], F.concat(F.lit("f"), F.col("i")).alias("audio"), captures.context(*[F.col(c) for c in ("front", "app", "bundle", "title", "focused", "whole", "value", "caret", "secure")]).alias("context"),
    )
    kept, gone = captures.record(captures.recorded(runs.where("id < 3")), runs.where("id >= 3"), 4)
    rows = {r.id: r for r in kept.collect()}
    assert set(rows) == {2, 3, 4, 5} and len(kept.columns) == 21 and {r.audio for r in gone.collect()} == {"f0", "f1"}
    assert [(rows[i].intent, rows[i].selected, rows[i].clean) for i in (2, 3, 4)] == [("dictation", None, ""), ("dictation", None, ""), ("command:manual", "sel", "")]
    assert rows[3].context_summary == captures.NO_ACTIVITY and rows[5].picture_status == captures.NO_PICTURE and rows[5].picture_url is None


def meter(samples):
    """The meter as a plain loop in single precision; a sample is (rms, reset)."""
    f, shown = np.float32, []
    for rms, reset in samples:
        if reset or not shown:
            low, high, now = f(-55), f(-37), f(0)
        db = f(math.log10(max(float(rms or 0), 1e-5)) * 20)
        quiet = min(db, high - f(18))
        low = low + (quiet - low) * f(0.12) if quiet <= low else low + (quiet - low) * f(0.02) if quiet <= low + f(4) else low
        least = low + f(18)
        high = max(high + (db - high) * f(0.55) if db >= high else high + (max(db, least) - high) * f(0.04), least)
        raw = min(max((db - low) / max(high + f(8) - low, f(26)), f(0)), f(1))
        g = f(0) if raw < f(0.06) and db <= low + f(3) else max(raw, f(0.12)) if db >= low + f(3) else raw
        now = now + (g - now) * (f(0.45) if g > now else f(0.12))
        shown.append(float(now))
    return shown


def test_levels_equal_a_plain_loop(spark):
    rng = random.Random(5)
    given = {k: [(rng.choice([None, 0.0, 10 ** rng.uniform(-5, 0)]), rng.random() < share) for _ in range(n)] for k, n, share in (("long", 1300, 0.0), ("cut", 300, 0.05), ("one", 1, 1.0))}
    rows = [(k, i, rms, reset if i % 7 else reset or None) for k, s in given.items() for i, (rms, reset) in enumerate(s)]
    got = {(r.key, r.at): r.shown for r in machines.levels(spark.createDataFrame(rows, "key string, at int, rms double, reset boolean").repartition(5), "key", ["at"]).collect()}
    assert len(got) == len(rows)
    for k, s in given.items():
        assert np.allclose([got[k, i] for i in range(len(s))], meter(s), atol=1e-5)


def test_long_curves_keep_their_order(spark):
    n = 3 * machines.PART
    whole = spark.range(1).select(machines.level_curve(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x % 17 / 17.0)).alias("l")).first().l
    assert np.allclose(whole, meter([(x % 17 / 17, False) for x in range(1, n + 1)]), atol=1e-5)
