"""Snapshots of stored tables, timers over streams against their batch versions, trees of elements, wake phrases in parts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.functions import rules, shortcuts, text
from brindle.sources.snapshots import read_snapshot, read_stored, write_snapshot
from brindle.streaming import sessions, timers

DAY = datetime(2024, 1, 1)


def test_snapshots_switch_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, path)
    assert read_snapshot(spark, path, "id int").count() == 0
    write_snapshot(spark.range(3), path)
    old = read_snapshot(spark, path)
    write_snapshot(spark.range(5), path)
    assert old.count() == 3 and read_snapshot(spark, path).count() == 5  # a reader keeps the version it has opened
    spark.range(9).write.parquet(f"{path}/versions/not-finished")  # a job that died before the switch
    assert read_snapshot(spark, path).count() == 5


def test_broken_blobs_are_empty(spark):
    good = '[{"id":"a","term":"T","source":"manual","status":"active","isEnabled":true,"observationCount":1,"createdAt":"2024-01-01T00:00:00Z","updatedAt":"2024-01-01T00:00:00Z"}]'
    cases = [(0, None, False, 0), (1, "", True, 0), (2, "[]", False, 0), (3, good, False, 1), (4, good[:-1], True, 0), (5, "[null]", True, 0), (6, good.replace('"id":"a",', ""), True, 0), (7, "null", True, 0), (8, good.replace("manual", "other"), True, 0)]
    got = read_stored(spark.createDataFrame([c[:2] for c in cases], "i int, blob string")).collect()
    assert [(r.i, r.broken, len(r.entries)) for r in got] == [(i, b, n) for i, _, b, n in cases]
    assert (got[3].entries[0].starred, got[3].entries[0].usageCount) == (False, 0)


def test_stored_shortcuts_that_do_not_decode(spark):
    blobs = ["", "null", "[]", '{"keyCode":1,"keyDisplay":"x","modifiers":0,"kind":"key","preset":"none such"}', '{"keyCode":"x","keyDisplay":"x","modifiers":0,"kind":"key"}', '{"keyCode":1,"keyDisplay":"x","modifiers":0,"kind":"key","more":1}']
    got = [r.b.binding for r in spark.createDataFrame([(b,) for b in blobs], "b string").select(shortcuts.stored_binding(F.col("b")).alias("b")).collect()]
    assert got[:5] == [None] * 5 and (got[5].code, got[5].kind) == (1, "key")


def test_parts_of_a_name_stand_for_a_greeting(spark):
    given = ["june, iper open it", "Hey  June-Iper: open it", "june open it", "juniper open it", "june iperx"]
    rows = spark.createDataFrame([(g,) for g in given], "t string").select(text.wake_match(F.col("t"), ["hey"], ["juniper"], ["june iper"], segmented=["june iper"]).alias("m")).collect()
    assert [r.m and tuple(r.m) for r in rows] == [("greeting", "open it"), ("greeting", "open it"), None, None, None]


def test_intents_and_terms(spark):
    row = spark.range(1).select(rules.restored_intent(F.lit("command:manual"), F.lit("")), rules.restored_intent(F.lit("command:manual"), F.lit(None)), rules.restored_intent(F.lit(None).cast("string"), F.lit("x")), rules.recognition_terms(F.lit("a"), ["b"], F.lit(None).cast("boolean")), rules.thumbnail_url(F.lit("u?v=1")))
    assert tuple(row.first()) == ("command:manual", "dictation", "dictation", "a", "u?v=1&s=44")


def test_screen_trees_leave_out_what_has_no_root(spark):
    rows = [(1, 0, None, 0, "AXGroup", "no text"), (1, 1, 0, 1, "AXHeading", " second "), (1, 2, 0, 0, "AXTextArea", "first"), (1, 3, 2, 0, "AXStaticText", "first"), (1, 4, 2, 1, "AXStaticText", "x"), (1, 5, 99, 0, "AXHeading", "orphan"), (1, 6, 7, 0, "AXHeading", "cycle"), (1, 7, 6, 0, "AXHeading", "cycle too"), (2, 0, None, 0, "AXHeading", None)]
    got = sessions.screen_tree(spark.createDataFrame(rows, "k int, id int, parent int, pos int, role string, value string"), "k").collect()
    assert [tuple(r) for r in got] == [(1, "first\nsecond")]


def streamed(spark, tmp_path, rows, schema, parts, make):
    """Rows of a streaming query over files of the rows, cut as given; the last file moves the watermark past all."""
    source = str(tmp_path / "in")
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}/part={n:04d}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    q = make(files).writeStream.format("memory").queryName(f"timers_{tmp_path.name.replace('-', '_')}").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
        return [tuple(r) for r in spark.table(q.name).collect()]
    finally:
        q.stop()


def test_watchdog_in_a_stream_equals_the_table(spark, tmp_path):
    r = random.Random(3)
    start = {k: DAY + timedelta(seconds=r.randint(0, 40)) for k in range(25)}
    rows = [(k, s, "start", r.choice([None, 3.0])) for k, s in start.items()]
    rows += [(k, s + timedelta(seconds=r.choice([0.5, 1.9, 2.0, 2.1, 4.9, 5.1, 9])), "buffer", None) for k, s in start.items() for _ in range(r.randint(0, 2))]
    r.shuffle(rows)
    parts = [sorted(rows, key=lambda x: x[1])[i::3] for i in range(3)]  # out of order between files
    parts += [[(900 + i, DAY + timedelta(hours=1 + i), "buffer", None)] for i in range(3)]
    got = streamed(spark, tmp_path, rows, "recording_id int, ts timestamp, event string, interrupted double", parts, lambda s: timers.watched(s, seconds=2.0, late="10 minutes"))
    table = spark.createDataFrame(rows, "recording_id int, ts timestamp, event string, interrupted double")
    want = sessions.watchdog(table.where("event = 'start'").select("recording_id", F.col("ts").alias("started"), "interrupted"), table.where("event = 'buffer'"))
    assert sorted((k, f) for k, _, f in got) == sorted((x.recording_id, x.failed) for x in want.collect())


def test_delayed_starts_in_a_stream_equal_the_table(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, DAY + timedelta(seconds=r.randint(0, 200) / 2), k * 1000 + i, r.choice(["start", "start", "swap", "stop"]), "hold") for k in range(6) for i in range(40)]
    parts = [sorted(rows, key=lambda x: x[1])[i::3] for i in range(3)]
    parts += [[(900 + i, DAY + timedelta(hours=1 + i), i, "stop", "hold")] for i in range(3)]
    schema = "k int, ts timestamp, event_id long, event string, mode string"
    got = streamed(spark, tmp_path, rows, schema, parts, lambda s: timers.delayed(s, "k", 3.0, "10 minutes"))
    want = sessions.debounced(spark.createDataFrame(rows, schema), "k", 3.0).collect()
    assert want and sorted((k, i, m) for k, _, i, m, _ in got) == sorted((x.k, x.event_id, x.mode) for x in want)
