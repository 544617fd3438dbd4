"""Queries on what runs capture: selections, contexts, recognised lines, recordings, whole history rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import captures
from ..sources.documents import table
from ..streaming import machines
from .catalogue import query

# A turn as a field: every fifth has no application in front; titles, elements and applications tell something, blanks, or nothing.
_GIVEN = """SELECT conv_id, turn, role, text, turn % 5 <> 4 AS front, CASE turn % 3 WHEN 0 THEN 'Slack' WHEN 1 THEN 'Terminal' END AS app, 'org.example.' || role AS bundle,
  CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' Talk ' || conv_id ELSE 'Talk' END AS title, CASE (conv_id + turn) % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE ' ' || text || ' end ' END AS focused,
  CASE conv_id % 3 WHEN 0 THEN NULL WHEN 1 THEN ' all of it ' ELSE '' END AS whole, conv_id % 7 = 0 AS secure FROM conversations"""
_TITLE = "CASE WHEN turn % 4 = 2 THEN 'Talk ' || conv_id WHEN turn % 4 = 3 THEN 'Talk' ELSE app END"
_RAW = "coalesce(nullif(focused, ''), nullif(whole, ''))"
_FLAT = r"nullif(replace(trim({}, E' \n\t\r'), chr(10), ' '), '')"
_TRIMMED = f"coalesce({_FLAT.format('focused')}, {_FLAT.format('whole')})"
_SENTENCE = f"""'The user is writing in ' || coalesce(app, 'the active application') || ', treated as ' || CASE app WHEN 'Slack' THEN 'work chat' WHEN 'Terminal' THEN 'code or terminal' ELSE 'general writing' END || '.'
  || CASE WHEN {_TRIMMED} IS NOT NULL THEN ' Nearby selected text is available as a tone and spelling hint.' ELSE '' END"""


def _given(spark, d):
    table(spark, d, "conversations").createOrReplaceTempView("_captured_turns")
    return spark.sql(_GIVEN.replace("FROM conversations", "FROM _captured_turns"))


_PLACE = ["front", "app", "bundle", "title", "focused", "whole"]


@query(f"""SELECT conv_id, turn, CASE WHEN front THEN app END AS app, CASE WHEN front THEN bundle END AS bundle, CASE WHEN front THEN {_TITLE} END AS title, md5(CASE WHEN front THEN {_RAW} END) AS selected, md5({_TRIMMED}) AS trimmed FROM ({_GIVEN})""")
def selections(spark, d):
    """Snapshots of the application in front, raw and trimmed selections."""
    place = [F.col(c) for c in _PLACE]
    rows = _given(spark, d).select("conv_id", "turn", captures.snapshot(*place).alias("s"), captures.selection(*place[4:]).alias("t"))
    return rows.select("conv_id", "turn", "s.app", "s.bundle", "s.title", F.md5("s.selected").alias("selected"), F.md5("t").alias("trimmed"))


_CARET = f"""CASE WHEN NOT secure AND turn % 6 > 0 AND trim(right(left(text, (turn % 6 * 70)::INT), 240), E' \\n\\t\\r') <> '' THEN right(left(text, (turn % 6 * 70)::INT), 240) END"""


def _contexts(rows):
    return rows.withColumn("context", captures.context(*[F.col(c) for c in _PLACE], F.col("text"), (F.col("turn") % 6 * 70).cast("int"), F.col("secure")))


@query(f"""SELECT conv_id, turn, CASE WHEN front THEN app END AS app, CASE WHEN front THEN {_TITLE} END AS title, md5(CASE WHEN front THEN {_TRIMMED} END) AS selected, md5(CASE WHEN front THEN {_CARET} END) AS before,
  CASE WHEN front THEN {_SENTENCE} ELSE 'You are dictating in an unrecognized context.' END AS activity FROM ({_GIVEN})""")
def captured_contexts(spark, d):
    rows = _contexts(_given(spark, d)).select("conv_id", "turn", "context.*")
    return rows.select("conv_id", "turn", "app", "title", F.md5("selected").alias("selected"), F.md5("before").alias("before"), "activity")


@query("""WITH r AS (SELECT conv_id, turn // 2 AS line, turn % 3 / 4.0 AS confidence, text FROM conversations WHERE turn % 7 < 6),
  b AS (SELECT conv_id, line, first(text ORDER BY confidence DESC, text) AS text FROM r GROUP BY 1, 2), j AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY line) AS t FROM b GROUP BY 1)
SELECT conv_id, md5(CASE WHEN length(t) > 500 THEN left(t, 200) || chr(10) || '[…]' || chr(10) || right(t, 296) ELSE t END) AS seen FROM j""")
def recognized_lines(spark, d):
    """Two turns of a chat are readings of one line."""
    turn = F.col("turn")
    readings = table(spark, d, "conversations").select("conv_id", F.floor(turn / 2).alias("line"), (turn % 3 / 4).alias("confidence"), F.when(turn % 7 < 6, F.col("text")).alias("text"))
    return captures.recognized(readings, "conv_id", 500).select("conv_id", F.md5("text").alias("seen"))


_NAME = """upper(concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])) || '.wav'"""


@query(f"""SELECT page_id, {_NAME} AS name, length(html) AS chars FROM (SELECT *, md5('{{"p0":"' || page_id || '","p1":"' || lang || '"}}') AS h FROM (SELECT page_id, html, 'x' || page_id % 3 AS lang FROM pages)) WHERE page_id % 11 > 0 AND page_id % 5 > 0""")
def recordings_kept(spark, d):
    """Pages stand for recordings: saved by name, some without content, some deleted by name and some names deleted twice."""
    pages = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 11 > 0, F.col("html")).alias("content"), F.concat(F.lit("x"), (F.col("page_id") % 3).cast("string")).alias("lang"))
    store = captures.saved(pages, ["page_id", "lang"]).where("name is not null")
    gone = store.where("page_id % 5 = 0").select("name")
    return captures.without(store, gone.unionAll(gone)).select("page_id", "name", F.length("content").alias("chars"))


MOST = 60
_RUN = f"""SELECT conv_id * 1000 + turn AS id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (conv_id * 37 % 101 + turn) AS ts, CASE turn % 4 WHEN 0 THEN 'dictation' WHEN 1 THEN 'command:manual' WHEN 2 THEN 'command:automatic' END AS intent,
  {_RAW} AS selected, text AS raw, CASE WHEN turn % 3 > 0 THEN 'So, ' || text END AS clean, 'Clean ' || turn AS prompt, 'system' AS system_prompt, 'done' AS status, 'debug ' || role AS debug, 'Ada' AS vocabulary,
  CASE WHEN turn % 2 = 0 THEN conv_id || '-' || turn || '.wav' END AS audio, conv_id, turn, text, front, app, bundle, title, focused, whole, secure FROM turns"""
_ROWS = f"""SELECT id, ts, coalesce(intent, 'dictation') AS intent, CASE WHEN intent LIKE 'command:%' THEN selected END AS selected, CASE WHEN front THEN {_TRIMMED} END AS captured, raw, coalesce(clean, '') AS clean, prompt, system_prompt,
  CASE WHEN front THEN {_SENTENCE} ELSE 'You are dictating in an unrecognized context.' END AS context_summary, NULL::VARCHAR AS context_system_prompt, NULL::VARCHAR AS context_prompt, NULL::VARCHAR AS picture_url, 'Not captured (local-only)' AS picture_status,
  status, debug, vocabulary, audio, CASE WHEN front THEN app END AS app, CASE WHEN front THEN bundle END AS bundle, CASE WHEN front THEN {_TITLE} END AS title FROM r"""
_HELD = f"WITH turns AS ({_GIVEN}), r AS ({_RUN}), h AS ({_ROWS})"


def _recorded(spark, d):
    """The history after the runs of every chat came to those of the even ones, and the names that went."""
    _given(spark, d).createOrReplaceTempView("_captured_runs")
    runs = _contexts(spark.sql(_RUN.replace("FROM turns", "FROM _captured_runs")))
    return captures.record(captures.recorded(runs.where("conv_id % 2 = 0")), runs.where("conv_id % 2 = 1"), MOST)


@query(f"{_HELD} SELECT * FROM h ORDER BY ts DESC, id LIMIT {MOST}")
def history_rows(spark, d):
    """The newest runs, all 21 columns."""
    return _recorded(spark, d)[0]


@query(f"{_HELD} SELECT audio, ts FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, id) AS place FROM h) WHERE place > {MOST} AND audio IS NOT NULL")
def history_rows_evicted(spark, d):
    return _recorded(spark, d)[1]


_F = lambda v: f"{v}::FLOAT"
_TO = lambda a, b, t: f"({a} + ({b} - {a}) * {t}::FLOAT)"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, value / 1000 AS rms, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
  n AS (SELECT *, (log10(greatest(rms, 1e-5)) * 20)::FLOAT AS db, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS i FROM e),
  r AS (SELECT user_id, run, 0::BIGINT AS i, NULL::BIGINT AS event_id, {_F(-55)} AS low, {_F(-37)} AS high, {_F(0)} AS shown FROM n WHERE i = 1
    UNION ALL SELECT user_id, run, i, event_id, low, high, (CASE WHEN g > shown THEN {_TO("shown", "g", 0.45)} ELSE {_TO("shown", "g", 0.12)} END)::FLOAT FROM (
      SELECT *, (CASE WHEN raw < {_F(0.06)} AND db <= low + {_F(3)} THEN {_F(0)} WHEN db >= low + {_F(3)} THEN greatest(raw, {_F(0.12)}) ELSE raw END)::FLOAT AS g FROM (
      SELECT *, least(greatest((db - low) / greatest(high + {_F(8)} - low, {_F(26)}), {_F(0)}), {_F(1)})::FLOAT AS raw FROM (
      SELECT user_id, run, i, event_id, db, shown, low, greatest(CASE WHEN db >= high THEN {_TO("high", "db", 0.55)} ELSE {_TO("high", f"greatest(db, low + {_F(18)})", 0.04)} END, low + {_F(18)})::FLOAT AS high FROM (
      SELECT user_id, run, i, event_id, db, high, shown, (CASE WHEN quiet <= low THEN {_TO("low", "quiet", 0.12)} WHEN quiet <= low + {_F(4)} THEN {_TO("low", "quiet", 0.02)} ELSE low END)::FLOAT AS low FROM (
      SELECT n.user_id, n.run, n.i, n.event_id, db, low, high, shown, least(db, high - {_F(18)}) AS quiet FROM r JOIN n ON n.user_id = r.user_id AND n.run = r.run AND n.i = r.i + 1))))))
SELECT event_id, round(shown::DOUBLE, 4) AS shown FROM r WHERE i > 0""")
def level_resets(spark, d):
    """A meter a user over all events; an error takes it back to its start."""
    samples = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") / 1000).alias("rms"), (F.col("event_type") == "error").alias("reset"))
    return machines.levels(samples, "user_id", ["ts", "event_id"]).select("event_id", F.round(F.col("shown").cast("double"), 4).alias("shown"))
