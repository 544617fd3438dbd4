"""Queries on the run history: appends, retention, edits, lookups; and on the languages of recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import locales, rules
from ..operators import history
from ..sources.documents import table
from ..streaming import sessions
from .catalogue import query

_H = """SELECT event_id AS id, ts, user_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'command:manual' WHEN 'error' THEN 'other' ELSE 'dictation' END AS intent,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '  ' WHEN event_id % 4 = 2 THEN event_type ELSE concat(' ', event_type, ' x') END AS clean, event_type AS raw, 'done' AS status,
  CASE WHEN event_id % 3 = 0 THEN concat('f', CAST(event_id AS VARCHAR(20)), '.wav') END AS audio FROM events"""


def _history(spark, d):
    table(spark, d, "events").createOrReplaceTempView("_history_events")
    return spark.sql(_H.replace("FROM events", "FROM _history_events"))


@query(f"SELECT id, ts, raw FROM ({_H})")
def history_scan(spark, d):
    return history.scan(_history(spark, d)).select("id", "ts", "raw")


_NEW = "SELECT id + 10000000 AS id, ts + INTERVAL 1 HOUR AS ts, raw, audio FROM h WHERE id % 50 = 0"
_ALL = f"h AS ({_H}), n AS ({_NEW}), u AS (SELECT id, ts, user_id, audio, status FROM h UNION ALL SELECT id, ts, NULL, audio, NULL FROM n), r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id) AS place FROM u)"


def _new(h):
    return h.where("id % 50 = 0").select((F.col("id") + 10000000).alias("id"), (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), "raw", "audio")


@query(f"WITH {_ALL} SELECT id, ts, user_id, status FROM r WHERE place <= 300")
def history_append(spark, d):
    h = _history(spark, d)
    return history.append_returning(h, _new(h), 300, "audio")[0].select("id", "ts", "user_id", "status")


@query(f"WITH {_ALL} SELECT audio, ts FROM r WHERE place > 300 AND audio IS NOT NULL")
def history_evicted(spark, d):
    h = _history(spark, d)
    return history.append_returning(h, _new(h), 300, "audio")[1]


@query(f"WITH {_ALL} SELECT id, ts, user_id, audio, status FROM u")
def history_insert(spark, d):
    h = _history(spark, d)
    return history.insert(h, _new(h)).select("id", "ts", "user_id", "audio", "status")


@query(f"SELECT audio, ts FROM ({_H}) WHERE audio IS NOT NULL")
def history_clear(spark, d):
    kept, names = history.clear(_history(spark, d), "audio")
    return names.join(kept.select("audio"), "audio", "left_anti")


@query(f"SELECT id, CASE WHEN intent IN ('dictation', 'command:manual') THEN intent ELSE 'dictation' END AS intent, coalesce(clean, '') AS clean FROM ({_H})")
def history_decode(spark, d):
    return history.decode(_history(spark, d), {"clean": F.lit("")}).select("id", "intent", "clean")


@query(f"""SELECT id, coalesce(nullif(trim(clean), ''), trim(raw)) AS shown, CASE WHEN trim(clean) <> '' THEN clean ELSE raw END AS whole FROM ({_H}) ORDER BY ts DESC, id LIMIT 10""")
def history_recent(spark, d):
    h = history.recent(_history(spark, d), "clean", "raw")
    return h.select("id", rules.display_text(F.col("clean"), F.col("raw")).alias("shown"), rules.full_text(F.col("clean"), F.col("raw")).alias("whole"))


@query(f"""WITH h AS ({_H}), p AS (SELECT p.id AS probe_id, arg_max(h.id, (h.ts, h.id)) AS id FROM h p JOIN h ON p.user_id = h.user_id AND trim(h.clean) <> '' AND p.ts >= h.ts AND p.ts - h.ts <= INTERVAL 1 HOUR GROUP BY p.id)
  SELECT probe_id, h.id, trim(raw) <> trim(clean) AS possible FROM p JOIN h ON h.id = p.id""")
def can_revert(spark, d):
    """Of each moment whether the last dictation within the hour could be taken back to its raw text."""
    h = _history(spark, d)
    found = history.recent_item(h.select(F.col("id").alias("probe_id"), F.col("ts").alias("at"), "user_id"), h.where("trim(clean) != ''").select("id", "ts", "user_id"), ["user_id"], None, 3600)
    return found.join(h.select("id", "raw", "clean"), "id").select("probe_id", "id", rules.revert_target(F.col("raw"), F.col("clean")).isNotNull().alias("possible"))


@query(f"WITH h AS ({_H}), m AS (SELECT user_id, max(ts) AS mark FROM h WHERE raw = 'error' AND trim(clean) <> '' GROUP BY 1) SELECT id FROM h LEFT JOIN m USING (user_id) WHERE mark IS NULL OR ts > mark")
def history_invalidated(spark, d):
    h = _history(spark, d)
    marks = history.scratched(h.where("raw = 'error'").select("user_id", F.col("clean").alias("previous"), F.col("ts").alias("at"))).where("mark is not null")
    return history.invalidated(h, marks.select("user_id", F.col("mark").alias("ts")), ["user_id"]).select("id")


@query(f"SELECT id, CASE WHEN trim(coalesce(clean, '')) <> '' THEN 'Scratched' ELSE 'Nothing to scratch' END AS status FROM ({_H}) WHERE raw = 'error'")
def scratch_status(spark, d):
    return history.scratched(_history(spark, d).where("raw = 'error'").select("id", F.col("clean").alias("previous"), F.col("ts").alias("at"))).select("id", "status")


_MAY = "id % 2 = 1 AND trim(clean) <> '' AND trim(raw) <> trim(clean)"


@query(f"SELECT id, CASE WHEN {_MAY} THEN raw ELSE clean END AS clean, CASE WHEN {_MAY} THEN status || '; reverted to raw' ELSE status END AS status FROM ({_H})")
def history_reverted(spark, d):
    h = _history(spark, d)
    return history.reverted(h, h.where("id % 2 = 1"), "raw", "clean", "status").select("id", "clean", "status")


@query(f"SELECT id, CASE WHEN id % 6 = 0 THEN 'again' ELSE clean END AS clean, CASE WHEN id % 6 = 0 THEN 'retried' WHEN id % 6 = 3 THEN 'no answer' ELSE status END AS status FROM ({_H})")
def history_retried(spark, d):
    h = _history(spark, d)
    results = h.where("id % 3 = 0").select("id", F.lit("again").alias("clean"), F.when(F.col("id") % 6 == 3, "no answer").alias("failure"))
    return history.retried(h, results.unionAll(results), ["clean"], "status").select("id", "clean", "status")


@query(f"SELECT id, coalesce(nullif(trim(clean), ''), raw) AS text, greatest(30.0, id % 90 + 30) AS budget FROM ({_H})")
def transcript_source(spark, d):
    return _history(spark, d).select("id", sessions.transcript(F.col("clean"), F.col("raw")).alias("text"), sessions.file_budget((F.col("id") % 90).cast("double")).alias("budget"))


@query(f"""SELECT id, CASE WHEN id % 5 = 0 THEN 'dictation' WHEN id % 5 IN (1, 2) THEN CASE WHEN s <> '' THEN 'command:automatic' ELSE 'dictation' END WHEN id % 2 = 0 THEN 'dictation' WHEN s <> '' THEN 'command:manual' END AS intent
  FROM (SELECT id, trim(coalesce(clean, '')) AS s FROM ({_H}))""")
def session_intents(spark, d):
    i = F.col("id")
    return _history(spark, d).select("id", rules.session_intent(F.when(i % 5 < 3, "automatic").otherwise("manual"), i % 5 != 0, F.col("clean"), i % 2 == 1).alias("intent"))


_TAGS = ["fr-FR", "en-GB", "de-DE", "en-US", "pt-BR", "en-IN", "fr-CA"]
_ASK = "CASE event_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'Auto' WHEN 2 THEN ' fr-CA ' WHEN 3 THEN 'fr-BE' WHEN 4 THEN 'Hinglish' WHEN 5 THEN 'xx' WHEN 6 THEN 'en-NZ' WHEN 7 THEN NULL ELSE 'pt' END"
_SYS = "CASE event_id % 4 WHEN 0 THEN 'de-AT' WHEN 1 THEN 'ja-JP' WHEN 2 THEN 'en-US' ELSE 'pt-PT' END"
_FALL = "CASE event_id % 4 WHEN 0 THEN 'de-DE' WHEN 1 THEN 'en-US' WHEN 2 THEN 'en-US' ELSE 'pt-BR' END"
_GOT = f"CASE event_id % 9 WHEN 0 THEN {_FALL} WHEN 1 THEN {_FALL} WHEN 2 THEN 'fr-CA' WHEN 3 THEN 'fr-FR' WHEN 4 THEN 'en-IN' WHEN 6 THEN 'en-GB' WHEN 8 THEN 'pt-BR' END"


@query(f"SELECT event_id, {_GOT} AS tag, coalesce(nullif(trim({_ASK}), ''), 'auto') AS preference, CASE WHEN event_id % 9 = 2 THEN ' fr-CA ' ELSE coalesce({_GOT}, 'auto') END AS stored FROM events")
def locales_resolved(spark, d):
    supported = F.array(*[F.lit(t) for t in _TAGS])
    tag = locales.resolve(F.expr(_ASK), F.expr(_SYS), supported)
    listed = F.array(F.lit(" fr-CA "), F.lit("auto"))
    return table(spark, d, "events").select("event_id", tag.alias("tag"), locales.preference(F.expr(_ASK)).alias("preference"), locales.migrated(F.expr(_ASK), listed, tag).alias("stored"))


@query(f"SELECT event_id, tag, tag IS NOT NULL AND tag IN ('en-US', 'fr-FR') AS installed FROM (SELECT event_id, {_GOT} AS tag FROM events)")
def locales_installed(spark, d):
    rows = table(spark, d, "events").select("event_id", locales.resolve(F.expr(_ASK), F.expr(_SYS), F.array(*[F.lit(t) for t in _TAGS])).alias("tag"))
    return locales.installed(rows, spark.createDataFrame([("en-US",), ("fr-FR",), ("en-US",)], "tag string")).select("event_id", "tag", "installed")


@query("SELECT 0 AS place, 'auto' AS code, 'Auto (System Language)' AS name UNION ALL SELECT row_number() OVER (ORDER BY lower(name), code)::INT, code, name FROM (SELECT DISTINCT lang AS code, upper(left(lang, 1)) || substr(lang, 2) || ' language' AS name FROM documents)")
def locale_options(spark, d):
    return locales.options(table(spark, d, "documents").select(F.col("lang").alias("code"), F.concat(F.upper(F.left("lang", F.lit(1))), F.substr("lang", F.lit(2)), F.lit(" language")).alias("name")))


# Each chat has its own settings: of email, of documents, or none.
@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 1 AND conv_id % 3 < 2 THEN CASE conv_id % 4 WHEN 0 THEN 'casual' WHEN 1 THEN 'formal' ELSE 'balanced' END WHEN turn % 4 = 2 AND conv_id % 3 = 1 THEN 'formal' ELSE 'balanced' END AS formality FROM conversations""")
def formalities(spark, d):
    chat = F.col("conv_id")
    context = F.element_at(F.array(*[F.lit(x) for x in ("codeOrTerminal", "email", "document", "neutral")]), (F.col("turn") % 4 + 1).cast("int"))
    email = F.when(chat % 4 == 0, "casual").when(chat % 4 == 1, "formal").when(chat % 4 == 2, "loud")
    config = F.when(chat % 3 == 0, F.create_map(F.lit("email"), email)).when(chat % 3 == 1, F.create_map(F.lit("email"), email, F.lit("document"), F.lit("formal"), F.lit("codeOrTerminal"), F.lit("formal")))
    return table(spark, d, "conversations").select("conv_id", "turn", rules.formality(config, context).alias("formality"))
