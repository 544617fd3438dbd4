"""Queries on vocabularies: edits, imports, learning, searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import vocabulary
from ..sources.documents import table
from .catalogue import query

# Entries of a vocabulary from the documents' numbers: keys repeat, and half of them carry an accent.
_ENT = """SELECT doc_id AS id, doc_id AS ordinal, concat(CASE WHEN doc_id % 2 = 0 THEN 'W' ELSE 'w' END, CAST(doc_id % 700 AS VARCHAR(9)), CASE WHEN doc_id % 3 = 0 THEN ' É' ELSE ' e' END) AS term,
  CASE WHEN doc_id % 4 = 0 THEN 'manual' ELSE 'learned' END AS source, CASE doc_id % 5 WHEN 0 THEN 'suggested' WHEN 1 THEN 'rejected' ELSE 'active' END AS status,
  doc_id % 6 <> 0 AS enabled, doc_id % 7 = 0 AS starred, doc_id % 11 AS observations, doc_id % 13 AS usage_count, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS updated_at FROM documents"""
_ENT_SQL = _ENT.replace("TIMESTAMP_NTZ", "TIMESTAMP")
_KEY = "lower(strip_accents({0}))"
_AT = "2024-02-02 00:00:00"


def _entries(spark, d, where="true"):
    table(spark, d, "documents").createOrReplaceTempView("_entry_documents")
    return spark.sql(_ENT.replace("FROM documents", "FROM _entry_documents")).where(where)


@query(f"""SELECT id, CASE id % 10 WHEN 4 THEN 'active' WHEN 5 THEN 'rejected' ELSE status END AS status, CASE id % 10 WHEN 2 THEN false WHEN 4 THEN true WHEN 5 THEN false ELSE enabled END AS enabled,
  CASE WHEN id % 10 = 3 THEN true ELSE starred END AS starred, id % 10 IN (2, 3, 4, 5) AS changed FROM ({_ENT_SQL}) WHERE id % 10 <> 1""")
def vocabulary_edits(spark, d):
    """Remove, disable, star, accept and dismiss by id."""
    e, at = _entries(spark, d), F.lit(_AT).cast("timestamp_ntz")
    ids = lambda k: e.where(F.col("id") % 10 == k).select("id")
    out = vocabulary.set_starred(vocabulary.set_enabled(vocabulary.remove(e, ids(1)), ids(2), False, at), ids(3), True, at)
    out = vocabulary.dismiss(vocabulary.accept(out, ids(4), at), ids(5), at)
    return out.select("id", "status", "enabled", "starred", (F.col("updated_at") == at).alias("changed"))


_ADD = "SELECT page_id AS ordinal, CASE page_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN concat(' New  term ', CAST(page_id % 30 AS VARCHAR(9))) ELSE concat('W', CAST(page_id % 900 AS VARCHAR(9)), '  É') END AS term FROM pages"
_ADDED = f"""a AS (SELECT ordinal, trim(regexp_replace(term, '\\s+', ' ', 'g')) AS term FROM ({_ADD})), k AS (SELECT *, {_KEY.format("term")} AS key FROM a),
  e AS (SELECT {_KEY.format("term")} AS key, min(ordinal) AS entry, arg_min(status, ordinal) AS status FROM ({_ENT_SQL}) GROUP BY 1),
  o AS (SELECT k.ordinal, k.term, k.key, e.entry, CASE WHEN k.term = '' THEN 'blank' WHEN e.status = 'active' OR row_number() OVER (PARTITION BY k.key ORDER BY k.ordinal) > 1 THEN 'duplicate' WHEN entry IS NOT NULL THEN 'promoted' ELSE 'added' END AS outcome FROM k LEFT JOIN e ON k.key = e.key)"""


def _additions(spark, d):
    table(spark, d, "pages").createOrReplaceTempView("_added_pages")
    return spark.sql(_ADD.replace("FROM pages", "FROM _added_pages"))


@query(f"WITH {_ADDED} SELECT ordinal, key, outcome FROM o")
def manual_additions(spark, d):
    return vocabulary.add_manual(_entries(spark, d), _additions(spark, d)).select("ordinal", "key", "outcome")


@query(f"""WITH {_ADDED}, x AS (SELECT n.ordinal, n.term, CASE WHEN p.entry IS NULL THEN n.source ELSE 'manual' END AS source, CASE WHEN p.entry IS NULL THEN n.status ELSE 'active' END AS status, CASE WHEN p.entry IS NULL THEN enabled ELSE true END AS enabled
    FROM ({_ENT_SQL}) n LEFT JOIN (SELECT entry FROM o WHERE outcome = 'promoted') p ON p.entry = n.ordinal)
  SELECT * FROM x UNION ALL SELECT (SELECT max(doc_id) FROM documents) + 1 + ordinal, term, 'manual', 'active', true FROM o WHERE outcome = 'added'""")
def manual_upsert(spark, d):
    e = _entries(spark, d)
    return vocabulary.with_manual(e, vocabulary.add_manual(e, _additions(spark, d)), F.lit(_AT).cast("timestamp_ntz")).select("ordinal", "term", "source", "status", "enabled")


@query(f"""WITH p AS (SELECT (conv_id * 1000 + turn) * 1000000 + i - 1 AS n, trim(x) AS term FROM (SELECT conv_id, turn, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT conv_id, turn, string_split_regex(replace(text, ' ', ','), '[\\n,;]') AS s FROM conversations)) WHERE trim(x) <> '')
  SELECT {_KEY.format("term")} AS key, arg_min(term, n) AS term FROM p GROUP BY 1""")
def legacy_terms(spark, d):
    texts = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.replace("text", F.lit(" "), F.lit(",")).alias("text"))
    return vocabulary.migrated_terms(_entries(spark, d), texts)


# The rows of an import taken one after another, by a reduction in SQL; the operator aggregates by key instead.
_ROW = "{{'ordinal': ordinal, 'term': term, 'source': source, 'status': status, 'enabled': enabled, 'starred': starred, 'observations': observations, 'usage_count': usage_count, 'updated': 0::BIGINT}}"
_STEP = """{'ordinal': a.ordinal, 'term': a.term, 'source': CASE WHEN b.source = 'manual' THEN 'manual' ELSE a.source END, 'status': CASE WHEN b.status = 'active' THEN 'active' ELSE a.status END,
  'enabled': CASE WHEN b.status = 'active' AND a.status <> 'active' THEN b.enabled ELSE a.enabled END, 'starred': a.starred OR b.starred, 'observations': greatest(a.observations, b.observations), 'usage_count': greatest(a.usage_count, b.usage_count),
  'updated': a.updated + CASE WHEN (b.status = 'active' AND a.status <> 'active') OR (b.source = 'manual' AND a.source <> 'manual') OR (b.starred AND NOT a.starred) THEN 1 ELSE 0 END}"""
_MERGED = f"""l AS (SELECT {_KEY.format("term")} AS key, arg_min({_ROW.format()}, ordinal) AS x FROM ({_ENT_SQL}) WHERE id % 9 = 0 GROUP BY 1),
  i AS (SELECT {_KEY.format("term")} AS key, list({_ROW.format()} ORDER BY ordinal) AS xs, arg_min(status, ordinal) AS first FROM ({_ENT_SQL}) WHERE id % 9 <> 0 AND id % 1400 < 1000 GROUP BY 1),
  m AS (SELECT coalesce(l.key, i.key) AS key, l.key IS NULL AS fresh, i.key IS NULL AS alone, first, list_reduce(CASE WHEN l.key IS NULL THEN xs WHEN i.key IS NULL THEN [x] ELSE list_prepend(x, xs) END, lambda a, b: {_STEP}) AS r FROM l FULL JOIN i ON l.key = i.key)"""


def _merge(spark, d):
    return vocabulary.import_merge(_entries(spark, d, "id % 9 = 0"), _entries(spark, d, "id % 9 <> 0 and id % 1400 < 1000"))


@query(f"""WITH {_MERGED} SELECT key, r.term AS term, r.source AS source, r.status AS status, r.enabled AS enabled, r.starred AS starred, r.observations AS observations, r.usage_count AS usage_count,
  CASE WHEN fresh THEN 'added' WHEN alone THEN 'kept' ELSE 'matched' END AS change, r.updated AS updated FROM m""")
def import_merge(spark, d):
    return _merge(spark, d).drop("counted")


@query(f"WITH {_MERGED} SELECT count(*) FILTER (fresh AND first <> 'rejected') AS added, sum(r.updated)::BIGINT AS updated FROM m")
def import_counters(spark, d):
    return vocabulary.import_counters(_merge(spark, d))


_KNOWN = "VALUES ('click0', 'Click0', 'manual', 'active', 1, 0), ('view3', 'View3', 'learned', 'rejected', 2, 1), ('error1', 'Error1', 'learned', 'suggested', 2, 2), ('unseen', 'Unseen', 'learned', 'suggested', 1, 3)"
_CALLS = "SELECT user_id AS call, event_id AS pos, concat(event_type, CAST(event_id % 37 AS VARCHAR(9))) AS key, upper(concat(event_type, CAST(event_id % 37 AS VARCHAR(9)))) AS term FROM events"


# One sight after another, by a reduction over maps of learned keys and their sights.
@query(f"""WITH e AS (SELECT * FROM ({_KNOWN}) t(key, term, source, status, observations, ordinal)), c AS (SELECT key, call, min(pos) AS pos FROM ({_CALLS}) GROUP BY 1, 2),
  m AS (SELECT list_reduce(list_prepend((SELECT map(list(key), list(observations::BIGINT)) FROM e WHERE source = 'learned' AND status <> 'rejected'), (SELECT list(map([key], [1::BIGINT]) ORDER BY call, pos, key) FROM c)),
    lambda a, b: CASE WHEN list_contains(['click0', 'view3'], map_keys(b)[1]) THEN a
      WHEN map_contains(a, map_keys(b)[1]) OR (cardinality(a) < 45 AND len(list_filter(map_values(a), lambda v: v < 3)) < 12) THEN map_concat(a, map([map_keys(b)[1]], [coalesce(a[map_keys(b)[1]], 0) + 1])) ELSE a END) AS m),
  l AS (SELECT unnest(map_keys(m)) AS key, unnest(map_values(m)) AS n FROM m)
  SELECT key, coalesce(term, upper(key)) AS term, coalesce(source, 'learned') AS source, CASE WHEN source = 'manual' OR status = 'rejected' THEN status WHEN n >= 3 THEN 'active' ELSE 'suggested' END AS status, coalesce(n, observations)::BIGINT AS observations FROM l FULL JOIN e USING (key)""")
def learn_capped(spark, d):
    """Learning beside manual and rejected entries, with places for 43 more learned and, at first, 10 more suggested ones; promotions free some."""
    e = spark.sql(f"SELECT key, term, source, status, CAST(observations AS BIGINT) AS observations, ordinal FROM ({_KNOWN}) t(key, term, source, status, observations, ordinal)")
    table(spark, d, "events").createOrReplaceTempView("_call_events")
    calls = spark.sql(_CALLS.replace("FROM events", "FROM _call_events"))
    return vocabulary.learn(e, calls, 3, 45, 12).select("key", "term", "source", "status", "observations")


@query(f"SELECT ordinal, term FROM ({_ENT_SQL}) WHERE status = 'suggested'")
def vocabulary_suggestions(spark, d):
    return vocabulary.suggestions(_entries(spark, d)).select("ordinal", "term")


@query(f"SELECT term, starred, row_number() OVER (ORDER BY starred DESC, ordinal)::INT AS place FROM ({_ENT_SQL}) WHERE status = 'active' AND contains(lower(term), 'w1') ORDER BY starred DESC, ordinal LIMIT 25")
def vocabulary_search(spark, d):
    """The first 25 saved entries that a search finds."""
    found = vocabulary.saved(_entries(spark, d), " W1").limit(25)
    return found.select("term", "starred", F.row_number().over(Window.orderBy(F.desc("starred"), "ordinal")).alias("place"))


@query(f"SELECT count(*) AS n FROM ({_ENT_SQL}) WHERE status <> 'rejected'")
def vocabulary_exported(spark, d):
    return vocabulary.exported(_entries(spark, d))


@query(f"SELECT id FROM ({_ENT_SQL}) WHERE status <> 'rejected' UNION ALL (SELECT id FROM ({_ENT_SQL}) WHERE status = 'rejected' ORDER BY id LIMIT 40)")
def vocabulary_purged(spark, d):
    return vocabulary.purged(_entries(spark, d), 40).select("id")


@query(f"SELECT term, usage_count, row_number() OVER (ORDER BY starred DESC, usage_count DESC, lower(term), term)::INT AS rank FROM ({_ENT_SQL}) WHERE status = 'active' AND enabled ORDER BY starred DESC, usage_count DESC, lower(term), term LIMIT 40")
def prompt_ranking(spark, d):
    """The terms that a prompt takes."""
    return vocabulary.ranking(_entries(spark, d)).select("term", "usage_count", "rank")


_ACCENTS = ["Zoé", "UBER alles", "naïve", "Ångström", "sao"]
_ACCENTED = "text || CASE doc_id % 4 WHEN 0 THEN ' zoe über  alles' WHEN 1 THEN ' (Über Alles) São' WHEN 2 THEN ' angstrom-NAÏVE' ELSE ' zoés naıve' END"


@query(rf"""SELECT term, count(given) AS uses FROM (VALUES {", ".join(f"('{t}')" for t in _ACCENTS)}) t(term) LEFT JOIN (SELECT {_ACCENTED} AS given FROM documents)
  ON regexp_matches(lower(strip_accents(given)), '(^|[^\p{{L}}\p{{N}}])' || regexp_escape(lower(strip_accents(term))) || '($|[^\p{{L}}\p{{N}}])') GROUP BY term""")
def usage_accents(spark, d):
    texts = table(spark, d, "documents").select("doc_id", F.expr(_ACCENTED).alias("text"))
    return vocabulary.usage(texts, spark.createDataFrame([(t,) for t in _ACCENTS], "term string"), "doc_id")
