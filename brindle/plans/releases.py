"""Queries on releases: candidates, order, notes, decisions, sources and dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, versions
from ..sources.documents import read_releases, table
from .catalogue import query

# Releases from the events' numbers: a user is a project; some tags and dates can't be read.
_REL = """SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN 'latest' ELSE concat(CASE WHEN event_id % 2 = 0 THEN 'v' ELSE '' END, CAST(event_id % 3 AS VARCHAR(9)), '.', CAST(event_id % 12 AS VARCHAR(9)), '.', CAST(event_id % 7 AS VARCHAR(9)),
  CASE event_id % 4 WHEN 0 THEN '-rc.2' WHEN 1 THEN '-rc.10' ELSE '' END) END AS tag,
  CASE event_id % 9 WHEN 0 THEN 'soon' WHEN 1 THEN concat('2024-01-', CAST(10 + event_id % 19 AS VARCHAR(9)), 'T10:00:00.500Z') ELSE concat('2024-02-', CAST(10 + event_id % 19 AS VARCHAR(9)), 'T08:30:00Z') END AS published_at,
  concat('notes ', event_type) AS body FROM events"""
_FINE = f"""SELECT *, event_id % 3 AS major, event_id % 12 AS minor, event_id % 7 AS patch, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 10 ELSE 1000000 END AS pre,
  CASE WHEN event_id % 9 = 1 THEN make_timestamp(2024, 1, 10 + event_id % 19, 10, 0, 0.5) ELSE make_timestamp(2024, 2, 10 + event_id % 19, 8, 30, 0) END AS published FROM ({_REL}) WHERE event_id % 11 <> 0 AND event_id % 9 <> 0"""


def _releases(spark, d):
    table(spark, d, "events").createOrReplaceTempView("_release_events")
    return spark.sql(_REL.replace("FROM events", "FROM _release_events"))


@query(f"SELECT event_id, tag, strftime(published, '%Y-%m-%d %H:%M:%S.%g') AS published FROM ({_FINE})")
def release_candidates(spark, d):
    return versions.candidates(_releases(spark, d)).select("event_id", "tag", F.date_format("published", "yyyy-MM-dd HH:mm:ss.SSS").alias("published"))


@query(f"SELECT user_id, tag, body FROM ({_FINE}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY major DESC, minor DESC, patch DESC, pre DESC, published DESC, tag DESC, body DESC) = 1")
def release_latest(spark, d):
    """Of each project the highest version; of equal ones the last published."""
    return versions.latest(_releases(spark, d), ["user_id"]).select("user_id", "tag", "body")


@query(f"""WITH r AS ({_FINE.replace(" AND event_id % 9 <> 0", "")}), n AS (SELECT user_id, string_agg(body, chr(10) || chr(10) ORDER BY major DESC, minor DESC, patch DESC, pre DESC, tag DESC, body DESC) AS notes FROM r WHERE (major, minor, patch, pre) > (2, 9, 5, 2) GROUP BY 1),
  l AS (SELECT user_id, tag, body FROM ({_FINE}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY major DESC, minor DESC, patch DESC, pre DESC, published DESC, tag DESC, body DESC) = 1)
  SELECT user_id, tag, coalesce(notes, body) AS body FROM l LEFT JOIN n USING (user_id)""")
def release_with_notes(spark, d):
    """The latest release of each project with the notes of all that are newer than a version."""
    r = _releases(spark, d)
    return versions.with_notes(versions.latest(r, ["user_id"]).select("user_id", "tag", "body"), r, versions.semver(F.lit("v2.9.5-rc.2")), ["user_id"])


@query(f"""SELECT event_id, regexp_replace(tag, '^[vV]', '') AS shown, strftime(published, '%b ') || day(published)::VARCHAR || strftime(published, ', %Y') AS day FROM ({_FINE})""")
def release_dates(spark, d):
    r = versions.candidates(_releases(spark, d))
    return r.select("event_id", versions.display(F.concat(F.lit(" "), "tag", F.lit(" "))).alias("shown"), versions.display_date(F.col("published")).alias("day"))


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN strftime(to_timestamp(event_id * 1000) AT TIME ZONE 'UTC', '%-I:%M %p') END AS reset, greatest(ceil(event_id / 100.0), 1)::BIGINT AS page FROM events")
def rate_limits(spark, d):
    header = F.when(F.col("event_id") % 5 > 0, (F.col("event_id") * 1000).cast("string")).otherwise("soon")
    return table(spark, d, "events").select("event_id", versions.reset_time(header).alias("reset"), versions.last_page(F.col("event_id")).cast("long").alias("page"))


@query("""SELECT event_id, event_id % 2 = 0 AND (event_id % 3 = 0 OR TIMESTAMP '2024-02-01' - ts > INTERVAL 7 DAY) AS checks, event_id % 3 = 0 OR epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) >= 300000000 AS stale,
  event_id % 5 > 0 AND event_id % 7 > 0 AND (event_id % 3 > 0 OR TIMESTAMP '2024-01-20' - ts > INTERVAL 24 HOUR) AS reminds FROM events""")
def update_checks(spark, d):
    i, at = F.col("event_id"), lambda x: F.lit(x).cast("timestamp_ntz")
    never = F.when(i % 3 != 0, F.col("ts"))
    tag, none = F.lit("v1"), F.lit(None).cast("string")
    reminds = versions.should_remind(i % 5 > 0, F.lit(True), tag, F.when(i % 7 == 0, tag), F.when(i % 3 == 0, tag).otherwise(none), F.col("ts"), at("2024-01-20"))
    return table(spark, d, "events").select("event_id", versions.should_check(i % 2 == 0, never, at("2024-02-01")).alias("checks"), versions.is_stale(never, at("2024-01-20")).alias("stale"), reminds.alias("reminds"))


@query("SELECT event_id, (row_number() OVER (ORDER BY ts DESC, event_id DESC))::INT AS place FROM events ORDER BY ts DESC, event_id DESC LIMIT 15")
def last_fifteen(spark, d):
    """The last rows of a listing, newest first: a top-k, whose window is short."""
    by = [F.desc("ts"), F.desc("event_id")]
    return table(spark, d, "events").orderBy(*by).limit(15).select("event_id", F.row_number().over(Window.orderBy(*by)).alias("place"))


@query("SELECT DISTINCT 'm' || (doc_id % 50) AS tag, 'manifest' AS origin FROM documents WHERE doc_id % 2 = 0")
def release_sources(spark, d):
    """Releases of the manifests; those of the second source only if there are none, as in the first branch here."""
    docs = table(spark, d, "documents")
    one = lambda k: F.to_json(F.struct(F.lit(k).alias("schema_version"), F.array(F.struct(F.concat(F.lit("m"), (F.col("doc_id") % 50).cast("string")).alias("tag_name"))).alias("releases")))
    manifests = docs.select(F.when(F.col("doc_id") % 2 == 0, one(1)).otherwise(one(2)).alias("document"))
    api = docs.select(F.lit("a").alias("tag"), F.lit("api").alias("origin"))
    read = read_releases(manifests).select(F.col("tag_name").alias("tag"), F.lit("manifest").alias("origin"))
    return versions.either_source(versions.either_source(read.limit(0), read), api).distinct()


_NOTES = "CASE turn % 3 WHEN 0 THEN concat('## ', text, chr(10), '  - ', text, chr(10), '### a **b** c') WHEN 1 THEN concat('- **', text, '** x ** y') ELSE concat('  ', text, chr(10), chr(10), '#### d') END"


@query(f"""WITH l AS (SELECT conv_id, turn, unnest(string_split({_NOTES}, chr(10))) AS x, generate_subscripts(string_split({_NOTES}, chr(10)), 1) AS place FROM conversations)
  SELECT conv_id, turn, place, CASE WHEN trim(x) LIKE '### %' THEN 'subheading' WHEN trim(x) LIKE '## %' THEN 'heading' WHEN trim(x) LIKE '- %' THEN 'bullet' ELSE 'body' END AS kind,
  md5(CASE WHEN trim(x) LIKE '### %' THEN substr(trim(x), 5) WHEN trim(x) LIKE '## %' THEN substr(trim(x), 4) WHEN trim(x) LIKE '- %' THEN '• ' || substr(trim(x), 3) ELSE x END) AS shown FROM l""")
def note_lines(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(versions.note_lines(F.expr(_NOTES.replace("chr(10)", r"'\n'")))).alias("place", "x"))
    return lines.select("conv_id", "turn", (F.col("place") + 1).cast("long").alias("place"), "x.kind", F.md5("x.text").alias("shown"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN md5('a ' || text || '|b**' || text || '|c') WHEN turn % 3 = 1 THEN md5(text) ELSE md5('a **' || text) END AS plain, CASE WHEN turn % 3 = 0 THEN 1 WHEN turn % 3 = 1 THEN 1 ELSE 0 END::INT AS bold
  FROM (SELECT conv_id, turn, replace(text, '*', '') AS text FROM conversations) WHERE text <> ''""")
def bold_runs(spark, d):
    """Two marks make bold text, a third is text."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.replace("text", F.lit("*"), F.lit("")).alias("text")).where("text != ''")
    line = F.expr("CASE turn % 3 WHEN 0 THEN concat('a ', text, '|**b**', '**', text, '|c') WHEN 1 THEN concat('**', text, '**') ELSE concat('a **', text) END")
    runs = versions.bold_runs(line)
    return t.select("conv_id", "turn", F.md5(F.array_join(F.transform(runs, lambda r: r.text), "")).alias("plain"), F.size(F.filter(runs, lambda r: r.bold)).alias("bold"))


@query(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN body ELSE 'a' END AS body, replace(body, 'notes ', '') AS flat FROM ({_REL})")
def notes_bodies(spark, d):
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("\n "), "body", F.lit(" \n\n## Download\nhere"))).otherwise("a\n## Download\nb")
    return _releases(spark, d).select("event_id", text.notes_body(body).alias("body"), text.flatten(F.concat(F.lit("\n"), F.substr("body", F.lit(7)), F.lit(" "))).alias("flat"))
