"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A listed entry is a host and a path prefix with a verdict; it fits its host and all subdomains, if the path
starts with its own.  Each URL has one candidate key for every pair (labels in the host, length of the path)
that the list holds, so the number of keys of a URL follows the list's shapes, not its length.  A key chooses
one block of 256 bits and one bit in each of its four words; the filter has at most MAX_BLOCKS blocks (a
fixed bound, so it may be broadcast).  Keys that pass meet the list in an equi-join, which removes false
positives; the longest entry wins (ties: the longer host, then the smaller verdict).

All of it is DataFrame expressions.  Only distinct (host, path) pairs are looked up, so a URL that fills a
third of the table costs one lookup, and its rows meet the result salted, so no task gets them all.  A key that very many
pairs share (a listed top-level domain) meets the list as one row; the entries that are hit meet the pairs salted.

Nulls and odd rows: a null URL, or one without ://, has empty host and path and no rule; an empty list gives
every URL the default verdict; listed rows with a null are left out; a listed path fits as a plain prefix, with or
without a slash; repeated rows are each returned; other columns pass through unchanged, whatever their names (they stand apart in
one struct meanwhile); an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, unused

MAX_BLOCKS, BITS_PER_KEY, SALTS = 1 << 17, 16, 16
PARTS = r"://([^/?#]*)([^?#]*)"
#: The rules of the registered query: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def _key(host, path):
    """One string for both; listed paths need not begin with a slash."""
    return F.concat(host, F.lit("/"), path)  # no host holds a slash


def _bloom(key):
    """Block and the four words' masks of a key."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    masks = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(g, {6 * i}) & 63 as int))") for i in range(4)]
    return h, g, masks


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """The blocks (block, w0 to w3) that hold any key of listed."""
    h, g, masks = _bloom(F.col("key"))
    bits = listed.select(F.pmod(h, F.lit(blocks)).alias("block"), g.alias("g")).select("block", *[m.alias(f"m{i}") for i, m in enumerate(masks)])
    return bits.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)])


def url_filter(pages: DataFrame, listed: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict, which replace columns of those names; listed: host, path, verdict."""
    entries = listed.where("host is not null and path is not null and verdict is not null").select(
        _key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_chars"), F.length(F.concat("host", "path")).alias("chars"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_chars")
    )
    # one row: the pairs, bounded by label counts times path lengths, and the number of keys
    shapes, size = entries.agg(F.sort_array(F.collect_set(F.struct("labels", "path_chars"))), F.count("*")).first()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * 256 < size * BITS_PER_KEY:
        blocks *= 2

    names = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in names]
    own = [F.col("own").getField(c).alias(c) for c in kept]
    located = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias(unused(kept))).alias("own"),
        ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit(""))).alias("host"),
        F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit("")).alias("path"),
    )
    if not shapes:
        return located.select(*own, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    by_labels: dict[int, list[int]] = {}
    for labels, chars in shapes:
        by_labels.setdefault(labels, []).append(chars)
    # of each number of labels the host's last ones, with each prefix length that a listed entry of so many labels has
    def keys_of(labels: int, chars: list[int]):
        fitting = F.filter(F.lit(chars), lambda n: n <= F.length("path"))
        keys = F.transform(fitting, lambda n: _key(F.substring_index("host", ".", -labels), F.substr("path", F.lit(1), n)))
        return F.when(F.size(F.split("host", r"\.")) >= labels, keys).otherwise(F.array().cast("array<string>"))

    keys = F.flatten(F.array(*[keys_of(*x) for x in by_labels.items()]))
    asked = located.where("host != ''").select("host", "path").distinct().select("host", "path", F.explode(keys).alias("key"))
    h, g, masks = _bloom(F.col("key"))
    asked = asked.withColumns({"block": F.pmod(h, F.lit(blocks)), "g": g})
    passed = asked.join(F.broadcast(bloom_filter(entries, blocks)), "block")  # MAX_BLOCKS rows at most
    for i, m in enumerate(masks):
        passed = passed.where(m.bitwiseAND(F.col(f"w{i}")) == m)
    salts = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = salts(entries.join(passed.select("key").distinct(), "key"))
    hits = passed.select("host", "path", "key", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int").alias("salt")).join(hit, ["key", "salt"])
    best = hits.groupBy("host", "path").agg(F.min(F.struct(-F.col("chars"), -F.col("host_chars"), F.col("verdict"), F.col("rule"))).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("found"))
    # every pair stands with each salt, so the rows of one URL, or of none, spread over SALTS tasks
    salted = salts(best)
    spread = located.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return spread.join(salted, ["host", "path", "salt"], "left").select(*own, "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = spark.createDataFrame([(h, p, v) for v, h, p in RULES], "host string, path string, verdict string")
    return url_filter(pages, listed).select("page_id", "host", "path", "rule", "verdict")


_FITS = " UNION ALL ".join(f"SELECT '{v}' AS v, '{h}' AS h, '{p}' AS p" for v, h, p in RULES)
ORACLE = f"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path FROM pages),
r AS ({_FITS}),
m AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM u JOIN r
      ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (n)
"""
