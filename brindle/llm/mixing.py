"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources in code-point order (null last) have the weights 5, 2, 1, repeating; they share `share` times
the words of all documents, but none more than `most` times its own: the excess is dealt again by weight.

The words to take are cut into blocks of `block` tokens.  Blocks go to the highest quotients target / (2n + 1),
first among sources, then among the shards (hash of the document) of each source, so every shard has an
integer quota.  A shard lays its documents out in a seeded order and takes its blocks in full rounds over all
documents and, for the rest, the first blocks of that order: a document's words are taken as often as blocks
cover them, never more than `most` times.  Running sums are per shard, of about SHARD_ROWS rows, so a source
that holds a third of all rows is split like any other; no single task sees all documents.

All of it is DataFrame expressions.  Nulls and odd rows: a null text has size 0; null sources form one
source; documents of one doc_id, or of none, are dealt to shards and ordered by doc_id and the hash of their text;
equal rows are counted before they are dealt and get their words one after another, and come back in pieces of COPIES
from as many tasks; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize

WEIGHTS, SHARE, MOST, BLOCK, SHARD_ROWS, SEED = (5, 2, 1), 1.5, 2, 8, 2000, 9
COPIES = 1 << 16  # equal rows that one row of counts becomes in one task


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with weight and target; a row for each source, so its windows are small.

    A source stops when its cap is at most weight x level; sorted by cap / weight those come first, and the
    level with the first k stopped is (all - caps of the k) / (weights of the others).
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighted = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    weighted = weighted.withColumns({"cap": F.col("source_size") * float(most), "ratio": F.col("source_size") * float(most) / F.col("weight")})
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_words = F.sum("source_size").over(everything) * share
    level = (all_words - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    found = weighted.withColumn("level", level)
    # the first source whose ratio is above the level of those before it fixes the level for itself and all after
    level = F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(everything)
    return found.withColumn("level", level).select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), "cap")).alias("target"))


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, tie: list[Column]) -> DataFrame:
    """parties with quota: of the seats of its group, those that Sainte-Lague gives it.

    With t = seats x votes / all votes, the divisor at seats' share gives round(t) seats, and the sum misses
    the total by half a seat a party at most; so a party's seats up to t - d - 1 are certain and those after
    t + d + 1 impossible, for d its share of that error, and only the quotients between are ranked.
    """
    g = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    p = parties.withColumns({"_all": F.sum(votes).over(g), "_n": F.count("*").over(g)})
    t = F.when(F.col("_all") > 0, F.col(seats) * F.col(votes) / F.col("_all")).otherwise(0.0)
    p = p.withColumn("_t", t).withColumn("_d", F.when(F.col("_all") > 0, F.col("_n") * 0.5 * F.col(votes) / F.col("_all")).otherwise(0.0))
    p = p.withColumn("_sure", F.greatest(F.floor(F.col("_t") - F.col("_d") - 1), F.lit(0)).cast("long"))
    p = p.withColumn("_last", F.when(F.col(votes) > 0, F.ceil(F.col("_t") + F.col("_d") + 1)).otherwise(0).cast("long"))
    asked = p.withColumn("_i", F.explode_outer(F.when(F.col("_last") > F.col("_sure"), F.sequence("_sure", F.col("_last") - 1))))
    by = g.orderBy(F.desc_nulls_last(F.when(F.col("_i").isNotNull(), F.col(votes) / (2 * F.col("_i") + 1))), *tie, "_i")
    left = F.col(seats) - F.sum(F.when(F.col("_i").isNull() | (F.col("_i") == F.col("_sure")), F.col("_sure")).otherwise(0)).over(g)
    got = F.when(F.col("_i").isNotNull() & (F.row_number().over(by) <= left), 1).otherwise(0)
    won = asked.withColumn("_won", got)
    keys = [c for c in parties.columns]
    return won.groupBy(*keys).agg((F.max("_sure") + F.sum("_won")).cast("long").alias("quota"))


def quotas(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: int = SEED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, source, text_key, size, copies, source_size, target, rounds, rest, begin of each distinct document.

    Equal rows (doc_id, source, text) are one row with their number, so that they can't fill a shard; taken() has
    the words of each copy.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    sized = documents.select("doc_id", "source", F.xxhash64("text").alias("text_key"), size.alias("size")).groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("copies"))
    sized = materialize(sized.withColumn("place", F.xxhash64("doc_id", "text_key", F.lit(seed))), "sizes")
    words = F.col("size") * F.col("copies")
    sources = sized.groupBy("source").agg(F.sum(words).alias("source_size"), F.count("*").alias("rows"))
    aimed = targets(sources.select("source", "source_size"), weights, share, most)
    blocks = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long")
    dealt = apportion(aimed.withColumn("blocks", blocks), [], "target", "blocks", [F.col("source").asc_nulls_last()]).drop("blocks")
    dealt = dealt.join(sources.select(F.col("source").alias("s"), F.greatest(F.ceil(F.col("rows") / shard_rows), F.lit(1)).alias("shards")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = materialize(dealt.withColumnRenamed("quota", "source_blocks"), "quotas")

    placed = sized.join(dealt.select(F.col("source").alias("s"), "shards"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("place"), F.col("shards")))
    shards = placed.groupBy("source", "shard").agg(F.sum(words).alias("shard_size"))
    q, s = dealt.alias("q"), shards.alias("s")
    shards = s.join(q, F.col("s.source").eqNullSafe(F.col("q.source"))).select("s.source", "s.shard", "s.shard_size", "q.source_size", "q.target", "q.source_blocks")
    shards = apportion(shards, ["source"], "shard_size", "source_blocks", [F.col("shard")])

    p, s = placed.alias("p"), shards.alias("s")
    rows = p.join(s, F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.shard") == F.col("s.shard"))).select("p.*", "s.shard_size", "s.source_size", "s.target", "s.quota")
    before = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    to_take = F.least(F.col("quota") * block, F.col("shard_size") * most)
    rounds = F.when(F.col("shard_size") > 0, F.floor(to_take / F.col("shard_size"))).otherwise(0).cast("long")
    rows = rows.withColumns({"rounds": rounds, "rest": to_take - rounds * F.col("shard_size"), "begin": F.coalesce(F.sum(words).over(before), F.lit(0))})
    return rows.select("doc_id", "source", "text_key", "size", "copies", "source_size", "target", "rounds", "rest", "begin")


def taken(copy: Column) -> Column:
    """Words that the mix takes of a copy (from 0) of a row of quotas()."""
    left = F.col("rest") - F.col("begin") - copy * F.col("size")
    return (F.col("rounds") * F.col("size") + F.greatest(F.least(left, "size"), F.lit(0))).cast("long")


def mix(documents: DataFrame, **settings) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, taken for each row of documents (doc_id, text, source)."""
    rows = quotas(documents, **settings)
    names = rows.columns
    first = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))
    # few rows have more copies than one piece; only their pieces are dealt out
    many = rows.where(F.col("copies") > COPIES).withColumn("first", F.explode(first)).repartition("doc_id", "text_key", "first")
    pieces = rows.where(F.col("copies") <= COPIES).withColumn("first", F.lit(0).cast("long")).unionAll(many)
    copy = F.explode(F.sequence("first", F.least(F.col("first") + COPIES, "copies") - 1))
    rows = pieces.select(*names, copy.alias("copy"))
    return rows.select("doc_id", "text_key", "source", "size", "source_size", "target", taken(F.col("copy")).alias("taken"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
