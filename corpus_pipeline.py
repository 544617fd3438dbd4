"""Corpus pipeline: toxicity, SimHash near-dedup, suffix-array dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of documents;
its result is written as Parquet and read again before the next.  The last stage adds size, source_size,
target and taken, and keeps what the mix takes.

Nulls and odd rows: doc_id is an integer; rows without doc_id, text or source go through every stage like others
(a null text is empty, a null source one source); repeated rows are near copies of each other, so the second stage
leaves one, and each of the other stages treats every row by itself; ties are settled by the hash of the text; an
empty table gives no row; columns of the user's own pass unchanged whatever their names (they stand apart in one struct while
an operator works), but for those that the last stage's new columns name: they come back as `<name>__own`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from brindle.llm.common import materialize, release, temporaries, unused
from brindle.llm.decontaminate import decontaminate
from brindle.llm.mixing import quotas, taken
from brindle.llm.simhash import one_of_each
from brindle.llm.suffix import suffix_dedup
from brindle.llm.toxicity import held_out, toxicity, train


def _apart(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and all others in the struct `own`."""
    read = [c for c in ("doc_id", "text", "source") if c in docs.columns]
    return docs.select(*read, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in read], F.lit(0).alias(unused(docs.columns))).alias("own"))


def _back(c: str) -> Column:
    """A column of docs in what an operator made of _apart(docs)."""
    return F.col(c) if c in ("doc_id", "text", "source") else F.col("own").getField(c).alias(c)


def _with_text(found: DataFrame, docs: DataFrame, text: str, changed: Column) -> DataFrame:
    """The columns of docs with the new text and its length where it changed; texts of which nothing is left go."""
    new = {"text": F.col(text).alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(_back("n_chars")).alias("n_chars")
    return found.where(~changed | (F.length(F.trim(text)) > 0)).select(*[new.get(c, _back(c)) for c in docs.columns])


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    own = _apart(docs)
    return toxicity(own, train(own, labels)).where("predicted = 0").select(*map(_back, docs.columns))


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays: that of the smallest doc_id (rows without one last), then of the smallest text hash."""
    return one_of_each(docs)


def drop_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that an earlier place holds too are cut out."""
    return _with_text(suffix_dedup(_apart(docs)), docs, "kept_text", F.col("n_removed") > 0)


def drop_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of words that benchmark windows hit are cut out."""
    return _with_text(decontaminate(_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs, "clean_text", F.col("n_hit") > 0)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with how many; each of several equal rows has its own number."""
    new = ("size", "source_size", "target", "taken")
    id_, text = F.col("doc_id"), F.xxhash64("text")
    # keys without nulls, so that rows meet in plain equi-joins
    key = lambda k: [F.coalesce(id_, F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("_id"), F.when(id_.isNull(), F.bitwise_not(k)).otherwise(k).alias("_text"), F.xxhash64("source", F.col("source").isNull()).alias("_source")]
    dealt = quotas(docs)
    dealt = dealt.select(*key(F.col("text_key")), *[c for c in dealt.columns if c not in ("doc_id", "source", "text_key")])
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), *key(text))
    others = [F.col("own").getField(f.name) for f in docs.schema.fields if isinstance(f.dataType, AtomicType) and f.name != "text"]
    copy = F.row_number().over(Window.partitionBy("_id", "_text", "_source").orderBy(*others)) - 1
    found = keyed.withColumn("_copy", copy.cast("long")).join(dealt, ["_id", "_text", "_source"]).withColumn("taken", taken(F.col("_copy"))).where("taken > 0")
    return found.select(*[F.col("own").getField(c).alias(f"{c}__own" if c in new else c) for c in docs.columns], *new)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]


def run(spark, sf_dir: str) -> DataFrame:
    """The documents after all stages; of the scratch tables only the last stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with temporaries() as kept:
            docs = materialize(stage(spark, docs, sf_dir), name)
            kept.add(docs._scratch)
        if before is not None:
            release(before)
        before = docs
    return docs


#: The classifier and the seeded order are not expressible in SQL.
ORACLE_SQL = None
