"""Helpers that several operators share: scratch tables, shards, word ids, components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call white space; bytes.split() splits at exactly these.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is left there is deleted when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_rest)
    _made[path] = spark
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    _made.pop(path, None)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _remove_rest() -> None:
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            remove_path(spark, path)


@contextlib.contextmanager
def temporaries():
    """Deletes, at its end, the scratch tables made within it but for those added to the set that it gives."""
    before, keep = set(_made), set()
    yield keep
    for path, spark in list(_made.items()):
        if path not in before and path not in keep:
            remove_path(spark, path)


def materialize(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder (in folders of its columns by) and read it again: lineage ends, and lost executors cost nothing before it."""
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    remove_path(df.sparkSession, df._scratch)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(names: Iterable[str]) -> str:
    """A name that is not among them."""
    return "_" * (1 + max(map(len, names), default=0))


def ascii_lower(column):
    """A-Z only, whatever the locale."""
    return F.translate(column, UPPER, LOWER)


def shards(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about max_bytes of text at most (a longer text comes alone), and the UTF-8 of each row (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), np.int64)
        begin = 0
        while begin < len(sizes):
            ends = np.cumsum(sizes[begin : begin + 65536])
            n = max(1, int(np.searchsorted(ends, max_bytes, "right")))
            part = batch.slice(begin, n)
            yield part, [x or b"" for x in column.slice(begin, n).cast(pa.binary()).to_pylist()]
            begin += n


def word_ids(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of each word its id in the order of first sight; where each list begins (and the end); the words by id."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    bounds = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=bounds[1:])
    flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(lists)), np.int32, int(bounds[-1]))
    return flat, bounds, list(ids)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between successive bounds; empty segments are 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), by alternating large-star and small-star.

    Each round is two shuffles of the edges, pre-aggregated, and ends in a written table; rounds grow with
    the logarithm of the longest path.  A component is named by its smallest node.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        near = both(e)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return near.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.unionAll(least.select("a", F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(now)
    while True:
        new = materialize(small(large(now)), "edges")
        release(now)
        now, before, seen = new, seen, mark(new)
        if seen == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
