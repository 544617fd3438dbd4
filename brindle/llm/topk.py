"""Exact top-k inner products by block-at-a-time pruning.

Vectors are integers, floor(256 x).  A task orders the rows it holds by their strongest component, so that rows
of one direction stand together, and packs them into blocks of document ranges, each with a forward index (the
matrix of its vectors) and the extremes of every component.  For a query the bound of a block is the sum over
components of the larger of query x maximum and query x minimum; a query visits blocks in falling order of bounds
and stops when the next bound is below its k-th score (an equal one is visited, as a smaller vec_id may tie).
Each task returns k rows a query at most; they meet by query.

How much is skipped depends on the vectors: with clusters or sparse components most blocks are; vectors without
any structure (independent components) leave every bound far above the k-th score, and all blocks are visited.

Queries are a stated set, written once in chunks of about CHUNK / 2 rows.  Chunks are taken one after another: the
driver and what is sent to the executors hold one chunk, every chunk meets all vectors in blocks, and its
results are written before the next is read.

Scores are exact.  Vectors and queries whose products could reach 2^53 are multiplied in unbounded integers,
row by row; all others in float64, which holds them exactly.  A score outside of the range of long is the end of
that range.

Nulls and odd rows: a vector that is null or holds a null or non-finite component, and a row without vec_id,
take no part; vectors of different lengths are compared as if the shorter went on with zeros; a row never
meets rows of its own vec_id; equal rows are separate candidates and one query; other columns are left out; an
empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, EVERY, BLOCK, CHUNK, SCALE = 5, 50, 64, 4096, 256
EXACT, LEAST, MOST = 2.0**53, -(2**63), 2**63 - 1


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors as rows, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _widen(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, max(0, width - m.shape[1]))))


class Best:
    """The k best of each query so far: scores falling, ties by smaller id; `found` says how many there are."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), LEAST, np.int64), np.full((n, k), MOST, np.int64)
        self.found = np.zeros(n, np.int64)
        self.visited = self.blocks = 0  # pairs of query and block

    def floor(self) -> np.ndarray:
        """The score that a candidate must reach, as a float; -inf while there are fewer than k."""
        return np.where(self.found < self.k, -np.inf, self.scores[:, -1].astype(np.float64))

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, real: np.ndarray) -> None:
        """Candidates `ids` of the queries `rows`; those that are not real don't count."""
        s = np.concatenate([self.scores[rows], scores], 1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], 1)
        own = np.arange(self.k) < self.found[rows, None]
        real = np.concatenate([own, real], 1)
        order = np.lexsort((i, ~s, ~real), axis=1)[:, : self.k]  # ~s falls as s rises, without overflow
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.found[rows] = np.take_along_axis(real, order, 1).sum(1)


def _exactly(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in unbounded integers, cut to the range of long."""
    whole = lambda m: [[int(x) for x in row] for row in m.tolist()]
    q, v = whole(queries), whole(vectors)
    return np.array([[min(max(sum(a * b for a, b in zip(x, y, strict=True)), LEAST), MOST) for y in v] for x in q], np.int64).reshape(len(q), len(v))


def ordered(vectors: np.ndarray) -> np.ndarray:
    """Order of the rows by their strongest component, its sign and its share of the row's length."""
    if not vectors.size:
        return np.arange(len(vectors))
    most = np.abs(vectors).argmax(1)
    value = vectors[np.arange(len(vectors)), most]
    return np.lexsort((value / np.maximum(np.linalg.norm(vectors / max(1.0, np.abs(vectors).max()), axis=1), 1e-300), value < 0, most))


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int = K, block: int = BLOCK) -> Best:
    width = max(queries.shape[1], vectors.shape[1])
    queries, vectors = _widen(queries, width), _widen(vectors, width)
    best = Best(len(queries), k)
    # rows and queries of which any product may leave float64's exact range
    room = np.sqrt(EXACT / max(1, width)) / 2
    far_q, far_v = np.abs(queries).max(1, initial=0) > room, np.abs(vectors).max(1, initial=0) > room
    for rows, columns in ((np.flatnonzero(far_q), np.arange(len(vectors))), (np.flatnonzero(~far_q), np.flatnonzero(far_v))):
        for a in range(0, len(columns) if len(rows) else 0, block):
            some = columns[a : a + block]
            best.add(rows, _exactly(queries[rows], vectors[some]), ids[some], query_ids[rows, None] != ids[None, some])
    near, asked = np.flatnonzero(~far_v), np.flatnonzero(~far_q)
    if not len(near) or not len(asked):
        return best
    near = near[ordered(vectors[near])]
    vectors, ids, queries, query_ids = vectors[near], ids[near], queries[asked], query_ids[asked]
    starts = np.arange(0, len(vectors), block)
    high, low = np.maximum.reduceat(vectors, starts), np.minimum.reduceat(vectors, starts)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    best.blocks += bounds.size
    for turn in range(len(starts)):
        at = order[:, turn]
        live = np.flatnonzero(bounds[np.arange(len(queries)), at] >= best.floor()[asked])
        if not len(live):
            break
        best.visited += len(live)
        for b in np.unique(at[live]):
            rows = live[at[live] == b]
            own = ids[b * block : (b + 1) * block]
            scores = queries[rows] @ vectors[b * block : (b + 1) * block].T
            real = query_ids[rows][:, None] != own[None, :]
            better = (real & (scores >= best.floor()[asked[rows], None])).any(0)  # columns that no query wants are not sorted
            if better.any():
                best.add(asked[rows], scores[:, better].astype(np.int64), own[better], real[:, better])
    return best


def usable(embeddings: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.where("vec_id is not null and embedding is not null").where(~bad).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


FOUND = "q bigint, query_id bigint, vec_id bigint, score bigint"


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = K, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query (vec_id, embedding) against all embeddings."""
    vectors, asked = usable(embeddings), usable(queries).distinct()
    n = asked.count() // (chunk // 2) + 1
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    if n == 1:
        return _chunk_top_k(vectors, asked, k, block)
    asked = materialize(asked, "queries", ["chunk"])
    parts = [materialize(_chunk_top_k(vectors, asked.where(F.col("chunk") == i), k, block), "found") for i in range(n)]
    return embeddings.sparkSession.read.schema(parts[0].schema).parquet(*[p._scratch for p in parts])


def _chunk_top_k(vectors: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    some = asked.select("vec_id", "embedding").orderBy("vec_id", "embedding").toArrow()  # a chunk at most
    query_ids = some.column("vec_id").to_numpy()
    matrix = _matrix(some.column("embedding").combine_chunks()) if some.num_rows else np.zeros((0, 0))

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            best = search(matrix, query_ids, _matrix(table.column("embedding").combine_chunks()), table.column("vec_id").to_numpy(), k, block)
            q, r = np.nonzero(np.arange(k) < best.found[:, None])
            return pa.RecordBatch.from_pydict({"q": q.astype(np.int64), "query_id": query_ids[q], "vec_id": best.ids[q, r], "score": best.scores[q, r]})

        for batch in batches if len(query_ids) else ():
            held.append(batch)
            if sum(b.num_rows for b in held) >= 1 << 16:
                yield flush()
                held.clear()
        if sum(b.num_rows for b in held):
            yield flush()

    rank = F.row_number().over(Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id"))
    return vectors.mapInArrow(run, FOUND).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(embeddings, embeddings.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id != c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
