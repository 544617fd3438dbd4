"""Hard negatives by a Voronoi-partition kNN join.

Vectors are integers, floor(256 x).  One more component, sqrt(M^2 - |v|^2) with M the largest norm, makes the largest
inner product the least distance; an asking vector gets 0 there.  Pivots are at most PIVOTS of the anchors, by
hash; every row belongs to the cell of its nearest pivot.

A search has two passes.  Anchors first meet the rows of their own cell, which gives each a score that its k-th result
reaches at least.  Then every cell has, for each class of labels, its anchors' largest distance u from the pivot and
the distances [near, far] at which they may still need a row; by the triangle inequality a row at distance d from
that pivot can only serve them if d - u <= far and d + u >= near.  It is copied to those cells and to no other, and the exact
scores are computed there.  The bounds are one row for each cell and one of LABELS classes of labels: 65536 rows at most.

The search runs twice: for the positives of each anchor (same label), and, with the windows that they set, for the
negatives of each anchor and positive (other label, scores between LOW and HIGH percent of the positive's).

A cell is dealt out in slices of AT_ONCE rows and ASKED asking rows, so that no task holds a whole cell.  Without any structure
(independent components) every row is copied to every cell, and the work is that of the whole product.

Scores are exact: products that could leave the exact range of float64 are computed in unbounded integers, and those
outside of the range of long are the end of that range.

Nulls and odd rows: a null label, a vector that is null or holds a null or non-finite component, and a row without
vec_id take no part; vectors of different lengths are compared as if the shorter went on with zeros; rows of one vec_id
never serve each other; equal rows are separate candidates and one anchor; a negative positive score has no negatives, since
its window is empty; an empty table gives no row; other columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .topk import EXACT, LEAST, MOST, SCALE, _exactly, _widen

POSITIVES, NEGATIVES, LOW, HIGH, EVERY = 5, 3, 50, 95, 50
PIVOTS, PER_PIVOT, LABELS = 1024, 256, 64
AT_ONCE, ASKED = 1 << 16, 1024


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (a long), v of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("long") if isinstance(embeddings.schema["label"].dataType, T.IntegralType) else F.xxhash64("label")
    v = F.transform(F.col("embedding").cast("array<double>"), _floor)
    return embeddings.where("vec_id is not null and label is not null and embedding is not null").where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))


def _floor(x: Column) -> Column:
    """floor(256 x) as a double; floor() itself gives a long, which large values leave."""
    y = x * SCALE
    return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # from 2^53 on a double has no fraction


def _matrix(column: pa.ListArray, width: int = 0) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


class Pivots:
    """The pivots, with the component that makes inner products distances."""

    def __init__(self, rows: np.ndarray, most: float):
        self.most = most
        self.rows, self.extra = rows, np.sqrt(np.maximum(0, most - (rows**2).sum(1)))

    def distances(self, rows: np.ndarray, asking: bool = False) -> np.ndarray:
        """From each row to each pivot."""
        width = max(rows.shape[1], self.rows.shape[1])
        a, b = _widen(rows, width), _widen(self.rows, width)
        norms = (a**2).sum(1)
        extra = np.zeros(len(a)) if asking else np.sqrt(np.maximum(0, self.most - norms))
        squares = norms[:, None] + (b**2).sum(1) - 2 * a @ b.T + (extra[:, None] - self.extra) ** 2
        return np.sqrt(np.maximum(0, squares))

    def slack(self) -> float:
        """Above any rounding of a distance."""
        return 1e-6 * (np.sqrt(self.most) + 1)


def _scores(asking: np.ndarray, rows: np.ndarray) -> np.ndarray:
    width = max(asking.shape[1], rows.shape[1])
    asking, rows = _widen(asking, width), _widen(rows, width)
    if np.abs(asking).max(initial=0) * np.abs(rows).max(initial=0) * max(1, width) < EXACT:
        return (asking @ rows.T).astype(np.int64)
    return _exactly(asking, rows)


class Held:
    """The k best rows of each asking row so far: scores falling, ties by smaller id."""

    def __init__(self, asking: pa.Table, k: int, same: bool):
        self.k, self.same = k, same
        self.v = _matrix(asking.column("v").combine_chunks())
        self.own, self.label, self.low, self.high = (asking.column(c).to_numpy() for c in ("own", "label", "low", "high"))
        self.who, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(len(self.own), LEAST)

    def meet(self, batch: pa.Table) -> None:
        ids, label = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        s = _scores(self.v, _matrix(batch.column("v").combine_chunks()))
        ok = (self.own[:, None] != ids) & ((self.label[:, None] == label) == self.same) & (s >= np.maximum(self.low, self.floor)[:, None]) & (s <= self.high[:, None])
        if s.shape[1] > self.k:  # of the batch no more than its own k best, and their ties
            ok &= s >= np.partition(np.where(ok, s, LEAST), -self.k, axis=1)[:, -self.k :][:, :1]
        who, at = np.nonzero(ok)
        who, score, id_ = np.append(self.who, who), np.append(self.score, s[who, at]), np.append(self.id, ids[at])
        order = np.lexsort((id_, ~score, who))  # ~ falls as it rises, without overflow
        who, score, id_ = who[order], score[order], id_[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < self.k
        self.who, self.score, self.id = who[keep], score[keep], id_[keep]
        full = place == self.k - 1
        self.floor[who[full]] = score[full]


def _meet(asks: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """ask, vec_id, score: the k best rows of each ask in each slice of its cell."""
    many, asked = ({r["cell"]: r["n"] for r in side.groupBy("cell").agg(F.count("*").alias("n")).collect()} for side in (rows, asks))  # a row a pivot at most
    count = lambda n, by: F.element_at(F.create_map(*[F.lit(x) for c in asked for x in (c, max(1, -(-n(c) // by)))]), F.col("cell"))
    if not asked:
        return asks.sparkSession.createDataFrame([], "ask bigint, vec_id bigint, score bigint")
    slices, parts = count(lambda c: many.get(c, 0), AT_ONCE), count(lambda c: asked[c], ASKED)
    spread = lambda id_, n: F.pmod(F.xxhash64(id_), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    none = F.lit(None).cast("long")
    left = asks.withColumn("part", spread("ask", parts)).withColumn("slice", every(slices)).select("cell", "part", "slice", F.lit(False).alias("row"), F.col("ask").alias("id"), "own", "label", "low", "high", "v")
    right = rows.where(F.col("cell").isin(*asked)).withColumn("slice", spread("vec_id", slices)).withColumn("part", every(parts)).select("cell", "part", "slice", F.lit(True).alias("row"), F.col("vec_id").alias("id"), none.alias("own"), "label", none.alias("low"), none.alias("high"), "v")

    def run(batches):
        key, held, waiting = None, None, []

        def result():
            if held is None or not len(held.who):
                return
            names = held.names[held.who]
            yield pa.RecordBatch.from_pydict({"ask": names, "vec_id": held.id, "score": held.score})

        def ready():
            nonlocal held, waiting
            if waiting:
                table = pa.Table.from_batches(waiting)
                held, waiting = Held(table, k, same), []
                held.names = table.column("id").to_numpy()

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
                if a == b:
                    continue
                now = tuple(int(c[a]) for c in columns[:3])
                if now != key:
                    yield from result()
                    key, held, waiting = now, None, []
                if not columns[3][a]:
                    waiting.append(batch.slice(a, b - a))
                    continue
                ready()
                for at in range(a, b if held is not None else a, 4096):
                    held.meet(pa.Table.from_batches([batch.slice(at, min(4096, b - at))]))
        yield from result()

    both = left.unionAll(right).repartition("cell", "part", "slice").sortWithinPartitions("cell", "part", "slice", "row")
    return both.mapInArrow(run, "ask bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(asks: DataFrame, rows: DataFrame, pivots: Pivots, k: int, same: bool) -> DataFrame:
    """ask, rank, vec_id, score: the k best of rows (cell, vec_id, label, v) for each of asks (ask, own, label, low, high, v).

    same: whether rows of the same label are looked for, or of any other; low, high: the scores that count.
    """
    most, slack = pivots.most, pivots.slack()
    label_class = F.pmod(F.xxhash64("label"), F.lit(LABELS)).cast("int") if same else F.lit(0)

    def place(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(b.num_columns - 1))
                d = pivots.distances(v, asking=True)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), pa.array((v**2).sum(1)), *b.columns], names=["cell", "u", "norm", *b.schema.names])

    fields = ["ask", "own", "label", "low", "high", "v"]
    asks = materialize(asks.select(*fields).mapInArrow(place, "cell int, u double, norm double, ask bigint, own bigint, label bigint, low bigint, high bigint, v array<double>"), "asks")
    home = materialize(_best(_meet(asks, rows, k, same), k), "home")

    # the score that each ask still needs, and from it the distances
    sure = home.where(F.col("rank") == k).select("ask", F.col("score").alias("floor"))
    needed = F.greatest("low", F.coalesce("floor", F.lit(LEAST)))
    at = lambda s: F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + F.lit(most) - 2 * s.cast("double")))
    far = F.when(needed == LEAST, F.lit(float("inf"))).otherwise(at(needed))
    near = F.when(F.col("high") == MOST, F.lit(0.0)).otherwise(at(F.col("high")))
    bounds = asks.join(sure, "ask", "left").groupBy("cell", label_class.alias("class")).agg(F.max("u").alias("u"), F.max(far).alias("far"), F.min(near).alias("near")).toArrow()  # PIVOTS x LABELS rows at most
    cell, kind, u, far, near = (bounds.column(c).to_numpy() for c in ("cell", "class", "u", "far", "near"))

    def route(batches):
        most_rows = max(1, (1 << 22) // max(1, len(cell)))
        for whole in batches:
            for begin in range(0, whole.num_rows, most_rows):
                b = whole.slice(begin, most_rows)
                d = pivots.distances(_matrix(b.column(3)))[:, cell]
                serves = ~((d - u > far + slack) | (d + u < near - slack))  # so that what is not a number serves
                serves &= b.column(0).to_numpy()[:, None] != cell
                if same:
                    serves &= b.column(4).to_numpy()[:, None] == kind
                row, to = np.nonzero(serves)
                for a in range(0, len(row), 8192):
                    some = b.take(pa.array(row[a : a + 8192]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[to[a : a + 8192]].astype(np.int32)), *some.columns[1:4]], names=["cell", "vec_id", "label", "v"])

    away = rows.select("cell", "vec_id", "label", "v", label_class.alias("class")).mapInArrow(route, "cell int, vec_id bigint, label bigint, v array<double>")
    away = materialize(away, "copies")
    return _best(home.select("ask", "vec_id", "score").unionAll(_meet(asks, away, k, same)), k)


def hard_negatives(embeddings: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchor: which rows (vec_id, label) ask."""
    rows = materialize(usable(embeddings), "vectors")
    asking = materialize(rows.where(anchor).distinct().select(F.monotonically_increasing_id().alias("ask"), F.col("vec_id").alias("own"), "label", "v"), "anchors")
    n = asking.count()
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    most = rows.agg(F.max(norm)).first()[0] or 0.0
    chosen = asking.orderBy(F.xxhash64("v"), "ask").limit(min(PIVOTS, -(-n // PER_PIVOT))).select("v").toArrow() if n else None
    pivots = Pivots(_matrix(chosen.column("v").combine_chunks()) if n else np.zeros((1, 1)), most)

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(pivots.distances(_matrix(b.column(2))).argmin(1).astype(np.int32)), *b.columns], names=["cell", *b.schema.names])

    rows = materialize(rows.mapInArrow(place, "cell int, vec_id bigint, label bigint, v array<double>"), "cells")
    first = search(asking.select("*", F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")), rows, pivots, positives, True)
    # an ask for each anchor and positive; decimals hold the products that long does not
    score = F.col("score").cast("decimal(20,0)")
    window = {"low": F.ceil(score * low / 100).cast("long"), "high": F.floor(score * high / 100).cast("long")}
    pairs = materialize(first.where("score >= 0").withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}).withColumn("score", F.col("positive_score")).withColumns(window).select(F.monotonically_increasing_id().alias("pair"), "ask", "positive_id", "positive_score", "low", "high"), "positives")
    asks = pairs.join(asking, "ask").select(F.col("pair").alias("ask"), "own", "label", "low", "high", "v")
    found = search(asks, rows, pivots, negatives, False)
    named = pairs.select(F.col("ask").alias("anchor"), F.col("pair").alias("ask"), "positive_id", "positive_score").join(asking.select(F.col("ask").alias("anchor"), F.col("own").alias("anchor_id")), "anchor")
    return found.join(named, "ask").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    return hard_negatives(embeddings.select("vec_id", label, "embedding"), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id != c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
