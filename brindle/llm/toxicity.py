"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the 32-bit hashes of its words, word pairs and pairs with one or two words between,
each once (presence).  Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters.

The model is fitted in one task on at most `max_rows` labelled rows with at most `max_features` features in all
(documented bounds; those with the smallest hash of doc_id, whole texts, up to the first that does not fit; one text
is taken whatever its length), with per-coordinate rates, and L1 leaves at most `max_weights` weights, so what is
broadcast has a fixed bound.  Rows of a doc_id that many documents share count towards both bounds.  Scoring reads
whole texts, without a shuffle.

Nulls and odd rows: null and empty texts have no feature and score the bias; rows whose label or doc_id is
null are not learnt from; a doc_id with several labels counts as toxic if any is; repeated rows are scored
each; with no usable label, every score is 0 (nothing is known to be toxic).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import segment_sums, shards, word_ids

MAX_ROWS, MAX_FEATURES, MAX_WEIGHTS, MIN_DOCS = 8192, 32 << 20, 65536, 3
#: Of 29 settings of ALPHA, L1 and EPOCHS, those with the least out_of_fold() log loss on the training rows of sf0.1.
ALPHA, BETA, L1, L2, EPOCHS, SEED = 2.0, 1.0, 12.0, 0.1, 5, 17
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SLOTS, SHARD_BYTES = 22, 2 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of each text, text by text, and the bounds between texts."""
    flat, bounds, vocabulary = word_ids([t.translate(_TABLE).split() for t in texts])
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))[flat]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))
    keys, docs = [h], [doc]
    for gap in (1, 2, 3):
        if len(h) > gap:
            inside = doc[gap:] == doc[:-gap]
            keys.append(_mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1 if gap == 1 else 2))[inside])
            docs.append(doc[gap:][inside])
    return (np.concatenate(keys) >> np.uint64(32)).astype(np.uint32), np.concatenate(docs)


def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    if not len(keys):
        return keys, docs
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return keys[new], docs[new]


def fit(rows: list[np.ndarray], labels: np.ndarray, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, epochs=EPOCHS, min_docs=MIN_DOCS, max_weights=MAX_WEIGHTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature keys, their weights, and the bias, of the rows in the given order."""
    none = np.zeros(0, np.uint32), np.zeros(0), -50.0
    if not len(rows) or not (labels > 0).any():
        return none
    known = np.concatenate(rows)
    known.sort()  # in place: the largest array of the task
    if len(known) >= min_docs:
        known = known[: len(known) - min_docs + 1][known[min_docs - 1 :] == known[: len(known) - min_docs + 1]]
        known = known[np.append(True, known[1:] != known[:-1])] if len(known) else known
    else:
        known = known[:0]
    n = len(known)
    inside = []
    for r in rows:
        at = np.minimum(np.searchsorted(known, r), max(0, n - 1))
        inside.append(np.append(at[known[at] == r] if n else at[:0], n).astype(np.int32))  # the bias is coordinate n
    z, g2, w = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    free = np.full(n + 1, l1)
    free[n] = 0
    mean = (labels > 0).mean()
    z[n] = -np.log(mean / (1 - mean) if mean < 1 else 50) * beta / alpha

    def weights(at):
        excess = np.abs(z[at]) - free[at]
        return np.where(excess > 0, -np.sign(z[at]) * excess / ((beta + np.sqrt(g2[at])) / alpha + l2 * (at < n)), 0.0)

    for _ in range(epochs):
        for at, y in zip(inside, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            old = np.sqrt(g2[at])
            g2[at] += g * g
            z[at] += g - (np.sqrt(g2[at]) - old) / alpha * w
    w = weights(np.arange(n + 1))
    kept = np.flatnonzero(w[:n])
    kept = np.sort(kept[np.argsort(-np.abs(w[kept]), kind="stable")[:max_weights]])
    return known[kept], w[kept], float(w[n])


def out_of_fold(texts: list[bytes], labels: np.ndarray, folds: int = 5, **settings) -> np.ndarray:
    """Probability of label 1 for each text from a model of the other folds; equal texts share a fold.  For choosing settings."""
    keys, docs = _distinct(*features(texts))
    bounds = np.searchsorted(docs, np.arange(len(texts) + 1))
    fold = np.array([xxhash.xxh3_64_intdigest(t) % folds for t in texts])
    p = np.zeros(len(texts))
    for f in range(folds):
        rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        p[own] = score([texts[i] for i in own], *fit([keys[bounds[i] : bounds[i + 1]] for i in rest], labels[rest], **settings))
    return p


def score(texts: list[bytes], keys: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text."""
    found, docs = features(texts)
    low = np.uint32((1 << _SLOTS) - 1)
    slots = np.zeros(1 << _SLOTS, bool)  # lets through little more than what the model knows
    slots[keys & low] = True
    maybe = slots[found & low]
    found, docs = _distinct(found[maybe], docs[maybe])
    total = np.full(len(texts), bias)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        hit = keys[at] == found
        total += np.bincount(docs[hit], weights[at[hit]], len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_weights: int = MAX_WEIGHTS, max_features: int = MAX_FEATURES, label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on rows of documents (doc_id, text) that labels (doc_id, label) names: at most max_rows, with max_features features in all.

    The rows come in a seeded order of doc_id, so the fit does not depend on partitions.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    usable = usable.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = usable.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(max_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen has max_rows rows at most
    signed = lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63)

    def bounded(held):
        """The first rows (place, tie, label, packed) in seeded order, up to both bounds."""
        held.sort()
        ends = np.cumsum([len(x[3]) // 4 for x in held])
        return held[: max(1, min(max_rows, int(np.searchsorted(ends, max_features, "right"))))]

    def pack(batches):
        """Of each task its first rows: none after them can be among the first of all."""
        held, size = [], 0
        for part, texts in shards(batches, "text", SHARD_BYTES):
            keys, docs = _distinct(*features(texts))
            bounds = np.searchsorted(docs, np.arange(len(texts) + 1))
            for x, label, a, b in zip(part.column("doc_id").to_pylist(), part.column("label").to_pylist(), bounds, bounds[1:], strict=False):
                packed = keys[a:b].tobytes()
                held.append((signed(str(x)), signed(packed), label, packed))
                size += b - a
            if len(held) > 2 * max_rows or size > 2 * max_features:
                held = bounded(held)
                size = sum(len(x[3]) // 4 for x in held)
        held = bounded(held)
        for k in range(0, len(held), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held[k : k + 512], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["place", "tie", "label", "packed"])

    def learn(batches):
        held, size = [], 0
        for x in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)):  # in order
            size += len(x[3]) // 4
            if held and (len(held) == max_rows or size > max_features):
                break
            held.append(x)
        if held:
            keys, weights, bias = fit([np.frombuffer(x[3], np.uint32) for x in held], np.array([x[2] for x in held], float), max_weights=max_weights)
            yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["keys", "weights", "bias"])

    schema = "place bigint, tie bigint, label int, packed binary"
    one = rows.mapInArrow(pack, schema).withColumn("one", F.lit(1)).repartition("one").drop("one").sortWithinPartitions("place", "tie")
    model = one.mapInArrow(learn, "keys binary, weights binary, bias double").collect()  # one row of at most max_weights weights
    if not model:
        return np.zeros(0, np.uint32), np.zeros(0), -50.0
    return np.frombuffer(model[0].keys, np.uint32), np.frombuffer(model[0].weights), model[0].bias


def toxicity(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """documents with score (0 to 1) and predicted (1 from 0.5 up); columns of those names are replaced."""
    from pyspark.sql import types as T

    keep = [f for f in documents.schema.fields if f.name not in ("score", "predicted")]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for part, texts in shards(batches, "text", SHARD_BYTES):
            p = score(texts, *model)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return documents.select(*[f"`{f.name}`" for f in keep]).mapInArrow(run, schema)


def held_out(doc_id="doc_id", remainder: int = 0):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == remainder, F.lit(False))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Learn from labelled rows outside the held-out fifth; score every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = toxicity(documents, train(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
