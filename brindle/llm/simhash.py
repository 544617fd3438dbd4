"""SimHash near-dedup: fingerprints of word shingles, linked at a few differing bits.

Fingerprint: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's 3-word
shingles, repeats included.  Links: fingerprints are embedded as the bit counts of their 2-bit segments.
One differing bit moves one count by one, so the Manhattan distance of two embeddings never exceeds the
Hamming distance: a range-join on a grid finds every link.  The grid has four axes of eight segments; at two
differing bits at most, at least two axes agree entirely, so a fingerprint enters the six cells that two of
its axes span, and pairs in a cell pass the Manhattan bound and then the exact bit count.

Equal fingerprints are one row from the start.  A crowded cell is cut by the same rule into the cells of a finer
grid: its free bits (segments of one bit) make four axes, of which two agree.  So every pair is met in a cell of a
few rows, by the same bound and the same check, and the work is linear in a crowded cell.

Nulls and odd rows: doc_id is of any type that has an order; null and empty texts have fingerprint zero, linked
like any other; rows with equal doc_id are each returned; a null doc_id is returned with its fingerprint and its
group's component, but names none (null where nothing else does); an empty table gives no row; other columns are
left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, materialize, shards

WORDS, BITS, SEED = 3, 2, 42
CROWD = 48  # fingerprints in a cell, above which it is cut into the cells of a finer grid
SPLIT = 1 << 16  # and above which this is done before cells are dealt to tasks


def fingerprint(text: bytes, words: int = WORDS) -> int:
    w = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    line = b" ".join(w)
    lengths = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends + 1 - lengths)[:n].tolist()
    ends = ends[min(words, len(w)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(documents: DataFrame) -> DataFrame:
    """The columns of documents but text (text: the text to read), and fingerprint (long), for each row."""
    fields = [f for f in documents.schema.fields if f.name not in ("text", "fingerprint")]
    schema = T.StructType([*fields, T.StructField("fingerprint", T.LongType())])

    def run(batches):
        for part, texts in shards(batches, "text"):
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], pa.array(prints)], names=schema.names)

    return documents.select(*[f"`{f.name}`" for f in fields], "text").mapInArrow(run, schema)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def embed(f: np.ndarray) -> np.ndarray:
    """Bit counts of the 2-bit segments, packed in 2 bits each."""
    return f - ((f >> np.uint64(1)) & np.uint64(0x5555555555555555))


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of packed bit counts (0 to 2): over the segments, 2 where 0 meets 2 and 1 where 1 meets another."""
    odd = np.uint64(0x5555555555555555)
    d = x ^ y
    ones = d & odd  # 1 against 0 or 2
    return np.bitwise_count(ones).astype(np.int64) + 2 * np.bitwise_count((d >> np.uint64(1)) & odd & ~ones).astype(np.int64)


def _axes(free: list[int]) -> list[list[int]]:
    """Free bits (or segments) in four axes."""
    n = len(free) // 4
    return [free[i * n : (i + 1) * n] for i in range(4)]


def refine(fixed: int) -> list[int]:
    """Masks of the bits fixed in the six cells that two of four axes of the free bits span; `fixed` are equal already."""
    axes = [sum(1 << b for b in a) for a in _axes([b for b in range(64) if not fixed >> b & 1])]
    return [fixed | axes[i] | axes[j] for i in range(4) for j in range(i + 1, 4)]


def cells(f: np.ndarray, fixed: int) -> list[tuple[int, np.ndarray]]:
    """The next grid in a cell: of each mask, the cell of each fingerprint (the fixed bits themselves)."""
    return [(m, f & np.uint64(m)) for m in refine(fixed)]


def cell_links(keys: np.ndarray, f: np.ndarray, fixed: int = 0, bits: int = BITS, crowd: int = CROWD) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) between fingerprints of each cell; rows are sorted by cell.

    A cell of more than `crowd` rows is a grid of its own, over what its rows do not share by definition; with 60
    bits fixed 16 distinct fingerprints remain, so every cell gets small enough to compare its pairs.
    """
    n = len(f)
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if n else np.zeros(0, int)
    sizes = np.diff(np.append(new, n))
    size = np.repeat(sizes, sizes)
    small = (size <= crowd) | (fixed.bit_count() >= 60)
    e = embed(f)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(size[small].max(initial=0))):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        i = i[manhattan(e[i], e[i + d]) <= bits]
        i = i[np.bitwise_count(f[i] ^ f[i + d]) <= bits]
        left.append(i)
        right.append(i + d)
    at = np.flatnonzero(~small)
    if len(at):
        cell = np.repeat(np.arange(len(sizes)), sizes)[at]
        for mask, value in cells(f[at], fixed):
            order = np.lexsort((value, cell))
            c, v = cell[order], value[order]
            key = np.cumsum(np.append(0, (c[1:] != c[:-1]) | (v[1:] != v[:-1])))
            a, b = cell_links(key, f[at][order], mask, bits, crowd)
            left.append(at[order][a])
            right.append(at[order][b])
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) that join all linked fingerprints of distinct (fingerprint).

    Cells of more than `split` rows become the cells of the next grid before they are dealt out, so that no task gets
    more than that of one cell; levels end where 60 bits are fixed.
    """
    half = F.shiftrightunsigned("fingerprint", 1)
    odd = F.lit(0x5555555555555555)
    counts = F.shiftleft(half.bitwiseAND(F.col("fingerprint")).bitwiseAND(odd), 1).bitwiseOR(half.bitwiseXOR(F.col("fingerprint")).bitwiseAND(odd))
    axes = [F.shiftrightunsigned("e", 16 * i).bitwiseAND(F.lit(65535)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    grid = F.array(*[F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(F.shiftleft(axes[i], 16)).bitwiseOR(axes[j]) for k, (i, j) in enumerate(pairs)])
    rows = distinct.withColumn("e", counts).select(F.lit(0).cast("long").alias("fixed"), F.explode(grid).alias("cell"), "fingerprint")

    def deeper(batches):
        """A row for each cell of the next grid; `cell` is a hash of the way there."""
        for batch in batches:
            fixed, cell, f = (batch.column(i).to_numpy() for i in range(3))
            f, cell = f.view(np.uint64), cell.view(np.uint64)
            for own in np.unique(fixed):
                on = np.flatnonzero(fixed == own)
                for mask, value in cells(f[on], int(own) % 2**64):
                    way = _mixed(_mixed(cell[on] ^ np.uint64(mask)) + value)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), mask, np.uint64).view(np.int64)), pa.array(way.view(np.int64)), pa.array(f[on].view(np.int64))], names=["fixed", "cell", "fingerprint"])

    out = None
    while True:
        crowded = materialize(rows.groupBy("fixed", "cell").agg(F.count("*").alias("n")).where((F.col("n") > split) & (F.bit_count("fixed") < 60)).select("fixed", "cell"), "cells")
        last = crowded.isEmpty()
        now = rows if last else rows.join(crowded, ["fixed", "cell"], "left_anti")
        found = _linked(now)
        out = found if out is None else out.unionAll(found)
        if last:
            return out
        rows = materialize(rows.join(crowded, ["fixed", "cell"], "left_semi").select("fixed", "cell", "fingerprint").mapInArrow(deeper, "fixed bigint, cell bigint, fingerprint bigint"), "grid")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _linked(rows: DataFrame) -> DataFrame:
    """Edges (a, b) within the cells of rows (fixed, cell, fingerprint): each cell's stars around the smallest member."""

    def run(batches):
        kept: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            fixed, cell, f = (table.column(c).to_numpy() for c in ("fixed", "cell", "fingerprint"))
            f = f.view(np.uint64)
            for own in np.unique(fixed):
                on = np.flatnonzero(fixed == own)
                a, b = cell_links(cell[on], f[on], int(own) % 2**64)
                if len(a):
                    used, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
                    root = _roots(len(used), flat[: len(a)], flat[len(a) :])
                    member = f[on][used]
                    least = member.copy()
                    np.minimum.at(least, root, member)
                    out = np.flatnonzero(least[root] != member)
                    yield pa.RecordBatch.from_pydict({"a": member[out].view(np.int64), "b": least[root][out].view(np.int64)})

        for batch in batches:  # rows are sorted by cell: the last cell of a batch may go on in the next
            if not batch.num_rows:
                continue
            cell = batch.column(1).to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))
            if cut:
                yield from flush(pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks())
                kept = [batch.slice(cut)]
            elif kept and kept[0].column(1)[0].as_py() != cell[0]:
                yield from flush(pa.Table.from_batches(kept).combine_chunks())
                kept = [batch]
            else:
                kept.append(batch)
        if kept:
            yield from flush(pa.Table.from_batches(kept).combine_chunks())

    return rows.select("fixed", "cell", "fingerprint").repartition("cell").sortWithinPartitions("cell", "fixed").mapInArrow(run, "a bigint, b bigint")


def groups(prints: DataFrame) -> DataFrame:
    """fingerprint, group (the smallest fingerprint reachable, as a signed long) and component_id of each distinct fingerprint of prints (doc_id, fingerprint)."""
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "distinct")
    joined = connected_components(links(distinct.select("fingerprint")))
    rooted = distinct.join(joined, distinct.fingerprint == joined.node, "left").select("fingerprint", "rep", F.coalesce("component", "fingerprint").alias("group"))
    return rooted.join(rooted.groupBy("group").agg(F.min("rep").alias("component_id")), "group").select("fingerprint", "group", "component_id")


def simhash_components(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (long), component_id for each row of documents (doc_id, text)."""
    prints = materialize(fingerprints(documents.select("doc_id", "text")), "fingerprints")
    return prints.join(groups(prints), "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of documents (doc_id, text, ...) of each group of linked fingerprints.

    It is the row of the smallest doc_id (rows without one come last), then of the smallest hash of its text; of
    rows that are equal in both, any one.
    """
    id_, text = F.col("doc_id"), F.xxhash64("text")
    place = F.when(id_.isNull(), F.bitwise_not(text)).otherwise(text)  # so that null ids are keys, too
    prints = materialize(fingerprints(documents.select("doc_id", "text", text.alias("text_key"))), "fingerprints")
    least = prints.groupBy("fingerprint").agg(F.min(F.struct(id_.isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    first = least.join(groups(prints), "fingerprint").groupBy("group").agg(F.min("first").alias("first")).select("first.*")
    zero = F.lit(0).cast(documents.schema["doc_id"].dataType)
    first = first.select(F.coalesce("doc_id", zero).alias("_id"), F.when(F.col("none"), F.bitwise_not("text_key")).otherwise(F.col("text_key")).alias("_place"))
    # the rows stand apart in one struct, so that no name of theirs meets one of these
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own"), F.coalesce(id_, zero).alias("_id"), place.alias("_place"))
    return rows.join(first, ["_id", "_place"], "left_semi").dropDuplicates(["_id", "_place"]).select(*[F.col("own").getField(c).alias(c) for c in documents.columns])


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
