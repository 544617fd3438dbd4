"""Benchmark decontamination: FM-index per training shard, searched backwards for the windows of test items.

A shard (about 8 MB of text) is turned into word ids of the benchmark's vocabulary.  A window can only lie in
a run of words in which every adjacent pair is a pair of the benchmark, so only runs that are as long as the
shortest window enter the index; this drops no occurrence.  The index: suffix array by prefix doubling, its
Burrows-Wheeler transform in a wavelet matrix with a rank for every 64 bits, and every eighth text position as a
sample.  All
windows are searched at once, last word first; the rows that remain walk to the next sample for their place.
Hit words merge into maximal spans.

The benchmark is taken in parts of at most MAX_ITEM_BYTES of text; each part is one pass over the documents,
written before the next part is read, so the driver and what is sent to the executors hold one part, however many there are.

Nulls and odd rows: null and empty texts have no words; items without words have no window; an item_id that
is null marks words, but isn't listed; repeated items count once; repeated documents are each returned; an empty table of
documents gives no row, an empty benchmark hits nothing; columns named like the new ones are replaced, all others pass.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, shards

WINDOW, SAMPLE, MAX_ITEM_BYTES = 10, 8, 16 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Bits:
    """Bits with ranks: 64 in a word, and one count of ones for each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros(len(bits) // 64 * 8 + 8, np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8").astype(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Index:
    """FM-index of a sequence of ids from 1 to sigma - 1; 0 is kept for the end.

    It holds the transform as a wavelet matrix of ranked bits, the first row of each id, which rows have a sampled
    text position (every sample-th), and those positions; neither the suffix array nor the sequence.
    """

    def __init__(self, sequence: np.ndarray, sigma: int, sample: int = SAMPLE):
        s = np.append(sequence, 0).astype(np.int64)
        n = self.n = len(s)
        rank, k = s, 1
        while True:  # prefix doubling
            after = np.zeros(n, np.int64)
            after[: max(0, n - k)] = rank[k:] + 1
            key = rank * (n + sigma + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
            rank, k = new, 2 * k
            if k >= n or rank[order[-1]] == n - 1:
                break
        sampled = order % sample == 0
        self.sampled, self.places = Bits(sampled), order[sampled]
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(s, minlength=sigma), out=self.first[1:])
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        x = s[order - 1]
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level) & 1 == 1
            self.ones.append(Bits(bit))
            self.zeros.append(n - int(bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before i in the transform."""
        begin, i = np.zeros(len(i), np.int64), i.copy()
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (c >> (self.levels - 1 - k)) & 1 == 1
            one_i, one_b = ones.rank(i), ones.rank(begin)
            i, begin = np.where(bit, zeros + one_i, i - one_i), np.where(bit, zeros + one_b, begin - one_b)
        return i - begin

    def access(self, i: np.ndarray) -> np.ndarray:
        c, i = np.zeros(len(i), np.int64), i.copy()
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one, bit = ones.rank(i), ones[i]
            c, i = 2 * c + bit, np.where(bit, zeros + one, i - one)
        return c

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of patterns (rows of one length): which occur, and the first and last + 1 row of the suffix array."""
        alive = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array, by steps to the next sampled one."""
        at, steps, todo = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(todo := todo[~self.sampled[at[todo]]]):
            c = self.access(at[todo])
            at[todo] = self.first[c] + self.rank(c, at[todo])
            steps[todo] += 1
        return self.places[self.sampled.rank(at)] + steps


class Phrases:
    """Windows of a part of the benchmark as ids, with the items that hold them."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        owners: defaultdict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners[tuple(w[i : i + window])] |= {str(item)} if item is not None else set()
        by: defaultdict[int, list] = defaultdict(list)
        for p in sorted(owners):
            by[len(p)].append((p, sorted(owners[p])))
        self.groups = [(np.array([p for p, _ in g], np.int64), [o for _, o in g]) for _, g in sorted(by.items())]
        self.base = len(self.ids) + 1
        self.pairs = np.unique(np.concatenate([(p[:, :-1] * self.base + p[:, 1:]).ravel() for p, _ in self.groups] or [np.zeros(0, np.int64)]))
        self.shortest = min((p.shape[1] for p, _ in self.groups), default=1)

    def hits(self, lists: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
        """Of each text the spans of hit words (begin, end), and the items that hit it."""
        none = (np.zeros((0, 2), np.int64), set())
        out = [none] * len(lists)
        bounds = np.cumsum([0, *map(len, lists)])
        get = self.ids.get
        flat = np.fromiter((get(w, 0) for x in lists for w in x), np.int64, int(bounds[-1]))
        n = len(flat)
        if not n or not self.groups:
            return out
        linked = np.zeros(n + 1, bool)  # a word and its predecessor are a pair of the benchmark
        key = flat[:-1] * self.base + flat[1:]
        both = np.flatnonzero((flat[:-1] > 0) & (flat[1:] > 0))
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key[both]), len(self.pairs) - 1)
            linked[both[self.pairs[at] == key[both]] + 1] = True
        linked[bounds] = False
        known = flat > 0
        begin = np.flatnonzero(known & ~linked[:n])
        end = np.flatnonzero(known & ~np.append(linked[1:n], False)) + 1
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        if not len(begin):
            return out
        length = end - begin + 1  # a separator after each run
        start = np.cumsum(length) - length
        place = np.repeat(begin - start, length) + np.arange(int(length.sum()))
        sequence = flat[np.minimum(place, n - 1)]
        sequence[start + length - 1] = self.base  # no pattern holds it
        index = Index(sequence, self.base + 1)
        edge = np.zeros(n + 1, np.int64)
        owners: defaultdict[int, set[str]] = defaultdict(set)
        for patterns, names in self.groups:
            which, low, high = index.search(patterns)
            if not len(which):
                continue
            count = high - low
            rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            word = place[index.locate(rows)]
            np.add.at(edge, word, 1)
            np.add.at(edge, word + patterns.shape[1], -1)
            doc = np.searchsorted(bounds, word, "right") - 1
            found = np.unique(doc * len(patterns) + np.repeat(which, count))
            for d, p in zip((found // len(patterns)).tolist(), (found % len(patterns)).tolist(), strict=True):
                owners[d].update(names[p])
            out = [(x[0], owners[i]) if i in owners else x for i, x in enumerate(out)]
        cover = np.cumsum(edge)[:n] > 0
        for d in np.unique(np.searchsorted(bounds, np.flatnonzero(cover), "right") - 1).tolist():
            own = np.concatenate([[False], cover[bounds[d] : bounds[d + 1]], [False]])
            out[d] = (np.stack([np.flatnonzero(~own[:-1] & own[1:]), np.flatnonzero(own[:-1] & ~own[1:])], 1), owners[d])
        return out


def parts(benchmark: DataFrame, max_bytes: int = MAX_ITEM_BYTES):
    """The items in parts of bounded size, read one part at a time."""
    sized = benchmark.select("item_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    total = sized.agg(F.sum("size"), F.count("*")).first()
    n = int(max(total[0] or 0, 64 * total[1]) // (max_bytes // 2)) + 1
    for k in range(n):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text").collect()
        yield sorted(((r[0], (r[1] or "").encode()) for r in rows), key=str)


def cut(text: bytes, spans: np.ndarray) -> str:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans.tolist():
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]]).decode("utf-8", "ignore")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents with n_words, n_hit, items (sorted ids), spans (hit words from, to) and clean_text.

    Columns of those names are replaced.
    """
    new = T.StructType.fromDDL("n_words bigint, n_hit bigint, items array<string>, spans array<array<bigint>>, clean_text string")
    keep = [f for f in documents.schema.fields if f.name not in new.names]
    schema = T.StructType([*keep, *new.fields])
    start = documents.select(*[f"`{f.name}`" for f in keep], F.lit(None).cast("bigint").alias("n_words"), F.lit(None).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<array<bigint>>").alias("spans"), F.lit(None).cast("string").alias("clean_text"))
    out, written = start, None
    for items in parts(benchmark):
        if out is not start:  # a part before this one
            before, written = written, materialize(out, "decontaminated")
            out = written
            if before is not None:
                release(before)
        phrases = Phrases(items, window)

        def run(batches, phrases=phrases):
            for part, texts in shards(batches, "text"):
                lists = [words(t) for t in texts]
                found = phrases.hits(lists)
                was = part.column("spans").to_pylist()
                names = part.column("items").to_pylist()
                spans, hit, ids, clean = [], [], [], []
                for (own, who), old, known, text in zip(found, was, names, texts, strict=True):
                    if old:  # from an earlier part of the benchmark
                        both = sorted([*old, *own.tolist()])
                        merged = [both[0]]
                        for a, b in both[1:]:
                            if a <= merged[-1][1]:
                                merged[-1] = [merged[-1][0], max(b, merged[-1][1])]
                            else:
                                merged.append([a, b])
                        own = np.array(merged)
                    spans.append(own.tolist())
                    hit.append(int((own[:, 1] - own[:, 0]).sum()))
                    ids.append(sorted({*known, *who}))
                    clean.append(cut(text, own) if len(own) else None)
                texts_out = part.column("text").to_pylist()
                clean = [t if c is None else c for c, t in zip(clean, texts_out, strict=True)]
                columns = dict(zip(part.schema.names, part.columns, strict=True)) | {"n_words": pa.array(map(len, lists), pa.int64()), "n_hit": pa.array(hit, pa.int64()), "items": pa.array(ids, pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "clean_text": pa.array(clean, pa.string())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        out = out.mapInArrow(run, schema)
    return out


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')".replace("{80}", "{{80}}").replace("{10FFFF}", "{{10FFFF}}")
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM b WHERE len(w) > 0)),
x AS (SELECT n, k, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT n, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM i))),
h AS (SELECT n, k, x.m, item_id FROM x JOIN i ON x.s = i.s AND x.m = i.m),
c AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(k, k + m)) AS p FROM h) GROUP BY n),
t AS (SELECT n, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM h GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (n) LEFT JOIN t USING (n)
"""
