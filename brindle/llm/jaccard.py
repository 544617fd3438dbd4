"""N-gram Jaccard join: sets of word shingles, linked at 100 * intersection >= PERCENT * union, by prefix trees.

A document's set holds the hashes (64 bits) of its distinct WORDS-word shingles; equal sets are one class from the
start.  The steps, all exact:

1. Candidates.  Of each set the PART smallest hashes are looked at.  Below the smaller of two such bounds both sets are
   known, and linked sets differ there by no more than they differ in all, so a set can only have links if at least
   `need(n)` of its looked-at hashes occur in another set, too.  Hashes are combined within a shard of text before
   they are dealt out, so a hash of very many documents is one row a shard.
2. The sets that remain are read whole; of their shingles, those that no other of them holds come first in the global
   order (they count as misses), the others follow by hash.  Linked sets share a shingle within their first
   n - ceil(PERCENT * n / 100) + 1.
3. A set is due at a shingle of that prefix if another set there has none of its earlier prefix shingles: each pair
   is met where its first common shingle is.  Only what is due is dealt out whole.  A shingle before which all its sets have
   the same prefix shingle has nothing due and is told by that one alone, without the list of the earlier ones.
4. In each group the rest of the sets, from the group's shingle on, is stored in a trie (compressed: a segment of
   shingles up to the next fork).  A set walks down the trie; the overlap with a segment is counted once for all sets
   below it, and a subtree goes when overlap so far plus the shorter remaining length cannot reach what the smallest
   set below needs, or when all sets below are in the walking set's class already: they cannot change the classes.
5. Groups of over LIMIT sets are cut into slices that meet in pairs, one pair a task.

Hash collisions are the only way to a wrong answer: within a pair of sets of n shingles about n^2 / 2^64.

Nulls and odd rows: doc_id is of any type that has an order.  A null text, an empty one and one without words have an
empty set (0) and are linked with nothing, not even with each other; fewer than WORDS words are one shingle, which
equals no longer one.  Rows with equal doc_id are each returned; a null doc_id is returned with its class, but names
none.  An empty table gives no row; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, materialize, release, shards, word_ids

WORDS, PERCENT = 4, 85
PART = 0.25  # share of a set's hashes that the first step looks at; above 1 - PERCENT / 100
LIMIT = 2048  # sets of a group in one task
FEW = 1 << 20  # survivors (two longs each) that are broadcast at most; more are joined by a shuffle


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles."""
    lists = [t.lower().split() for t in texts]  # bytes: A-Z and ASCII white space only
    flat, bounds, known = word_ids(lists)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[flat]
    n = max(0, len(hashes) - words + 1)
    h = hashes[:n].copy()
    for i in range(1, words):
        h = _mixed(h) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n + i]
    h = _mixed(h)
    out = []
    for i, w in enumerate(lists):
        if len(w) >= words:
            out.append(np.unique(h[bounds[i] : bounds[i + 1] - words + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(w), words)] if w else [], np.uint64))
    return out


def lost(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shingles of a set of n that a linked one may lack."""
    return n - -(-percent * n // 100)


def overlap(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Least intersection of linked sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def looked_at(n: np.ndarray, part: float = PART) -> np.ndarray:
    return np.minimum(n, (part * n).astype(np.int64) + 1)


def need(n: np.ndarray, percent: int = PERCENT, part: float = PART) -> np.ndarray:
    """Looked-at shingles that a set with a link shares at least.

    The smaller of two bounds may be either set's; both counts are least at the ends of the lengths that can link (but for
    rounding, for which two are taken off).
    """
    least, most = -(-percent * n // 100), 100 * n // percent
    own = looked_at(n, part) - n + overlap(n, least, percent)
    other = looked_at(most, part) - most + overlap(n, most, percent)
    return np.maximum(1, np.minimum(own, other) - 2)


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) ^ np.int64(-(1 << 63))  # keeps the order


def digests(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, place (hash of the text), h1, h2 (digest of the set) and n (its size) of each row."""
    kind = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("place", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("h1", "h2", "n")]])

    def run(batches):
        for part, texts in shards(batches, "text"):
            sets = shingle_sets(texts, words)
            both = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([len(s) for s in sets], pa.int64())], names=schema.names)

    return documents.select("doc_id", F.xxhash64("text").alias("place"), "text").mapInArrow(run, schema)


def _looked_at_rows(documents: DataFrame, words: int, part: float) -> DataFrame:
    """Rows (kind, a, b): 0: shingle a in set b of this shard alone; 1: shingle a in several sets of a shard; 2: set a has b shingles of that sort."""

    def run(batches):
        for _, texts in shards(batches, "text"):
            sets = {_digest(s)[0]: s for s in shingle_sets(texts, words) if len(s)}
            if not sets:
                continue
            n = np.array([len(s) for s in sets.values()])
            own = np.repeat(np.arange(len(n)), looked_at(n, part))
            ids = np.fromiter(sets, np.int64, len(n))
            found, first, back, count = np.unique(np.concatenate([s[:k] for s, k in zip(sets.values(), looked_at(n, part), strict=True)]), return_index=True, return_inverse=True, return_counts=True)
            several = count > 1
            hits = np.bincount(own, several[back], len(n)).astype(np.int64)
            kind = np.concatenate([np.where(several, 1, 0), np.full(np.count_nonzero(hits), 2)]).astype(np.int8)
            a = np.concatenate([_signed(found), ids[hits > 0]])
            b = np.concatenate([np.where(several, 0, ids[own[first]]), hits[hits > 0]])
            for at in range(0, len(a), 1 << 18):
                yield pa.RecordBatch.from_pydict({c: pa.array(x[at : at + (1 << 18)]) for c, x in (("kind", kind), ("a", a), ("b", b))})

    return documents.select("text").mapInArrow(run, "kind tinyint, a bigint, b bigint")


def _in_several(batches: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows (token, set, known), sorted by token, those (token, set) whose token has several sets or a row that is known.

    Of a run that goes on in the next batch, only its token and, while it has one set, that set are kept.
    """
    last, several, only, rows = None, False, 0, 0
    for token, owner, known in batches:
        if not len(token):
            continue
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        length = np.diff(np.append(start, len(token)))
        low, high = np.minimum.reduceat(owner, start), np.maximum.reduceat(owner, start)
        many = (low != high) | np.logical_or.reduceat(known, start)
        if last is not None and token[0] == last:
            many[0] |= several or (rows > 0 and low[0] != only)
            if many[0] and rows:
                yield np.full(rows, last), np.full(rows, only)
                rows = 0
        else:
            rows = 0
        keep = np.repeat(many, length) & ~known
        if keep.any():
            yield token[keep], owner[keep]
        fresh = last is None or token[-1] != last
        last, several = token[-1], bool(many[-1])
        rows = 0 if several else (0 if fresh else rows) + int(length[-1])
        only = owner[-1]


def _survivors(documents: DataFrame, classes: DataFrame, words: int, percent: int, part: float) -> DataFrame:
    """node, place, of one row of each class (h1, h2, n, first) that may have links."""
    rows = materialize(_looked_at_rows(documents, words, part), "looked_at")

    def credits(batches):
        parts = ((b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(0).to_numpy() == 1) for b in batches)
        for _, owner in _in_several(parts):
            ids, n = np.unique(owner, return_counts=True)
            yield pa.RecordBatch.from_pydict({"h1": ids, "hits": n.astype(np.int64)})

    met = rows.where("kind < 2").repartition("a").sortWithinPartitions("a").mapInArrow(credits, "h1 bigint, hits bigint")
    hits = met.unionAll(rows.where("kind = 2").select(F.col("a").alias("h1"), F.col("b").alias("hits"))).groupBy("h1").agg(F.sum("hits").alias("hits"))
    n = F.col("n")
    ceil = lambda c, by: F.expr(f"({c} + {by} - 1) div {by}")
    seen = lambda c: F.least(c, (part * c).cast("long") + 1)
    least, most = ceil(f"{percent} * n", 100), F.expr(f"100 * n div {percent}")
    shared = lambda m: F.ceil((percent * (n + m)) / (100 + percent)).cast("long")
    wanted = F.greatest(F.lit(1), F.least(seen(n) - n + shared(least), seen(most) - most + shared(most)) - 2)
    out = materialize(classes.join(hits, "h1").where(F.col("hits") >= wanted).select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n", "first"), "survivors")
    release(rows)
    return out


def _whole_sets(documents: DataFrame, rows: DataFrame, survivors: DataFrame, words: int) -> DataFrame:
    """node, tokens of each survivor, read from the text of one of its rows; rows: doc_id and place of all.

    Only where several rows have the same address (id and text) are whole sets dealt out to keep one.
    """
    zero = F.lit(0).cast(documents.schema["doc_id"].dataType)
    key = lambda id_, place: (F.coalesce(id_, zero).alias("i"), F.when(id_.isNull(), F.bitwise_not(place)).otherwise(place).alias("p"))
    asked = survivors.select("node", *key(F.col("first.doc_id"), F.col("first.place")))
    if survivors.count() <= FEW:
        asked = F.broadcast(asked)
    again = rows.select(*key(F.col("doc_id"), F.col("place"))).join(asked, ["i", "p"]).groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1")
    texts = documents.select(*key(F.col("doc_id"), F.xxhash64("text")), "text").join(asked, ["i", "p"]).select("node", "text")

    def run(batches):
        for batch, texts in shards(batches, "text"):
            for node, s in zip(batch.column(0).to_pylist(), shingle_sets(texts, words), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([_signed(s)], pa.list_(pa.int64()))], names=["node", "tokens"])

    sets = texts.mapInArrow(run, "node bigint, tokens array<bigint>")
    return sets if again.isEmpty() else sets.dropDuplicates(["node"])


def _shared_tokens(sets: DataFrame) -> DataFrame:
    """node, tokens: of each set the sorted tokens that another one holds, too."""

    def run(batches):
        for token, node in _in_several((b.column(0).to_numpy(), b.column(1).to_numpy(), np.zeros(b.num_rows, bool)) for b in batches):
            yield pa.RecordBatch.from_pydict({"node": node, "token": token})

    rows = sets.select(F.explode("tokens").alias("token"), "node")
    found = rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, "node bigint, token bigint")
    return found.groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("tokens"))


def _cells(kept: DataFrame, limit: int) -> DataFrame:
    """token, x, y, node, at of the prefixes (node, prefix): the cells of each token, slices of about `limit` nodes that meet in pairs.

    Where all nodes of a token have the same prefix shingle before it, all their pairs meet there or earlier, and it has no cells.
    """
    entries = kept.select("node", "prefix", F.posexplode("prefix").alias("at", "token")).select("token", "node", "at", F.get("prefix", F.col("at") - 1).alias("before"))
    fresh = (F.count("before") < F.count("*")) | (F.min("before") != F.max("before"))
    counts = entries.groupBy("token").agg(F.count("*").alias("sets"), fresh.alias("fresh")).where("sets > 1 and fresh").drop("fresh")
    slices = F.ceil(F.col("sets") / limit).cast("int")
    own = F.pmod(F.xxhash64("node"), slices).cast("int")
    to = F.transform(F.sequence(F.lit(0), slices - 1), lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))
    return entries.drop("before").join(counts, "token").withColumn("cell", F.explode(to)).select("token", "cell.x", "cell.y", "node", "at")


def _groups(batches: Iterable[pa.RecordBatch], keys: int = 3) -> Iterator[pa.Table]:
    """The rows of each key (the first columns); rows are sorted by it."""
    held: list[pa.RecordBatch] = []

    def key(b, i):
        return tuple(b.column(k)[i].as_py() for k in range(keys))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        if held and key(held[0], 0) != key(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *new], [*new, n], strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def due_rows(n: np.ndarray, at: np.ndarray, earlier: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which sets of a group have another there with none of their earlier tokens, and of a length and place that may link."""
    room = n[:, None] + n[None, :] - 2 * overlap(n[:, None], n[None, :], percent)
    may = at[:, None] + at[None, :] <= room
    np.fill_diagonal(may, False)
    flat = np.concatenate(earlier)
    if len(flat) and may.any():
        known, ids = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(n)), [len(e) for e in earlier])
        for low in range(0, len(known), 2048):
            on = (ids >= low) & (ids < low + 2048)
            m = np.zeros((len(n), min(2048, len(known) - low)), np.float32)
            m[owner[on], ids[on] - low] = 1
            may &= (m @ m.T) == 0
    return may.any(1)


class Trie:
    """Sets of ranks (sorted arrays) as a compressed prefix tree; sets stand in the order of their ranks."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.order, self.sets, self.sizes = np.array(order), [sets[i] for i in order], sizes[order]
        self.lengths = np.array([len(s) for s in self.sets])
        self.base = np.append(0, np.cumsum(self.lengths))
        self.flat = np.concatenate(self.sets) if sets else np.zeros(0, np.int64)
        low, start, end, parent, owner, high = [0], [0], [0], [-1], [-1], [0]
        stack = [0]
        for i, s in enumerate(self.sets):
            common = 0
            if i:
                p = self.sets[i - 1]
                m = min(len(p), len(s))
                differ = p[:m] != s[:m]
                common = int(differ.argmax()) if differ.any() else m
            while end[stack[-1]] > common:
                top = stack.pop()
                high[top] = i
                if end[stack[-1]] < common:  # fork within the segment: its upper part is a node of its own
                    low.append(low[top]), start.append(start[top]), end.append(common), parent.append(stack[-1]), owner.append(-1), high.append(0)
                    start[top], parent[top] = common, len(low) - 1
                    stack.append(len(low) - 1)
            low.append(i), start.append(common), end.append(len(s)), parent.append(stack[-1]), owner.append(i), high.append(0)
            stack.append(len(low) - 1)
        for top in stack:
            high[top] = len(self.sets)
        self.low, self.high, self.start, self.end, self.owner = (np.array(x) for x in (low, high, start, end, owner))
        parents = np.array(parent)
        self.children = np.argsort(parents, kind="stable")[1:]  # without the root
        self.first = np.searchsorted(parents[self.children], np.arange(len(low) + 1))
        spread = lambda f, x: np.array([f(x[a:b]) if b > a else 0 for a, b in zip(self.low, self.high, strict=True)])
        self.least, self.longest = spread(np.min, self.sizes), spread(np.max, self.lengths)

    def below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of the nodes, and for each which node it is a child of (by place)."""
        at, count = _spread(self.first[nodes], self.first[nodes + 1] - self.first[nodes])
        return self.children[at], np.repeat(np.arange(len(nodes)), count)

    def walk(self, i: int, classes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Sets after the i-th that are linked with it, but for those below nodes of its own class alone."""
        s, size = self.sets[i], self.sizes[i]
        held = np.zeros(int(self.flat.max()) + 1, bool)
        held[s] = True
        same = np.append(0, np.cumsum(classes == classes[i]))
        found = []
        nodes, which = self.below(np.array([0]))
        shared = np.zeros(len(nodes), np.int64)
        while len(nodes):
            rest = self.longest[nodes] - self.start[nodes]
            begin = self.flat[np.minimum(self.base[self.low[nodes]] + self.start[nodes], len(self.flat) - 1)]
            own = np.where(rest > 0, len(s) - np.searchsorted(s, begin), 0)
            low, high = np.maximum(self.low[nodes], i + 1), self.high[nodes]
            live = (high > low) & (shared + np.minimum(own, rest) >= overlap(size, self.least[nodes], percent))
            live &= same[high] - same[np.minimum(low, high)] < high - low
            nodes, shared = nodes[live], shared[live]
            at, count = _spread(self.base[self.low[nodes]] + self.start[nodes], self.end[nodes] - self.start[nodes])
            hits = np.append(0, np.cumsum(held[self.flat[at]]))
            ends = np.cumsum(count)
            shared = shared + hits[ends] - hits[ends - count]
            owner = self.owner[nodes]
            sets = owner > i
            ok = sets & (shared >= overlap(size, self.sizes[owner], percent))
            found.append(owner[ok])
            nodes, which = self.below(nodes)
            shared = shared[which]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ...; and the counts."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - count), count), count


def trie_links(tokens: list[np.ndarray], sizes: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (positions) that join all linked sets of the group into their classes."""
    known, ids = np.unique(np.concatenate(tokens), return_inverse=True)
    bounds = np.append(0, np.cumsum([len(t) for t in tokens]))
    trie = Trie([ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], sizes)
    classes = np.arange(len(tokens))
    out = []
    for i in range(len(tokens)):
        for j in trie.walk(i, classes, percent):
            if classes[j] != classes[i]:
                classes[classes == classes[j]] = classes[i]
                out.append((int(trie.order[i]), int(trie.order[j])))
    return out


def set_links(sets: DataFrame, shared: DataFrame, percent: int = PERCENT, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) that join the linked sets (node, n); shared: their tokens that several have."""
    n = F.col("n")
    misses = n - F.floor((percent * n + 99) / 100)
    alone = n - F.size("tokens")  # shingles of this set only: the first of its prefix
    kept = sets.join(shared, "node").withColumn("prefix", F.slice("tokens", 1, F.greatest(F.lit(0), misses + 1 - alone).cast("int"))).select("node", "n", alone.alias("alone"), "prefix", "tokens")
    kept = materialize(kept.where(F.size("prefix") > 0), "prefixes")
    fields = ["token", "x", "y", "node", "n", "place", "earlier"]
    cells = _cells(kept, limit).join(kept.select("node", "n", "alone", "prefix"), "node").withColumns({"place": F.col("at") + F.col("alone"), "earlier": F.slice("prefix", 1, F.col("at"))})

    def due(batches):
        for g in _groups(batches):
            if g.num_rows > 1:
                found = due_rows(g.column("n").to_numpy(), g.column("place").to_numpy(), [np.array(x, np.int64) for x in g.column("earlier").to_pylist()], percent)
                if found.any():
                    yield from g.select(fields[:4]).filter(pa.array(found)).combine_chunks().to_batches()

    asked = cells.select(*fields).repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(due, "token bigint, x int, y int, node bigint")
    after = F.filter("tokens", lambda t: t >= F.col("token"))  # the first of them is the group's own
    whole = asked.join(kept.select("node", "n", "tokens"), "node").select("token", "x", "y", "node", "n", after.alias("rest"))

    def links(batches):
        for g in _groups(batches):
            node = g.column("node").to_numpy()
            rest = g.column("rest").combine_chunks()
            flat, ends = rest.flatten().to_numpy(), np.append(0, np.cumsum(np.asarray(pa.compute.list_value_length(rest))))
            pairs = trie_links([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], g.column("n").to_numpy(), percent)
            if pairs:
                i, j = np.array(pairs).T
                yield pa.RecordBatch.from_pydict({"a": node[i], "b": node[j]})

    return whole.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(links, "a bigint, b bigint")


def jaccard_components(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, part: float = PART, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of documents (doc_id, text)."""
    documents = documents.select("doc_id", "text")
    rows = materialize(digests(documents, words), "sets")
    id_ = F.col("doc_id")
    first = F.min(F.struct(id_.isNull().alias("none"), "doc_id", "place")).alias("first")
    classes = materialize(rows.where("n > 0").groupBy("h1", "h2", "n").agg(first), "classes")
    survivors = _survivors(documents, classes, words, percent, part)
    whole = materialize(_whole_sets(documents, rows, survivors, words), "tokens")
    joined = connected_components(set_links(survivors.select("node", "n"), _shared_tokens(whole), percent, limit))
    named = survivors.join(joined, "node").select("h1", "h2", F.col("first.doc_id").alias("id"), "component")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    moved = named.join(least, "component").select("h1", "h2", "component_id")
    of = classes.join(moved, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("component_id", "first.doc_id").alias("component_id"))
    return rows.where("n > 0").join(of, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionAll(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), id_.alias("component_id")))


def op12_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words),
classes AS (SELECT list_sort(s) AS s, min(r) AS c, min(doc_id) AS id FROM sets WHERE len(s) > 0 GROUP BY 1),
tokens AS (SELECT c, len(s) AS n, unnest(s) AS t FROM classes),
pairs AS (
  SELECT a.c AS a, b.c AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
near AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
named AS (SELECT c.s, least(c.id, coalesce(min(o.id), c.id)) AS component_id FROM classes c LEFT JOIN reach ON reach.a = c.c LEFT JOIN classes o ON o.c = reach.b GROUP BY c.s, c.c, c.id)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id
FROM sets LEFT JOIN named ON list_sort(sets.s) = named.s
"""
