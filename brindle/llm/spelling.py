"""Spelling variants: words one edit apart, found through forward and backward minimal acyclic automata.

A word v of T code points is a first half of T // 2 code points and a second half.  One edit leaves one half whole: a word
w near v begins with v's first half or ends with its second.  So v is indexed under (T, first half), forward, and
(T, second half), backward, and w asks for T one less than its length, equal and one more.  Rows meet by that key;
a task takes whole keys, in shards of about SHARD rows.

For the words of each length a shard has a minimal acyclic automaton (reversed words in the backward one), built layer by
layer from the end: nodes with equal edges are one state.  Each edge holds how many words go before it, so a path adds up
to the word's number in order: a perfect hash.  All askers walk at once: the half exactly, then from each place on
the way an edge that is not the asker's letter (replaced), any edge with the letter kept (inserted) or no edge with the letter
skipped (deleted), then the rest exactly.  Numbers found twice are one; a word found backward whose first half the
asker has, too, has been found forward.

Keys of more than LIMIT indexed words are cut into slices, and their askers go to each.  A word has at most a few
near words for each of its places, whatever the size of the vocabulary, so nothing grows with the square of a group.

Nulls and odd rows: a null or empty text has no words; a null doc_id is the empty text in the key of the deletion;
repeated rows count each; words of any length are whole; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, shards

LEAST, TIMES, RATIO, EVERY = 7, 2, 10, 31
SHARD, LIMIT = 1 << 16, 1 << 16
# each byte of a Latin-1 text: letters as they are, A-Z as a-z, all others (and what Latin-1 lacks, as "?") a blank
_LETTERS = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: bytes) -> list[bytes]:
    """Maximal runs of Latin letters, lower-cased A to Z, in Latin-1."""
    return text.decode().encode("latin-1", "replace").translate(_LETTERS).split()


def words_of(doc_id: str, text: bytes, least: int = LEAST, every: int = EVERY) -> Counter:
    """The words of a text: runs, of which every EVERY-th (by hash with the document) has lost a code point."""
    out: Counter = Counter()
    for run, n in Counter([r for r in runs(text) if len(r) >= least]).items():
        word = run.decode("latin-1")
        h = zlib.crc32(f"{doc_id}:{word}".encode())
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            out[word] += n
    return out


def vocabulary(documents: DataFrame, least: int = LEAST, times: int = TIMES, every: int = EVERY) -> DataFrame:
    """word, n of all words of the documents (doc_id, text) that occur `times` times or more."""

    def run(batches):
        for part, texts in shards(batches, "text"):
            found: Counter = Counter()
            for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                found.update(words_of(doc_id or "", text, least, every))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    parts = documents.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Automaton:
    """Minimal acyclic automaton of different words of one length, each with its number in order."""

    def __init__(self, rows: np.ndarray):
        self.order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.zeros(len(rows), int)
        rows = rows[self.order]
        m, length = rows.shape
        differ = rows[1:] != rows[:-1]
        common = np.append(-1, np.where(differ.any(1), differ.argmax(1), length) if length else np.zeros(m - 1, int))
        source, letter, target, before = [], [], [], []
        state, words, total = np.zeros(m, np.int64), np.ones(1, np.int64), 1  # of each row the state after all letters; words below each state of the last layer
        for depth in range(length - 1, -1, -1):
            new = np.flatnonzero(common <= depth)  # rows at which a node of depth + 1 begins: its edge
            node = np.cumsum(common < depth) - 1  # of each row
            parent, char, child = node[new], rows[new, depth], state[new]
            begin = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            count = np.diff(np.append(begin, len(parent)))
            kind, first = _same(char, child, begin, count)
            kept = np.isin(np.arange(len(begin)), first)
            edges = np.flatnonzero(np.repeat(kept, count))
            name = np.empty(len(begin), np.int64)
            name[first] = total + np.arange(len(first))
            name = name[first][kind]
            below = words[child - (total - len(words))]
            ahead = np.cumsum(below) - below
            ahead -= np.repeat(ahead[begin], count)
            source.append(name[parent[edges]]), letter.append(char[edges]), target.append(child[edges]), before.append(ahead[edges])
            words = np.add.reduceat(below, begin)[first]
            total += len(first)
            state = name[node]
        self.root = int(state[0])
        source, letter, target, before = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (source, letter, target, before))
        order = np.lexsort((letter, source))
        self.letter, self.target, self.before = letter[order].astype(np.int64), target[order], before[order]
        self.edges = source[order] << 21 | self.letter
        self.first = np.searchsorted(source[order], np.arange(total + 1))

    def step(self, states: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the states that have an edge of their letter: which they are, the next state, and the words before."""
        asked = states << 21 | letters
        at = np.minimum(np.searchsorted(self.edges, asked), len(self.edges) - 1)
        on = np.flatnonzero(self.edges[at] == asked)
        return on, self.target[at[on]], self.before[at[on]]

    def numbers(self, rows: np.ndarray) -> np.ndarray:
        """Number of each row, -1 if it is no word."""
        out = np.full(len(rows), -1, np.int64)
        who, state, number = np.arange(len(rows)), np.full(len(rows), self.root), np.zeros(len(rows), np.int64)
        who, _, number = self._rest(rows, who, state, number, 0)
        out[who] = number
        return out

    def _rest(self, rows, who, state, number, at):
        """Walks the letters from place `at` on; those that arrive."""
        for i in range(at, rows.shape[1]):
            if not len(who):
                break
            on, state, plus = self.step(state, rows[who, i])
            who, number = who[on], number[on] + plus
        return who, state, number

    def near(self, rows: np.ndarray, half: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of words of `length` one edit from a row, the first `half` code points alike; each once."""
        rows = rows.astype(np.int64)
        who, state, number = self._rest(rows[:, :half], np.arange(len(rows)), np.full(len(rows), self.root), np.zeros(len(rows), np.int64), 0)
        gap = length - rows.shape[1]
        found = []
        for i in range(half, rows.shape[1] + (gap == 1)):
            if not len(who):
                break
            if gap < 0:  # the row has a letter more; of equal letters in a row the first stands for all
                on = np.flatnonzero((rows[who, i] != rows[who, i - 1]) | (i == half))
                found.append(self._rest(rows, who[on], state[on], number[on], i + 1))
            else:
                count = self.first[state + 1] - self.first[state]
                ends = np.cumsum(count)
                edge = np.arange(int(ends[-1])) + np.repeat(self.first[state] - (ends - count), count)
                of = np.repeat(np.arange(len(who)), count)
                if i < rows.shape[1]:  # a letter put before its equal is as one put after it
                    other = self.letter[edge] != rows[who[of], i]
                    edge, of = edge[other], of[other]
                found.append(self._rest(rows, who[of], self.target[edge], number[of] + self.before[edge], i + (gap == 0)))
            if i < rows.shape[1]:
                on, state, plus = self.step(state, rows[who, i])
                who, number = who[on], number[on] + plus
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found])]), axis=1)
        return pairs[0], pairs[1]


def _same(char: np.ndarray, child: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (edges from begin, count of them) with equal edges: the kind of each, and the first node of each kind."""
    own = np.repeat(np.arange(len(begin)), count)
    for seed in range(64):
        sign = np.add.reduceat(_mixed(_mixed(char.astype(np.uint64) + np.uint64(seed << 32)) + child.astype(np.uint64)), begin)
        _, first, kind = np.unique(sign, return_index=True, return_inverse=True)
        at = begin[first][kind][own] + np.arange(len(char)) - begin[own]  # the same edge of the first of its kind
        if (count == count[first][kind]).all() and (char == char[at]).all() and (child == child[at]).all():
            return kind, first
    raise AssertionError("signs of different nodes collide under every seed")


def _shard(rows: dict) -> Iterator[tuple]:
    """(word, n, near, best n, best word) of the askers of a shard; rows: of (backward, T) the indexed words and the askers by length."""
    for (backward, length), (index, askers) in rows.items():
        if not index or not askers:
            continue
        turn = -1 if backward else 1
        straight = points([w for w, _ in index])
        automaton = Automaton(straight[:, ::turn])
        straight = straight[automaton.order]
        words, n = [index[i][0] for i in automaton.order], np.array([index[i][1] for i in automaton.order], np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort(straight.T[::-1])] = np.arange(len(words))
        head = length // 2
        for asked in map(list, map(dict.items, askers.values())):
            own = points([w for w, _ in asked])
            who, number = automaton.near(own[:, ::turn], length - head if backward else head, length)
            if backward:
                new = (own[who, :head] != straight[number, :head]).any(1)
                who, number = who[new], number[new]
            if len(who):
                order = np.lexsort((rank[number], -n[number], who))
                who, number = who[order], number[order]
                begin = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                for a, count in zip(begin.tolist(), np.diff(np.append(begin, len(who))).tolist(), strict=True):
                    word, own_n = asked[who[a]]
                    yield word, own_n, count, int(n[number[a]]), words[number[a]]


NEAR = "word string, n bigint, near bigint, near_n bigint, near_word string"


def near_words(words: DataFrame, least: int = LEAST, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """word, near (how many words of the table are one edit away), near_n, near_word (the most frequent of them, the smallest of equals)."""
    size = F.length("word")
    t = F.col("t")
    head = F.floor(t / 2).cast("int")
    row = lambda backward, asks, half: F.struct(F.lit(backward).alias("backward"), t.cast("int").alias("t"), half.alias("half"), F.lit(asks).alias("asks"))
    halves = lambda asks: [row(False, asks, F.left("word", head)), row(True, asks, F.right("word", t - head))]
    index = words.withColumn("t", size).select("word", "n", F.explode(F.array(*halves(False))).alias("k"))
    askers = words.withColumn("t", F.explode(F.sequence(size - 1, size + 1))).where(t >= least).select("word", "n", F.explode(F.array(*halves(True))).alias("k"))
    rows = index.unionAll(askers).select("word", "n", "k.*").withColumn("key", F.xxhash64("backward", "t", "half"))
    hot = materialize(index.select(F.xxhash64("k.backward", "k.t", "k.half").alias("key")).groupBy("key").count().where(F.col("count") > limit), "hot")
    if hot.isEmpty():
        rows = rows.withColumn("slice", F.lit(0))
    else:
        slices = F.coalesce(F.ceil(F.col("count") / limit), F.lit(1)).cast("int")
        to = F.when(F.col("asks"), F.sequence(F.lit(0), slices - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), slices).cast("int")))
        rows = rows.join(hot, "key", "left").withColumn("slice", F.explode(to)).drop("count")
    columns = ["key", "slice", "backward", "t", "asks", "word", "n"]

    def run(batches):
        held, count, last = defaultdict(lambda: ([], defaultdict(dict))), 0, None  # an asker once, though it may come for several slices

        def flush():
            out = list(_shard(held))
            held.clear()
            for at in range(0, len(out), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out[at : at + (1 << 16)], strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n", "near", "near_n", "near_word"])

        for batch in batches:
            for key, part, backward, length, asks, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if count >= shard and (key, part) != last:
                    yield from flush()
                    count = 0
                last = key, part
                index_, askers_ = held[backward, length]
                if asks:
                    askers_[len(word)][word] = n
                else:
                    index_.append((word, n))
                count += 1
        yield from flush()

    # within a task by length, so that a shard has few automata
    spread = rows.select(*columns).repartition(partitions(words.sparkSession), "key", "slice").sortWithinPartitions("backward", "t", "key", "slice")
    found = spread.mapInArrow(run, NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("least"), "near_word")).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("near"), best).select("word", "near", (-F.col("best.least")).alias("near_n"), F.col("best.near_word"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from word, forms (word, form) followed to the last; each round doubles the steps, and a form has over a multiple of the uses, so rounds are few."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO, least: int = LEAST) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of words (word, n)."""
    words = materialize(words.select("word", "n"), "words")
    joined = words.join(near_words(words, least), "word", "left")
    good = F.col("near_n") >= ratio * F.col("n")
    found = materialize(joined.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(good, F.col("near_word")).alias("form"), F.when(good, F.col("near_n")).alias("form_n")), "forms")
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))
