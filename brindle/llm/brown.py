"""LM scoring: Brown class-based bigram model, with an add-half unigram base beside it.

Tokens: white-space words of the lower-cased (A-Z) text, then one end.  All counts come from all training
documents, and every word of them has a class.

1. Texts become shards of word ids beside the 64-bit hashes of their words, written once.
2. Word counts: each task counts its shards and sends packed counts by hash; nothing is cut.  Totals N and V,
   and the most counted words of all buckets together, come back.
3. The most frequent words are dealt to classes by exchange clustering (each word moves to the class that raises
   the likelihood of the class bigrams most, until a pass moves none).  Their number, and that of the classes, grows
   with the cube root of V (sizes()), so that their table of pairs stays smaller than the vocabulary at any size.
4. Every other word meets the counts of the classes before and after it by hash in a shuffle, and goes to the
   class under which these and its own occurrences are likeliest.  (Words without a class yet count as one kind of
   context here.)
5. Each shard asks for counts and classes of its words outside the broadcast head by bucket of the hash, each
   word once a shard, and writes its texts as sequences of classes.
6. Class bigrams of all training texts' sequences make the transitions.
7. Scoring: log10 P(class | class before) + log10 P(word | class) for each token.  Transitions are smoothed
   towards class frequencies and emissions add one half to every count; one more class holds the unknown word, so
   the model is a distribution over the V words and one unknown.

Nulls and odd rows: null and empty texts have the end alone; a null doc_id is a training row; repeated rows
count and are scored each; with an empty training set, every token has count 0; doc_id is an integer; other
columns are left out; an empty table gives no row.
"""

from __future__ import annotations

import inspect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, release, segment_sums, shards, word_ids

HEAD, PULL = 1 << 17, 20.0
SHARD_BYTES = 4 << 20
PIECE = 1 << 19  # tokens of which classes are looked at together
WORDS = 1 << 20  # words and counts that wait to be merged
CELLS = 1 << 22  # of a dense table of words and contexts at a time
_END = b"\n"  # no word holds it
_END_HASH = xxhash.xxh3_64_intdigest(_END)


def sizes(v: int) -> tuple[int, int]:
    """How many words exchange clustering deals to how many classes, of a vocabulary of v words."""
    clustered = max(1024, int(16 * np.cbrt(v)))
    return clustered, clustered * 3 // 64


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local word ids, bounds of texts, and the hash of each local word."""
    flat, bounds, vocabulary = word_ids([[*t.lower().split(), _END] for t in texts])
    return flat, bounds, np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))


def lean(run):
    """run, a function of tasks, that gives the memory which Arrow keeps for later back to the system after each batch or group; workers live on."""

    def batches(given):
        for out in run(given):
            yield out
            pa.default_memory_pool().release_unused()

    def group(table):
        out = run(table)
        pa.default_memory_pool().release_unused()
        return out

    def both(table, other):
        out = run(table, other)
        pa.default_memory_pool().release_unused()
        return out

    if inspect.isgeneratorfunction(run):
        return batches
    return group if len(inspect.signature(run).parameters) == 1 else both


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _merge(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return h, np.bincount(at, np.concatenate(counts), len(h)).astype(np.int64)


SHARD = "shard bigint, doc_id array<bigint>, held array<boolean>, flat binary, bounds binary, hashes binary"


def token_shards(docs: DataFrame) -> DataFrame:
    """Shards of docs (doc_id, text, held_out): word ids, bounds of texts and hashes of the words."""

    def pack(batches):
        task = TaskContext.get().partitionId()
        for k, (part, texts) in enumerate(shards(batches, "text", SHARD_BYTES)):
            flat, bounds, h = tokens(texts)
            yield pa.RecordBatch.from_pydict({"shard": [(task << 32) + k], "doc_id": [part.column("doc_id").to_pylist()], "held": [part.column("held_out").to_pylist()], "flat": [flat.tobytes()], "bounds": [bounds.tobytes()], "hashes": [h.tobytes()]}, schema=_SHARD)

    return materialize(docs.select("doc_id", "text", "held_out").mapInArrow(lean(pack), SHARD), "tokens")


_SHARD = pa.schema([("shard", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("flat", pa.binary()), ("bounds", pa.binary()), ("hashes", pa.binary())])


def _arrays(table, **types):
    """Of each row its binary columns as arrays of these types, which lie in Arrow's memory: nothing is copied."""
    for row in zip(*(table.column(c) for c in types), strict=True):
        yield [np.frombuffer(x.as_buffer(), t) for x, t in zip(row, types.values(), strict=True)]


def _training(batches):
    """Of each shard the word ids of training texts, the word before each (an end before a text's first), and the hashes."""
    for batch in batches:
        for held, (flat, bounds, h) in zip(batch.column("held"), _arrays(batch, flat=np.int32, bounds=np.int64, hashes=np.uint64), strict=True):
            before = np.empty_like(flat)
            before[1:] = flat[:-1]
            before[bounds[:-1]] = flat[bounds[1:] - 1]  # a text's last token is the end
            on = np.repeat(~np.asarray(held.values, bool), np.diff(bounds))
            yield flat[on], before[on], h


def _by_bucket(h: np.ndarray, n: int):
    """Order of h by bucket; the buckets that occur, and where each begins and ends in this order."""
    where = _bucket(h, n)
    order = np.argsort(where, kind="stable")
    ends = np.searchsorted(where[order], np.arange(n + 1))
    return order, [(k, slice(ends[k], ends[k + 1])) for k in range(n) if ends[k] < ends[k + 1]]


def word_counts(tokenized: DataFrame, head: int = HEAD) -> tuple[int, int, np.ndarray, np.ndarray]:
    """N, V, and the head's hashes (sorted) and counts: about `head` words, the most counted of all.

    The head ends within words of nearly one count, of which those of the smallest hashes are in it; so it depends
    on the corpus alone, not on its partitions.
    """
    n = partitions(tokenized.sparkSession)

    def count(batches):
        held = []

        def pack():
            h, c = _merge([x for x, _ in held], [y for _, y in held])
            held.clear()
            order, parts = _by_bucket(h, n)
            h, c = h[order], c[order]
            return pa.RecordBatch.from_pydict({"bucket": [k for k, _ in parts], "hashes": [h[x].tobytes() for _, x in parts], "counts": [c[x].tobytes() for _, x in parts]})

        for flat, _, h in _training(batches):
            c = np.bincount(flat, minlength=len(h))
            held.append((h[c > 0], c[c > 0]))
            if sum(len(x) for x, _ in held) > WORDS:
                yield pack()
        if any(len(x) for x, _ in held):
            yield pack()

    def merge(table: pa.Table) -> pa.Table:
        held, waiting = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        for h, c in _arrays(table, hashes=np.uint64, counts=np.int64):
            held.append((h, c))
            waiting += len(h)
            if waiting > max(WORDS, len(held[0][0])):  # as many again as are merged, so the work stays linear but for the sorts
                held, waiting = [_merge([x for x, _ in held], [y for _, y in held])], 0
        h, c = _merge([x for x, _ in held], [y for _, y in held])
        kinds, many = np.unique(_bin(c), return_counts=True)
        return pa.Table.from_pydict({"n": [int(c.sum())], "kinds": [kinds.tolist()], "many": [many.tolist()], "hashes": [h.tobytes()], "counts": [c.tobytes()]})

    packed = tokenized.select("held", "flat", "bounds", "hashes").mapInArrow(lean(count), "bucket bigint, hashes binary, counts binary")
    merged = materialize(packed.groupBy("bucket").applyInArrow(lean(merge), "n bigint, kinds array<bigint>, many array<bigint>, hashes binary, counts binary"), "counts")
    rows = merged.select("n", "kinds", "many").collect()  # a bucket each, of some thousand kinds of counts
    bins = np.zeros(max((r.kinds[-1] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        bins[r.kinds] += r.many
    above = np.cumsum(bins[::-1])[::-1]
    last = int(np.argmax(above <= head)) if (above <= head).any() else len(bins)  # bins from here on are in the head
    left = (head - int(above[last]) if last < len(bins) else head) / bins[last - 1] if last else 0.0
    limit = np.uint64(min(left, 1.0) * float(2**64 - 2**11))  # of the bin before, the words of small hashes

    def top(batches):
        for batch in batches:
            for h, c in _arrays(batch, hashes=np.uint64, counts=np.int64):
                kind = _bin(c)
                on = (kind >= last) | ((kind == last - 1) & (h < limit))
                yield pa.RecordBatch.from_pydict({"hashes": [h[on].tobytes()], "counts": [c[on].tobytes()]})

    h, c = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in merged.select("hashes", "counts").mapInArrow(lean(top), "hashes binary, counts binary").toLocalIterator():  # about HEAD words
        h.append(np.frombuffer(r.hashes, np.uint64))
        c.append(np.frombuffer(r.counts, np.int64))
    release(merged)
    h, c = np.concatenate(h), np.concatenate(c)
    order = np.argsort(h)
    return sum(r.n for r in rows), int(bins.sum()), h[order], c[order]


def _bin(counts: np.ndarray) -> np.ndarray:
    return np.floor(64 * np.log2(counts)).astype(np.int64)


def look_up(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted table, or -1."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def _table(keys: DataFrame, m: int) -> np.ndarray:
    """m x m counts, summed by row over keys (part, at, counts), which hold places of cells and their counts."""

    def merge(table: pa.Table) -> pa.Table:
        at, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b in _arrays(table, at=np.int64, counts=np.int64):
            at, counts = _merge([at, a], [counts, b])
        return pa.Table.from_pydict({"at": [at.tobytes()], "counts": [counts.tobytes()]})

    total = np.zeros(m * m, np.int64)
    for r in keys.groupBy("part").applyInArrow(lean(merge), "at binary, counts binary").toLocalIterator():
        total[np.frombuffer(r.at, np.int64)] = np.frombuffer(r.counts, np.int64)
    return total.reshape(m, m)


def _cells(keys, m: int):
    """The counts of a task's keys (arrays of row * m + column), packed by row."""
    at, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in keys:
        a, c = np.unique(k, return_counts=True)
        at, counts = _merge([at, a], [counts, c])
    row = (at // m) % 32
    for k in np.unique(row):
        yield pa.RecordBatch.from_pydict({"part": [int(k)], "at": [at[row == k].tobytes()], "counts": [counts[row == k].tobytes()]})


def pair_counts(tokenized: DataFrame, words: np.ndarray) -> np.ndarray:
    """Counts of (word before, word) over the clustered words (sorted hashes) and, last, all others."""
    m = len(words) + 1

    def count(batches):
        def keys():
            for flat, before, h in _training(batches):
                c = look_up(words, h)
                c = np.where(c < 0, m - 1, c)
                yield c[before] * m + c[flat]

        yield from _cells(keys(), m)

    return _table(tokenized.select("held", "flat", "bounds", "hashes").mapInArrow(lean(count), "part bigint, at binary, counts binary"), m)


def _before(c: np.ndarray, bounds: np.ndarray, words: np.ndarray, m: int) -> np.ndarray:
    """The word before each: an end stands before a text's first."""
    out = np.empty_like(c)
    out[1:] = c[:-1]
    end = look_up(words, np.array([_END_HASH], np.uint64))[0]
    out[bounds[:-1]] = end if end >= 0 else m - 1
    return out


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, counts: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word of pairs (the last, rare, has its own class, `classes`)."""
    m = len(pairs)
    own = np.empty(m, np.int64)
    own[np.argsort(-counts, kind="stable")] = np.arange(m - 1) % classes if len(counts) == m - 1 else 0
    own[m - 1] = classes
    k = classes + 1
    to = np.zeros((m, k))  # word before, class
    came = np.zeros((k, m))  # class before, word
    for c in range(k):
        to[:, c] = pairs[:, own == c].sum(1)
        came[c] = pairs[own == c].sum(0)
    table = np.stack([to[own == c].sum(0) for c in range(k)])
    moved = True
    while moved:  # each move raises the likelihood, so this ends
        moved = False
        for w in np.argsort(-counts, kind="stable"):
            a, self_pair = own[w], float(pairs[w, w])
            out, into = to[w].copy(), came[:, w].copy()
            out[a] -= self_pair
            into[a] -= self_pair
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= self_pair
            rows, columns = table.sum(1) + into, table.sum(0) + out  # w's neighbours count wherever it goes
            gain = (_g(table + out) - _g(table)).sum(1) + (_g(table + into[:, None]) - _g(table)).sum(0)
            d = np.diag(table)
            gain += _g(d + out + into + self_pair) - _g(d + out) - _g(d + into) + _g(d)
            gain -= _g(rows + out.sum() + self_pair) - _g(rows) + _g(columns + into.sum() + self_pair) - _g(columns)
            best = int(np.argmax(gain[:classes]))
            best = best if gain[best] > gain[a] + 1e-9 else a
            table[best] += out
            table[:, best] += into
            table[best, best] += self_pair
            if best != a:
                moved = True
                own[w] = best
                to[:, a] -= pairs[:, w]
                to[:, best] += pairs[:, w]
                came[a] -= pairs[w]
                came[best] += pairs[w]
    return own


def _steps(table: np.ndarray, kinds: np.ndarray, pull: float) -> np.ndarray:
    """log10 P(class | class before); kinds: words of each class but the last."""
    mean = table.sum(0) + 0.5
    mean[:-1][kinds == 0] = 1e-9  # a class without words is never met
    mean /= mean.sum()
    return np.log10((table + pull * mean) / (table.sum(1, keepdims=True) + pull))


class Model:
    """Of the clustered words at first, with all others in the last class; settle() has all words in classes."""

    def __init__(self, n: int, v: int, head: np.ndarray, counts: np.ndarray, words: np.ndarray, pairs: np.ndarray, classes: int, pull: float = PULL):
        self.n, self.words, self.classes, self.pull = n, words, classes, pull
        at = look_up(head, words)
        self.counts = own_counts = counts[at] if len(words) else np.zeros(0, np.int64)
        self.own = exchange(pairs, own_counts, classes)
        k = classes + 1
        self.log_count = np.log10(counts + 0.5)
        self.size = np.bincount(self.own[:-1], own_counts, k)[:classes]
        self.kinds = np.bincount(self.own[:-1], minlength=k)[:classes]
        self.emit = np.log10((own_counts + 0.5) / (self.size + 0.5 * self.kinds)[self.own[:-1]]) if len(words) else np.zeros(0)
        self.rare = float(np.log10(n - own_counts.sum() + 0.5 * (v - len(words) + 1)))
        self.base = float(np.log10(n + 0.5 * (v + 1)))
        table = np.zeros((k, k))
        np.add.at(table, (self.own[:, None], self.own[None, :]), pairs)
        self.step = _steps(table, self.kinds, pull)

    def place(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Class of each word, from its counts of classes before and after it: the likeliest of those with words."""
        k = self.classes
        with np.errstate(divide="ignore"):
            alone = np.where(self.kinds > 0, -np.log10(self.size + 0.5 * self.kinds), -np.inf)
        return np.argmax(left @ self.step[:, :k] + right @ self.step[:k].T + left.sum(1, keepdims=True) * alone, 1)

    def add(self, size: np.ndarray, kinds: np.ndarray) -> None:
        """Add the placed words: tokens and words of each class."""
        self.size, self.kinds = self.size + size, self.kinds + kinds
        self.inside = np.append(np.log10(np.maximum(self.size + 0.5 * self.kinds, 0.5)), np.log10(0.5))  # the last class has the unknown word only

    def settle(self, table: np.ndarray) -> None:
        """Transitions from the class bigrams of all tokens."""
        self.step = _steps(table.astype(float), self.kinds, self.pull)


def placed_words(tokenized: DataFrame, model: Model) -> DataFrame:
    """(bucket, hashes, counts, classes) of all training words that exchange clustering did not see."""
    n, k, words, own = partitions(tokenized.sparkSession), model.classes + 1, model.words, model.own

    def contexts(batches):
        for flat, before, h in _training(batches):
            order, parts = _by_bucket(h, n)
            rank = np.empty(len(h), np.int64)
            rank[order] = np.arange(len(h))
            at = look_up(words, h)
            other, c = at < 0, own[at]  # -1 has the last class
            a, b = other[flat], other[before]
            at, counts = np.unique(np.concatenate([rank[flat[a]] * 2 * k + c[before[a]], rank[before[b]] * 2 * k + k + c[flat[b]]]), return_counts=True)
            word, context = at // (2 * k), (at % (2 * k)).astype(np.uint16)
            h = h[order]
            for bucket, x in parts:
                i, j = np.searchsorted(word, (x.start, x.stop))
                if i < j:
                    some, length = np.unique(word[i:j], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"bucket": [bucket], "hashes": [h[some].tobytes()], "lengths": [length.astype(np.int32).tobytes()], "contexts": [context[i:j].tobytes()], "counts": [counts[i:j].astype(np.int32).tobytes()]})

    def place(table: pa.Table) -> pa.Table:
        columns = [table.column(c) for c in ("hashes", "lengths", "contexts", "counts")]
        h = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in columns[0]]))
        total, classes, some = np.zeros(len(h), np.int64), np.zeros(len(h), np.int16), max(1, CELLS // (2 * k))
        for begin in range(0, len(h), some):
            rows = min(some, len(h) - begin)
            seen = np.zeros((rows, 2 * k), np.int32 if model.n < 1 << 31 else np.int64)
            for packed in zip(*columns, strict=True):
                hashes, lengths, context, counts = (np.frombuffer(x.as_buffer(), t) for x, t in zip(packed, (np.uint64, np.int32, np.uint16, np.int32), strict=True))
                at = np.repeat(np.searchsorted(h, hashes) - begin, lengths)
                on = (at >= 0) & (at < rows)
                seen[at[on], context[on]] += counts[on]  # a word's contexts are distinct in a row
            for i in range(0, rows, 4096):
                part, x = seen[i : i + 4096].astype(float), slice(begin + i, begin + min(i + 4096, rows))
                total[x] = part[:, :k].sum(1)
                classes[x] = model.place(part[:, :k], part[:, k:])
        return pa.Table.from_pydict({"bucket": [table.column("bucket")[0].as_py()], "hashes": [h.tobytes()], "counts": [total.tobytes()], "classes": [classes.tobytes()]})

    packed = tokenized.select("held", "flat", "bounds", "hashes").mapInArrow(lean(contexts), "bucket bigint, hashes binary, lengths binary, contexts binary, counts binary")
    return materialize(packed.groupBy("bucket").applyInArrow(lean(place), "bucket bigint, hashes binary, counts binary, classes binary"), "words")


def head_words(placed: DataFrame, model: Model, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (sorted), counts and classes of the clustered words and of each bucket's most counted; adds all placed words to the model."""
    n, k = partitions(placed.sparkSession), model.classes

    def top(batches):
        for batch in batches:
            for h, c, own in _arrays(batch, hashes=np.uint64, counts=np.int64, classes=np.int16):
                first = np.lexsort((h, -c))[: max(1, head // n)]
                yield pa.RecordBatch.from_pydict({"hashes": [h[first].tobytes()], "counts": [c[first].tobytes()], "classes": [own[first].tobytes()], "size": [np.bincount(own, c, k).tobytes()], "kinds": [np.bincount(own, minlength=k).tobytes()]})

    size, kinds = np.zeros(k), np.zeros(k, np.int64)
    h, c, own = [model.words], [model.counts], [model.own[:-1].astype(np.int16)]
    for r in placed.select("hashes", "counts", "classes").mapInArrow(lean(top), "hashes binary, counts binary, classes binary, size binary, kinds binary").toLocalIterator():
        h.append(np.frombuffer(r.hashes, np.uint64))
        c.append(np.frombuffer(r.counts, np.int64))
        own.append(np.frombuffer(r.classes, np.int16))
        size += np.frombuffer(r["size"])
        kinds += np.frombuffer(r.kinds, np.int64)
    model.add(size, kinds)
    h, c, own = map(np.concatenate, (h, c, own))
    order = np.argsort(h)
    return h[order], c[order], own[order]


def class_sequences(tokenized: DataFrame, placed: DataFrame, model: Model, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Of each text its tokens, known tokens, base score, score without transitions, and its tokens' classes."""
    n, k, inside, base = partitions(tokenized.sparkSession), model.classes, model.inside, model.base
    head, head_counts, head_classes = known

    def ask(batches):
        for batch in batches:
            for shard, (h,) in zip(batch.column("shard").to_pylist(), _arrays(batch, hashes=np.uint64), strict=True):
                h = h[look_up(head, h) < 0]
                order, parts = _by_bucket(h, n)
                h = h[order]
                if parts:
                    yield pa.RecordBatch.from_pydict({"bucket": [b for b, _ in parts], "shard": [shard] * len(parts), "asked": [h[x].tobytes() for _, x in parts]})

    def answer(asked: pa.Table, words: pa.Table) -> pa.Table:
        h, c, own = (np.frombuffer(words.column(x)[0].as_py() if len(words) else b"", t) for x, t in (("hashes", np.uint64), ("counts", np.int64), ("classes", np.int16)))
        out = {"shard": asked.column("shard").to_pylist(), "bucket": asked.column("bucket").to_pylist(), "counts": [], "classes": []}
        for (x,) in _arrays(asked, asked=np.uint64):
            at = look_up(h, x)
            out["counts"].append((np.where(at < 0, 0, c[at]) if len(h) else np.zeros(len(at), np.int64)).tobytes())
            out["classes"].append((np.where(at < 0, k, own[at]) if len(h) else np.full(len(at), k)).astype(np.int16).tobytes())
        return pa.Table.from_pydict(out, schema=pa.schema([("shard", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("classes", pa.binary())]))

    def sequences(shard: pa.Table, answers: pa.Table) -> pa.Table:
        flat, bounds, h = next(_arrays(shard, flat=np.int32, bounds=np.int64, hashes=np.uint64))
        at = look_up(head, h)
        count, own = (np.where(at < 0, 0, x[at]) if len(head) else np.zeros(len(h), x.dtype) for x in (head_counts, head_classes))
        rest = np.flatnonzero(at < 0)
        if len(rest):
            rest = rest[_by_bucket(h[rest], n)[0]]
            answers = answers.sort_by("bucket")
            count[rest] = np.frombuffer(b"".join(answers.column("counts").to_pylist()), np.int64)
            own[rest] = np.frombuffer(b"".join(answers.column("classes").to_pylist()), np.int16)
        log_count = np.log10(count + 0.5)
        emit, size, own = log_count - inside[own], np.diff(bounds), own.astype(np.int16)[flat]
        return pa.Table.from_pydict({
            "doc_id": shard.column("doc_id")[0].values, "held_out": shard.column("held")[0].values, "n_tokens": size, "n_known": segment_sums((count > 0)[flat].astype(np.int64), bounds), "base_score": segment_sums(log_count[flat], bounds) - size * base,
            "score": segment_sums(emit[flat], bounds), "classes": [own[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
        }, schema=_SCORED)

    asked = tokenized.select("shard", "hashes").mapInArrow(lean(ask), "bucket bigint, shard bigint, asked binary")
    answers = asked.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(lean(answer), "shard bigint, bucket bigint, counts binary, classes binary")
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, classes binary"
    return materialize(tokenized.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(lean(sequences), schema), "classes")


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("classes", pa.binary())])


def _pieces(batch: pa.RecordBatch, column: int):
    """Slices of a batch whose texts (classes of two bytes a token) have about PIECE tokens at most; a longer text comes alone."""
    ends = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(column)), np.int64) // 2)
    begin, done = 0, 0
    while begin < len(ends):
        n = max(1, int(np.searchsorted(ends[begin:], done + PIECE, "right")))
        yield batch.slice(begin, n)
        begin, done = begin + n, int(ends[begin + n - 1])


def _classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all texts in a row, the class before each (the end's before a text's first), bounds of texts."""
    rows = column.to_pylist()
    bounds = np.concatenate([[0], np.cumsum([len(x) // 2 for x in rows])]).astype(np.int64)
    own = np.frombuffer(b"".join(rows), np.int16).astype(np.int64)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[bounds[:-1]] = own[bounds[1:] - 1]
    return own, before, bounds


def class_pairs(texts: DataFrame, k: int) -> np.ndarray:
    """Counts of (class before, class) over texts (classes)."""

    def count(batches):
        yield from _cells((before * k + own for own, before, _ in (_classes(x.column(0)) for b in batches for x in _pieces(b, 0))), k)

    return _table(texts.select("classes").mapInArrow(lean(count), "part bigint, at binary, counts binary"), k)


def score(documents: DataFrame, held_out, head: int = HEAD, clustered: int | None = None, classes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row of documents (doc_id, text).

    held_out: a condition; rows that meet it aren't learnt from.  clustered, classes: sizes() of the vocabulary by
    default.
    """
    tokenized = token_shards(documents.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")))
    n, v, hashes, counts = word_counts(tokenized, head)
    clustered, classes = clustered or sizes(v)[0], classes or sizes(v)[1]
    words = hashes[np.sort(np.lexsort((hashes, -counts))[:clustered])]
    model = Model(n, v, hashes, counts, words, pair_counts(tokenized, words), classes)
    placed = placed_words(tokenized, model)
    texts = class_sequences(tokenized, placed, model, head_words(placed, model, head))
    release(tokenized)
    release(placed)
    model.settle(class_pairs(texts.where(~F.col("held_out")), classes + 1))
    step = model.step

    def steps(batches):
        for batch in batches:
            for x in _pieces(batch, batch.schema.get_field_index("classes")):
                own, before, bounds = _classes(x.column("classes"))
                total = np.asarray(x.column("score")) + segment_sums(step[before, own], bounds)
                yield pa.RecordBatch.from_arrays([*x.columns[:5], pa.array(total)], names=[*x.schema.names[:5], "score"])

    scored = texts.mapInArrow(lean(steps), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op10_brown_lm(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
