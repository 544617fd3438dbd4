"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

A start of a document is repeated if the `match` bytes from it also start earlier (smaller doc_id, or the same
document, earlier).  Starts are dealt out by content, so that equal strings always meet in one task:

1. The anchor of a start is the last of the smallest mixed rolling hashes of the `GRAM`-byte strings inside
   its `match` bytes.  Equal strings have equal anchors; neighbouring starts that share one, at one place, make
   a piece (with the bytes they reach).  Pieces travel as anchor, digest and place, packed.
2. An anchor that occurs once ends there.  Of pieces with equal digests (128 bits) the earliest stays and all
   others are repeated; tasks do the same before they send.  Where pieces of one anchor differ, the earliest
   of each kind goes on with its bytes.  The starts of an anchor with more than CROWD kinds are dealt out again, each
   by the digest of its whole string, after equal ones have met in the sending task; so no key holds more than CROWD
   pieces, or one start of each sending task.
3. Each task sorts the suffixes of the pieces it got by the difference-cover algorithm: triples at positions
   1 and 2 modulo 3 are sorted and named, names are sorted by recursion until they differ or span `match`
   bytes, suffixes at 0 modulo 3 follow by one more sort, and a merge joins both.  Adjacent suffixes with
   equal prefixes are one group; all starts of a group but the earliest are repeated.
4. Repeated starts come back to their document, where their bytes merge into spans.

Nulls and odd rows: a null text is empty; a null doc_id is later than all others; documents that share a
doc_id are told apart by their text, and those that are equal in both are one document, each row of which is
returned with the same result; the order of different texts of one doc_id is that of their 64-bit hashes; texts
shorter than `match` bytes keep all; doc_id is an integer; other columns pass through; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, partitions, shards

MATCH, GRAM, CROWD = 100, 32, 500
_CHUNK, _SORT, _STARTS = 1 << 20, 1 << 20, 1 << 17
_BASE = 0x9E3779B97F4A7C15
_cache: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if len(_cache.get("p", ())) < n:
        for name, b in (("p", _BASE), ("q", pow(_BASE, -1, 2**64))):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _cache[name] = np.multiply.accumulate(x)
    return _cache["p"][:n], _cache["q"][:n]


def anchors(data: np.ndarray, match: int = MATCH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Of every start of which `match` bytes remain the place of its anchor; and the hash at each place."""
    n = len(data) - match + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, q = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(p * data, out=total[1:])
    h = (total[gram:] - total[:-gram]) * q[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    mask = np.uint64((1 << 22) - 1)
    low = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))  # of equal hashes the last
    width, span = match - gram + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])
    return (mask - (low & mask)).astype(np.int64), h


def pieces(texts: list[bytes], match: int = MATCH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of the texts' pieces: text, first start, number of starts, anchor."""
    parts, group, size = [], [], 0

    def flush():
        data = np.frombuffer(b"".join(t for _, _, t in group), np.uint8)
        low, h = anchors(data, match, gram)
        begin = 0
        cut, doc, base, valid = np.zeros(len(low), bool), np.empty(len(low), np.int32), np.empty(len(low), np.int64), np.zeros(len(low), bool)
        for i, at, t in group:
            end = begin + len(t)
            doc[begin:end], base[begin:end] = i, at - begin
            valid[begin : max(begin, end - match + 1)] = True
            cut[begin : begin + 1] = True
            begin = end
        cut[1:] |= (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(cut)
        length = np.diff(np.append(first, len(low)))
        keep = valid[first]
        first, length = first[keep], length[keep]
        parts.append((doc[first], first + base[first], length.astype(np.int32), h[low[first]]))

    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - match + 1), _CHUNK):
            part = t[at : at + _CHUNK + match - 1]
            if len(part) >= match:
                if size + len(part) > 2 * _CHUNK and group:
                    flush()
                    group.clear()
                    size = 0
                group.append((i, at, part))
                size += len(part)
    if group:
        flush()
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return tuple(np.concatenate([p[j] for p in parts]) for j in range(4))


def _names(key: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(key, kind="stable")
    name = np.empty(len(key), np.int64)
    name[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1])) if len(key) else 0
    return name, int(name.max(initial=-1)) + 1


def suffix_order(s: np.ndarray, depth: int = MATCH) -> np.ndarray:
    """Starts of the suffixes of s (values from 1) in order of at least their first `depth` values, by a difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.append(_names(s)[0] + 1, [0, 0, 0, 0]) if s.max() > 1 << 20 else np.append(s, [0, 0, 0, 0])
    k = int(s.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a position past the end, so that every suffix at 0 has a successor
    sample = np.concatenate([one, two])
    two_first = s[sample] * k + s[sample + 1]
    name, kinds = _names((two_first if k < 1 << 20 else _names(two_first)[0]) * k + s[sample + 2])
    if kinds < len(sample) and depth > 3:
        order = suffix_order(name + 1, -(-depth // 3))
        rank_of = np.empty(len(sample), np.int64)
        rank_of[order] = np.arange(len(sample))
    else:
        rank_of = np.empty(len(sample), np.int64)
        rank_of[np.argsort(name, kind="stable")] = np.arange(len(sample))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = rank_of + 1
    sample = sample[np.argsort(rank_of)]
    sample = sample[sample < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(s[zero] * (n + 4) + rank[zero + 1], kind="stable")]
    # merge: of each suffix at 0, how many sampled ones come before, by binary search
    low, high = np.zeros(len(zero), np.int64), np.full(len(zero), len(sample), np.int64)
    pair, triple = s[zero] * (n + 4) + rank[zero + 1], (s[zero] * k + s[zero + 1], rank[zero + 2])
    sample_pair = s[sample] * (n + 4) + rank[sample + 1]
    sample_two = s[sample] * k + s[sample + 1]
    while (open_ := low < high).any():
        mid = (low + high) // 2
        m = np.minimum(mid, len(sample) - 1)
        before = np.where(sample[m] % 3 == 1, sample_pair[m] < pair, (sample_two[m] < triple[0]) | ((sample_two[m] == triple[0]) & (rank[sample[m] + 2] < triple[1])))
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    low = np.maximum.accumulate(low)  # suffixes that agree to the depth may stand in any order
    out = np.empty(n, np.int64)
    at = low + np.arange(len(zero))
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = zero, sample
    return out


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, match: int) -> np.ndarray:
    """Whether the `match` bytes from a and from b are equal."""
    words = np.lib.stride_tricks.sliding_window_view(data, 4)
    same = np.ones(len(a), bool)
    at = np.arange(len(a))
    for k in [*range(0, match - 3, 4), max(0, match - 4)]:
        at = at[(words[a[at] + k] == words[b[at] + k]).all(1)] if match >= 4 else at
    same[:] = False
    same[at] = True
    return same


def repeated(texts: list[bytes], rank: np.ndarray, first: np.ndarray, match: int = MATCH) -> list[np.ndarray]:
    """Starts in each piece's bytes whose `match` bytes start earlier, by (rank of the document, place)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lengths + 1) - lengths - 1
    data = np.frombuffer(b"\0".join(texts) + b"\0\0\0\0", np.uint8)
    s = data[: len(data) - 3].astype(np.int64) + 2
    s[begin + lengths] = 1
    order = suffix_order(s, match)
    piece = np.repeat(np.arange(len(texts)), lengths + 1)
    valid = np.arange(len(s)) - begin[piece] + match <= lengths[piece]
    order = order[valid[order]]
    if not len(order):
        return [np.zeros(0, np.int64) for _ in texts]
    group = np.cumsum(np.append(0, ~_equal(data, order[:-1], order[1:], match)))
    place = first[piece[order]] + order - begin[piece[order]]
    by = np.lexsort((place, rank[piece[order]], group))
    own, who, at = group[by], rank[piece[order]][by], place[by]
    head = np.append(True, own[1:] != own[:-1])
    leader = np.maximum.accumulate(np.where(head, np.arange(len(own)), 0))
    later = (who != who[leader]) | (at != at[leader])  # the same place may have come twice
    hit = order[by[later]]
    hit = hit[np.argsort(hit)]
    ends = np.searchsorted(hit, np.append(begin, len(s)))
    return [hit[a:b] - begin[i] for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]


_KEY = "doc_id bigint, text_key bigint"


def _order(ids: np.ndarray, null: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rank of each document in the order of doc_id (null last), then text_key; equal documents share one."""
    by = np.lexsort((keys, ids, null))
    new = np.append(False, (ids[by][1:] != ids[by][:-1]) | (keys[by][1:] != keys[by][:-1]) | (null[by][1:] != null[by][:-1]))
    out = np.empty(len(ids), np.int64)
    out[by] = np.cumsum(new)
    return out


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> bytes:
    return np.stack([starts, lengths], 1).astype(np.int64).tobytes()


def repeated_starts(docs: DataFrame, match: int = MATCH, crowd: int = CROWD) -> DataFrame:
    """doc_id, text_key, spans (packed: first repeated start, how many) of docs (doc_id, text_key, text)."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    packed = "bucket int, ids binary, keys binary, doc binary, at binary, starts binary, anchor binary, digest binary, spans binary"
    dtype = np.dtype([("hi", ">u8"), ("lo", ">u8")])

    def thin(rank, doc, at, starts, anchor, digest):
        """Sorted by anchor, digest, document and place; which are the earliest of their kind; which equal rows to leave out."""
        by = np.lexsort((at, rank[doc], digest["lo"], digest["hi"], anchor))
        a, d, r, p = anchor[by], digest[by], rank[doc[by]], at[by]
        kind = np.append(True, (a[1:] != a[:-1]) | (d[1:] != d[:-1]))
        again = np.append(False, ~kind[1:] & (r[1:] == r[:-1]) & (p[1:] == p[:-1]))
        return by, kind, again

    def send(batches):
        held = []

        def pack():
            ids, null, keys, doc, at, starts, anchor, digest = [np.concatenate([h[j] for h in held]) for j in range(8)]
            held.clear()
            rank = _order(ids, null, keys)
            by, kind, again = thin(rank, doc, at, starts, anchor, digest)
            repeat = by[~kind & ~again]
            by = by[kind]
            where = ((anchor[by] >> np.uint64(8)) % np.uint64(n)).astype(np.int64)
            by = by[np.argsort(where * len(ids) + doc[by], kind="stable")]
            where = ((anchor[by] >> np.uint64(8)) % np.uint64(n)).astype(np.int64)
            repeat = repeat[np.argsort(doc[repeat], kind="stable")]
            ends, more = np.searchsorted(where, np.arange(n + 1)), np.linspace(0, len(repeat), n + 1).astype(int)
            blank = np.where(null, 1, 0).astype(np.uint8)
            rows = {c: [] for c in packed.replace(" int", "").replace(" binary", "").split(", ")}
            for k in range(n):
                own, out = by[ends[k] : ends[k + 1]], repeat[more[k] : more[k + 1]]
                if not len(own) and not len(out):
                    continue
                used, at_doc = np.unique(np.concatenate([doc[own], doc[out]]), return_inverse=True)
                rows["bucket"].append(k)
                rows["ids"].append(ids[used].tobytes() + blank[used].tobytes())
                rows["keys"].append(keys[used].tobytes())
                rows["doc"].append(at_doc[: len(own)].astype(np.int32).tobytes())
                rows["at"].append(at[own].astype(np.int32).tobytes())
                rows["starts"].append((starts[own] - 1).astype(np.uint8).tobytes())
                rows["anchor"].append(anchor[own].tobytes())
                rows["digest"].append(digest[own].tobytes())
                rows["spans"].append(np.stack([at_doc[len(own) :], at[out], starts[out]], 1).astype(np.int32).tobytes())
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in list(rows)[1:]]]))

        docs_held = 0
        for part, texts in shards(batches, "text", 4 << 20):
            doc, at, starts, anchor = pieces(texts, match)
            ends = (at + starts + match - 1).tolist()
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(texts[i][a:b]) for i, a, b in zip(doc.tolist(), at.tolist(), ends, strict=True)]), dtype)
            ids, null = _ids(part.column("doc_id"))
            held.append((ids, null, part.column("text_key").to_numpy(), doc.astype(np.int64) + docs_held, at, starts, anchor, digest))
            docs_held += len(texts)
            if sum(len(h[3]) for h in held) > 500_000:
                yield pack()
                docs_held = 0
        if held:
            yield pack()

    found_schema = f"{_KEY}, spans binary, open binary, keys binary"

    def meet(batches):
        """All pieces of an anchor are here."""
        held, spans = [], []
        total = 0
        for batch in batches:
            for _, ids, keys, doc, at, starts, anchor, digest, span in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                keys = np.frombuffer(keys, np.int64)
                m = len(keys)
                held.append((np.frombuffer(ids[: 8 * m], np.int64), np.frombuffer(ids[8 * m :], np.uint8), keys, np.frombuffer(doc, np.int32).astype(np.int64) + total, np.frombuffer(at, np.int32).astype(np.int64), np.frombuffer(starts, np.uint8).astype(np.int64) + 1, np.frombuffer(anchor, np.uint64), np.frombuffer(digest, dtype)))
                span = np.frombuffer(span, np.int32).reshape(-1, 3).astype(np.int64)
                spans.append(span + np.array([total, 0, 0]))
                total += m
        if not held:
            return
        ids, null, keys, doc, at, starts, anchor, digest = [np.concatenate([h[j] for h in held]) for j in range(8)]
        spans = np.concatenate(spans)
        held.clear()
        rank = _order(ids, null, keys)
        one = np.empty(int(rank.max()) + 1, np.int64)  # a document may have come in several packets
        one[rank] = np.arange(len(rank))
        by, kind, again = thin(rank, doc, at, starts, anchor, digest)
        repeat = by[~kind & ~again]
        spans = np.concatenate([np.stack([rank[spans[:, 0]], spans[:, 1], spans[:, 2]], 1), np.stack([rank[doc[repeat]], at[repeat], starts[repeat]], 1)])
        by = by[kind]
        first = np.flatnonzero(np.append(True, anchor[by][1:] != anchor[by][:-1])) if len(by) else np.zeros(0, int)
        kinds = np.diff(np.append(first, len(by)))
        kinds = np.repeat(kinds, kinds)
        by, kinds = by[kinds > 1], kinds[kinds > 1]
        more = np.stack([rank[doc[by]], at[by], starts[by] * np.where(kinds > crowd, -1, 1), anchor[by].view(np.int64)], 1)
        spans, more = spans[np.argsort(spans[:, 0], kind="stable")], more[np.argsort(more[:, 0], kind="stable")]
        used = np.union1d(spans[:, 0], more[:, 0])
        s, m = np.searchsorted(spans[:, 0], np.append(used, len(one))), np.searchsorted(more[:, 0], np.append(used, len(one)))
        for a in range(0, len(used), 20000):
            rows = range(a, min(a + 20000, len(used)))
            where = one[used[a : a + 20000]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[where], mask=null[where] > 0),
                    pa.array(keys[where]),
                    pa.array([_spans(spans[s[i] : s[i + 1], 1], spans[s[i] : s[i + 1], 2]) if s[i] < s[i + 1] else None for i in rows], pa.binary()),
                    pa.array([_spans(more[m[i] : m[i + 1], 1], more[m[i] : m[i + 1], 2]) if m[i] < m[i + 1] else None for i in rows], pa.binary()),
                    pa.array([more[m[i] : m[i + 1], 3].tobytes() if m[i] < m[i + 1] else None for i in rows], pa.binary()),
                ],
                names=["doc_id", "text_key", "spans", "open", "keys"],
            )

    names = ["key", "doc_id", "text_key", "at", "bytes"]

    def fetch(batches):
        """The bytes of open pieces; of crowded anchors the digest of each start, after those that are equal here have met."""
        crowded, held = [], 0

        def meet_here():
            ids, null, keys, doc, at, digest = [np.concatenate([c[j] for c in crowded]) for j in range(6)]
            crowded.clear()
            doc = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1  # starts of one document stand together
            head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            ids, null, keys = ids[head], null[head], keys[head]
            by, kind, again = thin(_order(ids, null, keys), doc, at, at, digest["lo"], digest)
            repeat, by = np.sort(by[~kind & ~again]), by[kind]
            data = digest[by].tobytes()
            rows = pa.Array.from_buffers(pa.binary(), len(by), [None, pa.py_buffer(np.arange(0, 16 * len(by) + 1, 16, dtype=np.int32).tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(digest["lo"][by].astype(np.int64)), pa.array(ids[doc[by]], mask=null[doc[by]]), pa.array(keys[doc[by]]), pa.array(at[by]), rows], names=names)
            if len(repeat):
                ends = np.append(np.flatnonzero(np.append(True, doc[repeat][1:] != doc[repeat][:-1])), len(repeat))
                own = doc[repeat][ends[:-1]]
                spans = [_spans(at[repeat[x:y]], np.ones(y - x, np.int64)) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(ids[own], mask=null[own]), pa.array(keys[own]), pa.array(np.full(len(own), -1)), pa.array(spans, pa.binary())], names=names)

        count = 0
        for batch in batches:
            ids, null = _ids(batch.column(0))
            keys, texts, opens, anchors_ = batch.column(1).to_numpy(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, (text, o, a) in enumerate(zip(texts.cast(pa.binary()).to_pylist(), opens, anchors_, strict=True)):
                out, many = [], []
                for blob, anchor in zip(o, a, strict=True):
                    for (at, m), name in zip(np.frombuffer(blob, np.int64).reshape(-1, 2).tolist(), np.frombuffer(anchor, np.int64).tolist(), strict=True):
                        if m > 0:
                            out.append((name, at, text[at : at + m + match - 1]))
                        else:
                            many.append(np.arange(at, at - m))
                out = list(dict.fromkeys(out))  # a document may be there twice
                for k in range(0, len(out), 5000):
                    part = out[k : k + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([None if null[i] else int(ids[i])] * len(part), pa.int64()), pa.array([int(keys[i])] * len(part), pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.binary())], names=names)
                if many:
                    at = np.unique(np.concatenate(many))
                    for k in range(0, len(at), _STARTS):
                        some = at[k : k + _STARTS]
                        digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[x : x + match]) for x in some.tolist()]), dtype)
                        one = lambda v, n=len(some): np.full(n, v)
                        crowded.append((one(ids[i]), one(null[i]), one(keys[i]), one(count), some, digest))
                        held += len(some)
                        if held >= _STARTS:
                            yield from meet_here()
                            held = 0
                    count += 1
        if crowded:
            yield from meet_here()

    def sort(batches):
        """Pieces in order of their keys; groups are sorted together up to _SORT bytes, and a group is never cut."""
        kept: list[pa.RecordBatch] = []
        size = 0

        def flush(table: pa.Table):
            settled = pa.compute.less(table.column("at"), 0)
            known = table.filter(settled)
            if len(known):
                yield known.select(["doc_id", "text_key", "bytes"]).rename_columns(["doc_id", "text_key", "spans"]).combine_chunks().to_batches()[0]
                table = table.filter(pa.compute.invert(settled))
            digests = pa.compute.equal(pa.compute.binary_length(table.column("bytes")), 16)
            starts, table = table.filter(digests).combine_chunks(), table.filter(pa.compute.invert(digests))
            if len(starts):
                ids, null = _ids(starts.column("doc_id").combine_chunks())
                keys, at = starts.column("text_key").to_numpy(), starts.column("at").to_numpy()
                digest = np.frombuffer(b"".join(starts.column("bytes").to_pylist()), dtype)
                by, kind, again = thin(_order(ids, null, keys), np.arange(len(at)), at, at, digest["lo"], digest)
                hit = by[~kind & ~again]
                hit = hit[np.lexsort((at[hit], keys[hit], ids[hit], null[hit]))]
                if len(hit):
                    new = np.append(True, (ids[hit][1:] != ids[hit][:-1]) | (null[hit][1:] != null[hit][:-1]) | (keys[hit][1:] != keys[hit][:-1]))
                    ends = np.append(np.flatnonzero(new), len(hit))
                    first = hit[ends[:-1]]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first], mask=null[first]), pa.array(keys[first]), pa.array([_spans(at[hit[x:y]], np.ones(y - x, np.int64)) for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["doc_id", "text_key", "spans"])
            if not len(table):
                return
            ids, null = _ids(table.column("doc_id").combine_chunks())
            keys, at = table.column("text_key").to_numpy(), table.column("at").to_numpy()
            hits = repeated(table.column("bytes").to_pylist(), _order(ids, null, keys), at, match)
            some = [i for i, h in enumerate(hits) if len(h)]
            if some:
                runs = []
                for i in some:
                    h = hits[i] + at[i]
                    cut = np.flatnonzero(np.append(True, np.diff(h) > 1))
                    runs.append(_spans(h[cut], np.diff(np.append(cut, len(h)))))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some], mask=null[some]), pa.array(keys[some]), pa.array(runs, pa.binary())], names=["doc_id", "text_key", "spans"])

        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                part = batch.slice(begin)
                room = int(np.searchsorted(np.cumsum(pa.compute.binary_length(part.column("bytes")).to_numpy()), max(1, _SORT - size)))
                key = part.column("key").to_numpy()
                if room >= len(key):
                    kept.append(part)
                    size += part.column("bytes").nbytes
                    break
                stop = int(np.searchsorted(key[room:], key[room], "right")) + room  # after the group that reaches the limit
                kept.append(part.slice(0, stop))
                begin += stop
                size = _SORT
                if stop < len(key):
                    yield from flush(pa.Table.from_batches(kept))
                    kept.clear()
                    size = 0
        if kept:
            yield from flush(pa.Table.from_batches(kept))

    sent = docs.mapInArrow(send, packed)
    met = materialize(sent.repartitionById(n, "bucket").mapInArrow(meet, found_schema), "pieces")
    opened = met.where("open is not null").groupBy("doc_id", "text_key").agg(F.collect_list("open").alias("open"), F.collect_list("keys").alias("keys"))
    same = F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.text_key") == F.col("o.text_key"))
    texts = docs.alias("d").join(opened.alias("o"), same).select("d.doc_id", "d.text_key", "d.text", "o.open", "o.keys")
    bytes_ = texts.mapInArrow(fetch, f"key bigint, {_KEY}, at bigint, bytes binary")
    sorted_ = bytes_.repartition("key").sortWithinPartitions("key").mapInArrow(sort, f"{_KEY}, spans binary")
    return met.where("spans is not null").select("doc_id", "text_key", "spans").unionAll(sorted_)


def merge_starts(spans: list[bytes], match: int) -> np.ndarray:
    """Maximal byte spans (begin, end) that repeated starts cover."""
    s = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 2) for b in spans])
    begin, end = s[:, 0], s[:, 0] + s[:, 1] - 1 + match
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], np.maximum.accumulate(end[by])
    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    return np.stack([begin[new], end[np.append(new[1:], len(end)) - 1]], 1)


def suffix_dedup(documents: DataFrame, match: int = MATCH, crowd: int = CROWD) -> DataFrame:
    """documents with n_bytes, n_removed, n_spans, kept_sha256 and kept_text, which replace columns of those names.

    kept_text leaves out characters that a removed span cuts in two; kept_sha256 is of the remaining bytes.
    """
    new = T.StructType.fromDDL("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string")
    fields = [f for f in documents.schema.fields if f.name not in (*new.names, "text_key", "spans")]
    keep = [F.col(f"`{f.name}`") for f in fields]
    docs = documents.select(*keep, F.xxhash64("text").alias("text_key"))
    spans = repeated_starts(docs.select("doc_id", "text_key", "text"), match, crowd).groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("spans"))
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_key") == F.col("s.text_key"))
    joined = docs.alias("d").join(spans.alias("s"), same, "left").select(*[F.col(f"d.`{f.name}`") for f in fields], "s.spans")

    def cut(batches):
        for part, texts in shards(batches, "text", 4 << 20):
            rows = []
            for text, found in zip(texts, part.column("spans").to_pylist(), strict=True):
                out, last, gone = [], 0, merge_starts(found, match).tolist() if found else []
                for a, b in gone:
                    out.append(text[last:a])
                    last = b
                kept = b"".join([*out, text[last:]])
                rows.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], *columns], names=[*[f.name for f in fields], *new.names])

    return joined.mapInArrow(cut, T.StructType([*fields, *new.fields]))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
