"""Each operator against a brute-force version on small tables with nulls, empties, ties, repeats and long texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from brindle.llm import brown, chat, decontaminate, mixing, simhash, suffix, topk, toxicity, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "the", "The"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = line(60)
    out = [(i, line(r.randint(1, 80)), "en", f"s{i % 4}", 0) for i in range(60)]
    out += [(100 + i, f"{line(15)} {shared} {line(9)}", "en", "hot", 0) for i in range(15)]
    out += [(200 + i, shared, None, "hot", None) for i in range(6)]
    out += [(300, None, None, None, None), (301, "", "en", "", 0), (302, " \t\n", "en", "s1", 3), (303, "x" * 3000, "en", "s1", 0), (304, "a b " * 30000, "en", None, 0)]
    out += [(5, out[5][1], "en", "s1", 0), (5, out[5][1], "en", "s1", 0), (6, "another text of six", "en", "s2", 0), (None, line(30), "en", "s3", 0), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_url_filter(spark):
    listed = spark.createDataFrame([("com", "/en/", "block"), ("a.com", "/en/7", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    cases = [("http://X.A.com/en/71?q", "x.a.com", "/en/71", "a.com/en/7", "allow"), ("https://b.com/en/", "b.com", "/en/", "com/en/", "block"), ("x://com/en/#f", "com", "/en/", "com/en/", "block"), ("x://xcom/en/", "xcom", "/en/", None, "allow"), ("no host", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://b.com/EN/", "b.com", "/EN/", None, "allow"), ("a://b.com", "b.com", "", None, "allow")]
    pages = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)] * 2, "page_id long, url string, rule string")
    got = urlfilter.url_filter(pages, listed).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *c[1:]) for i, c in enumerate(cases)] * 2, key=str)
    assert urlfilter.url_filter(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in urlfilter.url_filter(pages, listed.limit(0)).collect()} == {"allow"}


def test_url_filter_of_many_shapes(spark):
    r = random.Random(6)
    hosts, paths = ["a", "b.a", "c.b.a", "x.a", "a.b", "", "ab"], ["", "/", "/p", "/p/q", "/pq", "p", "/" + "z" * 50]
    rules = sorted({(r.choice(hosts[:5]), r.choice(paths)) for _ in range(25)} | {("a", "b/p")})
    listed = [(h, p, r.choice(["allow", "block"])) for h, p in rules]
    urls = [f"s://{h}{p}{t}" for h in hosts for p in paths for t in ("", "/r", "?q", "r")] + ["s://a?b/p", None]
    want = []
    for i, u in enumerate(urls):
        host, path = re.search(r"://([^/?#]*)([^?#]*)", u or "").groups() if u else ("", "")
        fits = [(len(h + p), len(h), v, h + p) for h, p, v in listed if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = min(fits, key=lambda x: (-x[0], -x[1], x[2], x[3]), default=(0, 0, "none", None))
        want.append((i, host, path, best[3], best[2]))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = urlfilter.url_filter(pages, spark.createDataFrame(listed, "host string, path string, verdict string"), "none").collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want


def test_chat_round_trip(spark):
    texts = [None, "", r"\### Assistant: </turn> ok", "\\", "\\\\e", "</turn>\n### x: y", "é" * 3, "\\h\\c\\", "a: b", "</turn", "x" * 50000]
    rows = [(c, i, r, t) for c, r in ((1, "user"), (2, "assistant"), (3, "a: </turn>### \\"), (None, None)) for i, t in enumerate(texts)] + [(4, 0, "user", "same")] * 2
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 5 and all(r.round_trip for r in got.values())
    assert [t.text for t in got[2].turns] == [t or "" for t in texts]
    assert len(got[2].loss_spans) == len(texts) and not got[1].loss_spans
    assert [t.text for t in got[4].turns] == ["same", "same"]
    assert "\\\\e" not in got[4].formatted and got[4].formatted == "### user: same</turn>\n" * 2
    wide = spark.createDataFrame([(1, 0, "user", "x", "y", 3)], "conv_id long, turn long, role string, text string, formatted string, source int")
    assert [r.formatted for r in chat.format_conversations(wide).collect()] == ["### user: x</turn>\n"]
    assert chat.format_conversations(wide.limit(0)).count() == 0


def test_chat_fails_where_a_chat_does_not_read_back(spark, monkeypatch):
    monkeypatch.setattr(chat, "unescape", lambda c, role=False: mixing.F.replace(c, mixing.F.lit("a"), mixing.F.lit("b")))
    rows = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="does not read back"):
        chat.format_conversations(rows).collect()


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(spaced(r[1]))
    taken, target = collections.Counter(), {}
    for r in got:
        assert r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, (s or "").encode())))}
    want, free, rest = {}, dict(weights), 1.5 * sum(size.values())
    while free:
        over = [s for s in free if rest * free[s] / sum(free.values()) > 2 * size[s] - 1e-9]
        if not over:
            want |= {s: rest * free[s] / sum(free.values()) for s in free}
            break
        for s in over:
            want[s] = 2 * size[s]
        rest -= sum(2 * size[s] for s in over)
        free = {s: w for s, w in free.items() if s not in over}
    assert all(abs(want[s] - target[s]) < 1e-6 and abs(taken[s] - want[s]) <= 16 for s in size), (want, taken)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    for shard_rows in (2000, 7):  # each row's words by a plain version; only the hashes come from Spark
        assert sorted(map(str, plain_mix(docs, want, shard_rows))) == sorted(str((r.doc_id, r.size, r.source, r.taken)) for r in mixing.mix(docs, shard_rows=shard_rows).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def sainte_lague(votes, seats):
    """Seats of each party (votes, tie-break), one after another to the highest quotient."""
    won = [0] * len(votes)
    for _ in range(seats):
        won[max(range(len(votes)), key=lambda i: (votes[i][0] / (2 * won[i] + 1), [-x for x in votes[i][1]]))] += 1
    return won


def plain_mix(docs, target, shard_rows, block=8, most=2):
    sized = docs.select("doc_id", "source", "text", mixing.F.xxhash64("text").alias("k")).withColumn("place", mixing.F.xxhash64("doc_id", "k", mixing.F.lit(mixing.SEED)))
    rows = [(r.doc_id, r.source, len(spaced(r.text)), r.place, r.k, r.h) for r in sized.withColumn("h", mixing.F.xxhash64("place")).collect()]
    names = sorted(target, key=lambda s: (s is None, (s or "").encode()))
    blocks = sainte_lague([(target[s], (i,)) for i, s in enumerate(names)], round(sum(target.values()) / block))
    out = []
    for s, own_blocks in zip(names, blocks):
        own = [r for r in rows if r[1] == s]
        shards = max(1, -(-len({(r[0], r[4]) for r in own}) // shard_rows))
        parts = collections.defaultdict(list)
        for r in own:
            parts[r[5] % shards].append(r)
        keys = sorted(parts)
        for k, quota in zip(keys, sainte_lague([(sum(r[2] for r in parts[k]), (k,)) for k in keys], own_blocks)):
            all_words = sum(r[2] for r in parts[k])
            words = min(quota * block, most * all_words)
            took = collections.Counter()
            order = sorted(range(len(parts[k])), key=lambda i: (parts[k][i][3], i))
            while words and all_words:
                for i in order:
                    some = min(words, parts[k][i][2])
                    took[i] += some
                    words -= some
            out += [(r[0], r[2], s, took[i]) for i, r in enumerate(parts[k])]
    return out


def test_sainte_lague(spark):
    r = random.Random(1)
    for _ in range(4):
        votes, seats = [r.choice([0, 1, 5, 50, 1000]) + i / 100 for i in range(1, r.randint(2, 9))], r.randint(0, 60)
        won = sainte_lague([(v, (i,)) for i, v in enumerate(votes)], seats)
        parties = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "i int, votes double, seats long")
        got = mixing.apportion(parties, [], "votes", "seats", [mixing.F.col("i")])
        assert [x.quota for x in got.orderBy("i").collect()] == won


def test_topk(spark):
    r = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in r.normal(size=6)]) for i in range(700)] + [(50, [1.0] * 6), (701, None), (702, [1.0, None]), (703, [float("nan")] * 6), (704, []), (None, [1.0] * 6), (800, [2.0] * 9), (51, [1.0] * 6)] + [(900 + i, [0.5] * 6) for i in range(8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    fine = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, e in fine:
        if q % 50 == 0:
            own = sorted(((-sum(a * b for a, b in zip(e, c)), i) for i, c in fine if i != q))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(own)]
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), block=64).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    chunked = topk.top_k(df.withColumn("score", mixing.F.lit("x")), df.where("vec_id % 50 = 0").withColumn("q", mixing.F.lit(1)), chunk=8).collect()
    assert sorted(map(tuple, chunked)) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_topk_scores_beyond_float64(spark):
    big = 2.0**23
    rows = [(0, [big, 1.0]), (1, [big, 0.0]), (2, [big, 5 / 256]), (3, [1.0, 1.0]), (50, [1.0, -1.0]), (4, [3e38, -3e38]), (100, [-3e38, 1.0]), (5, [big, 5 / 256]), (6, [-2.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    fine = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    cut = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    want = []
    for q in (0, 50, 100):
        own = sorted((-cut(sum(a * b for a, b in zip(fine[q], e))), i) for i, e in fine.items() if i != q)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(own)]
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0"), k=3, block=2).collect())) == sorted(want)


def test_topk_skips_blocks_of_structured_vectors():
    r = np.random.default_rng(2)
    for vectors in (np.repeat(np.eye(16) * 256, 200, 0) + r.integers(-9, 9, (3200, 16)), (r.random((3200, 64)) < 0.03) * r.integers(1, 256, (3200, 64))):
        vectors = r.permutation(vectors.astype(float))
        best = topk.search(vectors[:40], np.arange(40), vectors, np.arange(3200), 5, 32)
        assert best.visited < best.blocks / 2, best.visited / best.blocks
        scores = (vectors[:40] @ vectors.T).astype(int)
        for q in range(40):
            assert list(zip(best.scores[q], best.ids[q])) == [(s, i) for s, i in sorted(((s, i) for i, s in enumerate(scores[q]) if i != q), key=lambda x: (-x[0], x[1]))[:5]]


def test_decontamination(spark, docs, rows):
    items = [(1, rows[3][1]), (2, " ".join(rows[60][1].split()[10:40])), (3, "W1 w2"), (4, None), (None, rows[7][1]), (3, "w5"), (1, rows[3][1]), (6, "!!")]
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])] |= {str(i)} if i is not None else set()
    want = []
    for d, t, *_ in rows:
        w, hit, who = word(t), set(), set()
        for n in set(map(len, windows)):
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    who |= windows[x]
        want.append((d, len(w), len(hit), tuple(sorted(who))))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs.withColumn("spans", mixing.F.lit(1)), benchmark).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=str) == sorted(want, key=str)
    assert all(not (set(word(r.clean_text)) and r.n_hit == r.n_words) for r in got)
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), benchmark).count() == 0


def test_fm_index_counts_and_places():
    r = np.random.default_rng(1)
    s = r.integers(1, 4, 500)
    index = decontaminate.Index(s, 4)
    for n in (1, 2, 5):
        patterns = np.unique(np.lib.stride_tricks.sliding_window_view(s, n), axis=0)
        which, low, high = index.search(patterns)
        assert len(which) == len(patterns)
        for p, a, b in zip(patterns, low, high):
            assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(s) - n + 1) if (s[i : i + n] == p).all()]


def test_toxicity(spark):
    r = random.Random(2)
    bad, good = ["awful1", "vile2"], [f"n{i}" for i in range(300)]
    data = [(i, " ".join(r.choices(good, k=40) + ([r.choice(bad)] * 2 if i % 4 == 0 else []))) for i in range(600)] + [(1000, None), (1001, ""), (1002, "vile2 " * 20000), (None, "awful1")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1, None), (None, 1), (2, 0), (5000, 1)], "doc_id long, toxic int")
    scored = {x.doc_id: x for x in toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert len(scored) == len(data) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in scored.values())
    assert np.mean([scored[i].predicted == int(i % 4 == 0) for i in range(400, 600)]) > 0.95
    apart = toxicity.out_of_fold([(t or "").encode() for _, t in data[:400]], np.array([i % 4 == 0 for i in range(400)], float))
    assert np.mean((apart >= 0.5) == [i % 4 == 0 for i in range(400)]) > 0.95
    assert all((a == b) for a, b in zip(map(str, toxicity.train(docs.repartition(7), labels)), map(str, toxicity.train(docs.withColumn("label", mixing.F.lit("x")), labels))))
    none = toxicity.toxicity(docs, toxicity.train(docs, labels.limit(0)))
    assert none.where("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_toxicity_learns_within_its_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 20, f"a{i} b") for i in range(400)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels, **_: (np.zeros(0, np.uint32), np.zeros(0), float(1000 * len(rows) + sum(map(len, rows)))))
    learnt = lambda **k: divmod(int(toxicity.train(docs, labels, **k)[2]), 1000)  # noqa: E731  rows, features
    assert learnt(max_features=10**6) == (401, 200)  # 400 rows of 3 features
    assert learnt(max_rows=10) == (10, 30) and learnt(max_features=100) == (33, 99) and learnt(max_features=1) == (1, 3)


def plain_features(text):
    mask = 2**64 - 1
    w = [xxhash.xxh3_64_intdigest(x.encode()) for x in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))]

    def mixed(x):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & mask
        return x ^ (x >> 29)

    both = [mixed((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + (1 if gap == 1 else 2)) & mask) for gap in (1, 2, 3) for a, b in zip(w, w[gap:])]
    return {x >> 32 for x in [*w, *both]}


def test_toxicity_equals_plain_ftrl(spark):
    r = random.Random(4)
    words = [f"n{i}" for i in range(40)] + ["Été"]
    data = [(i, " ".join(r.choices(words, k=r.randint(1, 30)) + ["vile"] * (r.random() < (0.8 if i % 3 == 0 else 0.1)))) for i in range(150)] + [(7, "n1 vile n2"), (151, None), (152, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    labels = {i: int(i % 3 == 0) for i in range(0, 153, 1) if i % 5}
    got = {(x.doc_id, x.text): x.score for x in toxicity.toxicity(docs, toxicity.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))).collect()}
    hashed = lambda x: xxhash.xxh3_64_intdigest(x) - 2**63
    bytes_of = lambda t: np.array(sorted(plain_features(t)), np.uint32).tobytes()
    train = sorted((x for x in data if x[0] in labels), key=lambda x: (hashed(str(x[0])), hashed(bytes_of(x[1]))))
    seen = collections.Counter(f for _, t in train for f in plain_features(t))
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    mean = sum(labels[d] for d, _ in train) / len(train)
    z["bias"] = -math.log(mean / (1 - mean)) * toxicity.BETA / toxicity.ALPHA

    def weight(f):
        l1, l2 = (0, 0) if f == "bias" else (toxicity.L1, toxicity.L2)
        return 0.0 if abs(z[f]) <= l1 else -math.copysign(abs(z[f]) - l1, z[f]) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + l2)

    for _ in range(toxicity.EPOCHS):
        for d, t in train:
            own = [f for f in plain_features(t) if seen[f] >= toxicity.MIN_DOCS] + ["bias"]
            w = {f: weight(f) for f in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[d]
            for f in own:
                sigma = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA
                z[f] += g - sigma * w[f]
                n[f] += g * g
    for d, t in data:
        s = sum(weight(f) for f in plain_features(t) if seen[f] >= toxicity.MIN_DOCS) + weight("bias")
        assert abs(got[d, t] - 1 / (1 + math.exp(-s))) < 1e-9
    assert len({round(x, 6) for x in got.values()}) > 3


def test_simhash(docs, rows):
    def print_(t):
        w = spaced(t)
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum((2 * sum((x >> k) & 1 for x in h) > len(h)) << k for k in range(64)) if h else 0

    prints = [print_(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted(((r[0], p, least.get(g)) for r, p, g in zip(rows, prints, group)), key=str)
    got = sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in simhash.simhash_components(docs).collect()), key=str)
    assert got == want
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_simhash_links_through_rows_without_id(spark, monkeypatch):
    prints = [(None, 0b0011), (7, 0b0000), (4, 0b1111), (None, 1 << 40), (9, 1 << 40 | 1), (4, 0x7FFF << 45), (None, 0x7F7F << 20)]
    df = spark.createDataFrame([(d, str(f)) for d, f in prints], "doc_id long, text string")
    monkeypatch.setattr(simhash, "fingerprints", lambda d: d.select("doc_id", mixing.F.col("text").cast("long").alias("fingerprint")))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()), key=str)
    assert got == sorted([(d, f, c) for (d, f), c in zip(prints, [4, 4, 4, 4, 4, 4, None])], key=str)


def test_crowded_cells_keep_all_components(spark):
    r = np.random.default_rng(5)
    f = np.unique(np.concatenate([np.uint64(x) ^ (np.uint64(1) << r.integers(0, 8, 120, np.uint64)) ^ (np.uint64(1) << r.integers(0, 60, 120, np.uint64)) for x in (0, 2**40 - 1, 12345)]))
    keys = np.zeros(len(f), np.int64)
    ways = []
    for crowd in (10**6, 4, 1):
        a, b = simhash.cell_links(keys, f, crowd=crowd)
        assert (np.bitwise_count(f[a] ^ f[b]) <= 2).all()
        ways.append(simhash._roots(len(f), a, b).tolist())
    assert ways[0] == ways[1] == ways[2]
    df = spark.createDataFrame([(x,) for x in f.view(np.int64).tolist()], "fingerprint long")
    for split in (1 << 16, 5):
        got = {x.node: x.component for x in simhash.connected_components(simhash.links(df, split)).collect()}
        same = [got.get(x, x) for x in f.view(np.int64).tolist()]
        assert len(set(zip(ways[0], same))) == len(set(ways[0])) == len(set(same))


def test_manhattan_bound():
    f = np.random.default_rng(1).integers(0, 2**63, (2, 500), np.uint64)
    counts = lambda x: np.array([[(int(v) >> 2 * i & 1) + (int(v) >> 2 * i + 1 & 1) for i in range(32)] for v in x])
    want = np.abs(counts(f[0]) - counts(f[1])).sum(1)
    assert (simhash.manhattan(*map(simhash.embed, f)) == want).all() and (want <= np.bitwise_count(f[0] ^ f[1])).all()


def test_one_of_each_group(spark):
    long = " ".join(f"u{i}" for i in range(300))
    rows = [(7, long), (3, long), (3, long), (3, "quite another text of three"), (None, long), (None, "alone without an id"), (None, "alone without an id"), (9, None), (8, ""), (9, "more")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _x string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(df).collect()), key=str)
    assert got == sorted([(3, long), (3, "quite another text of three"), (None, "alone without an id"), (8, ""), (9, "more")], key=str)
    named = simhash.simhash_components(df.withColumn("doc_id", mixing.F.concat(mixing.F.lit("d"), "doc_id")))
    assert {r.component_id for r in named.collect() if r.doc_id == "d7"} == {"d3"}


@pytest.mark.parametrize("match,crowd", [(100, 500), (100, 2), (100, 0), (40, 3)])
def test_suffix_dedup(docs, rows, match, crowd):
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "", r[0]) for r in rows}, key=lambda x: (x[0], x[1], xxhash.xxh64_intdigest(x[2].encode(), 42) - (2**64 if xxhash.xxh64_intdigest(x[2].encode(), 42) >= 2**63 else 0)))
    if [r for r in rows if r[0] is None]:  # a null text is hashed as null
        order = [x for x in order if x[2]] + [x for x in order if not x[2]]
    seen, want = set(), {}
    for _, _, t, d in order:
        b = t.encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - match + 1):
            w = b[p : p + match]
            if w in seen:
                cover[p] += 1
                cover[p + match] -= 1
            seen.add(w)
        c = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~c])
        want[d, t] = (len(b), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = suffix.suffix_dedup(docs.withColumn("kept_text", mixing.F.lit(1)).withColumn("spans", mixing.F.lit(2)), match, crowd).collect()
    assert len(got) == len(rows)
    for r in got:
        assert want[r.doc_id, r.text or ""] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256), r.doc_id
    assert suffix.suffix_dedup(docs.limit(0)).count() == 0


def test_suffix_order():
    r = np.random.default_rng(0)
    for _ in range(100):
        s = r.integers(1, int(r.integers(2, 5)), int(r.integers(1, 60)))
        for depth in (3, 10, 100):
            order = suffix.suffix_order(s, depth)
            prefixes = [tuple(s[i : i + depth]) for i in order]
            assert sorted(order) == list(range(len(s))) and prefixes == sorted(prefixes)


def test_warc(spark, tmp_path):
    fake = "a\r\n\r\nWARC/1.1\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 0\r\n\r\n\r\n\r\nb"
    pages = [(1, "u", "x"), (2, "u\r\nv", "x"), (3, None, None), (4, "u", fake), (None, "v", "x"), (5, "w", ""), (6, "w", fake * 50), (7, "é", "é" * 5000), (7, "é", "é" * 5000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    largest = {}
    for p, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if p is None else p)
    for least, where in ((0, "a"), (2, "b")):
        warc.write_archives(df, f"{tmp_path}/{where}", least)
        got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, f"{tmp_path}/{where}").collect()), key=str)
        want = []
        for p, _, h in pages:
            n, m = len((h or "").encode()), largest[h or ""]
            own = n < least or p == m
            want.append((p, n, "response" if own else "revisit", None if own else m))
        assert got == sorted(want, key=str)
    warc.write_archives(df.limit(0), f"{tmp_path}/c")
    assert warc.read_archives(spark, f"{tmp_path}/c").count() == 0
    plain = warc.inflate(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    assert [(a, b) for a, b, *_ in warc.candidates(plain)] == [(0, len(plain))]


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 50_000)
    pages = [(i, "u", "x" * (9000 if i == 5 else 10) + str(i)) for i in range(40)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/a", compression="none")
    sizes = [f.stat().st_size for f in (tmp_path / "a").glob("part-*")]
    assert len(sizes) >= 10 and max(sizes) <= 50_000 and warc.read_archives(spark, f"{tmp_path}/a").count() == 40


def test_warc_long_url_and_broken_chain(spark, tmp_path):
    long = "http://a/" + "WARC/1.1 é" * 12000 + "WARC/1.1"
    pages = [(1, "u", "x"), (2, long, "y"), (3, "v", "z\r\nWARC/1.1\r\n"), (4, long, "WARC/1.1\r\n" * 30000), (5, "w", "v")]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/a")
    got = warc.read_archives(spark, f"{tmp_path}/a").select("page_id", "url", "payload_bytes").collect()
    assert sorted(map(tuple, got)) == [(p, u, len(h)) for p, u, h in pages]
    whole = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for name, data in (("b", whole + whole[:-6]), ("c", whole[:-1])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(data)
        with pytest.raises(Exception, match="chain of records ends|no record in"):
            warc.read_archives(spark, f"{tmp_path}/{name}").collect()


def test_brown(spark, docs, rows):
    got = brown.score(docs, mixing.F.crc32(mixing.F.col("doc_id").cast("string")) % 5 == 1, head=32, clustered=12, classes=4).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = collections.Counter(w for r in rows if not held(r[0]) for w in [*spaced(r[1]), "\n"])
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*spaced(t), "\n"])
    want = sorted((str(r[0]), len(spaced(r[1])) + 1, sum(counts[w] > 0 for w in [*spaced(r[1]), "\n"]), n, round(base(r[1]), 3)) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert brown.score(docs.limit(0), mixing.F.lit(False)).count() == 0


def test_brown_is_a_distribution():
    r = np.random.default_rng(0)
    texts = [" ".join(r.choice(["a", "b", "c", "d", "e"], 30)).encode() for _ in range(40)]
    flat, bounds, h = brown.tokens(texts)
    counts = np.bincount(flat)
    order = np.argsort(h)
    hashes, counts = h[order], counts[order]
    words = np.sort(hashes[np.argsort(-counts)[:3]])
    c = brown.look_up(words, h)
    c = np.where(c < 0, 3, c)[flat]
    pairs = np.zeros((4, 4), np.int64)
    np.add.at(pairs, (brown._before(c, bounds, words, 4), c), 1)
    model = brown.Model(int(counts.sum()), len(counts), hashes, counts, words, pairs, 2)
    rare = [k for k in range(len(hashes)) if hashes[k] not in words]
    inside = sum(10 ** (model.log_count[k] - model.rare) for k in rare) + 0.5 / 10**model.rare
    for before in range(3):
        total = 10 ** model.step[before, 2] * inside
        for k in range(3):
            total += 10 ** (model.step[before, model.own[k]] + model.emit[k])
        assert abs(total - 1) < 1e-6


def test_brown_scores_equal_a_plain_model(spark):
    r = random.Random(8)
    follow = {f"w{i}": r.sample([f"w{j}" for j in range(9)], 3) for i in range(9)}
    texts = []
    for _ in range(70):
        line = [r.choice(list(follow))]
        while r.random() < 0.93:
            line.append(r.choice(follow[line[-1]]) if r.random() < 0.8 else r.choice(list(follow)))
        texts.append(" ".join(line))
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, "w1 New w2"), (101, None), (102, "W3")]
    k, end = 4, "\n"
    token = lambda t: [*spaced(t), end]
    train = [token(t) for i, t in rows if i < 60]
    counts = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter((a, b) for t in train for a, b in zip([end, *t], t))
    words = sorted(counts, key=lambda w: xxhash.xxh3_64_intdigest(w))
    order = sorted(words, key=lambda w: -counts[w])
    own = {w: i % k for i, w in enumerate(order)}
    g = lambda x: x * math.log(x) if x else 0.0

    def table(of):
        out = np.zeros((k + 1, k + 1))
        for (a, b), n in pairs.items():
            out[of[a], of[b]] += n
        return out

    def likelihood(of):
        t = table(of)
        return sum(map(g, t.ravel())) - sum(map(g, t.sum(0))) - sum(map(g, t.sum(1)))

    moved = True
    while moved:
        moved = False
        for w in order:
            gains = [likelihood(own | {w: c}) for c in range(k)]
            best = int(np.argmax(gains))
            if gains[best] > gains[own[w]] + 1e-6:
                own[w], moved = best, True
    n, kinds = sum(counts.values()), collections.Counter(own.values())
    size = collections.Counter()
    for w, c in own.items():
        size[c] += counts[w]
    t = table(own)
    mean = t.sum(0) + 0.5
    mean[[c for c in range(k) if not kinds[c]]] = 1e-9
    mean /= mean.sum()
    step = (t + brown.PULL * mean) / (t.sum(1, keepdims=True) + brown.PULL)

    def plain(text):
        total, before = 0.0, own[end]
        for w in token(text):
            c = own.get(w, k)
            total += math.log10(step[before, c]) + (math.log10((counts[w] + 0.5) / (size[c] + 0.5 * kinds[c])) if w in own else 0.0)
            before = c
        return total

    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, counts string").repartition(3)
    got = {x.doc_id: x for x in brown.score(df, mixing.F.col("doc_id") >= 60, clustered=1000, classes=k).collect()}
    for i, text in rows:
        assert abs(got[i].score - plain(text)) < 1e-6, i
        assert abs(got[i].perplexity - 10 ** (-plain(text) / len(token(text)))) < 1e-6


def test_brown_head_does_not_depend_on_partitions(spark):
    r = random.Random(1)
    rows = [(i, " ".join(f"v{int(r.paretovariate(0.6))}" for _ in range(40))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", mixing.F.lit(False))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    heads = []
    for n in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        heads.append([x.tolist() if hasattr(x, "tolist") else x for x in brown.word_counts(brown.token_shards(df.repartition(n)), 40)])
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    counts = collections.Counter(w for _, t in rows for w in [*t.split(), "\n"])
    assert heads[0] == heads[1] and heads[0][:2] == [sum(counts.values()), len(counts)] and 20 < len(heads[0][2]) < 60
    assert min(heads[0][3]) >= sorted(counts.values())[-len(heads[0][3]) - 15]


def test_brown_places_words_outside_the_clustered(spark):
    r = random.Random(0)
    pairs = [("a", f"x{i}", "b") for i in range(40)] + [("c", f"y{i}", "d") for i in range(40)]
    often = [("a", "X", "b"), ("c", "Y", "d")]
    texts = [" ".join(w for i in range(6) for w in (often[k % 2] if i % 2 else r.choice(pairs[:40] if k % 2 == 0 else pairs[40:]))) for k in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, "a x1 b"), (1001, "a y1 b"), (1002, "c y1 d"), (1003, "c x1 d"), (1004, "never b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tokenized = brown.token_shards(df.withColumn("held_out", mixing.F.col("doc_id") >= 1000))
    n, v, h, c = brown.word_counts(tokenized)
    words = np.sort(h[np.lexsort((h, -c))[:7]])
    model = brown.Model(n, v, h, c, words, brown.pair_counts(tokenized, words), 7)
    placed = brown.placed_words(tokenized, model)
    head = brown.head_words(placed, model, 1000)
    assert len(head[0]) == v and head[1].sum() == n and model.kinds.sum() == v and model.size.sum() == n and (head[2] < 7).all()
    of = dict(zip(head[0].tolist(), head[2].tolist()))
    kind = lambda p: {of[x] for i in range(40) if (x := xxhash.xxh3_64_intdigest(f"{p}{i}")) in of}
    assert len(kind("x")) == len(kind("y")) == 1 and kind("x") != kind("y")
    texts = brown.class_sequences(tokenized, placed, model, head)
    model.settle(brown.class_pairs(texts.where("not held_out"), 8))
    for before in range(7):
        emitted = sum(10 ** (model.step[before, k] + np.log10(n + 0.5) - model.inside[k]) for n, k in zip(*head[1:])) + 10 ** model.step[before, 7]
        assert abs(emitted - 1) < 1e-6
    for few in (12, 1000):  # with and without words that are asked for by hash
        got = {x.doc_id: x for x in brown.score(df, mixing.F.col("doc_id") >= 1000, head=few, clustered=7, classes=7).collect()}
        assert got[1000].score > got[1001].score + 1 and got[1002].score > got[1003].score + 1 and got[1004].n_known == 2
    assert all(a < b for a, b in zip(brown.sizes(10**6), brown.sizes(10**7)))


@pytest.fixture(scope="module")
def pipeline_dir(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def test_pipeline_on_odd_rows(spark, docs, pipeline_dir):
    import corpus_pipeline

    for start in (docs, docs.limit(0), docs.withColumn("score", mixing.F.lit("x")).withColumn("size", mixing.F.lit(1))):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            new = corpus_pipeline.materialize(stage(spark, now, pipeline_dir), name)
            if name != "mixing":
                assert new.columns == now.columns
            assert new.count() <= now.count()
            now = new
    assert {"size__own", "size", "score"} <= set(now.columns)


def test_pipeline_mixes_repeated_rows_once_each(spark, docs, rows, pipeline_dir):
    import corpus_pipeline

    got = sorted(((r.doc_id, r.text, r.source, r.taken) for r in corpus_pipeline.mix_sources(spark, docs, pipeline_dir).collect()), key=str)
    key = mixing.F.xxhash64("text").alias("text_key")
    names = {(r.doc_id, r.text_key, r.source): r.text for r in docs.select("doc_id", "source", "text", key).collect()}
    assert got == sorted(((r.doc_id, names[r.doc_id, r.text_key, r.source], r.source, r.taken) for r in mixing.mix(docs).collect() if r.taken), key=str)


def test_pipeline_equals_its_stages_by_plain_versions(spark, rows, pipeline_dir):
    """Each stage's decision on its own input, worked out in plain Python from the stage's input rows."""
    import os

    import corpus_pipeline
    from brindle.llm import common

    now = spark.read.parquet(f"{pipeline_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    model = toxicity.train(now, spark.read.parquet(f"{pipeline_dir}/labels.parquet").where(~toxicity.held_out()))
    key = lambda r: (r.doc_id, r.text or "")
    kept = stages["toxicity"](spark, now, pipeline_dir).collect()
    assert sorted(map(key, kept), key=str) == sorted((key(r) for r in now.collect() if toxicity.score([(r.text or "").encode()], *model)[0] < 0.5), key=str)

    given = [(d, t or "") for d, t, *_ in rows]
    prints = [simhash.fingerprint(t.encode()) for _, t in given]
    group = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group = [group[j] if g == group[i] else g for g in group]
    kept = [key(r) for r in stages["simhash_near_dedup"](spark, now, pipeline_dir).collect()]
    assert len(kept) == len(set(group)) and {group[given.index(k)] for k in kept} == set(group)
    least = {g: min((d is None, d or 0) for (d, _), h in zip(given, group) if h == g) for g in group}
    assert all((d is None, d or 0) == least[group[given.index((d, t))]] for d, t in kept)

    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = {tuple(f"w{i}" for i in range(k, k + 10)) for k in (1, 2)}
    for r in stages["decontamination"](spark, now, pipeline_dir).collect():
        left = word(r.text)
        assert not any(tuple(left[k : k + 10]) in windows for k in range(len(left)))

    left = set(common._made)
    final = corpus_pipeline.run(spark, pipeline_dir)
    assert final.count() and len(set(common._made) - left) == 1 and os.listdir(common.shared_dir(spark).removeprefix("file://"))


OWN_NAMES = ("salt", "found", "begin", "rest", "rounds", "copies", "copy", "own", "host_chars", "key", "block", "best", "_id", "_place", "_copy", "_text", "_source", "_", "__", "spans", "text_key", "items", "kept_text", "clean_text", "n_hit", "score", "predicted", "place", "shard", "quota", "fingerprint", "a.b")


def test_url_filter_keeps_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/1", *OWN_NAMES), (2, None, *OWN_NAMES)], f"page_id long, url string, {', '.join(f'`{c}` string' for c in OWN_NAMES)}")
    listed = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string")
    for some in (listed, listed.limit(0)):
        got = urlfilter.url_filter(pages, some).collect()
        assert sorted((r.page_id, r.host, r.verdict) for r in got) == [(1, "a.com", "block" if some is listed else "allow"), (2, "", "allow")]
        assert all(r[c] == c for r in got for c in OWN_NAMES)


def test_url_filter_of_one_hot_key(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 1000, '.com/en/', id % 7) AS url")
    listed = spark.createDataFrame([("com", "/en/", "block"), ("h1.com", "/en/1", "allow"), ("org", "/", "block")], "host string, path string, verdict string")
    got = urlfilter.url_filter(pages, listed).collect()
    assert len(got) == 3000 and {r.page_id for r in got if r.verdict == "allow"} == {i for i in range(3000) if i % 1000 == 1 and i % 7 == 1}


def test_warc_refuses_ids_that_are_not_numbers(spark, tmp_path):
    with pytest.raises(TypeError, match="page_id is a whole number"):
        warc.write_archives(spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string"), str(tmp_path / "w"))


def test_warc_with_columns_of_its_own_names(spark, tmp_path):
    pages = spark.createDataFrame([(2, "u", "h", 7, "x", "y"), (3, "v", "h", 8, "x", "y")], "page_id int, url string, html string, size int, digest string, salt string")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()) == [(2, "revisit", 3), (3, "response", None)]


def test_pipeline_keeps_columns_of_any_name(spark, pipeline_dir):
    import corpus_pipeline

    own = spark.read.parquet(f"{pipeline_dir}/documents.parquet").select("*", *[mixing.F.lit(c).alias(c) for c in OWN_NAMES])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, own, pipeline_dir)
        assert set(own.columns) <= set(got.columns), name
        rows = got.collect()
        assert rows and all(r[c] == c for r in rows for c in OWN_NAMES), name


def test_mixing_of_very_many_equal_rows(spark, monkeypatch):
    rows = [(1, "a b c", "s"), (2, "d", "t"), (3, "e f", "t")] + [(7, "same words here", "s")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "COPIES", 64)
    assert sorted(map(str, mixing.mix(docs).collect())) == want and len(want) == len(rows)
    many = spark.range(300000).selectExpr("CAST(1 AS LONG) AS doc_id", "'x y' AS text", "'s' AS source")
    monkeypatch.setattr(mixing, "COPIES", 1 << 16)
    assert mixing.mix(many).agg(mixing.F.count("*"), mixing.F.sum("taken")).first()[:] == (300000, 900000)


def test_decontamination_of_many_benchmark_parts(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 60}" for k in range(12))) for i in range(40)] + [(90, "a b a b a b a b a b")], "item_id long, text string")
    whole = decontaminate.decontaminate(docs, items).drop("clean_text")
    want = sorted(map(str, whole.collect()))
    bounded = decontaminate.parts.__defaults__
    monkeypatch.setattr(decontaminate.parts, "__defaults__", (600,))
    parts = list(decontaminate.parts(items))
    assert len(parts) > 5 and sorted(map(str, decontaminate.decontaminate(docs, items).drop("clean_text").collect())) == want and bounded
