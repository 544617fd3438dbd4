"""Operators 11 to 13 against brute force, on nulls, empties, ties, repeats, long texts, hot groups and clashing columns."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import jaccard, negatives, spelling


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_negatives(rows, k=5, m=3, every=50, low=50, high=95):
    live = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in {(i, l, tuple(v)) for i, l, v in live if i % every == 0}:
        scored = sorted((-dot(v, w), j, l == label) for j, l, w in live if j != i)
        for s, p, _ in [x for x in scored if x[2]][:k]:
            fits = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:m]
            out += [(i, p, r + 1, j, -s, -n) for r, (n, j, _) in enumerate(fits)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "vec_id long, label int, embedding array<float>, cell string, v double")


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 8)) * 3
    out = [(i, int(i % 3), (centres[i % 6] + r.normal(size=8)).astype("f4").tolist()) for i in range(400)]
    out += [(500 + i, i % 2, [1.0] * 8) for i in range(60)]  # ties
    out += [(1000, None, [1.0] * 8), (1050, 1, None), (1100, 1, [1.0, None]), (1150, 1, [float("nan")] * 8), (1200, 1, [float("inf")]), (None, 1, [1.0] * 8), (1250, 2, []), (1300, 2, [2.0, 1.0]), (1350, 0, [0.0] * 8), (50, 2, out[50][2]), (50, 2, out[50][2])]
    return out


def test_hard_negatives(spark, points, monkeypatch):
    anchor = spelling.F.col("vec_id") % 50 == 0
    want = brute_negatives(points)
    assert len(want) > 50
    for settings in ({}, {"PER_PIVOT": 2, "AT_ONCE": 40, "ASKED": 3, "LABELS": 2}):
        for name, value in settings.items():
            monkeypatch.setattr(negatives, name, value)
        got = negatives.hard_negatives(vectors(spark, points).repartition(3), anchor)
        assert sorted(map(tuple, got.collect())) == want
    assert negatives.hard_negatives(vectors(spark, points).limit(0), anchor).count() == 0


def test_hard_negatives_copy_only_what_may_serve(spark, monkeypatch):
    r = np.random.default_rng(1)
    centres = np.eye(12) * 40
    rows = [(i, int(r.integers(2)), (centres[i % 12] + r.normal(size=12)).astype("f4").tolist()) for i in range(3000)]
    monkeypatch.setattr(negatives, "PER_PIVOT", 4)
    copies = []
    write = negatives.materialize
    monkeypatch.setattr(negatives, "materialize", lambda df, name: copies.append((name, out := write(df, name))) or out)
    got = negatives.hard_negatives(vectors(spark, rows), spelling.F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows)
    cells = 60 // 4
    assert sum(df.count() for name, df in copies if name == "copies") < 0.5 * 2 * len(rows) * (cells - 1)


def test_hard_negatives_beyond_floats(spark):
    rows = [(i, i % 2, [3e38 if i % 3 else -3e38, float(i), 1e30]) for i in range(0, 60, 5)]
    live = {i: [negatives.SCALE * float(np.float32(x)) for x in v] for i, _, v in rows}
    got = negatives.hard_negatives(vectors(spark, rows), spelling.F.col("vec_id") == 0).collect()
    assert all(r.positive_score == 2**63 - 1 for r in got) and live  # the end of the range of long


def brute_components(rows, words=4, percent=85):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append((i, frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets)), key=str)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)] + ["Été", "The"]
    line = lambda n: [r.choice(words) for _ in range(n)]
    out = [(i, " ".join(line(r.randint(1, 60)))) for i in range(40)]
    for family in range(12):  # near the threshold, on either side
        base = line(r.choice([12, 30, 90, 200]))
        for i in range(9):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                own[r.randrange(len(own))] = r.choice(words)
            if r.random() < 0.4:
                own = own[: -r.randint(1, len(own) // 6)]
            out.append((100 + 10 * family + i, " ".join(own)))
    template = line(150)
    for i in range(80):  # many distinct copies of one text
        own = list(template)
        own[r.randrange(150)] = f"x{i}"
        out.append((1000 + i, " ".join(own)))
    out += [(2000, None), (2001, ""), (2002, " \t"), (2003, "a"), (2004, "A"), (2005, "a b c"), (2006, "a b c"), (2007, "a b c d"), (2008, "q " * 20000), (2009, "Q " * 30000), (None, out[3][1]), (None, None), (None, "only here once"), (7, out[7][1]), (7, out[7][1]), (7, out[8][1])]
    return out


def test_jaccard_components(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, n string, tokens int").repartition(3)
    want = brute_components(texts)
    assert len({r[2] for r in want}) < len(texts) - 100
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect()), key=str) == want
    monkeypatch.setattr(jaccard, "FEW", 0)
    assert sorted(map(tuple, jaccard.jaccard_components(docs, limit=7).collect()), key=str) == want
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0
    few = [(i, t) for i, t in texts if t is None or len(t) < 20]
    assert sorted(map(tuple, jaccard.jaccard_components(docs.where("text is null or length(text) < 20"), words=2, percent=50, part=0.9).collect()), key=str) == brute_components(few, 2, 50)


def test_near_copies_do_not_deal_out_their_earlier_shingles(spark):
    r, parts = random.Random(4), spark.conf.get("spark.sql.shuffle.partitions")
    pairs = [sorted(r.sample(range(1 << 62), 2990)) for _ in range(40)]
    sets = spark.createDataFrame([(2 * i + j, 3000) for i in range(40) for j in (0, 1)], "node long, n long")
    shared = spark.createDataFrame([(2 * i + j, t) for i, t in enumerate(pairs) for j in (0, 1)], "node long, tokens array<long>")

    def shuffled():
        time.sleep(2)  # the store lags
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    spark.conf.set("spark.sql.shuffle.partitions", 400)  # else lists of one set stand side by side and are compressed away
    try:
        links = jaccard.set_links(sets, shared).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert sorted(tuple(sorted(e)) for e in links) == [(2 * i, 2 * i + 1) for i in range(40)]
    assert shuffled() - before < 12e6  # 4 MB; with the list of earlier shingles of each shingle 30 MB


def test_whole_sets_are_dealt_out_only_where_rows_share_an_address(spark):
    def sets(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        known = jaccard.digests(docs)
        survivors = known.groupBy("h1").agg(F.min(F.struct("doc_id", "place")).alias("first")).select(F.monotonically_increasing_id().alias("node"), "first").localCheckpoint()
        return jaccard._whole_sets(docs, known, survivors, jaccard.WORDS)

    one = sets([(1, "a b c d e"), (2, "a b c d f"), (None, "a b c d g"), (3, None)])
    assert "hashpartitioning(node" not in one._jdf.queryExecution().toString()
    again = sets([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d g"), (None, "a b c d g"), (1, "a b c d f")])
    assert (one.count(), again.count()) == (4, 3)


def test_trie_walk_finds_what_pairs_do():
    r = random.Random(2)
    for _ in range(60):
        sets = [np.array(sorted({0, *r.sample(range(1, 40), r.randint(0, 20))})) for _ in range(r.randint(2, 12))]
        sizes = np.array([len(s) + r.randint(0, 2) for s in sets])
        trie = jaccard.Trie(sets, sizes)
        apart = np.arange(len(sets))
        got = {tuple(sorted((int(trie.order[i]), int(trie.order[j])))) for i in range(len(sets)) for j in trie.walk(i, apart, 60)}
        want = {(a, b) for b in range(len(sets)) for a in range(b) if len(np.intersect1d(sets[a], sets[b])) >= jaccard.overlap(sizes[a], sizes[b], 60)}
        assert got == want


def brute_variants(rows, least=7, times=2, ratio=10):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                count[w] += 1
    known = {w: n for w, n in count.items() if n >= times}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else (a[p:] == b[p + 1 :] if len(a) < len(b) else a[p + 1 :] == b[p:])

    by = {w: [v for v in known if near(w, v)] for w in known}
    form = {}
    for w, vs in by.items():
        if vs and known[best := min(vs, key=lambda v: (-known[v], v))] >= ratio * known[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), known[w], len(by[w]), known.get(form.get(w))) for w in known)


@pytest.fixture(scope="module")
def spelled():
    r = random.Random(4)
    base = ["banana" + "na" * i for i in range(4)] + ["Straße" + "éßÿ" * i for i in range(1, 3)] + ["aaaaaaaa", "AAAAAAAAA", "abababab", "z" * 300, "y" * 7, "seven×÷" + "x" * 5]
    typo = lambda w: r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("aébz") + w[k:], w[:k] + r.choice("nàs") + w[k + 1 :]]) if (k := r.randrange(len(w))) >= 0 else w
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = base[min(int(r.expovariate(0.5)), len(base) - 1)]
            while r.random() < 0.25:
                w = typo(w)
            words.append(w)
        rows.append((i, r.choice([" ", ", ", "1", "—", "·", "š"]).join(words)))
    return rows + [(None, rows[0][1]), (None, None), (400, ""), (401, "short words only"), (5, rows[5][1]), (402, "longestword " * 5000), (403, "w" * 100000), (404, "w" * 100000), (405, "w" * 50000 + "v" + "w" * 49999)]


def test_spelling_variants(spark, spelled):
    docs = spark.createDataFrame([(*t, "x", 1) for t in spelled], "doc_id long, text string, word string, n int").repartition(3)
    short = docs.where("text is null or length(text) < 60000")
    rows = [(i, t) for i, t in spelled if t is None or len(t) < 60000 or " " in t]
    want = brute_variants(rows)
    assert any(w[2] != w[1] and w[1] for w in want) and len(want) > 200
    words = spelling.vocabulary(short.unionAll(docs.where("doc_id = 402")).dropDuplicates(["doc_id", "text"]).unionAll(docs.where("doc_id = 5").limit(1)))
    assert sorted(map(tuple, spelling.variants(words).collect())) == want
    near = {r.word: r.near for r in spelling.near_words(words.cache(), limit=5, shard=40).collect()}
    assert near == {w: n for w, _, _, _, n, _ in want if n}
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0


def test_automaton_numbers_words_in_order():
    words = sorted({"".join(random.Random(i).choices("abc", k=6)) for i in range(300)})
    rows = spelling.points(words)
    a = spelling.Automaton(rows[::-1])
    assert [words[::-1][i] for i in a.order] == words
    assert a.numbers(rows.astype(np.int64)).tolist() == list(range(len(words)))
    assert a.numbers(spelling.points(["zzzzzz", "aaaaab"]).astype(np.int64)).tolist()[0] == -1
    full = spelling.Automaton(spelling.points([x + y for x in "abcd" for y in "efgh"]))
    assert len(full.first) - 1 == 3  # four prefixes, one state


def test_very_long_words(spark):
    words = spark.createDataFrame([("w" * 3000, 50), ("w" * 1500 + "v" + "w" * 1499, 3), ("w" * 2999, 2)], "word string, n long")
    got = {len(r.word) + ("v" in r.word): (r.n_near, r.form and len(r.form)) for r in spelling.variants(words).collect()}
    assert got == {3000: (2, None), 3001: (2, 3000), 2999: (2, 3000)}
