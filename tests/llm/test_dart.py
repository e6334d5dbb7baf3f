import random
from collections import Counter

import numpy as np
import pytest

from tesselite.llm import dart, queries


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows, weighting="presence"):
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    names, up = list(texts), {}
    sets = [shingles(t) if weighting == "count" else Counter(set(shingles(t))) for t in names]

    def root(k):
        while up.get(k, k) != k:
            k = up[k]
        return k

    held = {}
    for k, s in enumerate(sets):
        for q in s:
            held.setdefault(q, []).append(k)
    for k, s in enumerate(sets):
        for m in {m for q in s for m in held[q] if m < k}:
            if (s & sets[m]).total() >= 0.8 * (s | sets[m]).total() - 1e-9:
                up[root(k)] = root(m)
    groups = {}
    for k, t in enumerate(names):
        groups.setdefault(root(k), []).extend(texts[t])
    return {i: min(g) for g in groups.values() for i in g}


def corpus():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]

    def edit(b, k):
        b = list(b)
        for _ in range(k):
            b[rnd.randrange(len(b))] = rnd.choice(words)
        return " ".join(b)

    base = [rnd.choice(words) for _ in range(120)]
    texts = [edit(base, rnd.randrange(7)) for _ in range(300)]
    for _ in range(150):
        b = [rnd.choice(words) for _ in range(rnd.randrange(1, 200))]
        texts += [edit(b, rnd.randrange(4)) for _ in range(rnd.randrange(1, 4))]
    line = " ".join(rnd.choice(words) for _ in range(9)) + " "
    texts += [line * 4, line * 5, line * 9, None, "", "  ", "a", "a", "A b", "a b", "x " * 30_000, "x " * 30_001]
    return list(enumerate(texts))


def test_shingles_are_those_of_words():
    rnd = random.Random(1)
    for _ in range(60):
        t = " ".join(rnd.choice(["a", "B", "éa", "cc"]) for _ in range(rnd.randrange(40)))
        got, want = dart.shingles(t), shingles(t)
        assert len(got) == want.total() and len(np.unique(got)) == len(want)
    assert dart.shingles("a  b\nc D e")[0] == dart.shingles("A b c d E")[0]


@pytest.mark.parametrize("weighting", ["presence", "count"])
def test_signatures_estimate_the_similarity(weighting):
    rng = np.random.default_rng(5)
    agree, want = [], []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        share = rng.integers(50, 300)
        y = np.concatenate((x[:share], rng.integers(0, 1 << 63, 300 - share).astype(np.uint64)))
        wx = rng.integers(1, 9, 300).astype(float) if weighting == "count" else np.ones(300)
        wy = np.concatenate((wx[:share] + (weighting == "count"), np.ones(300 - share)))
        a, b = dict(zip(x.tolist(), wx)), dict(zip(y.tolist(), wy))
        want.append(sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b))
        ox, oy = np.argsort(x), np.argsort(y)
        agree.append((dart.signature(x[ox], wx[ox]) == dart.signature(y[oy], wy[oy])).mean())
    off = np.array(agree) - np.array(want)
    assert abs(off.mean()) < 0.02 and np.abs(off).max() < 0.2


def test_weights_below_one_and_small_sets():
    x = np.array([5], np.uint64)
    assert (dart.signature(x, np.array([0.3])) == dart.signature(x, np.array([0.3]))).all()
    both = (dart.signature(x, np.array([0.25]), 2000) == dart.signature(x, np.array([0.5]), 2000)).mean()
    assert 0.45 < both < 0.55


@pytest.mark.parametrize("weighting", ["presence", "count"])
def test_classes_equal_brute_force(spark, weighting):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = {r.doc_id: r.class_id for r in dart.near_copies(df, weighting=weighting).collect()}
    assert got == brute(rows, weighting)


def test_one_of_each_class_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", "s", 1) for r in [*rows, *rows[:3]]] + [(None, "only null ids here now", "x", "s", 1)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dart.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, *sorted(set(brute(rows).values()))]
    assert dart.keep_one(df.limit(0)).count() == 0 and dart.near_copies(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in queries.op8_near_copies(spark, sf).collect()} == brute(rows)


def test_texts_together_sign_like_one_alone():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["a", "b", "cé", "d"]) for _ in range(rnd.choice([0, 1, 3, 4, 5, 6, 40, 400]))) for _ in range(60)] + [None, "x" * 600_000 + " y z", "w " * 300_000]
    lows = dart.hashing.lowered(texts)
    for weighting in ("presence", "count"):
        x, w, doc = dart.weighted_sets(*dart.shingles_of(lows), len(lows), weighting)
        sig = dart.signatures_of(x, w, doc, len(lows))
        for d, t in enumerate(texts):
            ox, n = np.unique(dart.shingles(t), return_counts=True)
            assert (x[doc == d] == ox).all()
            assert (sig[d] == dart.signature(ox, n if weighting == "count" else np.ones(len(ox)))).all()


def test_an_index_counts_exactly():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(120)]
    index = dart.Index(sets)
    for x in sets:
        assert index.similar(x, 0.8).tolist() == [k for k, y in enumerate(sets) if dart.similar(x, y, 0.8)]
    assert len(dart.Index([]).similar(sets[0], 0.8)) == 0


def boilerplate(n=350):
    """Texts that share from half to most of their words, many of them just below or above the least similarity."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    own = lambda k: [rnd.choice(words) for _ in range(k)]
    base = own(100)
    texts = [" ".join(base[: rnd.randrange(55, 100)] + own(rnd.randrange(2, 40))) for _ in range(n)]
    return list(enumerate(texts + [t + " " + rnd.choice(words) for t in rnd.sample(texts, 40)]))


def test_clusters_around_boilerplate_lose_no_link(spark, monkeypatch):
    rows = boilerplate()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in dart.near_copies(df).collect()} == want
    # every row of the rest meets in blocks
    monkeypatch.setattr(dart, "PROPOSED", 0)
    monkeypatch.setattr(dart, "HELD", 64)
    monkeypatch.setattr(dart, "PASSING", 128)
    assert {r.doc_id: r.class_id for r in dart.near_copies(df).collect()} == want


def test_one_text_may_be_most_rows(spark):
    rows = [(i, "one text that very many rows hold alike") for i in range(6000)] + [(7000 + i, f"text {i} of its own, unlike all others here {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.class_id for r in dart.near_copies(df).collect()}
    assert got == brute(rows)


def test_maps_and_repeated_ids_are_kept(spark):
    rows = [(1, "a b c d e f", {"k": "x"}), (1, "a b c d e f", {"k": "y"}), (1, "quite another text", {}), (2, None, None), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more map<string,string>")
    kept = dart.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "", str(r.more)) for r in kept.collect()) in ([(1, "a b c d e f", "{'k': 'y'}"), (1, "quite another text", "{}"), (2, "", "None")],)


@pytest.mark.parametrize(("common", "proposed"), [(0.0, 10**9), (0.1, 10**9), (0.1, 50), (0.1, 0)])
def test_rest_finds_every_link_of_a_bucket(spark, monkeypatch, common, proposed):
    rng = np.random.default_rng(3)
    base, sets = rng.integers(0, 1 << 62, 100), []
    for i in range(130):
        x = np.concatenate((base[: rng.integers(55, 100)], rng.integers(0, 1 << 62, rng.integers(2, 30))))
        sets.append(np.unique(x).astype(np.uint64))
        if i % 4 == 0:
            x[rng.integers(0, len(x), 4)] = rng.integers(0, 1 << 62, 4)
            sets.append(np.unique(x).astype(np.uint64))
    want = {(j, i) for i in range(1, len(sets)) for j in range(1, i) if dart.similar(sets[i], sets[j], 0.8)}
    monkeypatch.setattr(dart, "COMMON", common)
    monkeypatch.setattr(dart, "PROPOSED", proposed)
    items = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "row long, items binary")
    members = spark.createDataFrame([(7, i, len(sets), 0, i, 0) for i in range(len(sets))], "bucket long, row long, n long, pivot long, component long, home long")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in dart._rest(members, items, 0.8).collect()}
    assert {p for p in got if p[0]} == want
