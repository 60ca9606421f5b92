"""The similarity join against brute force, on groups of copies and mixtures."""

import random

import numpy as np
import pytest

from quarterline.llm import ngram_join as j
from quarterline.llm import graph
from quarterline.llm.graph import components


def brute(docs, threshold=85):
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for k, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= threshold * len(s | t):
                x, y = sorted((find(i), find(k)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus():
    rng = random.Random(5)
    word = lambda: f"W{rng.randrange(3000)}"
    base = [word() for _ in range(120)]
    docs = []
    for i in range(150):  # near copies of one text, from close to far
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = word()
        docs.append(" ".join(w))
    chain = [word() for _ in range(80)]
    for i in range(12):  # neighbours link, the ends don't
        docs.append(" ".join(chain[4 * i :] + chain[: 4 * i][::-1]))
    docs += [" ".join(base[:50] + [word() for _ in range(rng.randrange(2, 60))]) for _ in range(60)]
    docs += [" ".join(word() for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    docs += ["a b c", "A  b\tc", "a b", "one", None, "", " \n", docs[0].lower(), docs[3]]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return list(zip(order, docs))


@pytest.mark.parametrize("threshold", [85, 60])
def test_components_are_those_of_brute_force(spark, threshold):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.link_documents(df, threshold=threshold).collect()}
    assert got == brute(docs, threshold)


def test_one_of_each_stays(spark):
    docs = corpus()[:60]
    rows = [(i, t, "x", 1) for i, t in docs] + [(None, None, "y", 2), (None, "", "y", 2), (docs[0][0], docs[0][1], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ROOT string, n int")
    kept = j.keep_one(df).collect()
    truth = brute(docs)
    expected = sorted(i for i, (n, c) in truth.items() if n == 0 or c == i)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == expected and sum(r.doc_id is None for r in kept) == 2
    assert j.keep_one(df.limit(0)).count() == 0 and kept[0].asDict().keys() == {"doc_id", "text", "ROOT", "n"}


def test_many_equal_rows_and_rows_without_ids(spark):
    rng = random.Random(2)
    a = " ".join(f"w{rng.randrange(999)}" for _ in range(90))
    b = a + " and more"
    rows = [(1, a)] * 2500 + [(2, b)] * 2500 + [(None, a)] * 200 + [(None, f"{b} x")] * 200 + [(None, None)] * 3 + [(9, "else")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = j.link_documents(df).groupBy("doc_id", "n_shingles", "component_id").count().collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, 87, 1, 2500), (2, 89, 1, 2500), (None, 87, 1, 200), (None, 90, 1, 200), (None, 0, None, 3), (9, 1, 9, 1)], key=str
    )
    nobody = j.link_documents(df.where("doc_id is null")).groupBy("n_shingles", "component_id").count().collect()
    assert sorted(map(tuple, nobody)) == [(0, None, 3), (87, None, 200), (90, None, 200)]


def test_sets_with_one_half_of_a_name_in_common_stay_apart(spark):
    rows = [(1, 7, 3, 5, 10), (2, 7, 4, 5, 11), (3, 7, 3, 5, 10), (None, 8, 1, 2, 12)]
    signed = spark.createDataFrame(rows, "id long, key long, more long, n long, digest long")
    got = {(r.raw, r.more): (r.name, r.least) for r in j.named_classes(signed).collect()}
    assert got[7, 3] == (7, 1) and got[7, 4][0] != 7 and got[7, 4][1] == 2 and got[8, 1] == (8, None)


def test_prefixes_of_similar_sets_meet_in_every_order():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, 9, j.SLOTS).astype(np.uint8)
    for _ in range(300):
        both = rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)
        a = np.unique(np.append(both, rng.integers(0, 2**63, rng.integers(0, 5)).astype(np.uint64)))
        b = np.unique(np.append(both, rng.integers(0, 2**63, rng.integers(0, 5)).astype(np.uint64)))
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            for seed in j.ORDERS:
                assert len(np.intersect1d(j.prefix(a, classes, seed, 85), j.prefix(b, classes, seed, 85)))


def test_bitmaps_differ_in_no_more_bits_than_sets_in_tokens(spark):
    rng = np.random.default_rng(4)
    rows, apart = [], []
    for i in range(300):
        both = rng.integers(0, 2**63, rng.integers(1, 700)).astype(np.uint64) * np.uint64(2)
        extra = [np.unique(np.append(both, rng.integers(0, 2**63, rng.integers(0, 1 + len(both) // 5)).astype(np.uint64))) for _ in "ab"]
        rows.append((i, *[[int(x) for x in j.odd_bits(s)] for s in extra]))
        apart.append(len(np.setxor1d(*extra)))
    rows += [(300, [1], [1, 2, 3, 4]), (301, [5, 3], [6])]
    df = spark.createDataFrame(rows, "i long, a array<long>, b array<long>")
    got = {r.i: r.n for r in df.select("i", j.differing_bits("a", "b").alias("n")).collect()}
    assert all(got[i] <= n for i, n in enumerate(apart)) and any(len(a) != len(b) for _, a, b in rows[:300])
    assert sum(got[i] >= n / 2 for i, n in enumerate(apart)) > 250
    assert got[300] is None and got[301] == 0


def test_far_pairs_are_dropped_before_their_texts_are_read(spark, monkeypatch):
    """Pairs that share a start only are told apart by the bitmaps made with the signatures."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    start = [word() for _ in range(12)]
    docs = [(i, " ".join(start + [word() for _ in range(90)])) for i in range(40)] + [(40, " ".join(start))]
    docs.append((41, docs[7][1] + " end"))
    made, details = [], j.Verifier.details
    monkeypatch.setattr(j.Verifier, "details", lambda self, pairs: (made.append(pairs.count()), details(self, pairs))[1])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in j.link_documents(df).collect()} == brute(docs)
    assert sum(made) <= 3


def test_components_of_a_path_and_a_star(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_few_and_many_links_give_equal_components(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (9999, 9999)]
    rng.shuffle(rows)
    links = spark.createDataFrame(rows, "u long, v long")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("few", "")
    try:
        few = sorted(map(tuple, components(links).collect()))
        assert jobs() <= 8
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(graph, "FEW", 0)
    assert few == sorted(map(tuple, components(links).collect()))
