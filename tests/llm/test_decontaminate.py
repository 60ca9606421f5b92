"""Benchmark search against brute force: the exact distance, the recall, and the cases."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarterline.llm import decontaminate as d

LETTERS = str.maketrans("0123456789", "ghijklmnop")


def plain_fit(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abé ", max_size=12), st.text("abé ", max_size=20))
def test_fits_is_the_edit_distance(item, text):
    assert d.fits(item, text) == plain_fit(item, text)


def test_windows_cover_every_item_length():
    for n in range(1, 400):
        size = d.window_size(n)
        assert size == 1 or (size + d.stride(size) - 1 <= n and size >= n * 0.4)


def made(seed, n):
    rng = random.Random(seed)
    ranks = (int(rng.paretovariate(0.7)) % 4000 for _ in range(n))
    return [hashlib.md5(str(r).encode()).hexdigest()[: 2 + r % 9].translate(LETTERS) for r in ranks]


def edited(words, share, seed):
    rng, out = random.Random(seed), []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append("edited" if x < 2 * share / 3 else w)
        if 2 * share / 3 <= x < share:
            out.append("more")
    return out


def corpus(share):
    items = [(i, " ".join(made(i, 15 + i % 45))) for i in range(60)]
    docs = []
    for i, t in items:
        body = made(1000 + i, 200)
        docs.append((i, " ".join(body[:90] + edited(t.split(), share, i) + body[90:]).upper()))
        docs.append((500 + i, " ".join(made(5000 + i, 200))))
    return items, docs


@pytest.mark.parametrize("share,least", [(0.0, 1.0), (0.07, 0.9)])
def test_recall_against_brute_force(spark, share, least):
    items, docs = corpus(share)
    truth = set()
    for i, t in items:
        truth |= {(k, i) for k, text in docs if d.fits(t, text.lower()) <= int(len(t) * d.MAX_DISTANCE)}
    got = d.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert found <= truth and len(found) >= least * len(truth) and len(truth) > 40
    if not share:
        assert all(r.distance == 0 for r in rows)


def test_cases(spark):
    item = " ".join(made(3, 20))
    docs = [(1, f"x y {item}", 1), (1, f"x y {item}", 1), (None, item.upper(), 2), (2, None, 3), (3, "", 4), (4, "other words " * 30_000, 5), (5, "short", 6)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, Digest int")
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (7, item)], "item_id long, text string")
    pairs = {(r.doc_id, r.item_id, r.distance) for r in d.find_items(docs, items).collect()}
    assert pairs == {(1, 7, 0), (None, 7, 0)}
    kept = d.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.Digest for r in kept.collect()) == [3, 4, 5, 6]
    assert d.decontaminate(docs.limit(0), items).count() == 0 and d.decontaminate(docs, items.limit(0)).count() == 7


def test_walks_fall_in_step_again():
    s = np.append(d.Symbols()([f"w{i}".encode() for i in range(60)]), np.uint64(0))
    t = s.copy()
    t[0] = 5
    same = [d.window_keys(s, np.array([1]), 33, r)[0] == d.window_keys(t, np.array([1]), 33, r)[0] for r in range(8)]
    assert all(same)


def filter_of(keys):
    bloom = np.zeros(d.FILTER_BITS // 8, np.uint8)
    for p in d.filter_places(np.asarray(keys).view(np.uint64)):
        np.bitwise_or.at(bloom, p >> 3, (128 >> (p & 7)).astype(np.uint8))
    return bloom


@pytest.mark.parametrize("n", [8, 12, 18, 30, 59])
def test_recall_at_the_bound(n):
    """A fifth of the words replaced, at any place in a document: one sure window has to be enough."""
    rng, hit, trials = random.Random(n), 0, 150
    for t in range(trials):
        item = made(n * 1000 + t, n)
        gone = set(rng.sample(range(n), n // 5))
        out = [f"x{t}x{i}" if i in gone else w for i, w in enumerate(item)]
        text = " ".join([f"before{i}" for i in range(rng.randrange(40, 80))] + out + [f"after{i}" for i in range(60)])
        row = d.item_rows([" ".join(item)]).iloc[0]
        found = d.hits_of([text], {row["size"]: row["words"]}, filter_of(row["keys"]), d.Symbols())[0]
        hit += bool({k for k, _, _ in found} & set(row["keys"].tolist()))
    assert hit >= 0.93 * trials


def test_repetitions_follow_the_bound():
    for size in (9, 13, 19, 28):
        assert d.repetitions(size) >= 16 and d.repetitions(size, edited=0.1) < d.repetitions(size) < d.repetitions(size, edited=0.25)


def test_pieces_do_not_change_hits(monkeypatch):
    item = made(3, 20)
    row = d.item_rows([" ".join(item)]).iloc[0]
    bloom, texts = filter_of(row["keys"]), [" ".join(made(50 + i, 37) + item + made(90 + i, 11)) for i in range(20)] + [None, ""]
    whole = d.hits_of(texts, {row["size"]: 20}, bloom, d.Symbols())
    monkeypatch.setattr(d, "PIECE", 64)
    cut = d.hits_of(texts, {row["size"]: 20}, bloom, d.Symbols())
    assert [sorted(x) for x in cut] == [sorted(x) for x in whole] and all(whole[:20])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab é漢", max_size=140), st.text(alphabet="ab é漢", max_size=200)), max_size=6), st.sampled_from([8, 1 << 21]))
def test_distances_of_a_batch_are_those_of_single_pairs(pairs, cells):
    items, texts = [a for a, _ in pairs] + ["ab" * 70] * len(pairs), [b for _, b in pairs] * 2
    before, d.MASK_CELLS = d.MASK_CELLS, cells
    try:
        assert d.fits_all(items, texts).tolist() == [d.fits(a, b) for a, b in zip(items, texts)]
    finally:
        d.MASK_CELLS = before


def test_few_items_are_sent_and_no_window_is_shuffled(spark, monkeypatch):
    items, docs = corpus(0.07)
    docs = spark.createDataFrame(docs + [(None, docs[0][1]), docs[1]], "doc_id long, text string")
    items = spark.createDataFrame([*items, (items[0][0], items[1][1])], "item_id long, text string")  # an id with two texts

    def found():
        rows = d.find_items(docs, items)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        windows = [x for x in plan.splitlines() if "hashpartitioning" in x and ", at#" in x]
        return sorted(map(str, rows.collect())), len(windows)

    sent, windows = found()
    monkeypatch.setattr(d, "SENT_KEYS", 0)
    joined, moved = found()
    assert sent == joined and len(sent) > 40 and windows == 0 and moved


def test_symbols_are_the_words_hashes():
    words = [b"a", b"b", "é".encode(), b"a"]
    assert d.Symbols()(words).tolist() == [d.xxhash.xxh64_intdigest(w) for w in words] and not len(d.Symbols()([]))
