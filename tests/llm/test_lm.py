"""Language-model scores: the base by brute force, the model by held-out bits."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quarterline.llm import lm


def corpus(n=300):
    rng = random.Random(2)
    parts = ["ba", "ko", "ri", "tel", "un", "mes", "o", "ga"]
    word = lambda: "".join(rng.choice(parts) for _ in range(min(5, int(rng.paretovariate(1)))))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 120))), "ab"[i % 2]) for i in range(n)]
    docs = [(i, t.upper() if i % 7 == 0 else t, g) for i, t, g in docs]
    return docs + [(n, None, None), (n + 1, "", "a"), (n + 2, "\t\n", "b"), (n + 3, "zq " * 30_000, "c"), (None, "ba ba", None), (5, docs[5][1], "b")]


def test_base_and_model(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = lm.score(df.repartition(3)).collect()
    import zlib

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    toks = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = Counter(w for i, t, _ in docs if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    expected = sorted(
        (i is None, i or 0, held(i), len(toks(t)), sum(w in c for w in toks(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), 6))
        for i, t, _ in docs
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert next(r for r in got if r.doc_id == 303).score > next(r for r in got if r.doc_id == 303).base_score / 10
    copies = [r.score for r in got if r.doc_id == 5]
    assert len(copies) == 2 and copies[0] == pytest.approx(copies[1], abs=1e-9)
    assert lm.score(df.limit(0)).count() == 0


def test_only_words_outside_the_head_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    found = []
    for head in (lm.HEAD_WORDS, 50, 0):
        monkeypatch.setattr(lm, "HEAD_WORDS", head)
        out = lm.score(df.repartition(3))
        found.append(sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in out.collect()))
    assert found[0] == found[1] == found[2]


def spelled_model(words):
    counts = lm.bit_counts(words).astype(np.uint16)
    weights, seen = lm.start_weights(), np.zeros((256 * lm.BUCKETS, 2))
    for _ in range(5):
        lm.learn(counts, words, weights, seen)
    refined = (seen[:, 1] + 0.5) / (seen[:, 0] + 1)
    return {"odds": lm.odds_table(counts), "weights": weights, "map": refined}


def test_spelling_is_a_distribution_and_learns():
    rng = random.Random(1)
    words = [b"".join(rng.choice([b"ba", b"ko", b"ri", b"tel"]) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    model = spelled_model(sorted(set(words)))
    single = [bytes([b]) for b in range(256) if not bytes([b]).isspace()]
    assert 0 < (10 ** lm.spelling_scores(model, single)).sum() <= 1
    like, unlike = lm.spelling_scores(model, [b"bakotel", b"xqzvwyj"])
    assert like > unlike + 5
    # the bits of a byte sum to one in any context
    two = [b"ba" + bytes([b]) for b in range(256)]
    assert (10 ** lm.spelling_scores(model, [w for w in two if not w[-1:].isspace()])).sum() <= 1


def test_text_scores_are_sequential():
    experts = np.array([[0.5, 0.01], [0.25, 0.01], [0.0, 0.02]])
    prior = np.array([0.8, 0.1, 0.1])
    ids = [np.array(x, np.int64) for x in ([0, 0, 1, 2, 2] * 9, [2], [1, 0, 2])]
    got = lm.text_scores(ids, experts, prior)
    for x, total in zip(ids, got):
        shares, low, step, out = prior * lm.PRIOR_TOKENS, 0, 1, 0.0
        while low < len(x):
            w, new = shares / (lm.PRIOR_TOKENS + low), shares.copy()
            for t in range(low, min(low + step, len(x))):
                q = np.array([*experts[x[t]], (x[:t] == x[t]).sum() / max(t, 1)]) * w
                out += math.log10(q.sum())
                new += q / q.sum()
            shares, low = new, low + step
            step = min(lm.STEP, 2 * step) if low >= 8 else 1
        assert total == pytest.approx(out, abs=1e-9)


def test_bit_counts_are_not_cut(spark):
    """More words than 16 bits count: the odds are those of the whole counts."""
    words = [(b"a" if i % 4 else b"b") + format(i, "x").translate(str.maketrans("0123456789", "ghijklmnop")).encode() for i in range(200_000)]
    counts = lm.bit_counts(words)
    assert counts.max() > 65_535
    model = lm.spelling_model(spark.createDataFrame([(bytearray(w), 2) for w in words], "word binary, c long"))
    np.testing.assert_allclose(model["odds"].value, lm.odds_table(counts), rtol=1e-5, atol=1e-5)


def test_words_seen_twice_train_the_mixer(spark):
    rows = [(bytearray(w), 2) for w in {b"".join(random.Random(i).choices([b"ba", b"ko", b"ri", b"tel"], k=5)) for i in range(500)}]
    model = lm.spelling_model(spark.createDataFrame(rows, "word binary, c long"))
    assert not np.allclose(model["weights"], lm.start_weights())


def test_scores_do_not_depend_on_the_splits_of_the_read(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(30)), "en" if i % 3 else "de") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "t"))
    docs, found = spark.read.parquet(str(tmp_path / "t")), []
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    out = lm.score(docs, from_files=True)  # chunks are written with these splits and read with others
    try:
        for size in (before, "5000"):
            spark.conf.set(key, size)
            found.append({r.doc_id: (r.n_tokens, round(r.score, 6)) for r in out.select("*").collect()})
            out = lm.score(docs, from_files=True)
    finally:
        spark.conf.set(key, before)
    assert found[0].keys() == found[1].keys() == set(range(3000))
    assert all(a == found[1][i] for i, a in found[0].items())


def ordered_model(texts, codes=None):
    leaves, n = np.zeros((2, 1 << lm.WORD_BITS), np.int64), np.zeros(1 << lm.CODE, np.int64)
    for hashes, place in lm.sequences(texts):
        lm.add_word_counts(leaves, hashes, place)
        n += np.bincount(lm.codes_of(hashes), minlength=1 << lm.CODE)
    counts, nodes = np.stack([lm.node_counts(x, lm.HALF) for x in leaves]), lm.node_counts(n, lm.CODE)
    alone = np.log((nodes[:, 1] + lm.DELTA) / (nodes[:, 0] + lm.DELTA)).astype(np.float32)
    sums = np.zeros((lm.WORD_GATES, 12))
    for hashes, place in lm.sequences(texts, 500):
        lm.newton_sums(alone, lm.odds_but_one(counts), hashes, place, sums)
    return {"nodes": alone, "odds": lm.packed_odds(counts), "weights": lm.newton_step(sums)}, sums, counts


def test_token_hashes_of_texts_and_of_words_agree():
    texts = ["The cat sat\x0bon  the mat", " ", None, "a\tb \u00e9 \u00a0Z", "", "x" * 700] * 3
    found = list(lm.sequences(texts, 20))
    alone = [lm.hashes_of(lm.tokens(t)) for t in texts]
    assert (np.concatenate([h for h, _ in found]) == np.concatenate(alone)).all()
    assert (np.concatenate([p for _, p in found]) == np.concatenate([np.arange(len(x)) for x in alone])).all()
    assert len(set(lm.hashes_of([b"a", b"b", lm.END]))) == 3


def test_codes_after_any_two_words_are_a_distribution():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(60)) for _ in range(200)]
    model, sums, counts = ordered_model(texts)
    every = np.arange(1 << lm.CODE, dtype=np.uint64) << np.uint64(64 - lm.CODE)
    for pair in ([b"a", b"bb"], [b"never", b"seen"], [b"h", b"a"]):
        hashes = np.stack([np.tile(lm.hashes_of(pair)[:, None], len(every))[0], np.tile(lm.hashes_of(pair)[:, None], len(every))[1], every], 1).ravel()
        got = lm.code_scores(model, hashes, np.tile([0, 1, 2], len(every)))
        assert got[2::3].sum() == pytest.approx(1, abs=1e-5) and got[1] == got[4]
    # slopes and curvatures by a plain loop over tokens and bits
    slow = np.zeros_like(sums)
    for text in texts:
        h = lm.hashes_of(lm.tokens(text))
        for d, node, bit, slots in lm.word_bits(h, np.arange(len(h))):
            for t in range(len(h)):
                x, gate = [float(model["nodes"][node[t]])], d
                for i in range(2):
                    n = counts[i][slots[i][t]] - ([0, 1] if bit[t] else [1, 0])
                    x.append(round(max(-12, min(12, math.log((n[1] + lm.DELTA) / (n[0] + lm.DELTA)))) * 512) / 512)
                    gate = gate * 4 + sum(int(n.sum()) > k for k in (0, 3, 31))
                p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, lm.WORD_START))))
                slow[gate] += [*((bit[t] - p) * np.array(x)), *(p * (1 - p) * np.outer(x, x)).ravel()]
    np.testing.assert_allclose(sums, slow, rtol=2e-3, atol=0.05)


def test_the_order_of_words_is_learned(spark):
    """A held-out text in the order of the training texts beats the same words shuffled; both did score alike."""
    rng = random.Random(4)
    names = [f"w{i}" for i in range(60)]
    after = {w: rng.sample(names, 2) for w in names}

    def walk(n):
        out = [rng.choice(names)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    rows = [(i, " ".join(walk(80)), False) for i in range(400)]
    tests = [walk(80) for _ in range(20)]
    rows += [(1000 + i, " ".join(w), True) for i, w in enumerate(tests)]
    rows += [(2000 + i, " ".join(rng.sample(w, len(w))), True) for i, w in enumerate(tests)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in lm.score(df, lang=None, held_out=F.col("held")).collect()}
    assert all(got[1000 + i].base_score == pytest.approx(got[2000 + i].base_score) for i in range(20))
    bits = lambda k: sum(got[k + i].bits_per_byte for i in range(20)) / 20
    assert bits(1000) < 0.7 * bits(2000)
