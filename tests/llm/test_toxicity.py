"""Toxicity: held-out accuracy on made texts, whole texts, and the cases."""

import random
import zlib

import numpy as np

from quarterline.llm import toxicity as t


def corpus(n=900):
    rng = random.Random(4)
    plain = [f"{a}{b}" for a in ("stone", "river", "green", "cloud", "paper") for b in ("s", "ly", "ing", "er", "ness", "ful")]
    bad = ["nasty", "vile", "awfulest", "awfuling", "awfulness"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic = i % 6 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad).capitalize() + rng.choice(["", ".", ","])
        docs.append((i, " ".join(words), ["en", "fr", None][i % 3]))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_texts_and_cases(spark):
    docs, labels = corpus()
    tail = "river " * 20_000 + "vile nasty"
    more = [(10_000, None, "en"), (10_001, "", None), (10_002, tail, "en"), (7, docs[7][1], "xx"), (None, "nasty vile", None)]
    df = spark.createDataFrame(docs + more, "doc_id long, text string, lang string").withColumnRenamed("lang", "LANG")
    ones = spark.createDataFrame(labels + [(7, None), (8, labels[8][1]), (None, 1)], "doc_id long, toxic int")
    net = t.train(df, ones)
    scored, s = t.score(df, net)
    got = [(r.doc_id, r.text, r[s].score, r[s].threshold, r[s].flagged) for r in scored.collect()]
    truth = dict(labels)
    held = [(p >= 0.3, truth[i] == 1) for i, _, p, *_ in got if i in truth and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.97 and len(held) > 150
    by = {i: p for i, _, p, *_ in got}
    assert by[10_000] == by[10_001] < 0.3 and by[10_002] >= 0.3 and by[None] >= 0.3
    assert all(0 <= p <= 1 and f == (p >= c) for _, _, p, c, f in got)
    assert t.score(df.limit(0), net)[0].count() == 0


def test_without_labels_of_both_classes(spark):
    docs, labels = corpus(30)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    net = t.train(df, spark.createDataFrame([(i, 0) for i, _ in labels], "doc_id long, toxic int"))
    scored, s = t.score(df, net)
    assert {r[s].score < 0.01 for r in scored.collect()} == {True}


def test_best_threshold():
    p, y = np.array([0.9, 0.8, 0.8, 0.3, 0.1]), np.array([True, True, False, True, False])
    cut = t.best_threshold(p, y)
    assert 0.1 < cut < 0.3
