"""Learned topics and isotonic calibration on made data."""

import random

import pytest

from quarterline.operators import calibrate as cal
from quarterline.operators import topics as tp


def isotonic(counts):
    """The max-min form of the isotonic fit."""
    out = {}
    for i, (b, _, _) in enumerate(counts):
        share = lambda j, k: sum(c[2] for c in counts[j : k + 1]) / sum(c[1] for c in counts[j : k + 1])
        out[b] = max(min(share(j, k) for k in range(i, len(counts))) for j in range(i + 1))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_blocks_are_the_isotonic_fit(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(100) / 100 + 0.005, rng.randrange(2)) for _ in range(rng.choice([1, 5, 300]))] + [(None, 1), (0.5, None)]
    df = spark.createDataFrame(rows, "p double, y int")
    counts = sorted(tuple(r) for r in cal.bin_counts(df, "p", "y").collect())
    blocks = cal.pooled(cal.bin_counts(df, "p", "y"))
    want = isotonic(counts)
    got = cal.with_calibrated(df, "p", blocks).collect()
    first = want[min(want)]
    for r in got:
        b = None if r.p is None else min(99, int(round(r.p, 9) * 100))
        below = [x for x in want if b is not None and x <= b]
        assert r.calibrated == (None if b is None else pytest.approx(want[max(below)] if below else first))
    values = [b.pos / b.n for b in blocks.first().blocks]
    assert values == sorted(set(values))


def test_without_held_out_rows_scores_stay_and_overconfidence_goes(spark):
    rng = random.Random(1)
    none = spark.createDataFrame([], "p double, y int")
    df = spark.createDataFrame([(0.25, 1)], "p double, y int")
    assert cal.with_calibrated(df, "p", cal.pooled(cal.bin_counts(none, "p", "y"))).first().calibrated == 0.25
    rows = []
    for _ in range(4000):
        t = rng.random()
        rows.append((min(1.0, max(0.0, 0.5 + 4 * (t - 0.5))), int(rng.random() < t)))  # pushed to 0 and 1
    over = spark.createDataFrame(rows, "p double, y int")
    fixed = cal.with_calibrated(over, "p", cal.pooled(cal.bin_counts(over, "p", "y")))
    before, after = (cal.calibration_error(fixed, c, "y").first().ece for c in ("p", "calibrated"))
    assert before > 0.15 and after < 0.02


def test_topics_are_learned_from_company(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        policy = i % 2 == 0
        words = rng.choices(["rate", "bank", "loan"] if policy else ["rain", "crop", "farm"], k=4) + rng.choices(["so", "it"], k=3)
        if rng.random() < 0.7:
            words.append("policy" if policy else "weather")
        rows.append((i, words))
    rows += [(400, None), (401, []), (402, ["never", "seen"]), (402, ["rate", "loan", None]), (402, ["rate", "loan", None])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    seeds = {"policy": ["policy"], "nature": ["weather"]}
    vectors, priors = tp.topic_vectors(df.where("id <= 400"), seeds)
    out = tp.learned_scores(df, vectors, priors, list(seeds)).collect()
    assert len(out) == len(rows)
    hit = [r for r in out if r.tokens and "rate" in r.tokens and "policy" not in r.tokens]
    assert hit and all(r.score_policy > 0.5 > r.score_nature for r in hit)
    prior = {r.score_policy for r in out if not r.tokens or r.tokens == ["never", "seen"]}
    assert len(prior) == 1
    report = {r.topic: r for r in tp.seed_agreement(tp.learned_scores(df, vectors, priors, list(seeds)), seeds).collect()}
    assert report["policy"].recall > 0.9 and report["policy"].n == len(rows) - 1
