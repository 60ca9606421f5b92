"""Period tone on small tables: quotas, thresholds, ties, NULLs, input order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarterline.functions.scale import zscore
from quarterline.operators import corpus as cp
from quarterline.operators import tone as tn


def column(spark, values, fn, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", fn(F.col("x"))).orderBy("i").collect()]


def test_gap_and_quota(spark):
    assert column(spark, [0.10, 0.05, 0.0, -1.0], lambda c: tn.gap_factor(c, F.lit(0.0))) == [1, 0.5, 0, 0]
    assert column(spark, [100, 500, 1000, 0, 1], tn.quota, "bigint") == [30, 60, 80, 0, 30]


def rows(spark, scores, prob=lambda i: i / 1000, year=2001):
    data = [(i, year, 1, prob(i), float(s), 0.0) for i, s in enumerate(scores)]
    schema = "id int, year int, quarter int, neg_prob double, score_policy double, score_macro double"
    df = spark.createDataFrame(data, schema).repartition(3)
    return tn.raw_weights(tn.top_topics(df))


@pytest.mark.parametrize(
    "scores,tau,n",
    [
        ([0.6] * 29 + [0.46], 0.45, 30),
        ([0.6] * 30 + [0.46], 0.50, 30),
        ([0.6] * 5 + [0.42] * 3 + [0.1] * 9, 0.40, 8),
    ],
)
def test_threshold(spark, scores, tau, n):
    got = tn.thresholds(rows(spark, scores)).where("topic = 'policy'").first()
    assert (got.tau_used, got.n_eligible) == (tau, n)
    empty = tn.thresholds(rows(spark, scores)).where("topic = 'macro'").first()
    assert (empty.tau_used, empty.n_eligible) == (0.40, 0)


def test_selection_prefers_low_ids_on_ties(spark):
    selected = tn.select_weighted(rows(spark, [0.7] * 100))
    assert sorted(r.id for r in selected.collect()) == list(range(30))


def test_null_score_keeps_its_weight(spark):
    df = rows(spark, [0.6, 0.9], prob=lambda i: None if i == 0 else 1.0)
    got = tn.weighted_tone(tn.select_weighted(df)).first()
    assert got.tone == pytest.approx(0.9 / 1.5) and got.tail == 1.0
    back = {r.id: r.weight_policy for r in tn.write_back(df, tn.select_weighted(df)).collect()}
    assert back == {0: pytest.approx(0.6), 1: pytest.approx(0.9)}


def reference_tone(pdf):
    """Plain pandas statement of the roll-up."""
    med, out = pdf.neg_prob.median(), []
    for (y, q), g in pdf.groupby(["year", "quarter"]):
        p = g.dropna(subset=["neg_prob"]).assign(info=lambda d: (d.neg_prob - med).abs())
        k = min(len(p), 200, max(50, round(0.2 * len(p))))
        top = np.sort(p.sort_values(["info", "id"], ascending=[False, True]).neg_prob.to_numpy()[:k])
        cut = int(0.1 * k)
        row = {"year": y, "quarter": q, "tone_all": top[cut : k - cut].mean(), "tone_tail_all": np.percentile(top, 90)}
        quota = int(np.clip(round(0.12 * len(g)), 30, 80))
        for topic, other in (("policy", "macro"), ("macro", "policy")):
            s, o = g[f"score_{topic}"], g[f"score_{other}"]
            lead = s >= o if topic == "policy" else s > o
            w = np.where(lead, s * np.clip((s - o) / 0.1, 0, 1), 0.0)
            for tau in (0.5, 0.45, 0.4):
                e = g.assign(w=w)[(np.maximum(s, o) >= tau) & (w > 0)]
                if len(e) >= 30:
                    break
            e = e.sort_values(["w", "id"], ascending=[False, True])[:quota]
            row[f"tone_{topic}"] = (e.w * e.neg_prob.fillna(0)).sum() / e.w.sum()
            row[f"tone_tail_{topic}"] = np.percentile(e.neg_prob.dropna(), 90)
        out.append(row)
    return pd.DataFrame(out)


def test_quarterly_tone_matches_pandas(spark):
    """One quarter holds a third of the rows; the result does not depend on row order."""
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "year": 2001 + rng.integers(0, 2, n),
            "quarter": rng.integers(1, 5, n),
            "neg_prob": np.round(rng.random(n), 2),
            "score_policy": np.round(rng.random(n) * 0.7, 2),
            "score_macro": np.round(rng.random(n) * 0.7, 2),
        }
    )
    pdf.loc[: n // 3, ["year", "quarter"]] = (2005, 1)
    pdf.loc[rng.random(n) < 0.1, "neg_prob"] = None
    want = reference_tone(pdf).set_index(["year", "quarter"])
    for parts in (1, 7):
        df = spark.createDataFrame(pdf.sample(frac=1, random_state=parts)).repartition(parts)
        df = df.withColumn("neg_prob", F.nanvl("neg_prob", F.lit(None)))
        got = tn.quarterly_tone(tn.raw_weights(tn.top_topics(df))).toPandas().set_index(["year", "quarter"])
        for c in want:
            assert np.allclose(got.loc[want.index, c], want[c]), c
            z = (want[c] - want[c].mean()) / want[c].std()
            assert np.allclose(got.loc[want.index, f"{c}_z"], z), c


def test_zscore(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, None)], "i int, a double, b double")
    got = zscore(df, ["a", "b"]).orderBy("i").collect()
    assert [r.a_z for r in got] == [pytest.approx(-0.70710678), pytest.approx(0.70710678), None]
    assert [r.b_z for r in got] == [0.0, 0.0, 0.0]


def test_section_flags(spark):
    data = [(2002, 3, "S4"), (2002, 3, " S3 "), (2002, 4, "S4"), (2003, 1, "S5"), (None, 1, "S1")]
    df = spark.createDataFrame(data, "year int, quarter int, section string").coalesce(1)
    got = [(r.is_real, r.is_guid) for r in tn.section_flags(df).collect()]
    assert got == [(False, True), (True, False), (True, False), (False, True), (False, False)]


def test_similarity_edges(spark):
    docs = spark.createDataFrame([(2001, 1), (2001, 2), (2001, 4), (2002, 1)], "year int, quarter int")
    terms = [(2001, 1, "a", 2), (2001, 1, "b", 1), (2001, 2, "a", 1), (2002, 1, "a", 3), (2002, 1, "c", 1)]
    tf = spark.createDataFrame(terms, "year int, quarter int, term string, tf bigint")
    got = cp.similarity_prev(tf, docs).orderBy("year", "quarter").collect()
    assert got[0].similarity_prev is None
    w_a, w_b = 2 * np.log(4 / 3), np.log(4)
    assert got[1].similarity_prev == pytest.approx(w_a / np.hypot(w_a, w_b))
    assert [r.similarity_prev for r in got[2:]] == [0.0, 0.0]  # the third document is empty
    flagged = cp.period_continuity(docs)
    flags = flagged.orderBy("q_idx").collect()
    assert [r.prev_quarter_available for r in flags] == [0, 1, 0, 1]
    assert [(r.year, r.quarter) for r in cp.gap_report(flagged).collect()] == [(2001, 4)]
    single = cp.similarity_prev(tf.where("year = 2002"), docs.where("year = 2002")).first()
    assert single.similarity_prev is None


def test_rollup_counts_joiner(spark):
    df = spark.createDataFrame([(1, 1, "增长1.5%。"), (1, 1, "回 落"), (1, 2, None)], "year int, quarter int, text string")
    got = cp.readability(cp.document_rollup(df)).orderBy("quarter").collect()
    assert (got[0].total_chars, got[0].n_rows, got[0].n_marks) == (9, 2, 3)
    assert (got[1].total_chars, got[1].n_marks) == (0, 1)


def test_rows_without_a_period_count_nowhere(spark):
    rows = [(i, 2001 if i < 100 else None, 1 if i < 100 else None, i / 200) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, year int, quarter int, neg_prob double")
    assert tn.global_median(df).first()["median"] == pytest.approx(0.2475)
    got = tn.topk_informative(df).collect()
    assert {r.year for r in got} == {2001} and max(r.info for r in got) == pytest.approx(0.2475)
    assert [(r.year, r.n_selected) for r in tn.tone_all(df).collect()] == [(2001, 50)]
