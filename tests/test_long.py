"""Windows in chunks, keyed calendars, lattice segmentation, ARMA and MIDAS on made data."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterline.functions.halo import numbered, over_chunks
from quarterline.operators import events as ev
from quarterline.operators import regress as rg
from quarterline.operators import segment as sg
from quarterline.operators import series as sr


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_chunked_windows_are_whole_windows(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice("abc"), i, rng.choice([None, 1.0, 2.5, -3.0])) for i in range(200)] + [(None, None, 1.0), ("a", None, 2.0)]
    df = spark.createDataFrame(rows, "s string, t int, v double").repartition(5)
    along = W.partitionBy("s").orderBy("t")
    long = sr.lag_long(df, ["v"], [1, 3], ["t"], ["s"], chunk)
    assert sorted(map(str, long.collect())) == sorted(map(str, sr.add_lags(df, ["v"], [1, 3], "t", ["s"]).collect()))
    ahead = sr.cumulative_long(df, "v", [0, 2, 5], ["t"], ["s"], chunk=chunk)
    assert sorted(map(str, ahead.collect())) == sorted(map(str, sr.forward_cumulative(df, "v", [0, 2, 5], "t", ["s"]).collect()))
    change = sr.change_long(df, ["v"], ["t"], ["s"], chunk)
    assert sorted(map(str, change.collect())) == sorted(map(str, df.withColumn("d_v", F.col("v") - F.lag("v").over(along)).collect()))
    assert sorted(r["__g"] for r in numbered(df, ["s", "t"]).collect()) == list(range(202))
    assert sr.lag_long(df.limit(0), ["v"], [1], ["t"]).count() == 0


def test_no_window_over_one_partition(spark):
    df = spark.range(1000).withColumn("v", F.rand(1))
    plan = over_chunks(df, ["id"], lambda along: {"l": F.lag("v").over(along)}, before=1)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("strict", [False, True])
def test_keyed_calendars_against_plain_search(spark, strict):
    rng = random.Random(4)
    t0 = datetime(2001, 1, 1)
    cal = [(s, t0 + timedelta(seconds=rng.randrange(400_000_000) if s != "c" else 86_400 * d)) for s in "abc" for d in range(60)] * 2
    events = [(i, rng.choice(["a", "b", "c", "d", None]), t0 + timedelta(seconds=rng.randrange(450_000_000))) for i in range(300)]
    events += [(1000 + i, s, t) for i, (s, t) in enumerate(cal[:50])] + [(2000, "a", None), (2000, "a", None)]
    df = spark.createDataFrame(events, "id int, s string, t timestamp").repartition(4)
    days = spark.createDataFrame([*cal, ("a", None)], "s string, d timestamp")
    got = {r.id: r.out for r in ev.asof_next(df, days, ["s"], "t", "d", "out", strict).collect()}
    for i, s, t in events:
        own = sorted(d for c, d in cal if c == s)
        later = [d for d in own if t and (d > t if strict else d >= t)]
        want = None if t is None or not own else later[0] if later else None if strict else own[-1]
        assert got[i] == want
    assert ev.asof_next(df, days, ["s"], "t", "d", "out").count() == len(events)


def cheapest(run, costs, unknown):
    """All ways through a run; least cost, then longer words first."""
    ways = [((0, ()), 0)]
    best = None
    while ways:
        (c, words), at = ways.pop()
        if at == len(run):
            key = (c, tuple(-len(w) for w in words))
            best = min(best or (key, words), (key, words))
            continue
        for n in range(1, len(run) - at + 1):
            w = run[at : at + n]
            if w in costs or n == 1:
                ways.append(((c + costs.get(w, unknown), (*words, w)), at + n))
    return list(best[1])


def test_lattice_paths_are_brute_force(spark):
    rng = random.Random(8)
    signs = "中国人民银行"
    freq = {"".join(rng.choice(signs) for _ in range(rng.randrange(1, 4))): rng.randrange(1, 50) for _ in range(40)}
    texts = ["".join(rng.choice(signs + "币,a1 é") for _ in range(rng.randrange(0, 14))) for _ in range(120)] + [None, "", "币", "中" * 9, "abc12 x"]
    words = spark.createDataFrame([*freq.items(), ("中国", 1), ("", 5), (None, 2), ("国人", None)], "word string, freq int")
    freq["中国"], freq["国人"] = max(freq.get("中国", 1), 1), max(freq.get("国人", 1), 1)
    total = sum(freq.values())
    costs = {w: round((np.log(total) - np.log(f)) * 1e6) for w, f in freq.items()}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    import regex

    for r in sg.segment(df.unionByName(df), words).collect():
        want = []
        for piece in regex.findall(r"(?s)\p{Han}+|[A-Za-z]+|[0-9]+|.", r.text or ""):
            want += cheapest(piece, costs, round(np.log(total) * 1e6)) if regex.match(r"\p{Han}", piece) else [piece]
        assert r.tokens == want, r.text
    assert sg.segment(df, words.limit(0)).where("id = 123").first().tokens == list("中" * 9)


def test_a_small_dictionary_moves_no_text_and_gives_the_joined_tokens(spark, monkeypatch):
    rng = random.Random(9)
    signs = "中国人民银𠀀"
    freq = [("".join(rng.choice(signs) for _ in range(rng.randrange(1, 5))), rng.randrange(1, 9)) for _ in range(60)]
    words = spark.createDataFrame([*freq, ("國" * 3, None)], "word string, freq int")
    texts = ["".join(rng.choice(signs + "国x7 \n，") for _ in range(rng.randrange(0, 40))) for _ in range(80)] + [None, "", "國" * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    looked_up = sg.segment(df, words)
    assert "Exchange" not in looked_up._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(sg, "MAX_WORDS", 0)
    joined = {r.id: r.tokens for r in sg.segment(df, words).collect()}
    assert {r.id: r.tokens for r in looked_up.collect()} == joined and len(joined) == len(texts)
    assert joined[len(texts) - 1] == ["國" * 3, "國" * 3, "國"]


def test_a_dictionary_of_a_million_words_stays_on_the_cluster(spark):
    signs = F.lit("".join(chr(0x4E00 + i) for i in range(1000)))
    at = lambda k: F.substring(signs, F.col("id") % k + 1, 1)
    many = spark.range(1_000_000).select(F.concat(at(997), at(991), at(983)).alias("word"), F.lit(3).alias("freq"))
    one = many.where("id = 5").first().word if "id" in many.columns else many.first().word
    df = spark.createDataFrame([(1, one + "龘" + one)], "id int, text string")
    assert sg.segment(df, many).first().tokens == [one, "龘", one]


def test_arma_finds_a_moving_average(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=6000)
    y = 1000.0 + e[1:] + 0.6 * e[:-1]
    rows = [("ma", i, float(v), float(x)) for i, (v, x) in enumerate(zip(y, rng.normal(size=len(y))))]
    ar = [0.0]
    for v in rng.normal(size=3000):
        ar.append(0.7 * ar[-1] + v)
    rows += [("ar", i, float(v), 1.0) for i, v in enumerate(ar)]
    df = spark.createDataFrame(rows, "s string, t int, y double, x double").repartition(4)
    for long in (False, True):
        out = rg.arma_order_by_bic(df, "y", ["x"], ["t"], ["s"], long=long).where("best = 1").collect()
        assert {(r.s, r.p, r.q) for r in out} == {("ma", 0, 1), ("ar", 1, 0)}


def test_midas_weights_are_found_again(spark):
    rng = np.random.default_rng(5)
    tone = rng.normal(size=80)
    quarters = spark.createDataFrame([(2000 + i // 4, i % 4 + 1, float(v)) for i, v in enumerate(tone)], "year int, quarter int, tone double")
    rows = []
    for s, theta in (("a", (0.4, -0.2)), ("b", (-0.6, 0.0))):
        w = np.asarray(rg.midas_weights(8, theta))
        for i in range(80):
            term = w[: i + 1][: min(8, i + 1)] @ tone[max(0, i - 7) : i + 1][::-1] / w[: min(8, i + 1)].sum()
            rows += [(s, 2000 + i // 4, i % 4 + 1, float(np.sqrt(5 + term))) for _ in range(3)]
    days = spark.createDataFrame([*rows, ("a", 1990, 1, 1.0), ("none", 2000, 1, None)], "s string, year int, quarter int, r double")
    grid = [(a / 2, -b / 5) for a in range(-2, 3) for b in range(3)]
    best = rg.midas_weight_search(days, quarters, "r", "tone", grid, by=["s"], rounds=5, step=(0.25, 0.1))
    found = {r.s: (r.theta1, r.theta2, r.ssr) for r in best.collect()}
    assert set(found) == {"a", "b"} and all(v[2] < 0.05 for v in found.values())
    assert abs(found["a"][0] - 0.4) < 0.15 and abs(found["b"][0] + 0.6) < 0.15
    daily = rg.midas_daily(days, quarters, best, "tone", by=["s"])
    assert daily.count() == days.count() and daily.where("year = 1990 or s = 'none'").where("midas is not null").count() == 0
    assert daily.where("s = 'a' and midas is null").count() == 1
