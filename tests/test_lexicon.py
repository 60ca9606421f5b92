"""Lexicon scoring on hand-made token lists."""

import pytest
from pyspark.sql import functions as F

from quarterline.functions.tokens import collect_words, filter_tokens, segmenter
from quarterline.operators import lexicon as lx
from quarterline.profiles import ZH_TONE

WORDS = [("好", 1), ("上涨", 1), ("回落", -1), ("衰退", -1), ("改善", 1)]


def tone(spark, sentences):
    words = spark.createDataFrame(WORDS, "word string, weight int")
    rows = [(i, "".join(t), t) for i, t in enumerate(sentences)]
    df = spark.createDataFrame(rows, "id int, text string, tokens array<string>").repartition(2)
    got = lx.dict_tone(df, words, ZH_TONE).orderBy("id").collect()
    return [(r.dict_tone * max(len(r.tokens), 1), r.is_valid_unit) for r in got]


def test_dict_tone(spark):
    cases = {
        ("不", "不", "好"): 1,
        ("不", "好"): -1,
        ("不", "好", "好"): 0,  # the negator before the first anchor does not reach the second
        ("不", "a", "b", "c", "d", "e", "f", "好"): 1,  # outside the window of six
        ("衰退", "放缓"): -0.5,
        ("未", "衰退", "a", "b", "放缓"): 0.5,
        ("衰退", "a", "b", "c", "放缓"): -1,
        ("价格", "上涨"): -1,
        ("价格", "回落"): 1,
        ("坏账风险", "上涨"): -1,
        ("坏账风险", "a", "b", "c", "d", "e", "上涨"): 1,
        ("上涨",): 1,
        ("无关",): 0,
    }
    got = tone(spark, [list(c) for c in cases])
    assert [round(v, 9) for v, _ in got] == list(cases.values())
    assert all(valid == 1 for _, valid in got)


def test_valid_unit(spark):
    df = spark.createDataFrame(
        [(1, "12345元", ["x"]), (2, "增长1%", ["x"]), (3, None, None), (4, "x", [])],
        "id int, text string, tokens array<string>",
    )
    got = df.select(lx.valid_unit(F.col("text"), F.col("tokens"))).collect()
    assert [r[0] for r in got] == [0, 1, 0, 0]


def test_build_and_supplement(spark):
    sheets = [
        ("Positive", 1, 1, " 增长 "), ("Positive", 1, 2, "Word"), ("neg words", 2, 1, "增长"),
        ("负面", 3, 1, "下滑"), ("政治", 4, 1, "团结"), ("misc", 5, 1, "其他"), ("Positive", 1, 3, None),
    ]
    df = spark.createDataFrame(sheets, "sheet string, sheet_order int, row int, word string")
    words = {r.word: r.weight for r in lx.build_lexicon(df).collect()}
    assert words == {"增长": -1, "下滑": -1, "团结": 1}
    full = {r.word: r.weight for r in lx.supplement_lexicon(lx.build_lexicon(df)).collect()}
    assert full["增长"] == -1 and full["复苏"] == 1 and full["困难"] == -1 and len(full) == 19


def test_pos_neg_net(spark):
    rows = [(1, "降幅收窄好", ["降幅", "收窄", "好"]), (2, "不好的", ["不", "好", "的"]), (3, "  ", [" "])]
    df = spark.createDataFrame(rows, "id int, text string, tokens array<string>")
    got = lx.pos_neg_net(df, ["好"], ["坏"]).orderBy("id").collect()
    assert (got[0].Pos, got[0].Neg) == (pytest.approx(2 / 3), 0)
    assert (got[1].Pos, got[1].Neg, got[1].Neg_net) == (0, 0.5, 0.5)
    assert got[2].Neg_net == 0


def brute(text, known):
    out, i, longest = [], 0, max(map(len, known))
    while i < len(text):
        for k in range(longest, 0, -1):
            if text[i : i + k] in known and len(text[i : i + k]) == k:
                break
        else:
            k = 1
            if text[i].isascii() and text[i].isalnum():
                same = str.isdigit if text[i].isdigit() else str.isalpha
                while i + k < len(text) and text[i + k].isascii() and same(text[i + k]):
                    k += 1
        out.append(text[i : i + k])
        i += k
    return out


def test_segmenter(spark):
    known = ["货币政策", "货币", "稳健", "政策稳", "M2", "增长"]
    texts = ["稳健的货币政策稳健", "M2增长12.5%abc", "货币政策", "", "增增长", "货币政"]
    words = spark.createDataFrame([(w,) for w in known], "word string")
    cut = segmenter(collect_words(words))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.w for r in df.select("i", cut("t").alias("w")).orderBy("i").collect()]
    assert got == [brute(t, set(known)) for t in texts]


def test_repeated_words_and_ids_have_one_answer(spark):
    words = spark.createDataFrame([("good", 1), ("good", -1), ("bad", -1)], "word string, weight int")
    rows = [(1, "x", ["x", "a", "good", "bad"]), (1, "x", ["good"]), (1, "x", ["good"]), (2, "x", None)]
    df = spark.createDataFrame(rows, "id int, text string, tokens array<string>")
    got = lx.dict_tone(df, words, ZH_TONE).collect()
    assert sorted((r.id, len(r.tokens or []), r.dict_tone) for r in got) == [(1, 1, 1.0), (1, 1, 1.0), (1, 4, 0.0), (2, 0, 0.0)]


def test_stopwords_are_sent_to_the_tokens(spark):
    df = spark.createDataFrame([("的",), ("增长",), ("增长",), (None,)], "token string")
    out = filter_tokens(df, spark.createDataFrame([("的",), (None,)], "word string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert [r.token for r in out.collect()] == ["增长", "增长"]


def test_filter_tokens(spark):
    words = ["增长", "的", "12", "3.5", "，", "_", "a1", "①", " "]
    df = spark.createDataFrame([(w,) for w in words], "token string")
    stop = spark.createDataFrame([("的",)], "word string")
    assert {r.token for r in filter_tokens(df, stop).collect()} == {"增长", "a1", "①"}


def test_both_ways_of_finding_hits_agree(spark, monkeypatch):
    rows = [(1, ["up", None, "down", "up"]), (1, ["up", "down", "up"]), (2, None), (3, []), (4, ["", "x"]), (5, ["up"] * 3)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    words = spark.createDataFrame([("up", 1.0), ("up", 0.5), ("down", -1.0), ("x", None), (None, 2.0)], "word string, weight double")
    inline = sorted(map(str, lx.with_hits(df, words).collect()))
    assert inline == sorted(map(str, lx.with_joined_hits(df, words).collect()))
    assert "[Row(pos=0, word='up', weight=1.0), Row(pos=1, word='down', weight=-1.0), Row(pos=2" in inline[0]
    monkeypatch.setattr(lx, "MAX_WORDS", 1)
    assert lx.weight_sets(words) is None and sorted(map(str, lx.with_hits(df, words).collect())) == inline
    none = lx.with_hits(df, words.limit(0))
    assert [r.hits for r in none.orderBy("id", "tokens").collect()] == [[], [], None, [], [], []]
