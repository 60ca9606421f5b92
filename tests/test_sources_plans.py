"""Files, columns and whole plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarterline.functions.coerce import round_all
from quarterline.functions.tokens import segmenter
from quarterline.operators import weak as wk
from quarterline.plans import text_tone as tt
from quarterline.profiles import ToneRules
from quarterline.sources import columns as co
from quarterline.sources import files as fl


def test_csv_encodings(spark, tmp_path):
    text = "年份,值\n一季度,1.5\n"
    for name, encoding in (("a", "utf-8"), ("b", "utf-8-sig"), ("c", "gbk")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
        spark_name = "GBK" if encoding == "gbk" else "UTF-8"
        df = fl.scan_csv(spark, str(tmp_path / f"{name}.csv"), encoding=spark_name)
        assert df.columns == ["年份", "值"] and df.first()[0] == "一季度"
    typed = fl.scan_csv(spark, str(tmp_path / "a.csv"), "k string, v double")
    assert typed.first().v == 1.5


def test_words_and_documents(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("的\n 了 \n\n的\n", encoding="utf-8")
    words = fl.scan_words(spark, [str(tmp_path / "none.txt"), str(tmp_path / "stop.txt")])
    assert sorted(r.word for r in words.collect()) == ["了", "的"]
    assert fl.scan_words(spark, []).count() > 40
    docs = fl.scan_documents(spark, str(tmp_path)).collect()
    assert [(d.report_id, d.text.count("\n")) for d in docs] == [("stop.txt", 4)]
    assert fl.optional_source(spark, str(tmp_path / "x"), spark.read.text) is None


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    fl.write_table(spark.range(3), path)
    for _ in range(2):
        df = spark.read.parquet(path)
        fl.replace_table(spark, df.select((F.col("id") + 1).alias("id")), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    assert not (tmp_path / "t.__new").exists() and not (tmp_path / "t.__old").exists()


def test_csv_starts_with_a_mark(spark, tmp_path):
    path = str(tmp_path / "c")
    fl.write_table(spark.createDataFrame([("一", 1)], "`年份` string, v int"), path, "csv")
    files = list((tmp_path / "c").glob("*.csv"))
    assert files and all(f.read_bytes().startswith("\ufeff年份,v".encode()) for f in files)
    assert fl.scan_csv(spark, path).columns == ["年份", "v"]


def periods(spark, path):
    return {(r.year, r.quarter, r.v) for r in spark.read.parquet(path).collect()}


@pytest.mark.parametrize("step", range(12))
def test_replacement_killed_at_any_step_recovers(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    old = {(2001, 1, "a"), (2001, 2, "b"), (2002, 1, "c")}
    schema = "year int, quarter int, v string"
    fl.write_table(spark.createDataFrame(sorted(old), schema), path, keys=["year", "quarter"])
    new = {(2001, 2, "B"), (2002, 1, "C"), (2003, 1, "D")}
    left = step
    whole = fl._file_system

    class Dying:
        """A file system whose n-th change ends the run."""

        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            call = getattr(self.fs, name)
            if name not in ("rename", "delete", "mkdirs", "create"):
                return call

            def change(*args):
                nonlocal left
                left -= 1
                if left < 0:
                    raise KeyboardInterrupt
                return call(*args)

            return change

    monkeypatch.setattr(fl, "_file_system", lambda s, p: (Dying(whole(s, p)[0]), whole(s, p)[1]))
    died = False
    try:
        fl.replace_periods(spark, spark.createDataFrame(sorted(new), schema), path)
    except KeyboardInterrupt:
        died = True
    monkeypatch.undo()
    fl.recover(spark, path)
    after = {(2001, 1, "a"), *new}
    assert periods(spark, path) in (old, after)
    if not died or step > 4:
        assert periods(spark, path) == after
    fl.replace_periods(spark, spark.read.parquet(path).where("year = 2001").withColumn("v", F.lit("x")), path)
    assert {p for p in periods(spark, path) if p[0] == 2001} == {(2001, 1, "x"), (2001, 2, "x")}
    assert sorted(x.name for x in tmp_path.iterdir()) == ["t"]


def test_report_pages_in_any_encoding(spark, tmp_path):
    pages = ["第一页\n货币政策", "", "abc\r\n第三页"]
    body = "\f".join(pages)
    for name, raw in {"u.txt": body.encode(), "mark.txt": b"\xef\xbb\xbf" + body.encode(), "g b.txt": body.encode("gbk"), "empty.txt": b""}.items():
        (tmp_path / name).write_bytes(raw)
    rows = fl.scan_report_pages(spark, str(tmp_path)).orderBy("report_id", "page_no").collect()
    assert [(r.report_id, r.page_no, r.text) for r in rows] == [(n, i, t) for n in ("g b.txt", "mark.txt", "u.txt") for i, t in enumerate(pages)]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["﻿ Date ", "Year", "SHIBOR_1"])
    assert co.normalize_headers(df).columns == ["date", "year", "shibor_1"]
    out = co.resolve_columns(df, {"Year": "year"}, {"rate": ["SHIBOR"]}, "date")
    assert out.columns == ["date", "year", "rate"]
    with pytest.raises(ValueError, match="missing columns"):
        co.require_columns(df, ["nope"])
    assert co.first_present(out, ["x", "rate"]) == "rate"
    with pytest.raises(ValueError):
        co.first_present(out, ["x"])
    assert round_all(spark.createDataFrame([(0.0000005, 1)], "a double, b int")).first().a == 0.0


def test_sampling(spark):
    rows = [(i, int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, label int").repartition(4)
    sample = wk.train_eval_split(wk.balanced_sample(df)).toPandas()
    assert sample.label.value_counts().to_dict() == {0: 30, 1: 30}
    assert sorted(sample["shuffle"]) == list(range(1, 61))
    assert (sample.split == "train").sum() == 54
    with pytest.raises(Exception, match="smaller class"):
        wk.balanced_sample(df.where("id < 20")).count()


def test_weak_labels_quantile(spark):
    rows = [(i, "普通的一句正文", float(i)) for i in range(11)] + [(99, "12345", 5.0), (98, "短", -9.0)]
    df = spark.createDataFrame(rows, "id int, text string, Neg_net double")
    got = sorted((r.id, r.label) for r in wk.weak_labels_quantile(df).collect())
    assert got == [(0, 0), (1, 0), (9, 1), (10, 1)]


def test_pages_to_indicators(spark):
    """Chinese pages through sentences, lexicon, classifier and roll-up."""
    good, bad = "经济增长明显好转，就业改善。", "投资下滑，工业疲软，消费低迷。"
    policy = "货币政策保持稳健，信贷投放合理。"
    pages = []
    for year in (2001, 2002):
        for q in (1, 2, 4):
            body = "第一部分 概况\n" + "\n".join(good + bad + policy for _ in range(10 * q))
            pages += [(f"{year}Q{q}.txt", 0, body), (f"{year}Q{q}.txt", 1, "目录\n第一部分 ....... 1")]
    df = spark.createDataFrame(pages, "report_id string, page_no bigint, text string").repartition(3)
    sentences = tt.pages_to_sentences(df)
    assert sentences.count() == 2 * (10 + 20 + 40) * 3
    lexicon = spark.createDataFrame(
        [("增长", 1), ("好转", 1), ("改善", 1), ("稳健", 1), ("下滑", -1), ("疲软", -1), ("低迷", -1)],
        "word string, weight int",
    )
    cut = segmenter([r.word for r in lexicon.collect()] + ["货币政策", "就业", "经济", "投资", "工业", "消费"])
    scored = tt.classified(tt.scored_sentences(sentences, cut(F.col("text")), lexicon))
    means = {r.text: r.p for r in scored.groupBy("text").agg(F.avg("neg_prob").alias("p")).collect()}
    assert means[bad] > 0.5 > means[good]
    rules = ToneRules(taus=(0.10, 0.08, 0.05), gap=0.02)
    out = tt.indicators(scored, rules=rules).orderBy("year", "quarter").collect()
    assert [(r.year, r.quarter) for r in out] == [(y, q) for y in (2001, 2002) for q in (1, 2, 4)]
    assert [r.prev_quarter_available for r in out] == [0, 1, 0, 1, 1, 0]
    assert out[0].similarity_prev is None and out[2].similarity_prev is None
    assert out[0].n_sentences == 30 and all(r.tone_policy < r.tone_macro for r in out)


def test_daily_panel_runs_on_smoke_tables(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    first = rows.agg(F.min("date")).first()[0]
    assert rows.count() > 500 and first >= dt.date(1995, 1, 1)
