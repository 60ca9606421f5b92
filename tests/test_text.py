"""Rules for Chinese reports on hand-made lines."""

import pytest
from pyspark.sql import functions as F

from quarterline.functions import text as tx
from quarterline.functions.coerce import period_from_text, to_day, to_number
from quarterline.operators import textprep as tp
from quarterline.profiles import ZH


def apply(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, x string").repartition(3)
    return [r[1] for r in df.select("i", fn(F.col("x"))).orderBy("i").collect()]


def test_normalize_line(spark):
    cases = {
        "..... 12 正文": "正文",
        "中 国": "中国",
        "共3 月": "共3月",
        "3 月": "月",
        "一、概况 ........ 15": "一、概况",
        "增长……回落": "增长回落",
        "第 3 页": "",
        "abc PAGE 12 def": "abc def",
        "24 一是": "一是",
        "　全角　空格　": "全角空格",
        "": "",
        "中 国 人 民": "中国人民",
        "2001 年 3 月": "2001年3月",
        "a  b\tc": "a b c",
    }
    assert apply(spark, tx.normalize_line, list(cases)) == list(cases.values())


def test_page_numbers(spark):
    got = apply(spark, tx.is_page_number, ["IV", "123", "12345", "第1页", "IVX1"])
    assert got == [True, True, False, False, False]


def test_toc_page(spark):
    dotted = "\n".join(f"第{i}节 ........ {i}" for i in range(8))
    prose = "\n".join("正文很长的一行" for _ in range(4))
    few = "\n".join("第一部分 第二部分 第三部分 ...... 1" for _ in range(4))
    pages = [
        "目录\n第一部分 货币",
        "目录",
        dotted + "\n" + prose,
        dotted,
        few + "\n" + "\n".join("正文" for _ in range(10)),
        "第一部分 正文",
        "",
    ]
    got = apply(spark, lambda c: tx.is_toc_page(c, ZH), pages)
    assert got == [True, False, True, False, True, False, False]


def test_section_line_rules(spark):
    lines = [
        "第一部分 分析", "十一、标题", "十一、标题。正文", "（一）标题", "一季度增长平稳有力但是这一行超过三十个字所以不会被当作标题行删除掉的吧对吗是的",
        "图 3 走势", "数据来源：统计局", "见表一", "正文没有关键词", "12", "a.b.c.d.e.f.g",
    ]
    got = apply(spark, lambda c: tx.drop_section_line(c, ZH), lines)
    # a full-width bracket is not the bracket of the rule, and neither a numeral
    assert got == [True, True, False, False, False, True, True, True, False, True, True]


def test_older_line_rules(spark):
    lines = ["第一部分 分析", "二、措施", "十一、标题", "专栏 1 ....... 3", "专栏。.......", "正文", ""]
    got = apply(spark, lambda c: tx.drop_section_line_simple(c, ZH), lines)
    assert got == [True, True, False, True, False, False, True]


def test_caption_and_references(spark):
    got = apply(
        spark, tx.strip_caption,
        ["图 3 2005年增长", "表1 无年份", "专栏 2 题目 展望未来", "IV 专栏 下一步工作", "2005年图 3"],
    )
    assert got == ["2005年增长", "表1 无年份", "展望未来", "下一步工作", "2005年图 3"]
    got = apply(
        spark, tx.postprocess_sentence,
        ["增长(图 1)较快。", "如图 8所示，增长。", "参见表 3。", "见图8", "注：口径调整", "表 7：合计", "图图 3"],
    )
    assert got == ["增长较快。", "如下图所示，增长。", "参见下表。", "见下图", "", "下表：合计", "图图 3"]


def test_noise(spark):
    got = apply(
        spark, lambda c: tx.noise_reason(c, ZH),
        ["", "目录", "一。", "单位：亿元", "12月，贷款同比增长10%。", "普通的一句正文。", "123 456", "abc"],
    )
    assert got == ["empty", "toc", "short", "table", None, None, "table", "table"]
    got = apply(
        spark, lambda c: tx.is_noise_simple(c, ZH),
        ["", "一。", "目录页", "123%", "增1234567890", "普通的一句正文。", "2001年增长"],
    )
    assert got == [True, True, True, True, True, False, False]


def test_table_like(spark):
    row = "1 2 3 4 5 6 7 8 9 10 11 12 项目 合计"
    got = apply(spark, lambda c: tx.is_table_like(c, ZH), [row, "图3 走势", "贷款增长，利率为3%", "来源：x"])
    assert got == [True, True, False, True]


@pytest.fixture(scope="module")
def report(spark):
    body = [
        "第一部分 概况\n页眉\n甲乙丙。丁戊\n己庚！好。\n1",
        "前文见第二部分 政策\n页眉\n政策稳健。继续\n2",
        "页眉\n实施下去。第三部分 末尾\n3",
        "页眉\n第一部分 又一次\n补充一句话。\n4",
    ]
    pages = [("2001Q1.pdf", i, t) for i, t in enumerate(body)]
    pages += [("2001Q2.pdf", 0, "没有标题的正文。第二句话？")]
    return spark.createDataFrame(pages, "report_id string, page_no bigint, text string").repartition(4)


def test_repeated_lines(report):
    assert [tuple(r) for r in tp.repeated_lines(report).collect()] == [("2001Q1.pdf", "页眉", 4)]


def test_sections_and_sentences(report):
    lines = tp.section_lines(tp.body_lines(tp.clean_pages(report)))
    got = {(r.report_id, r.section, r.sentence_no): r.text for r in tp.split_sentences(lines).collect()}
    assert got == {
        ("2001Q1.pdf", "S1", 0): "甲乙丙。",
        ("2001Q1.pdf", "S1", 1): "丁戊己庚！",
        ("2001Q1.pdf", "S1", 3): "前文见补充一句话。",
        ("2001Q1.pdf", "S2", 0): "政策稳健。",
        ("2001Q1.pdf", "S2", 1): "继续实施下去。",
        ("2001Q2.pdf", "S_all", 0): "没有标题的正文。",
        ("2001Q2.pdf", "S_all", 1): "第二句话？",
    }
    titles = {(r.section, r.section_title) for r in lines.where("report_id = '2001Q1.pdf'").collect()}
    assert ("S1", "第一部分概况") in titles


def test_numbering(report):
    rows = tp.report_sentences(report).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, len(rows) + 1))
    first = [r for r in rows if r.report_id == "2001Q1.pdf"]
    assert [r.sent_id_in_report for r in first] == list(range(1, len(first) + 1))
    assert [r.section for r in first] == sorted(r.section for r in first)
    assert rows[-1].report_id == "2001Q2.pdf" and rows[-1].sent_id_in_report == 2


def test_periods_and_coercion(spark):
    df = spark.createDataFrame([("2001第一季度.pdf",), ("2015Q3_x.pdf",), ("x.pdf",)], "name string")
    y, q = period_from_text(F.col("name"))
    assert [tuple(r) for r in df.select(y, q).collect()] == [(2001, 1), (2015, 3), (None, None)]
    assert apply(spark, to_number, ["--", " 3.5 ", "N/A", "x", "1e3", "7d"]) == [None, 3.5, None, None, 1000.0, None]
    days = apply(spark, lambda c: to_day(c, "MM/dd/yyyy"), ["03/31/2001", "2001-03-31", "13/01/2001"])
    assert [str(d) for d in days] == ["2001-03-31", "None", "None"]
