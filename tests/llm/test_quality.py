"""Quality rules against plain Python and their SQL on made texts."""

import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarterline.llm import quality
from tests.oracle import compare

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, __quality string, LANG2 int"


def plain_counts(text):
    words = re.findall(rf"[^{SPACE}]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
        len(covered), len(lines), sum("A" <= c <= "Z" for c in text or ""),
    )


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab A#\n\té ", max_size=40))
def test_counts_are_the_plain_ones(text):
    assert quality.measure(text) == plain_counts(text)


def test_counts_of_very_long_texts():
    assert quality.measure("a b c " * 100_000)[:5] == (300_000, 300_000, 0, 0, 300_000)
    assert quality.measure("x" * 2_000_000)[:2] == (1, 2_000_000) and quality.measure(None) == (0,) * 7


@pytest.mark.parametrize("values", [[0] * 5, list(range(200)), [10**9, 5, 70, 71, 72]])
def test_buckets_are_narrow_and_in_order(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v long").selectExpr("v", f"{quality.bucket_sql('v')} AS b").collect()
    for v, b in rows:
        assert b <= v and (v < 64 and b == v or v - b <= v / 32 or b == 64 << 25)


def prose(i, n=60, word="word"):
    return " ".join(f"{word}{(i * 31 + k * 7) % 997}" for k in range(n))


def made():
    rows = [(i, prose(i), "en", "plain", "x", 1) for i in range(120)]
    rows += [(200 + i, prose(i).upper(), "en", "loud", "x", 1) for i in range(120)]  # capitals are this source's way
    rows += [(400, prose(5).upper(), "en", "plain", "x", 1)]
    rows += [(401, prose(6) + " # # #", "en", "plain", "x", 1), (402, prose(7) + " ######" * 9, "en", "plain", "x", 1)]
    rows += [(500 + i, " ".join(f"{w} ##" for w in prose(i).split()), "en", "code", "x", 1) for i in range(120)]
    rows += [(700, prose(8).upper(), "en", "rare", "x", 1)]  # small source: the language decides
    rows += [(800, None, None, None, None, None), (801, "", "en", None, "x", 1), (None, prose(9), None, "plain", "x", 1)]
    rows += [(None, prose(9), None, "plain", "x", 1), (802, "short", "en", "plain", "x", 1), (803, "a b c " * 40, "en", "plain", "x", 1)]
    return rows


def test_groups_get_their_own_cut_offs(spark):
    docs = spark.createDataFrame(made(), SCHEMA)
    judged, q = quality.judge_quality(docs)
    assert judged.columns == [*docs.columns, q]
    rows = judged.collect()
    got = {r.doc_id: r[q] for r in rows}
    assert len(rows) == len(made())
    assert got[0].cut_capitals < 1000 < got[200].cut_capitals and got[0].cut_symbols < got[500].cut_symbols
    assert got[0].kept and got[200].kept and got[500].kept  # each as its source writes
    assert not got[400].kept and not got[400].base_failed  # capitals where nobody has them
    assert got[401].kept and not got[402].kept  # three symbols are no evidence, many are
    assert got[700].cut_capitals == max(r[q].cut_capitals for r in rows if r.source == "rare")
    assert all(got[i].base_failed and not got[i].kept for i in (800, 801, 802, 803))
    assert got[800].cut_capitals is None and [r[q].kept for r in rows if r.doc_id is None] == [True, True]


def test_a_document_at_the_cut_off_is_kept(spark):
    cut = 3 * quality.LEAST_SPREAD  # lower-case sources: both quartiles are zero
    words = [" ".join(f"{'A' * k}{'b' * (96 - k)}{j:04d}" for j, k in enumerate(ks)) for ks in ([2] * 92 + [1] * 8, [2] * 93 + [1] * 7)]
    base = " ".join(f"{'b' * 96}{j:04d}" for j in range(100))
    rows = [(i, base, "en", "s", "x", 1) for i in range(150)] + [(900, words[0], "en", "s", "x", 1), (901, words[1], "en", "s", "x", 1)]
    judged, q = quality.judge_quality(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: r[q] for r in judged.collect()}
    assert got[900].cut_capitals == cut and got[900].kept and not got[901].kept and got[0].kept


def test_rows_are_those_of_the_sql(spark):
    docs = spark.createDataFrame(made(), SCHEMA).select("doc_id", "text", "lang", "source")
    judged, q = quality.judge_quality(docs)
    out = judged.select("doc_id", *[judged[f"{q}.{c}"] for c in quality.OP9_COLUMNS[1:]])
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    ok, note = compare(out, con, f"WITH {quality.quality_ctes('documents')} SELECT {', '.join(quality.OP9_COLUMNS)} FROM judged")
    assert ok, note


def test_filter_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(made(), SCHEMA)
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[-1].kept for r in quality.judge_quality(docs)[0].collect())
    assert quality.filter_quality(docs.limit(0)).count() == 0
