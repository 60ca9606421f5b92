"""The physical plans have the shapes the operators promise."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarterline.functions.text import add_once

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def plan(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["topn_weighted", "topk_informative"])
def test_selection_is_trimmed_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize(
    "name", ["asof_strict_next", "mapped_event_agg", "daily_panel", "similarity_prev", "split_sections"]
)
def test_no_cross_or_range_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(spark, "mapped_event_agg")
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert scans and all("l_comment" not in s and "o_totalprice" not in s for s in scans)
    assert any("l_discount" in s and "l_orderkey" not in s for s in scans)


def test_filters_do_not_repeat_costly_columns(spark):
    df = add_once(spark.range(5), {"x": F.regexp_replace(F.col("id").cast("string"), "1", "7")})
    text = df.where("x <> '7' AND length(x) > 0")._jdf.queryExecution().executedPlan().toString()
    assert text.count("regexp_replace") == 1
