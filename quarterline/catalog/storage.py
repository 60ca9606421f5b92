"""Files written from the tables and read back: word lists, reports, optional sources, replaced periods."""

import uuid

from pyspark.sql import functions as F

from quarterline.catalog.base import SP, query, table, texts
from quarterline.session import ensure_checkpoint_dir
from quarterline.sources import files as fl

LETTERS, HAN = "abcdefghijklmnopqrstuvwxyz", "中国人民银行货币政策执报告经济增长物价稳定金融市场利"


def scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}_{uuid.uuid4().hex}"


@query(
    "scan_words",
    rf"""WITH w AS (SELECT DISTINCT regexp_replace(l, '^{SP}+|{SP}+$', '', 'g') AS word FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents))
SELECT word, word IN ('的', '了') AS standard FROM w WHERE word <> ''""",
)
def scan_words(spark, sf):
    """A word list from the second of two paths, next to the built-in list used when no path exists."""
    path = scratch(spark, "words")
    texts(spark, sf, "documents", "doc_id", "text").where("text IS NOT NULL").select("text").write.text(path)
    words = fl.scan_words(spark, [path + "_missing", path])
    standard = fl.scan_words(spark, [path + "_missing"]).withColumn("standard", F.lit(True))
    return words.join(standard, "word", "left").select("word", F.coalesce("standard", F.lit(False)).alias("standard"))


#: One report per source: the documents' letters as Han characters and plain ASCII, a page per document.
_PAGE = rf"regexp_replace(translate(lower(coalesce(text, '')), '{LETTERS}', '{HAN}'), '[^\x20-\x7E\n{HAN}]', '', 'g')"
REPORTS = f"SELECT 'report=' || source AS report_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS page_no, {_PAGE} AS text FROM documents"


def write_reports(spark, sf):
    """A folder per report, half of them in GBK and a quarter with a byte-order mark."""
    docs = texts(spark, sf, "documents", "doc_id", "source", "text")
    clean = F.regexp_replace(F.translate(F.lower(F.coalesce("text", F.lit(""))), LETTERS, HAN), rf"[^\x20-\x7E\n{HAN}]", "")
    gbk = F.crc32(F.col("source").cast("binary")) % 2 == 0
    fl.allow_charset(spark, "GBK")
    value = F.when(gbk, F.encode(clean, "GBK")).otherwise(F.encode(clean, "UTF-8")).cast("string")
    path = scratch(spark, "reports")
    rows = docs.select(F.col("source").alias("report"), "doc_id", value.alias("value")).repartition("report").sortWithinPartitions("report", "doc_id")
    rows.select("report", "value").write.partitionBy("report").option("lineSep", "\f").text(path)
    return path


@query("scan_report_pages", f"SELECT report_id, page_no, md5(text) AS digest, length(text) AS n FROM ({REPORTS})")
def scan_report_pages(spark, sf):
    """Reports of any length in UTF-8 or GBK, read page by page."""
    pages = fl.scan_report_pages(spark, write_reports(spark, sf), "*", name_level=2)
    return pages.select("report_id", "page_no", F.md5(F.col("text")).alias("digest"), F.length("text").cast("bigint").alias("n"))


@query("scan_documents", "SELECT r_name || '.txt' AS report_id, md5(string_agg(n_name, chr(10) ORDER BY n_name) || chr(10)) AS digest FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def scan_documents(spark, sf):
    """Small text files, one row each: a region's file lists its nations."""
    path = scratch(spark, "docs")
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = rows.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("text"))
    for r in lines.collect():  # one row per region
        fs, make = fl._file_system(spark, path)
        out = fs.create(make(f"{path}/{r.r_name}.txt"), True)
        out.write(bytearray((r.text + "\n").encode()))
        out.close()
    return fl.scan_documents(spark, path).select("report_id", F.md5("text").alias("digest"))


@query(
    "optional_source",
    "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note FROM nation",
)
def optional_source(spark, sf):
    """A table that exists, joined with one that doesn't: its column is NULL."""
    path = scratch(spark, "nation")
    fl.write_table(table(spark, sf, "nation").select("n_nationkey", "n_name"), path)
    there = fl.optional_source(spark, path, spark.read.parquet)
    notes = fl.optional_source(spark, path + "_notes", spark.read.parquet)
    if notes is None:
        return there.withColumn("note", F.lit(None).cast("string"))
    return there.join(notes, "n_nationkey", "left")


@query(
    "replace_periods",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1995 AND quarter(o_orderdate) IN (2, 3) THEN -o_totalprice ELSE o_totalprice END AS price,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter FROM orders""",
)
def replace_periods(spark, sf):
    """Two quarters of a table replaced by rows computed from the table itself."""
    path = scratch(spark, "orders")
    d = F.col("o_orderdate")
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.year(d).alias("year"), F.quarter(d).alias("quarter"))
    fl.write_table(rows.repartition("year", "quarter"), path, keys=["year", "quarter"])
    some = spark.read.parquet(path).where("year = 1995 AND quarter IN (2, 3)")
    fl.replace_periods(spark, some.withColumn("price", -F.col("price")), path)
    return spark.read.parquet(path)
