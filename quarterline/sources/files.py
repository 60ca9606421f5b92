"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterline.functions.coerce import strip
from quarterline.profiles import FALLBACK_STOPWORDS


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist on the file system it names?"""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def allow_charset(spark: SparkSession, encoding: str) -> None:
    """Let the session read charsets beyond the Unicode family, such as GBK."""
    if not encoding.upper().startswith(("UTF", "ISO-8859-1", "US-ASCII")):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    """CSV with a header row, in UTF-8 (with or without a byte-order mark) or GBK.

    Without a schema every column is read as a string; no pass is spent on inference.
    """
    allow_charset(spark, encoding)
    reader = spark.read.option("header", True).option("encoding", encoding)
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", True)
    df = reader.csv(path)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def scan_words(
    spark: SparkSession,
    candidates: str | Sequence[str] = (),
    fallback: Iterable[str] = FALLBACK_STOPWORDS,
) -> DataFrame:
    """Distinct trimmed words, one per line, from the first path that exists."""
    paths = [candidates] if isinstance(candidates, str) else list(candidates)
    found = next((p for p in paths if path_exists(spark, p)), None)
    if found is None:
        return spark.createDataFrame([(w,) for w in fallback], "word string").distinct()
    return distinct_words(spark.read.text(found), "value")


def distinct_words(df: DataFrame, column: str) -> DataFrame:
    """Trimmed, non-empty, distinct values of a string column as ``word``."""
    return df.select(strip(F.col(column)).alias("word")).where("word <> ''").distinct()


def scan_documents(spark: SparkSession, directory: str, glob: str = "*.txt") -> DataFrame:
    """One row per text file: ``report_id`` (the file name) and ``text``."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return (
        spark.read.option("pathGlobFilter", glob)
        .text(directory, wholetext=True)
        .select(F.url_decode(name).alias("report_id"), F.col("value").alias("text"))
    )


def optional_source(spark: SparkSession, path: str | None, read) -> DataFrame | None:
    """``read(path)`` when the path exists, else ``None``."""
    if path is None or not path_exists(spark, path):
        return None
    return read(path)


def scan_report_pages(
    spark: SparkSession, directory: str, glob: str = "*.txt", name_level: int = 1,
    fallback: str = "GBK",
) -> DataFrame:
    """``report_id, page_no, text``: text reports cut at form feeds, each file in its own encoding.

    Pages are records of the scan, so a long report is split like any file and is never one string.
    A file whose every page is valid UTF-8 (with or without a byte-order mark) is read as such, any
    other one in the ``fallback`` charset; the form feed is the same byte in both. ``report_id`` is the
    path's ``name_level``-th part from the end. Pages count from 0.
    """
    allow_charset(spark, fallback)
    path = F.col("_metadata.file_path")
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(directory, lineSep="\f")
    pages = raw.select(
        path.alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").cast("binary").alias("bytes"),
    )
    valid = pages.groupBy("path").agg(F.min(F.is_valid_utf8(F.col("bytes").cast("string"))).alias("utf8"))
    along = W.partitionBy("path").orderBy("block", "place")  # the pages of one report
    both = pages.join(valid, "path").withColumn("page_no", F.row_number().over(along) - 1)
    text = F.when(F.col("utf8"), F.col("bytes").cast("string")).otherwise(F.decode("bytes", fallback))
    text = F.when(F.col("page_no") == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    name = F.element_at(F.split("path", "/"), -name_level)
    return both.select(F.url_decode(name).alias("report_id"), F.col("page_no").cast("int").alias("page_no"), text.alias("text"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", keys: Sequence[str] = ()) -> None:
    """Write over ``path``, in one folder per value of ``keys``; CSV files get a byte-order mark and a header."""
    if fmt == "csv":
        first = df.columns[0]
        df = df.withColumnRenamed(first, "\ufeff" + first)
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*keys) if keys else writer
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def replace_table(spark: SparkSession, df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite a path that ``df`` itself may read.

    The result is written next to the target first and then swapped in, because Spark cannot
    overwrite the files it is reading. See ``recover`` for runs that end in between.
    """
    recover(spark, path)
    write_table(df, f"{path}.__new", fmt)
    _commit(spark, path, [""])


def replace_periods(
    spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str] = ("year", "quarter")
) -> None:
    """Overwrite the periods that ``df`` has rows of; all other periods of the Parquet table stay.

    The table has one folder per period (``write_table`` with ``keys``). ``df`` may read it.
    """
    recover(spark, path)
    write_table(df, f"{path}.__new", keys=keys)
    fs, make = _file_system(spark, path)
    _commit(spark, path, _folders(fs, make(f"{path}.__new"), len(keys)))


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a replacement that ended half-way.

    The commit record lists the folders to swap and is written when the new ones are complete: with
    it the swap is finished, from whichever step it had reached; without it the new folders are
    dropped and the table is as before.
    """
    fs, make = _file_system(spark, path)
    record = make(f"{path}.__commit")
    if fs.exists(record):
        lines = spark.read.text(f"{path}.__commit").where("value <> ''").collect()
        _swap(spark, path, [r.value[1:] for r in lines])
    else:
        fs.delete(make(f"{path}.__new"), True)


def _file_system(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _folders(fs, root, depth: int, prefix: str = "") -> list[str]:
    """The ``key=value`` folders ``depth`` levels down."""
    if not depth:
        return [prefix]
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and "=" in s.getPath().getName()]
    return [f for n in names for f in _folders(fs, root.suffix(f"/{n}"), depth - 1, f"{prefix}/{n}")]


def _commit(spark: SparkSession, path: str, parts: Sequence[str]) -> None:
    """Write the record under another name first: a rename shows all of it or nothing."""
    fs, make = _file_system(spark, path)
    draft = f"{path}.__draft"
    out = fs.create(make(draft), True)
    out.write(bytearray("".join(f"={p}\n" for p in parts).encode()))
    out.close()
    if not fs.rename(make(draft), make(f"{path}.__commit")):
        raise OSError(f"cannot commit to {path}")
    _swap(spark, path, parts)


def _swap(spark: SparkSession, path: str, parts: Sequence[str]) -> None:
    """Move each new folder into place; every step can be repeated."""
    fs, make = _file_system(spark, path)
    for part in parts:
        new, target, old = make(f"{path}.__new{part}"), make(f"{path}{part}"), make(f"{path}.__old{part}")
        if not fs.exists(new):
            continue  # moved before
        if fs.exists(target):
            fs.delete(old, True)
            fs.mkdirs(old.getParent())
            if not fs.rename(target, old):
                raise OSError(f"cannot move {target} aside")
        fs.mkdirs(target.getParent())
        if not fs.rename(new, target):
            raise OSError(f"cannot move the new table to {target}")
    for rest in ("__old", "__new", "__commit"):
        fs.delete(make(f"{path}.{rest}"), True)
