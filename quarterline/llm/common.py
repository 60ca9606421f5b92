"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarterline.session import checkpoint, ensure_checkpoint_dir

#: Word separators of every operator here: space and the five ASCII controls 9 to 13.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL when there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most ``rows`` rows at a time to Python, so that long texts stay within memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


_KEPT: dict = {}


def kept(key, make: Callable):
    """An object that a Python worker keeps between batches, such as a cache of word hashes."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def fixed(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back."""
    return checkpoint(df)


def lowered(text: str | None) -> bytes:
    """UTF-8 with only A-Z in lower case (what bytes.lower() does)."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


class Scratch:
    """Intermediate tables in the shared folder that go when the work is done."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.what = spark, what
        self.paths: list[str] = []

    def fixed(self, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, self.what)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Remove all tables; results that outlive the work must be fixed elsewhere first."""
        for path in self.paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths = []
