"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.session import scratch_path

#: separators of words: space and the ASCII controls tab .. carriage return
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and return
    the written table.  Cuts lineage in a way that survives lost executors and
    keeps an expensive step from being evaluated again by every consumer."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that are no longer used, which
    it does when the driver collects garbage, and else seldom does on a driver with
    little to collect; everything still needed must have been written by then."""
    spark._jvm.System.gc()


class Tables:
    """Tables that one operator writes on its way, deleted as soon as they are
    read for the last time; the shuffle files of a step go with its writing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        release(self.spark)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names or tuple(self.paths):
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)


def give_back() -> None:
    """Returns to the system what this process has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` of mapInArrow that treats each batch by itself, without what a batch
    leaves behind: Spark keeps a Python worker for the tasks and stages that follow,
    and with it all memory that numpy and Arrow have freed but not returned."""

    def run(batches):
        for batch in batches:
            yield from work(iter((batch,)))
            del batch
            give_back()

    return run


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null text: no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def id_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)
