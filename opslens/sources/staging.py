"""Tables written once to a folder and read back, so that several readers share one pass."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Of tables written: a third smaller than Spark's own choice.
CODEC = "zstd"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for intermediate files; where it names none, the warehouse, which executors share."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While this is open, a query's shuffle files are removed when it ends. Otherwise they stay until the driver happens to collect
    its garbage, so that those of many steps lie on the disks at once."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back, so later steps start from the files."""
    df.write.mode("overwrite").option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
