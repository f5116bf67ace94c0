"""Tables written once to the shared folder and read back, so that several readers share one pass and lineage ends there."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, under the warehouse, which executors share too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new shared folder and read it back."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_kept: dict = {}


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """What an operation keeps in a Python worker between its tasks. Workers serve one operation after the other, so what another
    has kept there goes first."""
    if key not in _kept:
        make_room()
        _kept[key] = make()
    return _kept[key]


def make_room() -> None:
    """Drop what operations have kept in this worker."""
    if _kept:
        _kept.clear()
        give_back_memory()


def give_back_memory() -> None:
    """Return memory that is no longer used to the system: Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that gives memory back when it is through."""
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back_memory()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that an operator's own columns cannot clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def unpacked(df: DataFrame, kept: list[str], added: list[str], row: str = "row") -> DataFrame:
    """The packed columns and ``added``; an input column named like an added one gives way."""
    taken = {c.lower() for c in added}
    return df.select(*(F.col(f"{row}.`{c}`").alias(c) for c in kept if c.lower() not in taken), *added)
