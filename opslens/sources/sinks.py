"""Result sinks: JSON payloads and Markdown reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.functions.numbers import json_text
from opslens.sources.staging import CODEC

#: Bytes of a row group in a store of reports: what a look-up of one report reads.
REPORT_BLOCK = 1 << 20


def write_tables(tables: Mapping[str, DataFrame], folder: str, at_once: int = 4) -> None:
    """Write each table as Parquet to its own folder; a few jobs run side by side, as most are small."""
    def write(item: tuple[str, DataFrame]) -> None:
        item[1].write.mode("overwrite").option("compression", CODEC).parquet(f"{folder}/{item[0]}")

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(write, tables.items()))


def write_json(payloads: DataFrame, path: str, mode: str = "overwrite", pretty: bool = False) -> None:
    """Write payload structs as JSON, one document per row, NULL fields kept, numbers written out.

    Documents take one line each; ``pretty`` ones are indented over several.
    """
    keys = [c for c in payloads.columns if c != "payload"]
    document = payloads.select(F.struct(*[F.col(f"`{c}`") for c in keys], "payload.*").alias("value"))
    text = json_text(F.col("value"), document.schema["value"].dataType, pretty)
    document.select(text.alias("value")).write.mode(mode).text(path)


def write_report(reports: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write report texts: one alone as a text file, those of many groups as a store that finds a group's report.

    The store is a few Parquet files: reports are dealt by hash of their keys, as many to a task as Spark finds fit, and
    sorted by key. Row groups are small and have Bloom filters of the keys, so a look-up reads footers and one row group,
    and there is no file or folder for each of the groups.
    """
    if not by:
        reports.select(F.col("report").alias("value")).write.mode(mode).text(path)
        return
    keys = [F.col(f"`{b}`") for b in by]
    writer = reports.repartition(*keys).sortWithinPartitions(*keys).write.mode(mode).option("parquet.block.size", REPORT_BLOCK)
    for b in by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{b}", "true")
    writer.parquet(path)


def read_report(spark: SparkSession, path: str, **key: object) -> DataFrame:
    """The reports of a store whose keys have these values (NULL finds NULL)."""
    found = spark.read.parquet(path)
    for name, value in key.items():
        c = F.col(f"`{name}`")
        found = found.where(c.isNull() if value is None else c == F.lit(value))
    return found


def export_reports(reports: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write each report as a text file in a folder named by its keys; for a few groups that people open by hand."""
    keys = [F.col(f"`{b}`").cast("string").alias(b) for b in by]
    reports.select(*keys, F.col("report").alias("value")).write.mode("overwrite").partitionBy(*by).text(path)
