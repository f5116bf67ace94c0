"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; a row's fractional rank (its rank over its source's
rows) says how far through the source it stands. Sorted by fractional rank, rows of all sources interleave in proportion,
and equal cuts of that order give shards that hold the mixture of the whole and differ by one row at most.

Both rankings are built from buckets, so no task holds a source or the whole table: only bucket counts are summed up
across buckets, rows are numbered within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opslens.llm.mixing import shuffle_key, source_key
from opslens.llm.staging import packed, unpacked

#: 16 ** 3 hash buckets in each source, and as many slices of the fractional rank.
BUCKET_DIGITS = 3
SLICES = 4096


def shard(
    docs: DataFrame, shards: int = 16, *, source: str = "source", doc_id: str = "doc_id", seed: str = "shards",
) -> DataFrame:
    """All rows of ``docs`` with shard (from 0) and slot (gapless from 0 in each shard, in the interleaved order).

    A null source is a source of its own; null ids are shuffled like the empty text. Repeated rows are all kept; rows
    alike in every column are interchangeable. Fewer rows than shards leave shards empty; an empty table gives an empty
    result. Input columns named shard or slot give way.
    """
    rows = docs.select(packed(docs), source_key(F.col(source)).alias("sk"), shuffle_key(F.col(doc_id), seed).alias("key"))
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    counts = rows.groupBy("sk", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.select(
        "sk", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"),
        F.sum("n").over(Window.partitionBy("sk")).alias("of"))
    inside = Window.partitionBy("sk", "bucket").orderBy("key", F.xxhash64("row"))
    ranked = rows.withColumn("nth", F.row_number().over(inside)).join(buckets, ["sk", "bucket"])
    ranked = ranked.withColumn("part", (F.col("ahead") + F.col("nth") - 0.5) / F.col("of"))
    ranked = ranked.withColumn("slice", F.floor(F.col("part") * SLICES))

    slices = ranked.groupBy("slice").agg(F.count("*").alias("n"))
    # SLICES rows at most
    slices = slices.select(
        "slice",
        F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"),
        F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    order = Window.partitionBy("slice").orderBy("part", "sk", "key", F.xxhash64("row"))
    placed = ranked.withColumn("at", F.row_number().over(order)).join(slices, "slice")
    place: Column = F.col("first") + F.col("at") - 1
    number = F.expr(f"cast((first + at - 1) * {shards} div `all` as int)")
    start = F.expr(f"(shard * `all` + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", number).withColumn("slot", place - start)
    return unpacked(placed, docs.columns, ["shard", "slot"])


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Write the shards as folders ``shard=N``; each holds its rows in slot order, over as many files as tasks wrote it."""
    shard(docs, shards, **options).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
