"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected to be copied ``target / source size`` times. Documents are put in an order, their
expected copies are summed up from the source's first document on, one random offset per source is added, and a document
is emitted once for each integer that the running sum crosses on it. The order is by size class and then by a seeded
hash, so every run of neighbours has nearly the same size and the words taken come near the target, not only the copies.

No task ever holds a source: a source is cut into strata (size class x hash bucket), only strata totals are summed over
the source, and rows are numbered inside their stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opslens.llm.staging import packed, unpacked

#: Characters of a hexadecimal digest that name a hash bucket: 16 buckets for each source and size class.
BUCKET_DIGITS = 1
#: Leading binary digits of a size that name its class: classes are 1/16 of their size wide or less.
CLASS_DIGITS = 5
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts sources by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def size_class(size: Column) -> Column:
    """Sortable name of a size's class: the number of its binary digits and the first few of them."""
    digits = F.bin(size)
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, CLASS_DIGITS))


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """Seeded hash that deals rows in random order; null ids hash like the empty text."""
    return F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Targets of sources. ``sizes``: one row (sk, source_size) for each source.

    Sources in the order of ``sk`` weigh ``weights``, repeating, and share the sum of all sizes. With sources ordered by
    ``cap * size / weight``, those at the front stop at ``cap * size``; the first that does not, fixes the level that all
    later ones get for each unit of weight. Levels rise up to that source and fall after it, so it is the largest. One row per source passes through one task, as the rank of a source by name
    is a single sequence.
    """
    named = Window.orderBy("sk")
    weight = F.element_at(
        F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = sizes.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    filled = Window.orderBy(F.col("most") / F.col("weight"), "sk")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("sk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double")
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    )
    levels = ranked.withColumn("level", level).withColumn("stops", F.col("most") <= F.col("level") * F.col("weight"))
    shared = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    return levels.withColumn("shared", shared).select(
        "sk", "source_size",
        F.when(F.col("stops"), F.col("most").cast("double")).otherwise(F.col("shared") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, *, size: Column | None = None, source: str = "source", doc_id: str = "doc_id",
    weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix",
) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, copies and taken (copies times size).

    ``size``: words of the column ``text`` unless given. Null or empty texts have size 0, count as documents of their
    source and take nothing. A null source is a source of its own. Repeated rows are documents of their own; rows that
    are alike in every column are interchangeable. A source without words has target 0 and no copies. An empty table
    gives an empty result. Input columns named like an added one give way to it. ``cap`` also bounds a document's copies.
    """
    size = word_count(F.col("text")) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    key = shuffle_key(F.col(doc_id), seed)
    rows = docs.select(packed(docs), source_key(F.col(source)).alias("sk"), size.alias("size"), key.alias("key"))
    rows = rows.withColumns({"cls": size_class(F.col("size")), "bucket": F.substring("key", 1, BUCKET_DIGITS)})
    stratum = ["sk", "cls", "bucket"]

    strata = rows.groupBy(*stratum).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sums = strata.groupBy("sk").agg(F.sum("words").alias("source_size"))
    ahead = Window.partitionBy("sk").orderBy("cls", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("sk"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    placed = (
        strata.select(*stratum, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
        .join(targets(sums, weights, cap), "sk")
        .withColumns({"rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0),
                      "offset": offset})
    )
    inside = Window.partitionBy(*stratum).orderBy("size", "key", F.xxhash64("row"))
    place = F.col("ahead") + F.row_number().over(inside)
    until = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    copies = F.least(until(place) - until(place - 1), F.ceil("rate")).cast("long")
    done = (
        rows.join(placed, stratum)
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
    return unpacked(done, docs.columns, ["size", "source_size", "target", "copies", "taken"])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is copied, with the columns of ``docs`` alone."""
    size = options.pop("size", None)
    size = word_count(F.col("text")) if size is None else size
    keep = (options.get("source", "source"), options.get("doc_id", "doc_id"))
    slim = docs.select(packed(docs, "whole"), *keep, size.alias("words"))
    dealt = mix(slim, size=F.col("words"), **options).where("copies > 0")
    return dealt.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("whole.*")
