"""Helpers for results that hold one row per group (or one row in all, without group keys)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

RANK = "rank"


def one_row_per_group(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Put partial results side by side, one row per group.

    Each part holds the group keys and columns of its own, with at most one row per group. They are
    stacked and folded, so one small shuffle replaces a chain of joins, and NULL keys still meet.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    values = [c for c in stacked.columns if c not in by]
    return stacked.groupBy(*by).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in the given order, numbered from 1 in column ``rank``."""
    if by:
        numbered = df.withColumn(RANK, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return numbered.where(F.col(RANK) <= k)
    return df.orderBy(*order).limit(k).withColumn(RANK, F.row_number().over(Window.orderBy(*order)))


def ranked_list(df: DataFrame, by: Sequence[str], item: Column, name: str) -> DataFrame:
    """Fold the few ranked rows of each group into one array column, in rank order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(RANK), item.alias("item"))))
    return df.groupBy(*by).agg(F.transform(pairs, lambda p: p["item"]).alias(name))
