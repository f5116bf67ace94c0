"""Exact quantiles that never gather a whole group's values in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_SALTS = 32
_DIGIT = 16


def attach(df: DataFrame, lookup: DataFrame, by: Sequence[str], *spread_on: str) -> DataFrame:
    """Join one ``lookup`` row per group onto ``df`` without piling a large group into one task.

    Both sides are joined on the group keys plus a salt taken from ``spread_on``; every lookup row
    is repeated once per salt. ``df`` is expected to be aggregated already by the keys and the
    columns ``spread_on``, so its values differ within a group and the salt spreads them.
    """
    keys = [f"__key{i}" for i in range(len(by))]
    right = lookup.select(
        *[F.col(b).alias(k) for b, k in zip(by, keys)],
        *[c for c in lookup.columns if c not in by],
        F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("__slot"),
    )
    # The default is never used; it tells the optimizer that no salt is missing.
    salt = F.coalesce(F.pmod(F.xxhash64(*spread_on), F.lit(_SALTS)).cast("int"), F.lit(0))
    left = df.withColumn("__salt", salt)
    on = F.col("__salt") == F.col("__slot")
    for b, k in zip(by, keys):
        on = on & F.col(b).eqNullSafe(F.col(k))
    return left.join(right, on).drop("__salt", "__slot", *keys)


def order_key(x: Column) -> Column:
    """A DOUBLE as a whole number of 64 bits that keeps its order; different values have different numbers.

    The exponent stands in the upper bits and the rest of the value below it; negative values have the negative number.
    """
    size = F.abs(x)
    tiny, places = F.lit(2.0 ** -1022), float(1 << 52)
    guess = F.greatest(F.least(F.floor(F.log2(size)).cast("int"), F.lit(1023)), F.lit(-1022))
    # The logarithm is rounded, so next to a power of two it may be one off.
    exponent = guess + F.when(size < F.pow(F.lit(2.0), guess), -1).when(size / F.pow(F.lit(2.0), guess) >= 2, 1).otherwise(0)
    part = size / F.pow(F.lit(2.0), exponent) - 1
    number = F.shiftleft((exponent + 1023).cast("bigint"), 52) + (part * places).cast("bigint")
    number = (F.when(size < tiny, (size / tiny * places).cast("bigint")).when(size == float("inf"), F.lit(2047 << 52))
              .otherwise(number))
    return F.when(x < 0, -number).otherwise(number)


def exact_quantile(counts: DataFrame, value: str, p: float, by: Sequence[str] = (), alias: str = "quantile") -> DataFrame:
    """Linearly interpolated quantile of ``value``, one row per group.

    ``counts`` holds (by..., value, n). The value is found digit by digit: values become ordered whole numbers, and each of
    four passes counts the next 16 bits of those that share the digits found so far, takes the digit that holds the rank,
    and notes the smallest value behind it. So a pass puts 65,536 counts of a group in order at most, whatever the values,
    and all passes read the same counts.
    """
    if not by:
        return exact_quantile(counts.withColumn("__all", F.lit(0)), value, p, ("__all",), alias).drop("__all")
    v = F.col(value)
    # every pass reads the same columns, so Spark shuffles the counts once
    known = counts.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.cast("double").alias("__v"), "n").groupBy(*by, "__v").agg(F.sum("n").alias("__n"))
    known = known.withColumn("__k", order_key(F.col("__v")))
    found = None
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        here = known
        if found is not None:
            here = attach(known, found.select(*by, F.struct("prefix", "before", "at", "rank", "next").alias("__f")), by, "__k")
            here = here.where(F.shiftright("__k", shift + _DIGIT) == F.col("__f.prefix"))
        digit = F.shiftright("__k", shift).alias("prefix")
        counted = here.groupBy(*by, digit).agg(F.sum("__n").alias("n"), F.min("__v").alias("least"), *(
            [] if found is None else [F.first("__f").alias("f")]))
        group = Window.partitionBy(*by)
        in_order = group.orderBy("prefix")
        if found is None:
            rank = (F.sum("n").over(group) - 1) * F.lit(p)
            facts = {"rank": rank, "at": F.floor(rank), "start": F.lit(0).cast("bigint"), "behind": F.lit(None).cast("double")}
        else:
            facts = {"rank": F.col("f.rank"), "at": F.col("f.at"), "start": F.col("f.before"), "behind": F.col("f.next")}
        placed = counted.withColumns({**facts, "upto": F.sum("n").over(in_order), "following": F.lead("least").over(in_order)})
        upto = F.col("start") + F.col("upto")
        found = placed.where((upto > F.col("at")) & (upto - F.col("n") <= F.col("at"))).select(
            *by, "prefix", (upto - F.col("n")).alias("before"), "at", "rank",
            F.coalesce("following", "behind").alias("next"), F.col("least").alias("low"), upto.alias("upto"))
    high = F.when(F.col("upto") > F.ceil("rank"), F.col("low")).otherwise(F.col("next"))
    return found.select(*by, _between(F.col("low"), F.coalesce(high, F.col("low")), F.col("rank") - F.floor("rank")).alias(alias))


def _between(low: Column, high: Column, part: Column) -> Column:
    step = high - low
    return (F.when(low == high, low).when(part >= 0.5, high - step * (1 - part)).otherwise(low + step * part))
