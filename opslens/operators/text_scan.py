"""Sensitive values inside free text, row by row.

A text is searched once: what stands between digits and can be part of no number is taken down to its first and last
character, so that words next to a number still count as its neighbours. The rules about numbers look at what is left,
which is short. The rule about addresses looks at texts with an "@" only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opslens.operators.privacy import VALUE_RULES, may_match, value_pattern

# Two characters that no number rule allows inside a match, and all between them up to the next digit.
_BETWEEN = r"(?U)([^\d\s().-])[^\d]*([^\d\s().-])"


def number_spans(c: Column) -> Column:
    """A text without most of what is not part of numbers; it holds the same values of each number rule."""
    return F.regexp_replace(c, _BETWEEN, "$1#$2")


def value_counts(c: Column) -> Column:
    """How many values of each rule's kind a text holds, as a struct; missing text holds none."""
    count = lambda text, rule: F.coalesce(F.when(may_match(text, rule), F.regexp_count(text, F.lit(value_pattern(rule)))), F.lit(0))
    found = lambda spans: F.struct(*[count(c if rule == "email" else spans, rule).alias(rule) for rule in VALUE_RULES])
    return F.transform(F.array(number_spans(c)), found)[0]


def scan_text(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Per row: the keys, and for each rule a hit flag and a hit count. No header is asked here."""
    counted = df.select(*keys, value_counts(F.col(column)).alias("found"))
    flags = [(F.col("found")[rule] > 0).alias(f"{rule}_hit") for rule in VALUE_RULES]
    return counted.select(*keys, *flags, *[F.col("found")[rule].alias(f"{rule}_count") for rule in VALUE_RULES])


def text_hit_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column and rule: rows, rows hit and their share, in one pass."""
    counted = df.select(*[value_counts(F.col(f"`{c}`")).alias(f"f{i}") for i, c in enumerate(columns)])
    sums = counted.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(F.col(f"f{i}")[rule] > 0).alias(f"{i}_{rule}") for i in range(len(columns)) for rule in VALUE_RULES])
    cells = [F.struct(F.lit(col).alias("column"), F.lit(rule).alias("rule"), F.col(f"{i}_{rule}").alias("rows_hit"))
             for i, col in enumerate(columns) for rule in VALUE_RULES]
    cell = sums.select("rows", F.explode(F.array(*cells)).alias("cell"))
    return cell.select("cell.column", "cell.rule", "rows", "cell.rows_hit",
                       F.try_divide(F.col("cell.rows_hit"), F.col("rows")).alias("hit_rate"))
