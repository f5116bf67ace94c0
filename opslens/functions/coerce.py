"""Expressions that read dirty values: numbers, flags, blanks.

Nothing here raises on bad input; what cannot be read becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The number spellings that count as readable.
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"

# Flag spellings that count as true (compared in lower case, untrimmed).
TRUTHY = ("1", "true", "yes", "y")

# Words that mark a fulfilment status as delayed.
DELAY_WORDS = ("delay", "late", "exception")


def is_number_text(c: Column) -> Column:
    """True where a text reads as a number."""
    return c.rlike(NUMBER_TEXT)


def to_number(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Read a column as DOUBLE; unreadable text, NaN and non-numeric types become NULL."""
    if isinstance(dtype, T.StringType):
        return F.when(is_number_text(c), c.try_cast("double"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return F.lit(None).cast("double")


def is_truthy(c: Column) -> Column:
    """True for the accepted flag spellings; missing is false."""
    return F.coalesce(F.lower(c.cast("string")).isin(*TRUTHY), F.lit(False))


def is_delayed(c: Column) -> Column:
    """True where a status holds one of the delay words anywhere; missing is false."""
    text = F.lower(c.cast("string"))
    hit = F.lit(False)
    for word in DELAY_WORDS:
        hit = hit | text.contains(word)
    return F.coalesce(hit, F.lit(False))


def is_blank(c: Column) -> Column:
    """True where a value is missing or only white space."""
    return c.isNull() | c.cast("string").rlike(r"(?U)^\s*$")


def plain_text(c: Column, dtype: T.DataType) -> Column:
    """A value as text, with floating numbers written out instead of in Spark's E notation."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return double_text(c.cast("double"))
    return c.cast("string")


def double_text(x: Column) -> Column:
    """A DOUBLE as its shortest decimal text: 12000000.0, not 1.2E7."""
    size = F.abs(x)
    wide = F.rtrim(x.try_cast("decimal(27,10)").cast("string"), F.lit("0"))
    small = F.rtrim(x.try_cast("decimal(38,24)").cast("string"), F.lit("0"))
    return (
        F.when((size >= 1e7) & (size < 1e16), F.when(wide.endswith("."), F.concat(wide, F.lit("0"))).otherwise(wide))
        .when((size >= 1e-4) & (size < 1e-3), small)
        .otherwise(x.cast("string"))
    )


def label(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """A group key as display text; a missing key reads "nan"."""
    return F.coalesce(plain_text(c, dtype), F.lit("nan"))
