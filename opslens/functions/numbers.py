"""Rounding, exact money sums and number display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from opslens.functions.coerce import double_text

DASH = "—"

# Amounts are summed with so many decimal places; the digits before the point that are left bound an amount.
_PLACES = 14
_LARGEST = 10.0 ** (38 - _PLACES - 2)
# Amounts of four places and fewer digits than this are whole numbers of units, in two parts of which the lower has 20 bits.
_UNIT, _SHORT, _BITS = 10_000.0, 1e8, 20


def fixed(x: Column, places: int) -> Column:
    """Text with thousands separators and a fixed number of places.

    Rounds the exact binary value, ties to even (2.675 -> "2.67"), which ``round`` and
    ``format_string`` do not.
    """
    return F.format_number(x, places)


def rounded(x: Column, places: int) -> Column:
    """Round a DOUBLE on its exact binary value, ties to even."""
    # format_number takes the double nearest to half a unit for an exact tie, so it is looked up.
    half = float(f"5e-{places + 1}")
    size = F.abs(x)
    return (
        F.when(size == half, F.signum(x) * round(half, places))
        .when(size < float("inf"), F.replace(fixed(x, places), F.lit(","), F.lit("")).cast("double"))
        .otherwise(x)
    )


def money_sum(x: Column) -> Column:
    """Sum of DOUBLE amounts that does not depend on the order rows arrive in.

    Amounts are added as decimals with 14 places; what lies beyond them is rounded. A finite amount of 10^22 or more is an
    error. Infinite amounts make an infinite sum. NULL amounts count as nothing, a group without amounts sums to 0.
    """
    return money_total(*[F.sum(part) for part in money_parts(x)])


def money_parts(x: Column) -> tuple[Column, Column, Column, Column]:
    """The parts of an amount that can be summed exactly, each by itself.

    An amount below 10^8 that has four places at most, like nearly all amounts of money, is a whole number of units; its upper
    and lower digits are summed as whole numbers, which is fast and cannot overflow below 10^12 rows. Any other finite amount
    is a decimal, an infinite one stays as it is.
    """
    size, units = F.abs(x), F.rint(x * _UNIT)
    short = (size < _SHORT) & (units / _UNIT == x)
    whole = F.when(short, units.cast("bigint"))
    amount = (F.when(short, F.lit(None)).when(size < _LARGEST, x.try_cast(f"decimal(38,{_PLACES})"))
              .when(size < float("inf"), F.raise_error(F.concat(F.lit("amount out of range: "), x.cast("string"))).cast(f"decimal(38,{_PLACES})")))
    return F.shiftright(whole, _BITS), whole.bitwiseAND(F.lit((1 << _BITS) - 1)), amount, F.when(size == float("inf"), x)


def money_total(upper: Column, lower: Column, amounts: Column, endless: Column) -> Column:
    """The amount that sums of these parts make."""
    exact = lambda part: F.coalesce(part, F.lit(0)).cast("decimal(25,0)")
    units = (exact(upper) * F.lit(1 << _BITS).cast("decimal(7,0)") + exact(lower)).cast("decimal(33,0)")
    short = units.cast(f"decimal(38,4)") * F.lit("0.0001").cast("decimal(4,4)")
    total = short.cast(f"decimal(38,{_PLACES})") + F.coalesce(amounts, F.lit(0).cast(f"decimal(38,{_PLACES})"))
    return total.cast("double") + F.coalesce(endless, F.lit(0.0))


def money_text(x: Column) -> Column:
    """"$1,234"; missing shows a dash."""
    return F.coalesce(F.concat(F.lit("$"), fixed(x, 0)), F.lit(DASH))


def percent_text(x: Column) -> Column:
    """A rate as "12.3%"; missing shows a dash."""
    return F.coalesce(F.concat(fixed(x * 100, 1), F.lit("%")), F.lit(DASH))


def count_text(n: Column) -> Column:
    """"1,234"."""
    return F.format_number(n, 0)


_MARK = "\u0001"


def _marked(c: Column, kind: T.DataType) -> Column:
    """A value whose DOUBLEs are replaced by their marked decimal text."""
    if isinstance(kind, T.DoubleType):
        return F.concat(F.lit(_MARK), double_text(c))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _marked(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_marked(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def json_text(c: Column, kind: T.DataType, pretty: bool = False) -> Column:
    """A struct as JSON with NULL fields kept and DOUBLEs written out instead of in E notation."""
    options = {"ignoreNullFields": "false", **({"pretty": "true"} if pretty else {})}
    return F.regexp_replace(F.to_json(_marked(c, kind), options), r'"\\u0001([^"]*)"', "$1")
