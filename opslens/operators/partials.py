"""Sums that can be added up: what every metric needs of rows, and the same for rows already summed by a key.

A metric adds up cells (counts, amounts, least and greatest values), whether a cell stands for one row or for many. So
``partials`` sums a table by all keys that metrics use in one pass, batches of rows can be summed when they arrive, and a
metric over the sums of many batches equals that over their rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from opslens.functions.coerce import is_blank
from opslens.functions.numbers import money_parts, money_total
from opslens.operators import typed as t
from opslens.operators.typed import Operations

N, FIRST, LAST = "cell n", "cell first", "cell last"
MONEY = ("cell money upper", "cell money lower", "cell money other", "cell money endless")
RETURNED, DELAYED, STOCK = "cell returned", "cell delayed", "cell stock"
BAD_DATES, NO_REVENUE, NEGATIVE, BAD_UNITS, NO_PRODUCT = (f"cell {x}" for x in ("bad dates", "no revenue", "negative", "bad units", "no product"))
SET = "cell set"

_LEAST, _GREATEST = (FIRST, STOCK), (LAST,)
#: Keys that metrics sum by, each alone; and those for delays judged by duration.
KEYS = (t.PRODUCT, t.CATEGORY, t.CHANNEL, t.SUPPLIER, t.STATUS, t.TS, t.DAYS)


def _cells(ops: Operations) -> dict[str, Column]:
    """The cells of one row; those of concepts that are missing are left out."""
    count = lambda condition: F.coalesce(condition, F.lit(False)).cast("bigint")
    cells = {N: F.lit(1).cast("bigint")}
    if ops.has("revenue"):
        revenue = F.col(t.REVENUE)
        cells |= dict(zip(MONEY, money_parts(revenue)))
        cells |= {NO_REVENUE: count(revenue.isNull()), NEGATIVE: count(revenue < 0)}
    if ops.has("date"):
        cells |= {FIRST: F.col(t.TS), LAST: F.col(t.TS), BAD_DATES: count(F.col(t.TS).isNull())}
    if ops.has("return_flag"):
        cells[RETURNED] = count(F.col(t.RETURNED))
    if ops.has("shipping_status"):
        cells[DELAYED] = count(F.col(t.DELAYED))
    if ops.has("inventory"):
        cells[STOCK] = F.col(t.INVENTORY)
    if ops.has("units"):
        cells[BAD_UNITS] = count(F.col(t.UNITS).isNull() | (F.col(t.UNITS) < 0))
    if ops.has("product"):
        cells[NO_PRODUCT] = count(is_blank(F.col(t.PRODUCT)))
    return cells


def cells(ops: Operations, *keys: str) -> DataFrame:
    """(by..., keys..., cells) to be summed up: those stored for these keys, or else one row for each row."""
    if keys in ops.sums:
        return ops.sums[keys]
    own = [F.col(f"`{c}`") for c in dict.fromkeys((*ops.by, *keys))]
    return ops.rows.select(*own, *[c.alias(name) for name, c in _cells(ops).items()])


def total(name: str) -> Column:
    """The aggregate that adds a cell up."""
    return F.min(f"`{name}`") if name in _LEAST else F.max(f"`{name}`") if name in _GREATEST else F.sum(f"`{name}`")


def rows_in() -> Column:
    """Number of rows; 0 where there are none."""
    return F.coalesce(total(N), F.lit(0).cast("bigint"))


def revenue_in(ops: Operations) -> Column:
    """Exact sum of revenue; 0 without a revenue column."""
    return money_total(*[total(part) for part in MONEY]) if ops.has("revenue") else F.lit(0.0)


def share_of(name: str) -> Column:
    """A count cell as a share of rows."""
    return F.try_divide(total(name).cast("double"), total(N).cast("double"))


def key_sets(ops: Operations) -> list[tuple[str, ...]]:
    """The keys that this table's metrics sum by."""
    mapped = {t.PRODUCT: "product", t.CATEGORY: "category", t.CHANNEL: "channel", t.SUPPLIER: "supplier", t.STATUS: "shipping_status", t.TS: "date"}
    sets = [(), *((key,) for key, concept in mapped.items() if ops.has(concept))]
    if ops.has("delivery_days") and not ops.has("shipping_status"):
        sets += [(t.DAYS,), *([(t.SUPPLIER, t.DAYS)] if ops.has("supplier") else [])]
    return sets


def _keys_of(ops: Operations) -> list[str]:
    used = {key for keys in key_sets(ops) for key in keys}
    return [*ops.by, *(key for key in KEYS if key in used)]


def partials(ops: Operations) -> DataFrame:
    """The cells of all rows, summed by each set of keys in one pass: (by..., keys..., cells..., set)."""
    columns, sets = _keys_of(ops), key_sets(ops)
    column = lambda name: F.col(f"`{name}`")
    rows = cells(replace(ops, sums={}), *columns[len(ops.by):])
    sums = [total(name).alias(name) for name in _cells(ops)]
    grouped = rows.groupingSets([[column(c) for c in (*ops.by, *keys)] for keys in sets], *[column(c) for c in columns])
    return grouped.agg(F.grouping_id().cast("bigint").alias(SET), *sums)


def id_counts(ops: Operations) -> DataFrame:
    """(by..., order id, cells): how often each id occurs."""
    found = ops.rows.groupBy(*[F.col(f"`{b}`") for b in ops.by], t.ORDER_ID)
    return found.agg(F.count(F.lit(1)).alias(N))


def with_sums(ops: Operations, stored: DataFrame, ids: DataFrame | None = None) -> Operations:
    """Operations whose metrics add up stored ``partials`` (of one table or of many batches) instead of rows."""
    columns = _keys_of(ops)
    number = lambda keys: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in (*ops.by, *keys))
    sums = {keys: stored.where(F.col(f"`{SET}`") == number(keys)) for keys in key_sets(ops)}
    return replace(ops, sums=sums | ({(t.ORDER_ID,): ids} if ids is not None else {}))


def kind(ops: Operations, *keys: str):
    """Type of the last key."""
    return cells(ops, *keys).schema[keys[-1]].dataType


def grouped(frame: DataFrame, by: Sequence[str], *keys: str):
    """Grouping by the group keys and ``keys``."""
    return frame.groupBy(*[F.col(f"`{c}`") for c in (*by, *keys)])
