"""The typed projection that all metrics and checks share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from opslens.functions.coerce import is_delayed, is_truthy, to_number
from opslens.functions.dates import DateReading, to_ts
from opslens.operators.columns import ConceptMap

# Names of the typed columns. No normal header holds a space, so these cannot meet a source column.
TS, ORDER_ID, PRODUCT, CATEGORY = "typed ts", "typed order_id", "typed product", "typed category"
SUPPLIER, STATUS, UNITS, REVENUE = "typed supplier", "typed status", "typed units", "typed revenue"
INVENTORY, DAYS, RETURNED, DELAYED = "typed inventory", "typed days", "typed returned", "typed delayed"
CHANNEL = "typed channel"

# Concepts used as they come: concept -> name.
_KEYS = {"order_id": ORDER_ID, "product": PRODUCT, "category": CATEGORY, "channel": CHANNEL, "supplier": SUPPLIER,
         "shipping_status": STATUS}


@dataclass(frozen=True)
class Operations:
    """Typed rows, the concept map they were read under, and the keys results are grouped by.

    ``sums`` holds, by the keys they were summed by, sums to read instead of rows (see ``operators/partials.py``).
    """

    rows: DataFrame
    concepts: ConceptMap
    by: tuple[str, ...] = ()
    sums: Mapping[tuple[str, ...], DataFrame] = field(default_factory=dict)

    def has(self, *concepts: str) -> bool:
        return all(self.concepts.get(c) for c in concepts)


def _mapped(df: DataFrame, concepts: ConceptMap) -> dict[str, str | None]:
    return {concept: col if col in df.columns else None for concept, col in concepts.items()}


def key_columns(df: DataFrame, concepts: ConceptMap) -> list[Column]:
    """The mapped columns that are used as they come."""
    found = _mapped(df, concepts)
    return [F.col(f"`{found[c]}`").alias(name) for c, name in _KEYS.items() if found.get(c)]


def read_columns(df: DataFrame, concepts: ConceptMap, dates: Mapping[str, DateReading] | None = None) -> dict[str, Column]:
    """The mapped columns whose text has to be read: name -> expression. ``dates`` tells how a date column is read."""
    found = _mapped(df, concepts)
    readers = {
        TS: ("date", lambda c, t: to_ts(c, t, (dates or {}).get(found["date"]))),
        UNITS: ("units", to_number),
        REVENUE: ("revenue", to_number),
        INVENTORY: ("inventory", to_number),
        DAYS: ("delivery_days", lambda c, t: F.coalesce(to_number(c, t), F.lit(0.0))),
        DELAYED: ("shipping_status", lambda c, t: is_delayed(c)),
        RETURNED: ("return_flag", lambda c, t: is_truthy(c)),
    }
    return {
        name: read(F.col(f"`{found[concept]}`"), df.schema[found[concept]].dataType).alias(name)
        for name, (concept, read) in readers.items() if found.get(concept)
    }


def typed(df: DataFrame, concepts: ConceptMap, by: Sequence[str] = (),
          dates: Mapping[str, DateReading] | None = None) -> Operations:
    """Project ``df`` to the group keys and the typed columns of the mapped concepts; ``dates`` as ``elect_dates`` finds it."""
    rows = df.select(*[F.col(f"`{b}`") for b in by], *key_columns(df, concepts),
                     *read_columns(df, concepts, dates).values())
    return Operations(rows, _mapped(df, concepts), tuple(by))
