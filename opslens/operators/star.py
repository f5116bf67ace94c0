"""Star schema: one fact table and its natural-key dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opslens.functions.coerce import plain_text
from opslens.functions.dates import DateReading, to_ts
from opslens.operators import typed as t
from opslens.operators.columns import ConceptMap
from opslens.operators.partials import N, cells, grouped, kind
from opslens.operators.typed import Operations

# Concepts in the column order of the fact table, and the dimension of each keyed concept.
FACT_CONCEPTS = (
    "date", "product", "category", "channel", "supplier", "units", "revenue", "inventory", "delivery_days",
    "shipping_status", "return_flag",
)
DIMENSIONS = {
    "dim_product": "product",
    "dim_category": "category",
    "dim_channel": "channel",
    "dim_supplier": "supplier",
}
FACT = "fact_operations"
DIM_DATE = "dim_date"


def _keys(by: Sequence[str]) -> list[Column]:
    return [F.col(f"`{b}`") for b in by]


def fact_operations(df: DataFrame, concepts: ConceptMap, by: Sequence[str] = (),
                    dates: Mapping[str, DateReading] | None = None) -> DataFrame:
    """The group keys and the mapped columns, each once, the date parsed and the rest as they came."""
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = list(dict.fromkeys(concepts[c] for c in FACT_CONCEPTS if concepts.get(c) in types and concepts[c] not in by))
    date = concepts.get("date")
    columns = [to_ts(F.col(f"`{c}`"), types[c], (dates or {}).get(c)).alias(c) if c == date else F.col(f"`{c}`") for c in wanted]
    return df.select(*_keys(by), *columns) if columns else df


def dim_date(df: DataFrame, date_column: str, by: Sequence[str] = (), reading: DateReading | None = None) -> DataFrame:
    """Distinct dates of each group with month label and ISO week."""
    parsed = to_ts(F.col(f"`{date_column}`"), df.schema[date_column].dataType, reading)
    # A filter on the date would be moved below and read each text twice; one on a count stays where it is.
    days = df.select(*_keys(by), parsed.cast("date").alias("date")).groupBy(*_keys(by), "date").agg(F.count("date").alias("n"))
    return days.where("n > 0").select(*_keys(by), "date", F.date_format("date", "yyyy-MM").alias("month"), F.weekofyear("date").alias("week"))


def dim_values(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-missing values of one column as text, for each group."""
    text = plain_text(F.col(f"`{column}`"), df.schema[column].dataType)
    return df.select(*_keys(by), text.alias(column)).where(F.col(f"`{column}`").isNotNull()).distinct()


def dimensions(ops: Operations) -> dict[str, DataFrame]:
    """The dimensions of operations whose keys may be summed already; each column keeps its source's name."""
    tables = {}
    if ops.has("date"):
        days = grouped(cells(ops, t.TS).select(*_keys(ops.by), F.col(t.TS).cast("date").alias("date"), F.col(f"`{N}`")), ops.by, "date")
        found = days.agg(F.count("date").alias("n")).where("n > 0")
        tables[DIM_DATE] = found.select(*_keys(ops.by), "date", F.date_format("date", "yyyy-MM").alias("month"), F.weekofyear("date").alias("week"))
    keys = {"product": t.PRODUCT, "category": t.CATEGORY, "channel": t.CHANNEL, "supplier": t.SUPPLIER}
    for name, concept in DIMENSIONS.items():
        if ops.has(concept):
            key = keys[concept]
            text = plain_text(F.col(key), kind(ops, key))
            tables[name] = cells(ops, key).where(F.col(key).isNotNull()).select(*_keys(ops.by), text.alias(ops.concepts[concept])).distinct()
    return tables


def star_schema(df: DataFrame, concepts: ConceptMap, by: Sequence[str] = (),
                dates: Mapping[str, DateReading] | None = None) -> dict[str, DataFrame]:
    """All tables of the model by name; a dimension without a mapped column is absent. ``dates`` as ``elect_dates`` finds it."""
    tables = {}
    if concepts.get("date") in df.columns:
        tables[DIM_DATE] = dim_date(df, concepts["date"], by, (dates or {}).get(concepts["date"]))
    for name, concept in DIMENSIONS.items():
        if concepts.get(concept) in df.columns:
            tables[name] = dim_values(df, concepts[concept], by)
    tables[FACT] = fact_operations(df, concepts, by, dates)
    return tables
