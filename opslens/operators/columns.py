"""Header normalisation and the map from business concepts to columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# Concepts and the header spellings that announce them, best first.
CONCEPT_CANDIDATES: dict[str, tuple[str, ...]] = {
    "date": ("order_date", "date", "created_at", "transaction_date"),
    "order_id": ("order_id", "transaction_id", "invoice_id"),
    "product": ("product_name", "product", "sku"),
    "category": ("product_category", "category"),
    "channel": ("sales_channel", "channel", "platform"),
    "supplier": ("supplier", "vendor"),
    "units": ("units_sold", "quantity", "qty", "units"),
    "revenue": ("revenue", "sales", "amount", "total"),
    "inventory": ("inventory_on_hand", "stock", "inventory"),
    "delivery_days": ("delivery_days", "days_to_deliver", "delivery_time"),
    "shipping_status": ("shipping_status", "status", "fulfillment_status"),
    "return_flag": ("return_flag", "returned", "is_returned"),
    "return_reason": ("return_reason", "refund_reason"),
}

ConceptMap = Mapping[str, str | None]


def date_columns(columns: Sequence[str]) -> list[str]:
    """Columns whose header announces a date."""
    return [c for c in columns if any(part in normalize_header(c) for part in CONCEPT_CANDIDATES["date"])]


def normalize_header(name: str) -> str:
    return str(name).strip().lower().replace(" ", "_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename every column to its normal form; two headers meeting in one name is an error."""
    taken: dict[str, str] = {}
    for name in df.columns:
        clean = normalize_header(name)
        if clean in taken:
            raise ValueError(f"headers {taken[clean]!r} and {name!r} both normalise to {clean!r}")
        taken[clean] = name
    return df.toDF(*taken)


def infer_columns(columns: Sequence[str]) -> dict[str, str | None]:
    """Work out which column carries which concept, from names alone.

    An exact candidate wins, in candidate order; otherwise the first column that contains any
    candidate; otherwise the concept is not there. One column may serve several concepts.
    """
    present = list(columns)

    def pick(candidates: tuple[str, ...]) -> str | None:
        exact = [c for c in candidates if c in present]
        loose = [col for col in present if any(c in col for c in candidates)]
        return next(iter(exact + loose), None)

    return {concept: pick(candidates) for concept, candidates in CONCEPT_CANDIDATES.items()}


def concept_table(spark: SparkSession, concepts: ConceptMap) -> DataFrame:
    """The concept map as a table, one row per concept."""
    rows = [(concept, column or "not detected") for concept, column in concepts.items()]
    return spark.createDataFrame(rows, "`business concept` string, `detected column` string")
