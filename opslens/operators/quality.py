"""Data-quality checks: one row per check with the number of rows it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from opslens.operators import partials as p, typed as t
from opslens.operators.groups import one_row_per_group
from opslens.operators.typed import Operations

# Check -> (severity when rows are affected, detail text), in reporting order.
CHECKS: dict[str, tuple[str, str]] = {
    "Invalid or missing dates": ("High", "Rows with dates that could not be parsed."),
    "Duplicate transaction/order IDs": ("Medium", "Duplicate identifiers can distort counts and revenue."),
    "Missing revenue values": ("Medium", "Rows with revenue that could not be read as a number."),
    "Negative revenue values": ("Medium", "Negative revenue can be valid for refunds but should be reviewed."),
    "Invalid unit quantities": ("Medium", "Missing or negative quantities should be reviewed."),
    "Missing product names": ("Low", "Rows without product names reduce usefulness of product analysis."),
}
DATES, DUPLICATES, NO_REVENUE, NEGATIVE_REVENUE, UNITS, NO_PRODUCT = CHECKS
SCHEMA_CHECK = "Basic schema check"
PASS = "Pass"
CHECK_TYPE = "array<struct<check:string,severity:string,rows_impacted:bigint,detail:string>>"


def _row_checks(ops: Operations) -> dict[str, str]:
    """The cell of every check that looks at one row at a time."""
    found = {DATES: ("date", p.BAD_DATES), NO_REVENUE: ("revenue", p.NO_REVENUE), NEGATIVE_REVENUE: ("revenue", p.NEGATIVE),
             UNITS: ("units", p.BAD_UNITS), NO_PRODUCT: ("product", p.NO_PRODUCT)}
    return {check: cell for check, (concept, cell) in found.items() if ops.has(concept)}


def duplicate_rows(ops: Operations) -> DataFrame:
    """Rows whose identifier occurs more than once, one row per group; missing ids equal each other."""
    ids = p.grouped(p.cells(ops, t.ORDER_ID), ops.by, t.ORDER_ID).agg(p.rows_in().alias("n"))
    return p.grouped(ids, ops.by).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias(DUPLICATES))


def check_counts(ops: Operations) -> DataFrame:
    """Row count and one count per applicable check, one row per group."""
    counts = p.grouped(p.cells(ops), ops.by).agg(p.rows_in().alias("rows"), *[
        F.coalesce(p.total(cell), F.lit(0)).alias(name) for name, cell in _row_checks(ops).items()])
    if not ops.has("order_id"):
        return counts
    return one_row_per_group([counts, duplicate_rows(ops)], ops.by)


def check_list(ops: Operations, keep: Sequence[str] | None = None) -> DataFrame:
    """The checks as one array per group, in reporting order; ``keep`` names the checks wanted."""
    counts = check_counts(ops)
    entry = lambda name, severity, n, detail: F.struct(
        F.lit(name).alias("check"), severity.alias("severity"), n.alias("rows_impacted"), detail.alias("detail"))
    done = []
    for name, (severity, detail) in CHECKS.items():
        if name in counts.columns and (keep is None or name in keep):
            n = F.col(f"`{name}`")
            done.append(entry(name, F.when(n > 0, severity).otherwise(PASS), n, F.lit(detail)))
    if not any(name in counts.columns for name in CHECKS):
        loaded = F.concat(F.lit("Loaded "), F.col("rows").cast("string"),
                          F.lit(" rows. No common order/operations fields were inferred."))
        done.append(entry(SCHEMA_CHECK, F.lit(PASS), F.lit(0).cast("bigint"), loaded))
    checks = F.array(*done) if done else F.array()
    return counts.select(*ops.by, checks.cast(CHECK_TYPE).alias("checks"))


def validate(ops: Operations, keep: Sequence[str] | None = None) -> DataFrame:
    """One row per check: (by..., check, severity, rows_impacted, detail)."""
    return check_list(ops, keep).select(*ops.by, F.explode("checks").alias("c")).select(*ops.by, "c.*")
