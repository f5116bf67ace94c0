"""The KPI pack: revenue, returns, delays, top lists, week over week, risk flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opslens.functions.coerce import double_text, label
from opslens.functions.numbers import money_sum, rounded
from opslens.functions.quantile import attach, exact_quantile
from opslens.operators import partials as p, typed as t
from opslens.operators.groups import one_row_per_group, ranked_list, top_rows
from opslens.operators.partials import cells, grouped, kind, revenue_in, rows_in, share_of, total
from opslens.operators.typed import Operations

TOP = 5
LATE_SHARE = 0.75
SLOTS = 32

# Thresholds of the risk rules.
DECLINE_PERCENT = -5
HIGH_DELAY_RATE = 0.12
HIGH_RETURN_RATE = 0.08
LOW_STOCK = 20
LOW_STOCK_ITEMS = 3

KPI_COLUMNS = (
    "date_range", "total_revenue", "avg_order_value", "row_count", "order_count", "return_rate", "delay_rate",
    "top_products", "top_categories", "inventory_risks", "supplier_delay_risks", "weekly_revenue_change_percent",
    "current_week_revenue", "previous_week_revenue", "risk_summary",
)

KEY_REVENUE = "array<struct<{key}:string,revenue:double>>"
LIST_TYPES = {
    "top_products": KEY_REVENUE.format(key="product"),
    "top_categories": KEY_REVENUE.format(key="category"),
    "inventory_risks": "array<struct<product:string,inventory_on_hand:bigint>>",
    "supplier_delay_risks": "array<struct<supplier:string,delay_rate:double>>",
}


def _label(ops: Operations, key: str) -> Column:
    return label(F.col(key), kind(ops, key))


def totals(ops: Operations) -> DataFrame:
    """Date range, revenue, row counts and rates, one row per group, in a single pass."""
    missing = F.lit(None)
    dated, flagged, with_status = ops.has("date"), ops.has("return_flag"), ops.has("shipping_status")
    sums = grouped(cells(ops), ops.by).agg(
        rows_in().alias("n"),
        revenue_in(ops).alias("revenue"),
        (total(p.FIRST) if dated else F.max(missing.cast("timestamp"))).alias("first_ts"),
        (total(p.LAST) if dated else F.max(missing.cast("timestamp"))).alias("last_ts"),
        (share_of(p.RETURNED) if flagged else F.max(missing.cast("double"))).alias("returned"),
        (share_of(p.DELAYED) if with_status else F.max(missing.cast("double"))).alias("delayed"),
    )
    day = lambda c: F.col(c).cast("date").cast("string")
    return sums.select(
        *ops.by,
        F.struct(day("first_ts").alias("start"), day("last_ts").alias("end")).alias("date_range"),
        rounded(F.col("revenue"), 2).alias("total_revenue"),
        (rounded(F.try_divide("revenue", "n"), 2) if ops.has("revenue") else F.lit(0.0)).alias("avg_order_value"),
        F.col("n").alias("row_count"),
        F.col("n").alias("order_count"),
        rounded(F.col("returned"), 4).alias("return_rate"),
        rounded(F.col("delayed"), 4).alias("delay_rate"),
    )


def _days_counted(ops: Operations, *keys: str) -> DataFrame:
    return grouped(cells(ops, *keys, t.DAYS), ops.by, *keys, t.DAYS).agg(rows_in().alias("n"))


def delay_threshold(ops: Operations) -> DataFrame:
    """75th percentile of delivery days (missing days count as 0), one row per group."""
    return exact_quantile(_days_counted(ops), t.DAYS, LATE_SHARE, ops.by, "p75_days")


def _long_deliveries(ops: Operations, *keys: str) -> DataFrame:
    """Rows counted per (group, keys, days) with a flag for days above the group's threshold."""
    counts, limit = _days_counted(ops, *keys), delay_threshold(ops)
    if ops.by:
        return attach(counts, limit, ops.by, *keys, t.DAYS).withColumn("late", F.col(t.DAYS) > F.col("p75_days"))
    return counts.withColumn("late", F.col(t.DAYS) > limit.scalar())


_late_share = lambda: F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)) / F.sum("n")


def delay_rate_by_duration(ops: Operations) -> DataFrame:
    """Share of rows that took longer than the 75th percentile, one row per group."""
    return _long_deliveries(ops).groupBy(*ops.by).agg(rounded(_late_share(), 4).alias("delay_rate"))


def supplier_delays(ops: Operations, k: int | None = TOP) -> DataFrame:
    """Delay rate per supplier, worst first: (by..., supplier, delay_rate, rank)."""
    if ops.has("shipping_status"):
        known = cells(ops, t.SUPPLIER).where(F.col(t.SUPPLIER).isNotNull())
        rates = grouped(known, ops.by, t.SUPPLIER).agg(share_of(p.DELAYED).alias("delay_rate"))
    else:
        late = _long_deliveries(ops, t.SUPPLIER).where(F.col(t.SUPPLIER).isNotNull())
        rates = late.groupBy(*ops.by, t.SUPPLIER).agg(_late_share().alias("delay_rate"))
    best = top_rows(rates, ops.by, [F.desc("delay_rate"), F.col(t.SUPPLIER).asc()], k)
    return best.select(*ops.by, _label(ops, t.SUPPLIER).alias("supplier"),
                       rounded(F.col("delay_rate"), 4).alias("delay_rate"), "rank")


def top_by_revenue(ops: Operations, key: str, name: str, k: int = TOP, keep_null: bool = True) -> DataFrame:
    """Largest revenue sums per key: (by..., name, revenue, rank). Ties go to the smaller key."""
    found = cells(ops, key) if keep_null else cells(ops, key).where(F.col(key).isNotNull())
    sums = grouped(found, ops.by, key).agg(revenue_in(ops).alias("revenue"))
    best = top_rows(sums, ops.by, [F.desc("revenue"), F.col(key).asc_nulls_last()], k)
    return best.select(*ops.by, _label(ops, key).alias(name), "revenue", "rank")


def top_products(ops: Operations, k: int = TOP) -> DataFrame:
    return top_by_revenue(ops, t.PRODUCT, "product", k).withColumn("revenue", rounded(F.col("revenue"), 2))


def top_categories(ops: Operations, k: int = TOP) -> DataFrame:
    return top_by_revenue(ops, t.CATEGORY, "category", k).withColumn("revenue", rounded(F.col("revenue"), 2))


def inventory_risks(ops: Operations, k: int = TOP) -> DataFrame:
    """Products with the least stock: (by..., product, inventory_on_hand, rank); unknown stock last."""
    least = grouped(cells(ops, t.PRODUCT).where(F.col(t.PRODUCT).isNotNull()), ops.by, t.PRODUCT).agg(total(p.STOCK).alias("least"))
    low = top_rows(least, ops.by, [F.asc_nulls_last("least"), F.col(t.PRODUCT).asc()], k)
    return low.select(*ops.by, _label(ops, t.PRODUCT).alias("product"),
                      F.col("least").try_cast("bigint").alias("inventory_on_hand"), "rank")


def weekly_change(ops: Operations) -> DataFrame:
    """Revenue of the seven days up to the latest date against the seven before, one row per group.

    The bounds are exact instants: [latest - 6 days, latest] and [latest - 13 days, latest - 6 days). Rows are read once and
    summed per instant. A group's instants are dealt into slots, and each slot keeps those within 13 days of its own latest
    one, which no later one can bring back; so what meets in one place is two weeks of a group, not its history.
    """
    six, thirteen = F.expr("interval 144 hours"), F.expr("interval 312 hours")
    by = [F.col(f"`{b}`") for b in ops.by] or [F.lit(0)]
    instants = grouped(cells(ops, t.TS), ops.by, t.TS).agg(rows_in().alias("n"), revenue_in(ops).alias("amount"))
    slot = F.pmod(F.xxhash64(t.TS), F.lit(SLOTS))
    latest = lambda *keys: F.max(t.TS).over(Window.partitionBy(*by, *keys))
    within = lambda df: df.where(F.col(t.TS).isNull() | (F.col(t.TS) >= F.col("latest") - thirteen))
    recent = within(instants.withColumn("slot", slot).withColumn("latest", latest("slot")))
    dated = within(recent.withColumn("latest", latest()))
    since = lambda days: F.col(t.TS) >= F.col("latest") - days
    sums = grouped(dated, ops.by).agg(
        F.coalesce(F.sum(F.when(F.col(t.TS).isNotNull(), F.col("n"))), F.lit(0)).alias("n"),
        money_sum(F.when(since(six), F.col("amount"))).alias("cur"),
        money_sum(F.when(since(thirteen) & ~since(six), F.col("amount"))).alias("prev"))
    change = F.when(F.col("prev") != 0, (F.col("cur") - F.col("prev")) / F.col("prev") * 100)
    seen = lambda c: F.when(F.col("n") > 0, c)
    return sums.select(
        *ops.by,
        seen(rounded(change, 2)).alias("weekly_revenue_change_percent"),
        seen(rounded(F.col("cur"), 2)).alias("current_week_revenue"),
        seen(rounded(F.col("prev"), 2)).alias("previous_week_revenue"))


def risk_flags(change: Column, delay: Column, returns: Column, inventory: Column) -> Column:
    """Array of risk sentences from the rounded metrics; a default sentence when no rule fires."""
    percent = lambda rate: F.concat(double_text(rounded(rate * 100, 1)), F.lit("%."))
    stock = F.transform(
        F.slice(inventory, 1, LOW_STOCK_ITEMS),
        lambda i: F.when(i["inventory_on_hand"] <= LOW_STOCK, F.concat(
            i["product"], F.lit(" has low inventory ("), i["inventory_on_hand"].cast("string"),
            F.lit(" units on hand)."))))
    rules = F.array(
        F.when(change < DECLINE_PERCENT, F.concat(
            F.lit("Revenue declined "), double_text(F.abs(change)), F.lit("% versus the previous week."))),
        F.when(delay > HIGH_DELAY_RATE, F.concat(F.lit("Delay rate is elevated at "), percent(delay))),
        F.when(returns > HIGH_RETURN_RATE, F.concat(F.lit("Return rate is elevated at "), percent(returns))),
    )
    fired = F.array_compact(F.concat(rules, F.coalesce(stock, F.array().cast("array<string>"))))
    return F.when(F.size(fired) > 0, fired).otherwise(
        F.array(F.lit("No major risk flags from the current rules.")))


def kpi_parts(ops: Operations) -> list[DataFrame]:
    """The partial results behind ``kpis``; only those the concept map allows."""
    by = ops.by
    parts = [totals(ops)]
    late_by_duration = not ops.has("shipping_status") and ops.has("delivery_days")
    if late_by_duration:
        parts[0] = parts[0].drop("delay_rate")
        parts.append(delay_rate_by_duration(ops))
    if ops.has("date"):
        parts.append(weekly_change(ops))
    pair = lambda *names: F.struct(*names)
    if ops.has("product"):
        parts.append(ranked_list(top_products(ops), by, pair("product", "revenue"), "top_products"))
    if ops.has("category"):
        parts.append(ranked_list(top_categories(ops), by, pair("category", "revenue"), "top_categories"))
    if ops.has("inventory", "product"):
        parts.append(ranked_list(
            inventory_risks(ops), by, pair("product", "inventory_on_hand"), "inventory_risks"))
    if ops.has("supplier") and (ops.has("shipping_status") or late_by_duration):
        parts.append(ranked_list(supplier_delays(ops), by, pair("supplier", "delay_rate"), "supplier_delay_risks"))
    return parts


def kpis(ops: Operations) -> DataFrame:
    """The whole KPI pack, one row per group. Metrics whose concept is missing are NULL."""
    pack = one_row_per_group(kpi_parts(ops), ops.by)
    absent = {name: F.lit(None).cast(LIST_TYPES.get(name, "double"))
              for name in KPI_COLUMNS[:-1] if name not in pack.columns}
    pack = pack.withColumns(absent) if absent else pack
    risks = risk_flags(F.col("weekly_revenue_change_percent"), F.col("delay_rate"), F.col("return_rate"),
                       F.col("inventory_risks"))
    return pack.withColumn("risk_summary", risks).select(*ops.by, *KPI_COLUMNS)
