"""The tables behind the dashboard: charts and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opslens.functions.coerce import plain_text
from opslens.functions.numbers import count_text, fixed, money_text, percent_text
from opslens.operators import typed as t
from opslens.operators.kpis import supplier_delays, top_by_revenue
from opslens.operators.partials import cells, grouped, kind, revenue_in, rows_in
from opslens.operators.typed import Operations

CHART_BARS = 10


def product_chart(ops: Operations) -> DataFrame:
    """The ten products with the most revenue, smallest first; rows without a product are left out."""
    best = top_by_revenue(ops, t.PRODUCT, "product", CHART_BARS, keep_null=False)
    return best.orderBy(*ops.by, F.desc("rank")).select(*ops.by, "product", "revenue")


def weekly_trend(ops: Operations) -> DataFrame:
    """Revenue per week, labelled by the Sunday it ends on; empty weeks in between show 0."""
    sunday = F.date_add(F.date_trunc("week", F.col(t.TS)).cast("date"), 6)
    weeks = cells(ops, t.TS).groupBy(*ops.by, sunday.alias("week_end")).agg(revenue_in(ops).alias("revenue"))
    # Rows without a date form a week of their own, whose empty sequence drops it below.
    following = F.lead("week_end").over(Window.partitionBy(*ops.by).orderBy("week_end"))
    until = F.coalesce(F.date_sub(following, 7), F.col("week_end"))
    filled = weeks.withColumn("until", until).select(*ops.by, "revenue", F.posexplode(
        F.sequence(F.col("week_end"), F.col("until"), F.expr("interval 7 days"))).alias("gap", "week_end"))
    return filled.select(*ops.by, "week_end", F.when(F.col("gap") == 0, F.col("revenue")).otherwise(0.0)
                         .alias("revenue")).orderBy(*ops.by, "week_end")


def status_mix(ops: Operations) -> DataFrame:
    """Rows per fulfilment status, most frequent first; missing statuses are left out."""
    counts = grouped(cells(ops, t.STATUS).where(F.col(t.STATUS).isNotNull()), ops.by, t.STATUS).agg(rows_in().alias("count"))
    text = plain_text(F.col(t.STATUS), kind(ops, t.STATUS))
    return counts.orderBy(*ops.by, F.desc("count"), t.STATUS).select(*ops.by, text.alias("status"), "count")


def supplier_chart(ops: Operations) -> DataFrame:
    """Delay rate of the worst suppliers as a percentage, smallest first."""
    worst = supplier_delays(ops)
    return worst.orderBy(*ops.by, F.desc("rank")).select(
        *ops.by, "supplier", "delay_rate", (F.col("delay_rate") * 100).alias("delay_percent"))


def _cards(kpis: DataFrame, by, cards: list[tuple[str, Column]]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(name).alias("label"), value.alias("value")) for name, value in cards])
    return kpis.select(*by, F.explode(items).alias("card")).select(*by, "card.label", "card.value")


def summary_cards(kpis: DataFrame, excluded: int, safe: int, by=()) -> DataFrame:
    """Headline cards as (label, value): records, columns left out, columns kept, revenue, delays."""
    return _cards(kpis, by, [
        ("Records loaded", count_text(F.col("row_count"))),
        ("Sensitive columns excluded", F.lit(str(excluded))),
        ("Safe analytics columns", F.lit(str(safe))),
        ("Total revenue", money_text(F.col("total_revenue"))),
        ("Delay rate", percent_text(F.col("delay_rate"))),
    ])


def kpi_cards(kpis: DataFrame, by=()) -> DataFrame:
    """Dashboard cards as (label, value): records, revenue, returns, week over week."""
    change = F.coalesce(F.col("weekly_revenue_change_percent"), F.lit(0.0))
    return _cards(kpis, by, [
        ("Orders / Records", count_text(F.col("order_count"))),
        ("Revenue", money_text(F.col("total_revenue"))),
        ("Return rate", percent_text(F.col("return_rate"))),
        ("Week-over-week", F.concat(F.replace(fixed(change, 1), F.lit(","), F.lit("")), F.lit("%"))),
    ])
