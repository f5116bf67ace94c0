"""Checks, KPIs, star schema, dashboard, payload and report on small tables."""

import json
import random
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opslens.operators import dashboard, kpis as k, partials, quality, report, star
from opslens.operators.columns import infer_columns
from opslens.operators.typed import typed

COLUMNS = ["order_date", "product", "category", "supplier", "units", "revenue", "stock", "delivery_days", "status",
           "returned", "transaction_id", "tenant"]


def frame(seed=0, n=400):
    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    rows = []
    for i in range(n):
        rows.append((
            pick("bad", None, *[f"2026-01-{d:02d}" for d in range(1, 29)]), pick(None, " ", "axe", "bolt", "cog", "dial"),
            pick("x", "y", None), pick("s1", "s2", "s3", None), pick("1", "-2", "?", "7"),
            pick("10.25", "7.5", "-3", "n/a", None, "1e2"), pick("3", "25", None), pick("1", "2.5", "9", None),
            pick("Late", "ok", "Delayed", None), pick("YES", "no", "1", None), pick("t1", f"u{i}", None),
            pick("hot", "hot", "hot", "cold", None)))
    return pd.DataFrame(rows, columns=COLUMNS)


def table(spark, data):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in data.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in data.columns))


def operations(spark, data, by=(), drop=()):
    kept = [c for c in data.columns if c not in drop and c != "tenant"]
    return typed(table(spark, data), infer_columns(kept), by)


def brute(data, status=True):
    """The KPI pack in pandas."""
    rev = pd.to_numeric(data["revenue"], errors="coerce").fillna(0)
    date = pd.to_datetime(data["order_date"], format="%Y-%m-%d", errors="coerce")
    if status:
        late = data["status"].fillna("").str.lower().str.contains("delay|late|exception")
    else:
        days = pd.to_numeric(data["delivery_days"], errors="coerce").fillna(0)
        late = days > days.quantile(0.75)
    key = data["product"].where(data["product"].notna(), None)

    def top(column):
        sums = rev.groupby(data[column], dropna=False).sum()
        best = sorted(sums.items(), key=lambda i: (-i[1], pd.isna(i[0]), str(i[0])))[:5]
        return [("nan" if pd.isna(a) else a, round(b, 2)) for a, b in best]

    stock = pd.to_numeric(data["stock"], errors="coerce").groupby(key).min()
    suppliers = late.groupby(data["supplier"]).mean()
    latest = date.max()
    now = date >= latest - pd.Timedelta(days=6)
    before = (date >= latest - pd.Timedelta(days=13)) & ~now
    cur, prev = rev[now].sum(), rev[before].sum()
    return {
        "date_range": (str(date.min().date()), str(date.max().date())),
        "total_revenue": round(rev.sum(), 2), "avg_order_value": round(rev.mean(), 2), "row_count": len(data),
        "order_count": len(data),
        "return_rate": round(data["returned"].fillna("").str.lower().isin(["1", "true", "yes", "y"]).mean(), 4),
        "delay_rate": round(late.mean(), 4), "top_products": top("product"), "top_categories": top("category"),
        "inventory_risks": [(a, int(b)) for a, b in sorted(stock.items(), key=lambda i: (i[1], i[0]))[:5]],
        "supplier_delay_risks": [(a, round(b, 4)) for a, b in sorted(suppliers.items(), key=lambda i: (-i[1], i[0]))[:5]],
        "weekly_revenue_change_percent": round((cur - prev) / prev * 100, 2) if prev else None,
        "current_week_revenue": round(cur, 2), "previous_week_revenue": round(prev, 2),
    }


def found(row):
    return {c: [tuple(i) for i in row[c]] if isinstance(row[c], list) else tuple(row[c]) if c == "date_range" else row[c]
            for c in k.KPI_COLUMNS[:-1]}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("status", [True, False])
def test_kpis(spark, seed, status):
    data = frame(seed)
    ops = operations(spark, data, drop=() if status else ("status",))
    assert found(k.kpis(ops).first()) == brute(data, status)


@pytest.mark.parametrize("status", [True, False])
def test_kpis_per_tenant_with_one_tenant_holding_most_rows(spark, status):
    data = frame(3, 900)
    rows = k.kpis(operations(spark, data, ("tenant",), () if status else ("status",))).collect()
    assert {r.tenant for r in rows} == {"hot", "cold", None}
    for r in rows:
        part = data[data["tenant"].isna() if r.tenant is None else data["tenant"] == r.tenant]
        assert found(r) == brute(part, status)


def test_missing_concepts_give_null(spark):
    row = k.kpis(typed(spark.createDataFrame([(1,), (2,)], "thing int"), infer_columns(["thing"]))).first()
    assert (row.row_count, row.total_revenue, row.avg_order_value) == (2, 0.0, 0.0)
    assert row.return_rate is row.delay_rate is row.top_products is row.weekly_revenue_change_percent is None
    assert row.risk_summary == ["No major risk flags from the current rules."]


def test_empty_table(spark):
    row = k.kpis(operations(spark, frame().head(0))).first()
    assert row.row_count == 0 and row.total_revenue == 0.0 and row.avg_order_value is None
    assert row.return_rate is None and not row.top_products and row.current_week_revenue is None
    json.loads(report.payload_json(report.payload(
        k.kpis(operations(spark, frame().head(0))), quality.check_list(operations(spark, frame().head(0))), [])).first()[0])


def test_week_bounds_are_exact_instants(spark):
    rows = [("2026-01-14 12:00:00", "1"), ("2026-01-08 12:00:00", "10"), ("2026-01-08 11:59:59", "100"),
            ("2026-01-01 12:00:00", "1000"), ("2026-01-01 11:59:59", "5"), ("x", "7")]
    df = spark.createDataFrame(rows, "date string, revenue string")
    for by in ((), ("g",)):
        ops = typed(df.withColumn("g", F.lit("a")), infer_columns(df.columns), by)
        row = k.weekly_change(ops).first()
        assert (row.current_week_revenue, row.previous_week_revenue) == (11.0, 1100.0)
        assert row.weekly_revenue_change_percent == -99.0


def test_week_without_earlier_revenue_or_dates(spark):
    df = spark.createDataFrame([("2026-01-14", "4")], "date string, revenue string")
    row = k.weekly_change(typed(df, infer_columns(df.columns))).first()
    assert row.current_week_revenue == 4.0 and row.weekly_revenue_change_percent is None
    row = k.weekly_change(typed(df.withColumn("date", F.lit("x")), infer_columns(df.columns))).first()
    assert tuple(row) == (None, None, None)


@pytest.mark.parametrize("status", [True, False])
@pytest.mark.parametrize("by", [(), ("tenant",)])
def test_sums_of_batches_give_what_their_rows_give(spark, tmp_path, status, by):
    data = frame(5, 700)
    drop = () if status else ("status",)
    whole = operations(spark, data, by, drop)
    for i in range(3):
        batch = operations(spark, data.iloc[i::3], by, drop)
        partials.partials(batch).write.mode("append").parquet(str(tmp_path / "sums"))
        partials.id_counts(batch).write.mode("append").parquet(str(tmp_path / "ids"))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    summed = partials.with_sums(replace(whole, rows=whole.rows.where("raise_error('rows are not read') is null")), read("sums"), read("ids"))
    same = lambda f: sorted(map(repr, f(summed).collect())) == sorted(map(repr, f(whole).collect()))
    assert same(k.kpis) and same(quality.validate) and same(dashboard.weekly_trend) and same(dashboard.product_chart)
    assert same(dashboard.supplier_chart) and (not status or same(dashboard.status_mix))


def test_instants_of_a_long_history_in_one_group(spark):
    day = 86_400
    df = spark.range(400_000).select(F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 97).alias("date"), F.lit("1").alias("revenue"))
    row = k.weekly_change(typed(df, infer_columns(df.columns))).first()
    latest = 399_999 * 97
    cur = sum(1 for i in range(380_000, 400_000) if i * 97 >= latest - 6 * day)
    prev = sum(1 for i in range(380_000, 400_000) if latest - 13 * day <= i * 97 < latest - 6 * day)
    assert (row.current_week_revenue, row.previous_week_revenue) == (cur, prev)


def flags(spark, change=None, delay=None, returns=None, stock=()):
    row = spark.createDataFrame([(change, delay, returns, [(f"p{i}", s) for i, s in enumerate(stock)])],
                                "c double, d double, r double, i array<struct<product:string,inventory_on_hand:bigint>>")
    return row.select(k.risk_flags(F.col("c"), F.col("d"), F.col("r"), F.col("i"))).first()[0]


def test_risk_flags(spark):
    none = ["No major risk flags from the current rules."]
    assert flags(spark) == flags(spark, -5.0, 0.12, 0.08, [21, None]) == none
    assert flags(spark, -5.01, 0.1201, 0.0801, [20, 3, 21, 1]) == [
        "Revenue declined 5.01% versus the previous week.", "Delay rate is elevated at 12.0%.",
        "Return rate is elevated at 8.0%.", "p0 has low inventory (20 units on hand).",
        "p1 has low inventory (3 units on hand)."]


def test_quality_checks(spark):
    data = frame(4)
    rows = {r.check: r for r in quality.validate(operations(spark, data)).collect()}
    assert list(rows) == list(quality.CHECKS)
    rev, units = pd.to_numeric(data["revenue"], errors="coerce"), pd.to_numeric(data["units"], errors="coerce")
    expected = [
        data["order_date"].isin(["bad"]).sum() + data["order_date"].isna().sum(),
        data["transaction_id"].duplicated(keep=False).sum(), rev.isna().sum(), (rev < 0).sum(),
        (units.isna() | (units < 0)).sum(), (data["product"].isna() | (data["product"] == " ")).sum()]
    assert [rows[c].rows_impacted for c in quality.CHECKS] == expected
    assert [rows[c].severity for c in quality.CHECKS] == ["High", "Medium", "Medium", "Medium", "Medium", "Low"]


def test_quality_passes_and_selection(spark):
    df = spark.createDataFrame([("x", "1"), (None, "2"), ("x", "3"), (None, "4"), ("y", "5")], "invoice_id string, amount string")
    ops = typed(df, infer_columns(df.columns))
    assert [(r.check, r.severity, r.rows_impacted) for r in quality.validate(ops).collect()] == [
        ("Duplicate transaction/order IDs", "Medium", 4), ("Missing revenue values", "Pass", 0),
        ("Negative revenue values", "Pass", 0)]
    assert quality.validate(ops, keep=["Missing revenue values"]).count() == 1
    assert quality.validate(ops, keep=[]).count() == 0


def test_schema_check_only_without_concepts(spark):
    df = spark.createDataFrame([(1,)], "thing int")
    assert quality.validate(typed(df, infer_columns(df.columns))).collect() == [
        ("Basic schema check", "Pass", 0, "Loaded 1 rows. No common order/operations fields were inferred.")]


def test_star_schema(spark):
    df = spark.createDataFrame(
        [("2021-01-01", "b", None, "5"), ("2026-12-31", "a", "c", "6"), ("zzz", "b", "c", "x"), ("2027-01-03", None, None, None)],
        "date string, product_category string, channel string, revenue string")
    tables = star.star_schema(df, infer_columns(df.columns))
    assert set(tables) == {"dim_date", "dim_product", "dim_category", "dim_channel", "fact_operations"}
    assert {tuple(map(str, r)) for r in tables["dim_date"].collect()} == {
        ("2021-01-01", "2021-01", "53"), ("2026-12-31", "2026-12", "53"), ("2027-01-03", "2027-01", "53")}
    assert {r[0] for r in tables["dim_category"].collect()} == {"a", "b"}
    assert tables["fact_operations"].columns == ["date", "product_category", "channel", "revenue"]
    assert tables["fact_operations"].count() == 4
    plain = spark.createDataFrame([(1, 2)], "u int, v int")
    assert star.star_schema(plain, infer_columns(plain.columns))["fact_operations"].columns == ["u", "v"]


def test_weekly_trend_fills_empty_weeks(spark):
    rows = [("2026-01-04", "1"), ("2026-01-05", "2"), ("2026-01-26", "4"), ("bad", "8")]
    df = spark.createDataFrame(rows, "date string, revenue string")
    trend = dashboard.weekly_trend(typed(df, infer_columns(df.columns))).collect()
    assert [(str(r.week_end), r.revenue) for r in trend] == [
        ("2026-01-04", 1.0), ("2026-01-11", 2.0), ("2026-01-18", 0.0), ("2026-01-25", 0.0), ("2026-02-01", 4.0)]


def test_trend_and_mix_add_up(spark):
    data = frame(6)
    ops = operations(spark, data)
    dated = pd.to_datetime(data["order_date"], format="%Y-%m-%d", errors="coerce").notna()
    rev = pd.to_numeric(data["revenue"], errors="coerce").fillna(0)
    assert sum(r.revenue for r in dashboard.weekly_trend(ops).collect()) == pytest.approx(rev[dated].sum())
    mix = dashboard.status_mix(ops).collect()
    assert {r.status: r["count"] for r in mix} == data["status"].value_counts().to_dict()
    assert [r["count"] for r in mix] == sorted([r["count"] for r in mix], reverse=True)


def test_charts(spark):
    data = frame(7)
    ops = operations(spark, data)
    chart = dashboard.product_chart(ops).collect()
    assert [r.revenue for r in chart] == sorted(r.revenue for r in chart)
    assert "nan" not in [r["product"] for r in chart]
    for r in dashboard.supplier_chart(ops).collect():
        assert r.delay_percent == r.delay_rate * 100


def test_cards(spark):
    pack = spark.createDataFrame([(12345, 12345, 1234.5, 0.25, None, None)],
                                 "row_count bigint, order_count bigint, total_revenue double, return_rate double, "
                                 "delay_rate double, weekly_revenue_change_percent double")
    assert [tuple(r) for r in dashboard.summary_cards(pack, 3, 12).collect()] == [
        ("Records loaded", "12,345"), ("Sensitive columns excluded", "3"), ("Safe analytics columns", "12"),
        ("Total revenue", "$1,234"), ("Delay rate", "—")]
    assert [tuple(r) for r in dashboard.kpi_cards(pack).collect()] == [
        ("Orders / Records", "12,345"), ("Revenue", "$1,234"), ("Return rate", "25.0%"), ("Week-over-week", "0.0%")]


def payloads(spark, data, excluded=("email",), by=(), drop=()):
    ops = operations(spark, data, by, drop)
    return report.payload(k.kpis(ops), quality.check_list(ops), list(excluded), "PCI-aware", by)


def test_payload_json(spark):
    data = frame(8)
    sent = json.loads(report.payload_json(payloads(spark, data)).first()[0])
    assert list(sent) == ["purpose", "metrics", "data_quality_findings", "privacy_controls"]
    assert tuple(sent["metrics"]) == k.KPI_COLUMNS
    assert sent["metrics"]["total_revenue"] == brute(data)["total_revenue"]
    assert sent["privacy_controls"] == {
        "excluded_sensitive_columns": ["email"], "raw_rows_sent_to_ai": False,
        "only_aggregated_metrics_sent_to_ai": True, "selected_privacy_standard": "PCI-aware"}
    assert sent["data_quality_findings"][0]["check"] == "Invalid or missing dates"
    empty = json.loads(report.payload_json(payloads(spark, data, drop=("returned",)), pretty=True).first()[0])
    assert empty["metrics"]["return_rate"] is None


def test_payload_holds_no_sensitive_value(spark):
    data = frame(9).assign(email=[f"secret{i}@example.com" for i in range(400)])
    assert "secret" not in report.payload_json(payloads(spark, data, drop=("email",))).first()[0]


def test_report(spark):
    df = spark.createDataFrame(
        [("2026-01-14", "95", "late", "yes", "axe", "4", "s1"), ("2026-01-06", "100", "ok", "no", "bolt", "30", "s2"),
         ("2026-01-01", "1000000.5", "ok", "no", None, None, None)],
        "date string, revenue string, status string, returned string, product string, stock string, vendor string")
    ops = typed(df, infer_columns(df.columns))
    sent = report.payload(k.kpis(ops), quality.check_list(ops), [])
    text = report.report_text(sent).first().report
    assert text.split("\n") == [
        "# Privacy-Safe Weekly Operations Report", "", "## Executive Summary",
        "The business processed 3 records with total revenue of $1,000,195.50. Weekly revenue decreased by 99.99% "
        "compared with the previous week.", "",
        "## Key Metrics", "- Total revenue: $1,000,195.50", "- Average order value: $333,398.50",
        "- Shipping or fulfillment delay rate: 33.3%", "- Return rate: 33.3%", "",
        "## Operational Risk Flags", "- Revenue declined 99.99% versus the previous week.",
        "- Delay rate is elevated at 33.3%.", "- Return rate is elevated at 33.3%.",
        "- axe has low inventory (4 units on hand).", "",
        "## Top Revenue Products", "- nan: $1,000,000.50", "- bolt: $100.00", "- axe: $95.00", "",
        "## Inventory Items to Review", "- axe: 4 units on hand", "- bolt: 30 units on hand", "",
        "## Supplier or Fulfillment Delay Review", "- s1: 100.0% delay rate", "- s2: 0.0% delay rate", "",
        "## Recommended Next Actions",
        "- Review low-inventory products and decide whether to reorder within the next 48 hours.",
        "- Investigate delayed shipments by supplier, warehouse, or fulfillment workflow.",
        "- Review return reasons and identify product or fulfillment issues driving returns.",
        "- Review declining products and channels to determine whether pricing, inventory, or marketing changes are needed.",
        "- Use this report as a starting point for owner/operator review, not as an automated final decision.", "",
        "## Privacy Note", "No sensitive columns were detected by the prototype scanner.",
        "The AI layer receives only aggregated metrics and data-quality findings, not raw customer-level records."]
    lines = report.report_lines(sent).orderBy("seq").collect()
    assert "\n".join(r.line for r in lines) == text and [r.seq for r in lines] == list(range(len(lines)))


def test_report_sections_vanish_and_footer(spark):
    df = spark.createDataFrame([("1",)], "revenue string")
    ops = typed(df, infer_columns(df.columns))
    sent = report.payload(k.kpis(ops), quality.check_list(ops), ["a", "b"])
    text = report.report_text(sent, footer=True).first().report
    assert "Inventory Items" not in text and "Supplier" not in text and "Top Revenue" not in text
    assert "excluded before AI report generation: a, b." in text
    assert "\n\n---\nGenerated by prototype on 2" in text and text.endswith("in-memory only.")
    short = report.report_text(sent, sections=[report.METRICS]).first().report
    assert short.startswith("# Privacy-Safe") and "## Key Metrics" in short and "Executive" not in short
