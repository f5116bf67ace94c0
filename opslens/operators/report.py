"""The aggregate-only payload and the weekly report written from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opslens.functions.coerce import double_text
from opslens.functions.numbers import count_text, fixed, json_text, rounded
from opslens.operators.kpis import DECLINE_PERCENT, HIGH_DELAY_RATE, HIGH_RETURN_RATE, KPI_COLUMNS
from opslens.operators.groups import one_row_per_group

# Texts of the payload and the report.
PURPOSE = "Generate a privacy-safe weekly operations report for a small business."
TITLE = "# Privacy-Safe Weekly Operations Report"
SUMMARY = "Executive Summary"
METRICS = "Key Metrics"
RISKS = "Operational Risk Flags"
PRODUCTS = "Top Revenue Products"
INVENTORY = "Inventory Items to Review"
DELAYS = "Supplier or Fulfillment Delay Review"
ACTIONS = "Recommended Next Actions"
PRIVACY = "Privacy Note"
SECTIONS = (SUMMARY, METRICS, RISKS, PRODUCTS, INVENTORY, DELAYS, ACTIONS, PRIVACY)
REORDER = "Review low-inventory products and decide whether to reorder within the next 48 hours."
LATE = "Investigate delayed shipments by supplier, warehouse, or fulfillment workflow."
RETURNS = "Review return reasons and identify product or fulfillment issues driving returns."
DECLINE = ("Review declining products and channels to determine whether pricing, inventory, or marketing changes "
           "are needed.")
OWNER = "Use this report as a starting point for owner/operator review, not as an automated final decision."
EXCLUDED = "The following sensitive or identifying columns were excluded before AI report generation: "
NOTHING_EXCLUDED = "No sensitive columns were detected by the prototype scanner."
ONLY_AGGREGATES = ("The AI layer receives only aggregated metrics and data-quality findings, not raw customer-level "
                   "records.")
FOOTER_START = "Generated by prototype on "
FOOTER_END = " UTC. Uses synthetic or user-provided data in-memory only."

LISTED = 5
LISTED_SUPPLIERS = 3


def payload(kpis: DataFrame, checks: DataFrame, excluded: Sequence[str], standard: str | None = None,
            by: Sequence[str] = ()) -> DataFrame:
    """One struct column ``payload`` per group, from the KPI pack and the check lists."""
    pack = one_row_per_group([kpis, checks], by)
    controls = [
        F.array(*[F.lit(c) for c in excluded]).cast("array<string>").alias("excluded_sensitive_columns"),
        F.lit(False).alias("raw_rows_sent_to_ai"),
        F.lit(True).alias("only_aggregated_metrics_sent_to_ai"),
    ]
    if standard is not None:
        controls.append(F.lit(standard).alias("selected_privacy_standard"))
    return pack.select(*by, F.struct(
        F.lit(PURPOSE).alias("purpose"),
        F.struct(*KPI_COLUMNS).alias("metrics"),
        F.col("checks").alias("data_quality_findings"),
        F.struct(*controls).alias("privacy_controls"),
    ).alias("payload"))


def payload_json(payloads: DataFrame, by: Sequence[str] = (), pretty: bool = False) -> DataFrame:
    """The payload as JSON text, NULL fields kept, numbers written out."""
    text = json_text(F.col("payload"), payloads.schema["payload"].dataType, pretty)
    return payloads.select(*by, text.alias("payload"))


def recommended_actions(risks: Column, delay: Column, returns: Column, change: Column) -> Column:
    """Array of next steps; the owner review always closes it."""
    low_stock = F.exists(risks, lambda r: F.lower(r).contains("low inventory"))
    return F.array_compact(F.array(
        F.when(low_stock, REORDER),
        F.when(delay > HIGH_DELAY_RATE, LATE),
        F.when(returns > HIGH_RETURN_RATE, RETURNS),
        F.when(change < DECLINE_PERCENT, DECLINE),
        F.lit(OWNER),
    ))


def _dollars(x: Column) -> Column:
    return F.concat(F.lit("$"), fixed(x, 2))


def _percent(rate: Column) -> Column:
    return F.concat(double_text(rounded(rate * 100, 1)), F.lit("%"))


def _bullets(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.concat(F.lit("- "), x))


def _sections(p: Column) -> dict[str, tuple[Column, bool]]:
    """Lines of each section, and whether the section goes away when it has none."""
    m, excluded = p["metrics"], p["privacy_controls"]["excluded_sensitive_columns"]
    change, delay, returns = m["weekly_revenue_change_percent"], m["delay_rate"], m["return_rate"]
    moved = F.concat(
        F.lit(" Weekly revenue "), F.when(change >= 0, "increased").otherwise("decreased"), F.lit(" by "),
        double_text(F.abs(change)), F.lit("% compared with the previous week."))
    summary = F.concat(
        F.lit("The business processed "), count_text(m["order_count"]), F.lit(" records with total revenue of "),
        _dollars(m["total_revenue"]), F.lit("."), F.coalesce(moved, F.lit("")))
    metrics = F.array_compact(F.array(
        F.concat(F.lit("Total revenue: "), _dollars(m["total_revenue"])),
        F.concat(F.lit("Average order value: "), _dollars(m["avg_order_value"])),
        F.concat(F.lit("Shipping or fulfillment delay rate: "), _percent(delay)),
        F.concat(F.lit("Return rate: "), _percent(returns)),
    ))
    empty = F.array().cast("array<string>")
    listing = lambda items, n, text: F.coalesce(F.transform(F.slice(items, 1, n), text), empty)
    products = listing(m["top_products"], LISTED, lambda i: F.concat(
        i["product"], F.lit(": "), _dollars(i["revenue"])))
    stock = listing(m["inventory_risks"], LISTED, lambda i: F.concat(
        i["product"], F.lit(": "), F.coalesce(i["inventory_on_hand"].cast("string"), F.lit("None")),
        F.lit(" units on hand")))
    suppliers = listing(m["supplier_delay_risks"], LISTED_SUPPLIERS, lambda i: F.concat(
        i["supplier"], F.lit(": "), _percent(i["delay_rate"]), F.lit(" delay rate")))
    note = F.when(F.size(excluded) > 0, F.concat(F.lit(EXCLUDED), F.array_join(excluded, ", "), F.lit("."))).otherwise(
        NOTHING_EXCLUDED)
    return {
        SUMMARY: (F.array(summary), False),
        METRICS: (_bullets(metrics), False),
        RISKS: (_bullets(m["risk_summary"]), False),
        PRODUCTS: (_bullets(products), True),
        INVENTORY: (_bullets(stock), True),
        DELAYS: (_bullets(suppliers), True),
        ACTIONS: (_bullets(recommended_actions(m["risk_summary"], delay, returns, change)), False),
        PRIVACY: (F.array(note, F.lit(ONLY_AGGREGATES)), False),
    }


def _line_array(payload_column: Column, sections: Sequence[str], footer: bool, made_at: Column | None = None) -> Column:
    line = lambda section, text: F.struct(F.lit(section).alias("section"), text.alias("line"))
    each = lambda section, texts: F.transform(texts, lambda text: line(section, text))
    blank = lambda section: F.array(line(section, F.lit("")))
    nothing = F.array().cast("array<struct<section:string,line:string>>")
    blocks = [F.array(line("Title", F.lit(TITLE)), line("Title", F.lit("")))]
    chosen = [(name, *block) for name, block in _sections(payload_column).items() if name in sections]
    for i, (name, lines, optional) in enumerate(chosen):
        end = [] if i == len(chosen) - 1 else [blank(name)]
        block = F.concat(F.array(line(name, F.lit(f"## {name}"))), each(name, lines), *end)
        blocks.append(F.when(F.size(lines) > 0, block).otherwise(nothing) if optional else block)
    if footer:
        made = F.concat(F.lit(FOOTER_START), F.date_format(
            F.to_utc_timestamp(F.current_timestamp() if made_at is None else made_at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            F.lit(FOOTER_END))
        blocks.append(F.array(line("Footer", F.lit("")), line("Footer", F.lit("---")), line("Footer", made)))
    return F.concat(*blocks)


def report_lines(payloads: DataFrame, by: Sequence[str] = (), sections: Sequence[str] = SECTIONS,
                 footer: bool = False, made_at: Column | None = None) -> DataFrame:
    """The report as rows (by..., section, seq, line). ``made_at`` is the time its footer tells, now if not given."""
    lines = payloads.select(*by, F.posexplode(_line_array(F.col("payload"), sections, footer, made_at)).alias("seq", "l"))
    return lines.select(*by, "l.section", "seq", "l.line")


def report_text(payloads: DataFrame, by: Sequence[str] = (), sections: Sequence[str] = SECTIONS,
                footer: bool = False, made_at: Column | None = None) -> DataFrame:
    """The report as one Markdown text per group."""
    lines = _line_array(F.col("payload"), sections, footer, made_at)
    return payloads.select(*by, F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("report"))
