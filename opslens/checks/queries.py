"""One query per operator, over the benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.checks.fixture import PEOPLE, SAFE_COLUMNS, STRICT_COLUMNS, ops, staged_ops
from opslens.functions.coerce import is_blank, is_delayed, is_truthy, to_number
from opslens.functions.dates import elect_dates, to_ts
from opslens.functions.numbers import rounded
from opslens.operators import dashboard, kpis as k, partials, privacy, quality, report, star, text_scan
from opslens.operators.columns import concept_table, infer_columns, normalize_columns
from opslens.operators.masking import masked
from opslens.operators.typed import Operations, typed
from opslens.plans import run_log
from opslens.plans.pipeline import STEP_LOG, STEPS, ReportingJob, Run, run_pipeline
from opslens.sources.runs import RUNS, commit_numbers, listed, remove, run_folder
from opslens.sources.sinks import read_report, write_report
from opslens.sources.staging import saved, shared_folder, shuffles_removed
from opslens.sources.tables import preview, read_csv
from opslens.streaming.refresh import refresh_stream

Query = Callable[[SparkSession, str], DataFrame]

REGION = ("region",)
MASK_KEY = "a key for tests"
EXCLUDED = ("order_id", "customer_name", "contact")
MODES = {
    "baseline": privacy.BASELINE, "hipaa": privacy.HIPAA, "gdpr": privacy.GDPR, "pci": privacy.PCI,
    "strict": privacy.STRICT,
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _operations(spark, sf_dir, *needed: str, columns: Sequence[str] = SAFE_COLUMNS, by: Sequence[str] = ()) -> Operations:
    """Typed rows of the fixture as it looks after the privacy split, with the columns a query needs."""
    return typed(ops(spark, sf_dir, (*(needed or columns), *by)), infer_columns(columns), by)


def _staged(spark, sf_dir, by: Sequence[str] = ()) -> Operations:
    """The same, summed in one pass by every key that metrics use; order ids are counted from the source when asked for."""
    found = _operations(spark, sf_dir, by=by)
    return partials.with_sums(found, saved(partials.partials(found), _folder(spark, "sums")))


def _kpi_columns(needed: str, *columns: str) -> Query:
    return lambda spark, sf_dir: k.totals(_operations(spark, sf_dir, needed)).select(*columns)


def _kpi_date_range(spark, sf_dir):
    return k.totals(_operations(spark, sf_dir, "order_date")).select(
        F.col("date_range.start").alias("start_date"), F.col("date_range.end").alias("end_date"))


def _strict(spark, sf_dir, *needed, by=()):
    return _operations(spark, sf_dir, *needed, columns=STRICT_COLUMNS, by=by)


def _privacy_findings(standard: str) -> Query:
    def run(spark, sf_dir):
        found = privacy.find_sensitive(ops(spark, sf_dir), standard)
        return privacy.findings_table(spark, found).withColumnRenamed("why flagged", "why_flagged")
    return run


def _privacy_sample(spark, sf_dir):
    found = privacy.find_sensitive(
        ops(spark, sf_dir), mode="sample", order_by=["transaction_id", "contact", "revenue"])
    return privacy.findings_table(spark, found).withColumnRenamed("why flagged", "why_flagged")


def _privacy_tables(spark, sf_dir):
    """Strict findings of several tables, one row per flagged column."""
    def findings(name):
        df = _table(spark, sf_dir, name)
        return privacy.scan(df, privacy.STRICT).select(
            F.lit(name).alias("table_name"), "column", F.array_join("reasons", "; ").alias("why_flagged"))
    return reduce(DataFrame.union, [findings(n) for n in ("customer", "orders", "events", "documents", "pages")])


def _privacy_modes(spark, sf_dir):
    table = ops(spark, sf_dir)
    hits = privacy.value_rules_hit(table, table.columns)
    identifiers = privacy.identifier_columns(table, table.columns)
    excluded = lambda mode: list(privacy.combine(
        table.columns, privacy.header_reasons(table.columns, mode), hits, identifiers))
    rows = [(mode, privacy.mode_description(mode), excluded(mode)) for mode in privacy.MODE_DESCRIPTIONS]
    return spark.createDataFrame(rows, "mode string, description string, excluded array<string>").select(
        "mode", "description", F.array_join("excluded", ", ").alias("excluded"))


def _safe_columns(spark, sf_dir):
    table = ops(spark, sf_dir)
    safe, _ = privacy.split(table, privacy.find_sensitive(table, all_reasons=False))
    return safe


def _sensitive_columns(spark, sf_dir):
    table = ops(spark, sf_dir)
    _, sensitive = privacy.split(table, privacy.find_sensitive(table, privacy.STRICT, all_reasons=False))
    return sensitive


def _concept_map(spark, sf_dir):
    found = concept_table(spark, infer_columns(_safe_columns(spark, sf_dir).columns))
    return found.toDF("concept", "detected_column")


def _normalized_preview(spark, sf_dir):
    shown = {"p_partkey": " Part Key ", "p_name": "Product  Name", "p_brand": "Brand-Code", "p_type": "TYPE"}
    return preview(normalize_columns(_table(spark, sf_dir, "part").select(
        *[F.col(c).alias(header) for c, header in shown.items()])), ["part_key"])


def _csv_roundtrip(spark, sf_dir):
    path = _folder(spark, "csv")
    written = ops(spark, sf_dir).write.options(
        header=True, escape="\"", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    written.csv(path)
    return read_csv(spark, path)


def _csv_multiline(spark, sf_dir):
    """Texts with line breaks and quotes, one file to each of four tasks, read back in splits."""
    path = _folder(spark, "csv-lines")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    docs.coalesce(4).write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_csv(spark, path, multi_line=True).withColumn("doc_id", F.col("doc_id").cast("long"))


def _numeric_coercion(spark, sf_dir):
    return ops(spark, sf_dir, ("transaction_id", "units_sold", "revenue")).select(
        "transaction_id", to_number(F.col("units_sold")).alias("units"), to_number(F.col("revenue")).alias("revenue"))


def _date_coercion(spark, sf_dir):
    """Order dates written in many layouts, read back; one key in thirteen has a clock time alone."""
    dates = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    layouts = ["yyyy-MM-dd", "M/d/yyyy", "yyyyMMdd", "MMM d, yyyy", "M/d/yy", "yyyy.MM.dd", "d MMMM yyyy", "dd-MMM-yy",
               "EEE, dd MMM yyyy", "yyyy/MM/dd'T'HH:mm:ss", "M/d/yyyy h:mm a", "M/d/yyyy HH:mm:ss.SSS"]
    written = F.lit("10:00")
    for i, layout in enumerate(layouts):
        written = F.when(F.col("o_orderkey") % 13 == i, F.date_format("d", layout)).otherwise(written)
    return dates.select("o_orderkey", written.alias("raw")).select(
        "o_orderkey", to_ts(F.col("raw")).cast("date").alias("parsed"),
        to_ts(F.col("raw"), reading="M/d/yyyy").cast("date").alias("parsed_strict"))


def _day_first(spark, sf_dir):
    """Order dates as a European and as an American file would write them, some with a clock time, some unreadable."""
    dates = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    written = lambda layout: F.when(F.col("o_orderkey") % 19 == 0, "unknown").otherwise(F.date_format("d", layout))
    return dates.select("o_orderkey", written("d/M/yyyy").alias("slashes"), written("dd.MM.yyyy HH:mm").alias("dots"),
                        written("M/d/yyyy").alias("american"), F.when(F.col("o_orderkey") % 2 == 0, written("d.M.yy")).otherwise(
                            written("d MMM yyyy")).alias("mixed"))


DATE_COLUMNS = ("slashes", "dots", "american", "mixed")


def _date_coercion_day_first(spark, sf_dir):
    """The same dates read back from each of these columns."""
    table = _day_first(spark, sf_dir)
    dates = elect_dates(table, DATE_COLUMNS)
    return table.select("o_orderkey", *[to_ts(F.col(c), reading=dates[c]).cast("date").alias(c) for c in DATE_COLUMNS])


def _date_readings(spark, sf_dir):
    """What the election finds for each of these columns."""
    found = elect_dates(_day_first(spark, sf_dir), DATE_COLUMNS)
    return spark.createDataFrame([(c, r.layout, r.day_first, r.plain) for c, r in found.items()],
                                 "column_name string, layout string, day_first boolean, plain boolean")


def _blank_and_flag(spark, sf_dir):
    columns = ("product", "return_flag", "shipping_status")
    return ops(spark, sf_dir, columns).select(
        is_blank(F.col("product")).alias("blank_product"), is_truthy(F.col("return_flag")).alias("returned"),
        is_delayed(F.col("shipping_status")).alias("is_late"),
    ).groupBy("blank_product", "returned", "is_late").agg(F.count(F.lit(1)).alias("n"))


def _dim_date(spark, sf_dir):
    return star.dim_date(ops(spark, sf_dir, ("order_date",)), "order_date")


def _dim(column: str) -> Query:
    return lambda spark, sf_dir: star.dim_values(ops(spark, sf_dir, (column,)), column)


def _fact_operations(spark, sf_dir):
    return star.star_schema(ops(spark, sf_dir, SAFE_COLUMNS), infer_columns(SAFE_COLUMNS))[star.FACT]


def _star_by_region(name: str) -> Query:
    columns = (*SAFE_COLUMNS, "region")
    return lambda spark, sf_dir: star.star_schema(ops(spark, sf_dir, columns), infer_columns(SAFE_COLUMNS), REGION)[name]


def _quality_schema_only(spark, sf_dir):
    table = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return quality.validate(typed(table, infer_columns(table.columns))).withColumnRenamed("check", "check_name")


def _quality(by=()) -> Query:
    return lambda spark, sf_dir: quality.validate(_operations(spark, sf_dir, *CHECKED, by=by)).withColumnRenamed(
        "check", "check_name")


def _risk_flags(spark, sf_dir):
    return k.kpis(_staged(spark, sf_dir)).select(F.posexplode("risk_summary").alias("seq", "risk"))


def _recommended_actions(spark, sf_dir):
    pack = k.kpis(_staged(spark, sf_dir))
    actions = report.recommended_actions(
        F.col("risk_summary"), F.col("delay_rate"), F.col("return_rate"), F.col("weekly_revenue_change_percent"))
    return pack.select(F.posexplode(actions).alias("seq", "action"))


def _kpi_cards(spark, sf_dir):
    return dashboard.kpi_cards(k.kpis(_staged(spark, sf_dir)))


def _summary_cards(spark, sf_dir):
    table = ops(spark, sf_dir)
    flagged = privacy.find_sensitive(table, all_reasons=False)
    pack = k.totals(_operations(spark, sf_dir, "revenue", "shipping_status"))
    return dashboard.summary_cards(pack, len(flagged), len(table.columns) - len(flagged))


def _payloads(spark, sf_dir, by=()):
    found = _staged(spark, sf_dir, by)
    return report.payload(k.kpis(found), quality.check_list(found), EXCLUDED, privacy.BASELINE, by)


def _payload_json(spark, sf_dir):
    return report.payload_json(_payloads(spark, sf_dir))


def _payload_values(spark, sf_dir):
    """The JSON payload read back: what a receiver finds in it."""
    schema = ("metrics struct<total_revenue:double,row_count:bigint,delay_rate:double,current_week_revenue:double,"
              "top_products:array<struct<product:string,revenue:double>>,risk_summary:array<string>>,"
              "data_quality_findings array<struct<check:string,severity:string,rows_impacted:bigint>>,"
              "privacy_controls struct<excluded_sensitive_columns:array<string>,raw_rows_sent_to_ai:boolean,"
              "selected_privacy_standard:string>")
    read = _payload_json(spark, sf_dir).select(F.from_json("payload", schema).alias("p"))
    return read.select(
        "p.metrics.total_revenue", "p.metrics.row_count", "p.metrics.delay_rate", "p.metrics.current_week_revenue",
        F.col("p.metrics.top_products")[0]["product"].alias("best_product"),
        F.col("p.metrics.top_products")[0]["revenue"].alias("best_revenue"),
        F.size("p.metrics.risk_summary").cast("bigint").alias("risks"),
        F.col("p.data_quality_findings")[1]["rows_impacted"].alias("duplicate_rows"),
        F.array_join("p.privacy_controls.excluded_sensitive_columns", ",").alias("excluded"),
        "p.privacy_controls.raw_rows_sent_to_ai", "p.privacy_controls.selected_privacy_standard")


def _weekly_report(spark, sf_dir):
    return report.report_lines(_payloads(spark, sf_dir))


def _weekly_report_by_region(spark, sf_dir):
    """The reports of all regions, each looked up by its key in the store they were written to."""
    path = _folder(spark, "reports")
    write_report(report.report_text(_payloads(spark, sf_dir, REGION), REGION), path, REGION)
    keys = [r["region"] for r in spark.read.parquet(path).select("region").distinct().collect()]
    return reduce(DataFrame.union, [read_report(spark, path, region=key) for key in keys])


def _report_footer(spark, sf_dir):
    """The report's last lines, made at the time of the last event."""
    made_at = _table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp")).scalar()
    lines = report.report_lines(_payloads(spark, sf_dir).withColumn("made_at", made_at), footer=True, made_at=F.col("made_at"))
    return lines.where("section = 'Footer'").select("line")


def _kpi_by_region(spark, sf_dir):
    return k.kpis(_staged(spark, sf_dir, REGION)).select(
        "region", F.col("date_range.start").alias("start_date"), F.col("date_range.end").alias("end_date"),
        "total_revenue", "avg_order_value", "row_count", "return_rate", "delay_rate",
        "weekly_revenue_change_percent", "current_week_revenue", "previous_week_revenue")


PRODUCT_REVENUE = ("product", "revenue")
DATE_REVENUE = ("order_date", "revenue")
SUPPLIER_STATUS = ("supplier", "shipping_status")
CHECKED = ("order_date", "transaction_id", "revenue", "units_sold", "product")


def _ranked(build, *needed: str, by=()) -> Query:
    def run(spark, sf_dir):
        found = build(_operations(spark, sf_dir, *needed, by=by))
        return found.select(*by, F.col("rank").cast("bigint").alias("position"), *[
            c for c in found.columns if c not in (*by, "rank")])
    return run


def _rounded_chart(build, *needed: str, by=()) -> Query:
    return lambda spark, sf_dir: build(_operations(spark, sf_dir, *needed, by=by)).withColumn(
        "revenue", rounded(F.col("revenue"), 2))


def _strict_suppliers(by=()) -> Query:
    return lambda spark, sf_dir: k.supplier_delays(
        _strict(spark, sf_dir, "supplier", "delivery_days", by=by)).select(*by, "supplier", "delay_rate")


def _by_duration(build, by=()) -> Query:
    return lambda spark, sf_dir: build(_strict(spark, sf_dir, "delivery_days", by=by))


def _weekly_change(by=()) -> Query:
    return lambda spark, sf_dir: k.weekly_change(_operations(spark, sf_dir, *DATE_REVENUE, by=by))


def _supplier_percent(spark, sf_dir):
    return dashboard.supplier_chart(_operations(spark, sf_dir, *SUPPLIER_STATUS)).select(
        "supplier", rounded(F.col("delay_percent"), 2).alias("delay_percent"))


def _status_mix(spark, sf_dir):
    return dashboard.status_mix(_operations(spark, sf_dir, "shipping_status")).withColumnRenamed("count", "n")


def _runs(spark, sf_dir):
    """A run log made of the event stream: every event is a run of the dataset named by its type."""
    return _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dataset"), F.lit(run_log.BUSINESS_AREAS[0]).alias("business_area"),
        F.lit(privacy.BASELINE).alias("privacy_standard"), F.lit(run_log.SCHEDULES[0]).alias("schedule"),
        F.col("ts").cast("timestamp").alias("last_run"),
        F.when(F.col("value") > 100, run_log.NEEDS_REVIEW).otherwise(run_log.SUCCESSFUL).alias("status"),
        F.col("value").alias("run_seconds"), F.concat(F.lit("run "), F.col("event_id").cast("string")).alias("output"))


def _run_log_latest(spark, sf_dir):
    return run_log.latest_runs(_runs(spark, sf_dir)).withColumn("last_run", F.col("last_run").cast("timestamp_ntz"))


def _run_table(spark, sf_dir):
    shown = run_log.run_table(_runs(spark, sf_dir))
    return shown.toDF(*[c.lower().replace(" ", "_") for c in shown.columns])


def _pii_in(table: str, keys: Sequence[str]) -> Query:
    return lambda spark, sf_dir: text_scan.scan_text(_table(spark, sf_dir, table), keys, "text")


def _text_hit_rates(spark, sf_dir):
    return text_scan.text_hit_rates(_table(spark, sf_dir, "documents"), ["text", "source"])


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/opslens-{name}-{uuid.uuid4().hex}"


@contextmanager
def _source(spark, sf_dir) -> Iterator[DataFrame]:
    """The fixture as a table of its own while jobs read it: each run reads its source more than once."""
    folder = _folder(spark, "source")
    try:
        yield staged_ops(spark, sf_dir, folder)
    finally:
        remove(spark, folder)


def _counts(spark, job: ReportingJob, names: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.union, [
        spark.read.parquet(job.table(name)).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name in names])


def _reporting_job(spark, sf_dir):
    """The whole job over the fixture: rows of each table it leaves behind."""
    with _source(spark, sf_dir) as source:
        job = ReportingJob(source=source, destination=_folder(spark, "job"))
        run_pipeline(spark, job)
    return _counts(spark, job, (
        "safe_operations", star.FACT, star.DIM_DATE, *star.DIMENSIONS, "sensitive_columns", "product_chart",
        "weekly_trend", "status_mix", "supplier_chart", "kpis", "run_log"))


def _job_rerun_stricter(spark, sf_dir):
    """What readers find after the job has run under the baseline and then under a mode that drops one column more."""
    with _source(spark, sf_dir) as source:
        job = ReportingJob(source=source, destination=_folder(spark, "rerun"))
        run_pipeline(spark, job)
        stricter = replace(job, privacy_standard=privacy.GDPR)
        run_pipeline(spark, stricter)
    runs = listed(spark, f"{job.destination}/{RUNS}")
    tables = [name for name in listed(spark, run_folder(job.destination, runs[-1])) if name not in ("payload", "report", "sums")]
    return _counts(spark, stricter, tables).union(spark.range(1).select(F.lit("runs"), F.lit(len(runs)).cast("long")))


def _job_two_writers(spark, sf_dir):
    """A run that began first and is committed last, and one that came between: what readers find, and what is kept."""
    with _source(spark, sf_dir) as source, shuffles_removed(spark):
        whole = ReportingJob(source=source, destination=_folder(spark, "writers"))
        first, second = Run(spark, whole), Run(spark, replace(whole, source=whole.source.where("supplier is not null")))
        for step in STEPS[:-1]:
            getattr(first, step)()
        second.work()
        between = spark.read.parquet(whole.table("kpis")).select(F.lit("between").alias("seen"), "row_count", "total_revenue")
        between = spark.createDataFrame(between.collect(), between.schema)
        getattr(first, STEPS[-1])()
    kept = F.lit(len(commit_numbers(spark, whole.destination)) + len(listed(spark, f"{whole.destination}/{RUNS}"))).cast("long")
    after = spark.read.parquet(whole.table("kpis")).select(F.lit("after"), "row_count", "total_revenue")
    return between.union(after).withColumn("kept", kept)


def _job_slow_reader(spark, sf_dir):
    """A reader that opened the fact table before the next run was published, and one that opens it after."""
    with _source(spark, sf_dir) as source:
        job = ReportingJob(source=source, destination=_folder(spark, "readers"))
        run_pipeline(spark, job)
        opened = spark.read.parquet(job.table(star.FACT))
        run_pipeline(spark, replace(job, source=job.source.where("supplier is not null")))
    count = lambda name, df: df.agg(F.lit(name).alias("reader"), F.count(F.lit(1)).alias("n"))
    return count("slow", opened).union(count("new", spark.read.parquet(job.table(star.FACT))))


def _step_log(spark, sf_dir):
    """The steps that a run logs, in order."""
    job = ReportingJob(source=ops(spark, sf_dir, ("order_date", "revenue")), destination=_folder(spark, "steps"))
    run_pipeline(spark, job)
    return spark.read.parquet(job.table(STEP_LOG)).select("position", "step", "status", (F.col("seconds") >= 0).alias("timed"))


def _masked_columns(spark, sf_dir):
    """Customers with their sensitive columns masked under a key."""
    table = _people(spark, sf_dir)
    return masked(table, privacy.find_sensitive(table, privacy.STRICT), MASK_KEY)


def _masked_job(spark, sf_dir):
    """The job with sensitive columns masked: order ids and names can be counted and joined, but not read."""
    with _source(spark, sf_dir) as source:
        job = ReportingJob(source=source, destination=_folder(spark, "masked"), mask_key=MASK_KEY)
        run_pipeline(spark, job)
    rows = spark.read.parquet(job.table("safe_operations"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("order_id").alias("order_ids"), F.count_distinct("customer_name").alias("names"),
        F.count_distinct("contact").alias("contacts"),
        F.count_if(F.col("contact").contains("buyer") | F.col("contact").contains("example") | F.col("customer_name").contains("Customer")).alias("raw"))


def _job_with_sample(spark, sf_dir):
    """The job with a privacy scan of the first values only, one column left alone."""
    scan = {"mode": "sample", "order_by": ["transaction_id", "contact", "revenue"], "skip": ["contact"]}
    with _source(spark, sf_dir) as source:
        job = ReportingJob(source=source, destination=_folder(spark, "sample"), scan=scan)
        run_pipeline(spark, job)
    return spark.read.parquet(job.table("sensitive_columns"))


def _job_payload(spark, sf_dir):
    """The payload and the report as a reader finds them in their files."""
    with _source(spark, sf_dir) as source:
        job = ReportingJob(source=source, destination=_folder(spark, "payload"))
        run_pipeline(spark, job)
    sent = spark.read.schema("purpose string, metrics struct<total_revenue:double,row_count:bigint,return_rate:double>").json(
        job.table("payload"))
    lines = spark.read.text(job.table("report")).agg(
        F.count_if(F.col("value").startswith("#")).alias("headings"), F.count_if(F.col("value").contains("new gear")).alias("named"))
    one = lambda df, c: df.select(c).scalar()
    return sent.select("metrics.total_revenue", "metrics.row_count", "metrics.return_rate", one(lines, "headings").alias("headings"))


def _event_rows(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 17 != 0, F.col("ts").cast("timestamp")).alias("date"), F.col("value").alias("revenue"),
        F.col("event_type").alias("status"), "event_id")


def _refresh_job(spark, sf_dir):
    """The event stream arriving in two drops, a refresh after each; some dates are missing."""
    folder = _folder(spark, "refresh")
    events = _event_rows(spark, sf_dir).drop("event_id")
    job = ReportingJob(source=f"{folder}/in", destination=f"{folder}/out", source_type="parquet", private=f"{folder}/private")
    first = F.coalesce(F.col("date") < "2024-01-20", F.lit(False))
    for drop in (events.where(first), events.where(~first)):
        drop.write.mode("append").parquet(job.source)
        refresh_stream(spark, job).awaitTermination()
    return spark.read.parquet(job.table("kpis")).select(
        F.col("date_range.start").alias("start_date"), F.col("date_range.end").alias("end_date"), "row_count",
        "total_revenue", "avg_order_value", "weekly_revenue_change_percent", "current_week_revenue",
        "previous_week_revenue")


def _refresh_three_drops(spark, sf_dir):
    """The operations arriving in three drops of uneven size: checks and lists after the last one."""
    folder = _folder(spark, "drops")
    table = ops(spark, sf_dir)
    job = ReportingJob(source=f"{folder}/in", destination=f"{folder}/out", source_type="parquet", private=f"{folder}/private")
    part = F.crc32(F.col("transaction_id").cast("binary")) % 10
    for low, high in ((0, 6), (6, 9), (9, 10)):
        table.where((part >= low) & (part < high)).write.mode("append").parquet(job.source)
        refresh_stream(spark, job).awaitTermination()
    pack = spark.read.parquet(job.table("kpis"))
    ranked = pack.select(F.posexplode("top_products").alias("position", "p")).select(
        F.lit("top product").alias("what"), "p.product", F.col("p.revenue").alias("value"))
    checks = spark.read.parquet(job.table("checks")).select(F.explode("checks").alias("c")).select(
        F.lit("check"), "c.check", F.col("c.rows_impacted").cast("double"))
    facts = spark.read.parquet(job.table(star.FACT)).agg(F.lit("facts"), F.lit(None), F.count(F.lit(1)).cast("double"))
    dates = spark.read.parquet(job.table(star.DIM_DATE)).agg(F.lit("dates"), F.lit(None), F.count(F.lit(1)).cast("double"))
    return ranked.union(checks).union(facts).union(dates).toDF("what", "name", "value")


def _refresh_turns_sensitive(spark, sf_dir):
    """Two drops with semicolons, the second with its columns in another order and one more, whose notes hold addresses:
    what readers find then."""
    folder = _folder(spark, "sensitive")
    events = _event_rows(spark, sf_dir).withColumn("revenue", F.col("revenue").cast("decimal(18,4)").cast("string"))
    job = ReportingJob(source=f"{folder}/in", destination=f"{folder}/out", private=f"{folder}/private", source_options={"sep": ";"})
    even = F.col("event_id") % 2 == 0
    note = F.concat(F.lit("user"), F.col("event_id").cast("string"), F.lit("@example.com"))
    drops = (events.where(even).select("date", "revenue", F.lit("fine").alias("note")),
             events.where(~even).select(note.alias("note"), "revenue", F.lit("x").alias("channel"), "date"))
    for drop in drops:
        drop.write.mode("append").options(header=True, sep=";").csv(job.source)
        refresh_stream(spark, job).awaitTermination()
    names = lambda df: F.lit(",".join(sorted(df.columns)))
    fact, flagged = spark.read.parquet(job.table(star.FACT)), spark.read.parquet(job.table("sensitive_columns"))
    sums = [part for layout in listed(spark, f"{job.private}/sums") for part in listed(spark, f"{job.private}/sums/{layout}")]
    held = len(listed(spark, f"{job.destination}/{RUNS}")) + len(sums)
    return spark.read.parquet(job.table("kpis")).select(
        "row_count", "total_revenue", names(fact).alias("fact_columns"),
        flagged.agg(F.array_join(F.sort_array(F.collect_list("column")), ",").alias("c")).scalar().alias("sensitive"),
        F.lit(held).cast("long").alias("folders_held"))


def _csv_inferred_types(spark, sf_dir):
    """Long whole numbers written as CSV and read back with types inferred."""
    path = _folder(spark, "csv-types")
    big = lambda digits: (F.col("o_orderkey") + F.lit(str(10 ** digits)).cast("decimal(38,0)")).cast("string")
    _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("k"), big(18).alias("id19"), big(25).alias("id26"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price")).write.options(header=True).csv(path)
    return read_csv(spark, path, infer_types=True).select(
        "k", "id19", F.col("id26").cast("string").alias("id26"), F.col("price").cast("decimal(18,2)").cast("string").alias("price"))


def _people(spark, sf_dir):
    """Customers with values that the rarer privacy rules are about, and others that come near."""
    # A file of few row groups is read by as few tasks; masking takes hundreds of times as long a row as reading does.
    customers = _table(spark, sf_dir, "customer").repartition(2 * spark.sparkContext.defaultParallelism)
    return customers.selectExpr(*(f"{sql.format(text='string')} as `{c}`" for c, sql in PEOPLE.items()))


def _privacy_rules(spark, sf_dir):
    found = privacy.find_sensitive(_people(spark, sf_dir), privacy.STRICT)
    return privacy.findings_table(spark, found).withColumnRenamed("why flagged", "why_flagged")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "kpi_revenue": _kpi_columns("revenue", "total_revenue", "avg_order_value", "row_count", "order_count"),
        "kpi_date_range": _kpi_date_range,
        "kpi_return_rate": _kpi_columns("return_flag", "return_rate"),
        "kpi_delay_rate": _kpi_columns("shipping_status", "delay_rate"),
        "kpi_delay_rate_p75": _by_duration(k.delay_rate_by_duration),
        "delay_threshold": _by_duration(k.delay_threshold),
        "delay_threshold_by_region": _by_duration(k.delay_threshold, REGION),
        "delay_rate_p75_by_region": _by_duration(k.delay_rate_by_duration, REGION),
        "top_products": _ranked(k.top_products, *PRODUCT_REVENUE),
        "top_categories": _ranked(k.top_categories, "category", "revenue"),
        "top_products_by_region": _ranked(k.top_products, *PRODUCT_REVENUE, by=REGION),
        "inventory_risks": _ranked(k.inventory_risks, "product", "inventory_on_hand"),
        "supplier_delay_risks": _ranked(k.supplier_delays, *SUPPLIER_STATUS),
        "supplier_delay_risks_p75": _strict_suppliers(),
        "supplier_delay_risks_p75_by_region": _strict_suppliers(REGION),
        "supplier_delay_percent": _supplier_percent,
        "weekly_change": _weekly_change(),
        "weekly_change_by_region": _weekly_change(REGION),
        "weekly_trend": _rounded_chart(dashboard.weekly_trend, *DATE_REVENUE),
        "weekly_trend_by_region": _rounded_chart(dashboard.weekly_trend, *DATE_REVENUE, by=REGION),
        "dashboard_top_products": _rounded_chart(dashboard.product_chart, *PRODUCT_REVENUE),
        "status_mix": _status_mix,
        "quality_checks": _quality(),
        "quality_checks_by_region": _quality(REGION),
        "quality_schema_only": _quality_schema_only,
        "privacy_findings_sample": _privacy_sample,
        "privacy_findings_tables": _privacy_tables,
        "privacy_modes": _privacy_modes,
        "safe_columns": _safe_columns,
        "sensitive_columns": _sensitive_columns,
        "concept_map": _concept_map,
        "normalized_preview": _normalized_preview,
        "csv_roundtrip": _csv_roundtrip,
        "csv_multiline": _csv_multiline,
        "numeric_coercion": _numeric_coercion,
        "date_coercion": _date_coercion,
        "date_coercion_day_first": _date_coercion_day_first,
        "date_readings": _date_readings,
        "blank_and_flag": _blank_and_flag,
        "risk_flags": _risk_flags,
        "recommended_actions": _recommended_actions,
        "kpi_cards": _kpi_cards,
        "summary_cards": _summary_cards,
        "payload_json": _payload_json,
        "payload_values": _payload_values,
        "weekly_report": _weekly_report,
        "report_footer": _report_footer,
        "weekly_report_by_region": _weekly_report_by_region,
        "kpi_by_region": _kpi_by_region,
        "run_log_latest": _run_log_latest,
        "run_table": _run_table,
        "pii_in_documents": _pii_in("documents", ["doc_id"]),
        "pii_in_conversations": _pii_in("conversations", ["conv_id", "turn"]),
        "text_hit_rates": _text_hit_rates,
        "reporting_job": _reporting_job,
        "refresh_job": _refresh_job,
        "job_rerun_stricter": _job_rerun_stricter,
        "job_with_sample": _job_with_sample,
        "job_payload": _job_payload,
        "refresh_turns_sensitive": _refresh_turns_sensitive,
        "refresh_three_drops": _refresh_three_drops,
        "job_two_writers": _job_two_writers,
        "job_slow_reader": _job_slow_reader,
        "step_log": _step_log,
        "masked_columns": _masked_columns,
        "masked_job": _masked_job,
        "csv_inferred_types": _csv_inferred_types,
        "privacy_rules": _privacy_rules,
        "fact_operations_by_region": _star_by_region(star.FACT),
        "dim_product_by_region": _star_by_region("dim_product"),
        "dim_date_by_region": _star_by_region(star.DIM_DATE),
        "dim_date": _dim_date,
        "dim_product": _dim("product"),
        "dim_category": _dim("category"),
        "dim_channel": _dim("channel"),
        "dim_supplier": _dim("supplier"),
        "fact_operations": _fact_operations,
    }
    for short, mode in MODES.items():
        found[f"privacy_findings_{short}"] = _privacy_findings(mode)
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top products by revenue."""
    return queries()["top_products"](spark, sf_dir)
