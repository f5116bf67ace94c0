"""The reporting job: source table in, safe model, checks, KPIs, payload and report out."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from opslens.functions.dates import DateReading
from opslens.operators import dashboard, kpis as k, partials, quality, report, star
from opslens.operators.columns import concept_table, infer_columns, normalize_columns
from opslens.operators.masking import masked
from opslens.operators.privacy import BASELINE, findings_table, scan_columns
from opslens.operators.typed import Operations, key_columns, read_columns
from opslens.plans import run_log
from opslens.sources.runs import current_commit, new_run, publish_run, remove, run_folder, table_path
from opslens.sources.sinks import write_json, write_report, write_tables
from opslens.sources.staging import saved, shuffles_removed
from opslens.sources.tables import check_csv, read_table

# The steps of a run, in order. Each is a method of ``Run``.
STEPS = (
    "ingest_source_data", "normalize_column_names", "scan_sensitive_fields", "exclude_or_mask_sensitive_fields",
    "validate_data_quality", "build_analytics_ready_model", "compute_business_metrics", "generate_safe_ai_payload",
    "generate_report", "publish_or_export_report",
)
DEFAULT_NAME = "weekly_operations_report"
RUN_LOG, STEP_LOG = "run_log", "step_log"


@dataclass(frozen=True)
class ReportingJob:
    """What to read, under which privacy mode, and where the results go (a folder all executors share).

    ``scan`` holds options of the privacy scan (mode, order_by, sample_size, skip). ``mask_key`` keeps sensitive columns, their
    values replaced under this key, instead of leaving them out. ``fault_limit`` is how many rows of a CSV source may be
    unplaceable before the job stops. ``private`` is the folder where a refresh keeps raw rows; it must lie outside the
    destination. ``retention`` is how many seconds a run stays for its readers after the next one is published.
    """

    source: str | DataFrame
    destination: str
    source_type: str = "csv"
    workflow_name: str = DEFAULT_NAME
    privacy_standard: str = BASELINE
    schedule: str = run_log.SCHEDULES[1]
    dataset: str = run_log.DATASETS[0]
    business_area: str = run_log.BUSINESS_AREAS[0]
    output: str = "Dashboard + Weekly AI Report"
    validations: Sequence[str] | None = None
    report_sections: Sequence[str] = report.SECTIONS
    by: Sequence[str] = ()
    footer: bool = False
    source_options: dict = field(default_factory=dict)
    scan: dict = field(default_factory=dict)
    mask_key: str | None = field(default=None, repr=False)
    fault_limit: int = 0
    private: str | None = None
    retention: float = 86_400.0

    def plan(self) -> dict:
        """The job as plain data, with its steps and governance flags."""
        shown = ("source_type", "schedule", "privacy_standard", "destination")
        return {
            "workflow_name": self.workflow_name or DEFAULT_NAME,
            **{name: getattr(self, name) for name in shown},
            "steps": list(STEPS),
            "validations": list(self.validations if self.validations is not None else quality.CHECKS),
            "report_sections": list(self.report_sections),
            "human_review_required": True,
            "raw_rows_sent_to_ai": False,
            "only_aggregated_metrics_sent_to_ai": True,
        }

    def table(self, name: str) -> str:
        """Where readers find an output: in the run published last; the logs are common to all runs."""
        if name in (RUN_LOG, STEP_LOG):
            return f"{self.destination}/{name}"
        return table_path(self.destination, current_commit(SparkSession.active(), self.destination), name)


@dataclass(frozen=True)
class SafeModel:
    """What a scan decided: the findings, the columns that stay, their meaning, how dates are read, and the key that sensitive
    columns are masked under (none: they are left out)."""

    findings: dict[str, list[str]]
    columns: list[str]
    concepts: dict[str, str | None]
    dates: dict[str, DateReading]
    mask_key: str | None = field(default=None, repr=False)

    def safe(self, table: DataFrame) -> DataFrame:
        """The columns that stay."""
        if self.mask_key:
            table = masked(table, self.findings, self.mask_key)
        return table.select(*[F.col(f"`{c}`") for c in self.columns])

    def rows(self, table: DataFrame) -> DataFrame:
        """The safe columns and the typed readings of them."""
        safe = self.safe(table)
        return safe.select("*", *read_columns(safe, self.concepts, self.dates).values())

    def operations(self, rows: DataFrame, by: Sequence[str]) -> Operations:
        """What metrics are computed from, over rows as ``rows`` makes them."""
        flat = rows.select(*[F.col(f"`{c}`") for c in self.columns])
        read = [F.col(f"`{c}`") for c in rows.columns if c not in self.columns]
        return Operations(rows.select(*[F.col(f"`{b}`") for b in by], *key_columns(flat, self.concepts), *read), self.concepts, tuple(by))


def safe_model(job: ReportingJob, columns: Sequence[str], findings: dict[str, list[str]],
               dates: dict[str, DateReading]) -> SafeModel:
    exposed = [b for b in job.by if b in findings]
    if exposed:
        raise ValueError(f"group keys {exposed} hold sensitive data under {job.privacy_standard}")
    safe = list(columns) if job.mask_key else [c for c in columns if c not in findings]
    return SafeModel(findings, safe, infer_columns([c for c in safe if c not in job.by]), dates, job.mask_key)


class Run:
    """One run of a job: a method for each step, which leave behind what later ones need."""

    def __init__(self, spark: SparkSession, job: ReportingJob):
        self.spark, self.job, self.by = spark, job, tuple(job.by)
        self.name, self.steps, self.status = new_run(), [], run_log.NEEDS_REVIEW
        self.folder = run_folder(job.destination, self.name)

    def ingest_source_data(self) -> None:
        job = self.job
        if isinstance(job.source, DataFrame):
            self.raw = job.source
            return
        if job.source_type == "csv":
            check_csv(self.spark, job.source, job.fault_limit, **job.source_options)
        self.raw = read_table(self.spark, job.source, job.source_type, **job.source_options)

    def normalize_column_names(self) -> None:
        self.table = normalize_columns(self.raw)

    def scan_sensitive_fields(self) -> None:
        self.model = safe_model(self.job, self.table.columns, *scan_columns(self.table, self.job.privacy_standard, **self.job.scan))

    def exclude_or_mask_sensitive_fields(self) -> None:
        """The source is parsed once more, here; what comes after reads these columns, or the sums over them."""
        staged = saved(self.model.rows(self.table), f"{self.folder}/safe_operations")
        ops = self.model.operations(staged, self.by)
        self.ops = partials.with_sums(ops, saved(partials.partials(ops), f"{self.folder}/sums"))
        self.facts = {star.FACT: star.fact_operations(staged.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*self.by, *self.model.columns))]),
                                                      self.model.concepts, self.by, self.model.dates)}

    def validate_data_quality(self) -> None:
        self.checks = saved(quality.check_list(self.ops, self.job.validations), f"{self.folder}/checks")

    def build_analytics_ready_model(self) -> None:
        spark, model = self.spark, self.model
        write_tables({
            "sensitive_columns": findings_table(spark, model.findings).toDF("column", "why_flagged"),
            "concepts": concept_table(spark, model.concepts).toDF("concept", "column"),
            **star.dimensions(self.ops), **self.facts}, self.folder)

    def compute_business_metrics(self) -> None:
        ops, by, model = self.ops, self.by, self.model
        self.pack = saved(k.kpis(ops), f"{self.folder}/kpis")
        tables = {
            "summary_cards": dashboard.summary_cards(self.pack, len(model.findings), len(model.columns), by),
            "kpi_cards": dashboard.kpi_cards(self.pack, by),
        }
        if ops.has("product", "revenue"):
            tables["product_chart"] = dashboard.product_chart(ops)
        if ops.has("date", "revenue"):
            tables["weekly_trend"] = dashboard.weekly_trend(ops)
        if ops.has("shipping_status"):
            tables["status_mix"] = dashboard.status_mix(ops)
        if ops.has("supplier", "shipping_status") or ops.has("supplier", "delivery_days"):
            tables["supplier_chart"] = dashboard.supplier_chart(ops)
        write_tables(tables, self.folder)

    def generate_safe_ai_payload(self) -> None:
        self.payloads = report.payload(self.pack, self.checks, list(self.model.findings), self.job.privacy_standard, self.by)
        write_json(self.payloads, f"{self.folder}/payload")

    def generate_report(self) -> None:
        job = self.job
        write_report(report.report_text(self.payloads, self.by, job.report_sections, job.footer), f"{self.folder}/report", self.by)

    def commit(self) -> dict:
        """What the commit tells beside the run."""
        return {}

    def publish_or_export_report(self) -> None:
        shown = [c for c in self.model.columns if c not in self.model.findings]
        publish_run(self.spark, self.job.destination, self.name, shown, self.model.findings, retention=self.job.retention, **self.commit())
        failed = self.checks.select(F.explode("checks").alias("c")).where("c.severity = 'High'").limit(1).count()
        self.status = run_log.NEEDS_REVIEW if failed else run_log.SUCCESSFUL

    def work(self) -> None:
        """All steps in order, each timed; a failed run takes its folder with it."""
        for step in STEPS:
            started, clock, status = datetime.now(timezone.utc), time.monotonic(), "failed"
            try:
                with shuffles_removed(self.spark):
                    getattr(self, step)()
                status = "done"
            except BaseException:
                remove(self.spark, self.folder)
                raise
            finally:
                self.steps.append((self.name, len(self.steps), step, started, time.monotonic() - clock, status))

    def logged(self) -> Row:
        """Do the work, append one row to the run log and one for each step to the step log; a failure is logged and raised."""
        job, started, clock = self.job, datetime.now(timezone.utc), time.monotonic()
        try:
            self.work()
        finally:
            entry = self.spark.createDataFrame([(
                job.dataset, job.business_area, job.privacy_standard, job.schedule, started, self.status,
                time.monotonic() - clock, job.output)], run_log.RUN_LOG_SCHEMA)
            entry.coalesce(1).write.mode("append").parquet(job.table(RUN_LOG))
            steps = self.spark.createDataFrame(self.steps, run_log.STEP_LOG_SCHEMA)
            steps.coalesce(1).write.mode("append").parquet(job.table(STEP_LOG))
        return entry.first()


def run_pipeline(spark: SparkSession, job: ReportingJob) -> Row:
    """Run every step, write each output table, append one row to the run log and return it.

    A run needs review when a check of high severity found rows, or when a step failed.
    """
    return Run(spark, job).logged()
