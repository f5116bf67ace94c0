"""The log of reporting runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What a run may be about, and how often it is meant to run.
DATASETS = (
    "Weekly Operations Report", "Inventory Risk Report", "Fulfillment Delay Report", "Returns and Refunds Report",
    "Sales Trend Report",
)
SCHEDULES = ("Daily at 8:00 AM", "Weekly on Monday", "Weekly on Friday", "Monthly", "Manual run only")
BUSINESS_AREAS = (
    "E-commerce operations", "Supply chain / logistics", "Healthcare operations without PHI",
    "General small business",
)
SUCCESSFUL = "Successful"
NEEDS_REVIEW = "Needs review"

RUN_LOG_SCHEMA = (
    "dataset string, business_area string, privacy_standard string, schedule string, last_run timestamp, "
    "status string, run_seconds double, output string"
)
STEP_LOG_SCHEMA = "run string, position int, step string, started timestamp, seconds double, status string"


def latest_runs(log: DataFrame) -> DataFrame:
    """The latest run of each dataset."""
    # max over structs combines before the shuffle, so a dataset with most of the runs stays cheap.
    rest = [c for c in log.columns if c not in ("dataset", "last_run")]
    latest = log.groupBy("dataset").agg(F.max(F.struct("last_run", *rest)).alias("run"))
    return latest.select("dataset", "run.*").select(*log.columns)


def duration_text(seconds: Column) -> Column:
    """"2 min 14 sec"."""
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%d min %02d sec", F.floor(whole / 60).cast("bigint"), whole % 60)


def run_table(log: DataFrame) -> DataFrame:
    """The latest runs for display, most recent first."""
    return latest_runs(log).orderBy(F.desc("last_run"), "dataset").select(
        F.col("dataset").alias("Reporting dataset"),
        F.col("business_area").alias("Business area"),
        F.col("privacy_standard").alias("Privacy standard"),
        F.col("schedule").alias("Schedule"),
        F.date_format("last_run", "yyyy-MM-dd hh:mm a").alias("Last run"),
        F.col("status").alias("Status"),
        duration_text(F.col("run_seconds")).alias("Run time"),
        F.col("output").alias("Output"),
    )
