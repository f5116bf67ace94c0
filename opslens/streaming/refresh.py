"""Refresh the reporting outputs when new files arrive in the input folder.

Each batch of files leaves behind what later refreshes need of it: its raw rows, what scans found in it, its sums by every
key of the metrics, how often each order id occurs, and its rows of the fact table. Outputs are computed from the sums
of all batches. Rows of earlier batches are read again only where the safe columns, their types or the reading of dates change.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from opslens.functions.dates import DateReading, layout_facts, readings
from opslens.operators import partials, star
from opslens.operators.columns import date_columns, normalize_columns
from opslens.operators.privacy import (
    combine, header_reasons, identifier_facts, identifier_values, identifiers_among, value_rules_hit)
from opslens.plans.pipeline import ReportingJob, Run, safe_model
from opslens.sources.runs import latest_commit, listed, remove
from opslens.sources.staging import saved
from opslens.sources.tables import check_csv, read_csv_files

BATCH = "refresh_batch"
FILES_AT_ONCE = 1000

_FILES = "path string, modificationTime timestamp, length long, content binary"
_FACTS = "column string, rows long, filled long, text boolean"
_LAYOUTS = "column string, fact string, n long"


def _new_files(spark: SparkSession, job: ReportingJob) -> DataFrame:
    """Paths of new files; their content is not read here."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", FILES_AT_ONCE)
    return files.load(job.source).select("path")


def _read(spark: SparkSession, job: ReportingJob, paths: list[str]) -> DataFrame:
    """The rows of new files, columns matched by name, with the reader and the options of the whole job."""
    if job.source_type == "parquet":
        return spark.read.option("mergeSchema", True).parquet(*paths)
    check_csv(spark, paths, job.fault_limit, **job.source_options)
    return read_csv_files(spark, paths, **job.source_options)


class RefreshRun(Run):
    """A run over all batches that reads the rows of the new one only."""

    def __init__(self, spark: SparkSession, job: ReportingJob, batch: int, paths: list[str]):
        super().__init__(spark, job)
        self.batch, self.paths = batch, paths

    def _kept(self, name: str, batch: int | None = None) -> str:
        return f"{self.job.private}/{name}/{BATCH}={self.batch if batch is None else batch}"

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write this batch's part of a table; the parts of all batches."""
        df.write.mode("overwrite").parquet(self._kept(name))
        return self.spark.read.schema(df.schema).parquet(f"{self.job.private}/{name}")

    def _batches(self) -> list[int]:
        prefix = f"{BATCH}="
        return sorted(int(n.removeprefix(prefix)) for n in listed(self.spark, f"{self.job.private}/history") if n.startswith(prefix))

    def _rows(self, batches: list[int]) -> DataFrame:
        """Raw rows of some batches, with the columns of all batches."""
        return self.spark.read.schema(self.schema).parquet(*[self._kept("history", b) for b in batches])

    def ingest_source_data(self) -> None:
        self.raw = _read(self.spark, self.job, self.paths)

    def normalize_column_names(self) -> None:
        """New rows are kept, and the columns seen so far: in the order of their first batch, new ones behind."""
        self.new = saved(normalize_columns(self.raw), self._kept("history"))
        texts = self._keep(self.spark.createDataFrame([(self.batch, self.new.schema.json())], "batch int, fields string"), "columns")
        fields: dict[str, T.StructField] = {}
        for row in sorted(texts.collect(), key=lambda r: r["batch"]):  # one row a batch
            for f in T.StructType.fromJson(json.loads(row["fields"])).fields:
                known = fields.setdefault(f.name, f)
                if known.dataType != f.dataType:
                    raise ValueError(f"column {f.name!r} is {f.dataType.simpleString()} in batch {row['batch']} and was {known.dataType.simpleString()}")
        self.schema = T.StructType(list(fields.values()))

    def scan_sensitive_fields(self) -> None:
        """Findings over all rows so far. Only new rows are scanned: earlier batches left their hits, their counts and the hashes
        of their identifiers' distinct values behind."""
        job, spark, columns = self.job, self.spark, self.schema.names
        scanned = [c for c in self.new.columns if c not in job.scan.get("skip", ())]
        hits = self._keep(spark.createDataFrame(sorted(value_rules_hit(self.new, scanned)), "column string, rule string"), "value_hits")
        facts = self._keep(spark.createDataFrame(identifier_facts(self.new, scanned), _FACTS), "identifier_facts")
        values = self._keep(identifier_values(self.new, scanned), "identifier_values")
        facts = facts.groupBy("column").agg(
            F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.bool_or("text").alias("text")).collect()
        known = {r["column"]: (r["rows"], r["filled"], r["text"]) for r in facts}
        by_header = header_reasons([c for c in columns if c not in job.scan.get("skip", ())], job.privacy_standard)
        found = combine(columns, by_header, {(r["column"], r["rule"]) for r in hits.distinct().collect()}, identifiers_among(known, values))
        self.model = safe_model(job, columns, found, self._dates())

    def _dates(self) -> dict[str, DateReading]:
        laid_out, facts = layout_facts(self.new, date_columns(self.new.columns))
        counts = laid_out.agg(F.count(F.lit(1)), *facts.values()).first()[1:]
        kept = self._keep(self.spark.createDataFrame([(*name, n) for name, n in zip(facts, counts)], _LAYOUTS), "date_layouts")
        return readings({(r["column"], r["fact"]): r["n"] for r in kept.groupBy("column", "fact").agg(F.sum("n").alias("n")).collect()})

    def exclude_or_mask_sensitive_fields(self) -> None:
        """Sums of the new batch, or of all if what they are sums of has changed since the last commit."""
        model, job = self.model, self.job
        date = model.dates.get(model.concepts.get("date"))
        told = [model.columns, [self.schema[c].dataType.simpleString() for c in model.columns], list(job.by), repr(date),
                sorted(model.findings.items()) if model.mask_key else None, bool(model.mask_key)]
        self.layout = hashlib.sha256(json.dumps(told).encode()).hexdigest()[:16]
        last = latest_commit(self.spark, job.destination)
        parts = last.more.get("parts", []) if last and last.more.get("layout") == self.layout else []
        parts = [p for p in parts if p["batches"] != [self.batch]]
        covered = {b for p in parts for b in p["batches"]}
        todo = [b for b in self._batches() if b not in covered]
        if self.batch in covered:  # taken in before, together with others
            parts, todo = [], self._batches()
        self.parts = [*parts, self._part(todo)]
        stored = self.spark.read.schema(self.sums_schema).parquet(*[f"{job.private}/{p['sums']}" for p in self.parts])
        ids = None
        if self.ops.has("order_id"):
            ids = self.spark.read.schema(self.ids_schema).parquet(*[f"{job.private}/{p['ids']}" for p in self.parts])
        self.ops, self.facts = partials.with_sums(self.ops, stored, ids), {}

    def _part(self, batches: list[int]) -> dict:
        """Write the sums, id counts and facts of some batches."""
        model, job, raw = self.model, self.job, self._rows(batches)
        self.ops = model.operations(model.rows(raw), self.by)
        part = {"batches": batches, "sums": f"sums/{self.layout}/{self.name}", "ids": None, "facts": f"facts/{self.layout}/{self.name}"}
        self.sums_schema = saved(partials.partials(self.ops), f"{job.private}/{part['sums']}").schema
        if self.ops.has("order_id"):
            part["ids"] = f"ids/{self.layout}/{self.name}"
            self.ids_schema = saved(partials.id_counts(self.ops), f"{job.private}/{part['ids']}").schema
        safe = model.safe(raw).select(*[F.col(f"`{c}`") for c in dict.fromkeys((*self.by, *model.columns))])
        saved(star.fact_operations(safe, model.concepts, self.by, model.dates), f"{job.destination}/{part['facts']}")
        return part

    def commit(self) -> dict:
        private = [f"{self.job.private}/{p[kind]}" for p in self.parts for kind in ("sums", "ids") if p[kind]]
        facts = [p["facts"] for p in self.parts]
        return {"tables": {star.FACT: facts}, "folders": [*facts, *private], "more": {"layout": self.layout, "parts": self.parts}}

    def work(self) -> None:
        try:
            super().work()
        except BaseException:
            for part in getattr(self, "parts", [])[-1:]:
                remove(self.spark, f"{self.job.destination}/{part['facts']}")
                for kind in ("sums", "ids"):
                    if part[kind]:
                        remove(self.spark, f"{self.job.private}/{part[kind]}")
            raise


def refresh_stream(spark: SparkSession, job: ReportingJob, checkpoint: str | None = None) -> StreamingQuery:
    """Take in the files that arrived since the last refresh and bring every output up to date.

    Raw rows, what earlier scans found and the sums of earlier batches are kept under ``job.private``, which must be given and
    lie outside the destination. Only new files are read, parsed and scanned; a column is found by its name, one that a
    file lacks is NULL there, and one that is new is NULL in earlier rows. Outputs are computed from the sums of all batches
    and published as a whole; the fact table grows by a folder a batch. Each batch's raw rows are written over if it is
    retried, and the commit names its sums once, so a lost driver or executor adds no row twice. The query stops when it has
    caught up; whatever keeps the schedule starts it again. ``checkpoint`` is the folder that remembers which files were
    taken in.
    """
    if job.source_type not in ("csv", "parquet"):
        raise ValueError(f"cannot follow a source of kind {job.source_type!r}")
    if not job.private or f"{job.private}/".startswith(f"{job.destination.rstrip('/')}/"):
        raise ValueError("a refresh needs a private folder outside the destination for raw rows")

    def take_in(files: DataFrame, batch: int) -> None:
        paths = [r["path"] for r in files.collect()]  # FILES_AT_ONCE at most
        RefreshRun(spark, job, batch, paths).logged()

    return (_new_files(spark, job).writeStream.foreachBatch(take_in)
            .option("checkpointLocation", checkpoint or f"{job.private}/refresh_checkpoint")
            .trigger(availableNow=True).start())
