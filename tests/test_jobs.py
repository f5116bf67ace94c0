"""Sources, sinks, the reporting job, the run log and the refresh."""

import dataclasses
import datetime
import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from opslens.checks import queries
from opslens.checks.fixture import OPS_COLUMNS, ops, staged_ops
from opslens.operators.masking import masked, permuted
from opslens.operators.privacy import find_sensitive
from opslens.operators.quality import CHECKS
from opslens.plans.pipeline import STEPS, ReportingJob, run_pipeline
from opslens.plans.run_log import RUN_LOG_SCHEMA, latest_runs, run_table
from opslens.sources.runs import clean, commit_numbers, current_run, latest_commit, listed, new_run, publish_run, put_if_absent
from opslens.sources.sinks import export_reports, read_report, write_report
from opslens.sources.staging import shared_folder
from opslens.sources.tables import NA_TOKENS, check_csv, csv_faults, preview, read_csv, read_csv_files, read_table
from opslens.streaming.refresh import refresh_stream


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'Order Date,Name,Name,Qty\n2026-01-05,"a ""q"", b",x,1\nNA,null,n/a,\n,"",None,007\n')
    df = read_csv(spark, path)
    assert df.columns == ["Order Date", "Name", "Name.1", "Qty"]
    assert {t for _, t in df.dtypes} == {"string"}
    assert [tuple(r) for r in df.collect()] == [
        ("2026-01-05", 'a "q", b', "x", "1"), (None,) * 4, (None, None, None, "007")]


def test_csv_types_can_be_inferred(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b,c,d\n1,1.5,x,007\n2,NA,3,4\n")
    df = read_csv(spark, path, infer_types=True)
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "bigint")]
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, "x", 7), (2, None, "3", 4)]


def test_csv_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n"x\ny",1\n')
    assert [tuple(r) for r in read_csv(spark, path, multi_line=True).collect()] == [("x\ny", "1")]


@pytest.mark.parametrize("seed", range(4))
def test_csv_quoted_line_breaks_in_many_splits(spark, tmp_path, seed):
    import csv
    import random

    rng = random.Random(seed)
    word = lambda: "".join(rng.choices('ab,"\n é\r', k=rng.choice([0, 1, 3, 8, 900 if seed == 3 else 40])))
    for name in ("b.csv", "a.csv"):
        rows = [("k", "t", "u"), *((f"{name}{i}", word(), word()) for i in range(400))]
        with open(tmp_path / name, "w", newline="") as f:
            csv.writer(f, lineterminator=rng.choice(["\n", "\r\n"])).writerows(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2048)
    try:
        df = read_csv(spark, str(tmp_path), multi_line=True, order_column="place", na_tokens=())
        assert df.rdd.getNumPartitions() > 8
        found = [(r.k, r.t or "", r.u or "") for r in df.orderBy("place").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [tuple(r) for name in ("a.csv", "b.csv") for r in list(csv.reader(open(tmp_path / name, newline="")))[1:]]
    assert found == expected


def test_csv_with_a_quote_that_is_never_closed(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n1,2\n\n   \n3,"x\ny\n')
    assert [tuple(r) for r in read_csv(spark, path, multi_line=True).collect()][0] == ("1", "2")
    assert read_csv(spark, path, multi_line=True).count() == 2
    assert read_csv(spark, write(tmp_path / "b.csv", "a,b\n"), multi_line=True).count() == 0


def test_csv_rows_keep_their_file_order(spark, tmp_path):
    write(tmp_path / "b.csv", "k,size\n" + "".join(f"{i},v\n" for i in range(5000, 9000)))
    write(tmp_path / "a.csv", "k,size\n" + "".join(f"{i},v\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        df = read_csv(spark, str(tmp_path), order_column="place")
        assert df.rdd.getNumPartitions() > 4
        assert [r.k for r in df.orderBy("place").collect()] == [str(i) for i in range(9000)]
        assert [r.k for r in preview(df, ["place"]).collect()] == [str(i) for i in range(12)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sample_of_first_values_in_file_order(spark, tmp_path):
    path = write(tmp_path / "a.csv", "size\n250\n300\n1200\n")
    df = read_csv(spark, path, order_column="place")
    found = find_sensitive(df, mode="sample", order_by=["place"], skip=["place"])
    assert found == {"size": ["sample values look like phone numbers"]}


def test_every_missing_token(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,k\n" + "".join(f"{token},k\n" for token in NA_TOKENS))
    assert read_csv(spark, path).where("a is not null").count() == 0


def test_read_table_kinds(spark, tmp_path, sf_dir):
    assert read_table(spark, f"{sf_dir}/nation.parquet", "parquet").count() == 25
    spark.range(3).createOrReplaceTempView("three")
    assert read_table(spark, "three", "table").count() == 3
    with pytest.raises(ValueError):
        read_table(spark, "x", "xls")


def test_preview(spark):
    df = spark.range(100).repartition(2)
    assert [r.id for r in preview(df, ["id"], 3).collect()] == [0, 1, 2]


def test_the_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_whole_numbers_stay_exact_at_any_length(spark, tmp_path):
    long = "1" * 45
    path = write(tmp_path / "a.csv", f"a,b,c\n1234567890123456789,{2**70},{long}\n1234567890123456788,5,7\n")
    df = read_csv(spark, path, infer_types=True)
    assert df.dtypes == [("a", "bigint"), ("b", "decimal(38,0)"), ("c", "string")]
    assert [(r.a, int(r.b), r.c) for r in df.collect()] == [(1234567890123456789, 2**70, long), (1234567890123456788, 5, "7")]


def test_headers_that_repeat_a_made_up_name(spark, tmp_path):
    assert read_csv(spark, write(tmp_path / "a.csv", "a,a.1,a\n1,2,3\n")).columns == ["a", "a.1", "a.2"]


def test_rows_that_cannot_be_placed_are_counted(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n1,2\n1,2,3\n4\n"x,\ny",5\n"q ""z"", w",6\n')
    found = csv_faults(spark, path).first()
    assert (found.surplus, found.broken) == (1, 2)
    with pytest.raises(ValueError, match="1 rows .* surplus"):
        check_csv(spark, path)
    check_csv(spark, path, 3)
    job = ReportingJob(source=path, destination=str(tmp_path / "out"))
    with pytest.raises(ValueError, match="surplus"):
        run_pipeline(spark, job)


def test_files_of_other_column_orders(spark, tmp_path):
    paths = [write(tmp_path / "1.csv", "a,b\n1,2\n"), write(tmp_path / "2.csv", "b,a\n4,3\n"), write(tmp_path / "3.csv", "c,a\n9,5\n")]
    rows = read_csv_files(spark, paths).orderBy("a").collect()
    assert [(r.a, r.b, r.c) for r in rows] == [("1", "2", None), ("3", "4", None), ("5", None, "9")]


@pytest.fixture(scope="module")
def published(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("job")
    source = str(folder / "ops.csv")
    ops(spark, sf_dir).write.option("header", True).csv(source)
    job = ReportingJob(source=source, destination=str(folder / "out"), privacy_standard="PII Baseline")
    return job, run_pipeline(spark, job)


def test_job_outputs(spark, published):
    job, run = published
    read = lambda name: spark.read.parquet(job.table(name))
    assert run.status == "Needs review" and run.dataset == "Weekly Operations Report"
    pack = read("kpis").first()
    assert (pack.row_count, pack.total_revenue, pack.delay_rate) == (6000, 258622293.47, 0.2963)
    assert {r.column for r in read("sensitive_columns").collect()} == {"order_id", "customer_name", "contact"}
    checks = {c["check"]: c["rows_impacted"] for c in read("checks").first().checks}
    assert checks["Duplicate transaction/order IDs"] == 2562 and checks["Invalid or missing dates"] == 103
    assert "contact" not in read("safe_operations").columns
    assert read("dim_supplier").count() == 9 and read("dim_date").count() == 1068
    assert read("fact_operations").count() == 6000
    assert read("weekly_trend").count() == 345 and read("status_mix").count() == 5
    assert read("product_chart").count() == 10 and read("supplier_chart").count() == 5
    assert dict(read("summary_cards").collect())["Safe analytics columns"] == "12"
    assert dict(read("kpi_cards").collect())["Revenue"] == "$258,622,293"
    assert read("concepts").count() == 13


def test_job_payload_and_report_files(spark, published):
    job, _ = published
    lines = [line for f in glob.glob(job.table("payload/part-*")) for line in open(f)]
    sent = json.loads(lines[0])
    assert len(lines) == 1 and sent["metrics"]["row_count"] == 6000
    assert "weekly_revenue_change_percent" in sent["metrics"] and "@example.com" not in lines[0]
    text = "".join(open(f).read() for f in glob.glob(job.table("report/part-*")))
    assert text.startswith("# Privacy-Safe Weekly Operations Report\n") and "new gear: $9,425,268.02" in text


def test_strict_job_judges_delays_by_duration(spark, sf_dir, tmp_path):
    job = ReportingJob(source=ops(spark, sf_dir), destination=str(tmp_path),
                       privacy_standard="Strict: PII + HIPAA + GDPR + PCI", validations=["Missing product names"],
                       report_sections=["Key Metrics"])
    assert run_pipeline(spark, job).status == "Successful"
    assert spark.read.parquet(job.table("kpis")).first().delay_rate == 0.225
    assert len(spark.read.parquet(job.table("checks")).first().checks) == 1


def test_job_for_many_businesses(spark, sf_dir, tmp_path):
    job = ReportingJob(source=ops(spark, sf_dir, OPS_COLUMNS + ("region",)), destination=str(tmp_path), by=("region",))
    run_pipeline(spark, job)
    assert spark.read.parquet(job.table("kpis")).count() == 5
    assert read_report(spark, job.table("report"), region="ASIA").first().report.startswith("# Privacy-Safe Weekly")


def test_store_of_many_reports(spark, tmp_path):
    path = str(tmp_path / "store")
    reports = spark.range(20_000).select(F.when(F.col("id") > 0, F.concat(F.lit("tenant "), F.col("id"))).alias("tenant"), (F.col("id") % 3).alias("area"),
                                         F.repeat(F.lit("line\n"), 60).alias("report"))
    write_report(reports, path, ("tenant", "area"))
    assert len(glob.glob(f"{path}/*.parquet")) <= 4 and spark.read.parquet(path).count() == 20_000
    assert [tuple(r)[:2] for r in read_report(spark, path, tenant="tenant 777").collect()] == [("tenant 777", 0)]
    assert read_report(spark, path, tenant=None).count() == 1 and read_report(spark, path, tenant="none").count() == 0
    plan = read_report(spark, path, tenant="tenant 777")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tenant,tenant 777)" in plan
    export_reports(reports.where("tenant in ('tenant 1', 'tenant 2')"), str(tmp_path / "files"), ("tenant",))
    assert sorted(os.path.basename(p) for p in glob.glob(f"{tmp_path}/files/tenant=*")) == ["tenant=tenant 1", "tenant=tenant 2"]


def test_job_over_awkward_headers(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Date,Qty,Qty,Sales.EUR,Key No,Item Product,Region (x)\n"
                                     "2026-01-05,1,2,10.5,k1,axe,n\nJan 6 2026,x,2,1,k2,,s\n")
    job = ReportingJob(source=path, destination=str(tmp_path / "out"), by=("region_(x)",))
    run_pipeline(spark, job)
    assert {r["region_(x)"]: r.total_revenue for r in spark.read.parquet(job.table("kpis")).collect()} == {"n": 10.5, "s": 1.0}
    assert spark.read.parquet(job.table("fact_operations")).columns == ["region_(x)", "date", "item_product", "qty", "sales.eur"]


def test_sensitive_group_keys_are_refused_and_logged(spark, tmp_path):
    df = spark.createDataFrame([("a", "1")], "name string, revenue string")
    job = ReportingJob(source=df, destination=str(tmp_path), by=("name",))
    with pytest.raises(ValueError, match="group keys"):
        run_pipeline(spark, job)
    assert spark.read.parquet(job.table("run_log")).first().status == "Needs review"


def test_plan_of_a_job():
    plan = ReportingJob(source="s", destination="d", workflow_name="").plan()
    assert plan["workflow_name"] == "weekly_operations_report" and plan["steps"] == list(STEPS) and len(STEPS) == 10
    assert plan["validations"] == list(CHECKS) and plan["raw_rows_sent_to_ai"] is False


def test_run_log(spark):
    at = datetime.datetime
    log = spark.createDataFrame([
        ("A", "area", "std", "Monthly", at(2026, 5, 18, 8, 0), "Successful", 134.9, "o1"),
        ("A", "area", "std", "Monthly", at(2026, 5, 17, 8, 0), "Needs review", 1.0, "o2"),
        ("B", "area", "std", "Monthly", at(2026, 5, 11, 20, 5), "Needs review", 188.0, "o3")], RUN_LOG_SCHEMA)
    assert {(r.dataset, r.output) for r in latest_runs(log).collect()} == {("A", "o1"), ("B", "o3")}
    shown = [tuple(r) for r in run_table(log).collect()]
    assert shown[0] == ("A", "area", "std", "Monthly", "2026-05-18 08:00 AM", "Successful", "2 min 14 sec", "o1")
    assert shown[1][4] == "2026-05-11 08:05 PM" and shown[1][6] == "3 min 08 sec"


def refresh(spark, job):
    refresh_stream(spark, job).awaitTermination()
    return spark.read.parquet(job.table("kpis")).first()


def test_refresh_takes_in_new_files_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source / "1.csv", "Date,Revenue,SKU\n2026-01-05,10,a\n2026-01-06,n/a,b\n")
    job = ReportingJob(source=str(source), destination=str(tmp_path / "out"), private=str(tmp_path / "private"))
    assert refresh(spark, job).total_revenue == 10.0
    write(source / "2.csv", "Date,Revenue,SKU\n2026-01-07,5.5,a\n")
    row = refresh(spark, job)
    assert (row.row_count, row.total_revenue, row.date_range.end) == (3, 15.5, "2026-01-07")
    assert refresh(spark, job).row_count == 3
    assert spark.read.parquet(job.table("run_log")).count() == 2


def test_refresh_stages_anew_when_a_column_turns_out_sensitive(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source / "1.csv", "date,revenue,note,return_flag\n2026-01-05,10,fine,yes\n")
    job = ReportingJob(source=str(source), destination=str(tmp_path / "out"), private=str(tmp_path / "private"))
    refresh(spark, job)
    assert spark.read.parquet(job.table("sensitive_columns")).count() == 0
    write(source / "2.csv", "date,revenue,note,return_flag\n2026-01-06,5,a@b.co,no\n")
    row = refresh(spark, job)
    assert (row.row_count, row.total_revenue, row.return_rate) == (2, 15.0, 0.5)
    assert spark.read.parquet(job.table("sensitive_columns")).first().column == "note"
    write(source / "3.csv", "date,revenue,note,return_flag\n2026-01-07,1,fine,no\n")
    row = refresh(spark, job)
    assert (row.row_count, row.total_revenue) == (3, 16.0)
    assert spark.read.parquet(job.table("sensitive_columns")).first().column == "note"
    assert dict(spark.read.parquet(job.table("summary_cards")).collect())["Safe analytics columns"] == "3"


def test_refresh_can_be_retried(spark, tmp_path):
    """A batch that failed after its rows were kept is taken in again without doubling them."""
    source = tmp_path / "in"
    source.mkdir()
    write(source / "1.csv", "date,revenue\n2026-01-05,10\n")
    job = ReportingJob(source=str(source), destination=str(tmp_path / "out"), private=str(tmp_path / "private"))
    refresh(spark, job)
    refresh_stream(spark, job, str(tmp_path / "forgotten")).awaitTermination()
    assert spark.read.parquet(job.table("kpis")).first().row_count == 1


def test_refresh_equals_the_whole_job(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    table = ops(spark, sf_dir)
    table.where("revenue < '4'").write.option("header", True).csv(source)
    job = ReportingJob(source=source, destination=str(tmp_path / "out"), private=str(tmp_path / "private"))
    refresh(spark, job)
    table.where("revenue >= '4'").write.mode("append").option("header", True).csv(source)
    found = refresh(spark, job)
    whole = ReportingJob(source=source, destination=str(tmp_path / "whole"))
    run_pipeline(spark, whole)
    assert found == spark.read.parquet(whole.table("kpis")).first()
    assert spark.read.parquet(job.table("checks")).first() == spark.read.parquet(whole.table("checks")).first()


def test_refresh_of_events(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("ts").alias("date"), F.col("value").alias("revenue"), F.col("event_type").alias("status"))
    events.where("date < '2024-01-15'").write.parquet(source)
    job = ReportingJob(source=source, destination=str(tmp_path / "out"), private=str(tmp_path / "private"), source_type="parquet")
    first = refresh(spark, job)
    events.where("date >= '2024-01-15'").write.mode("append").parquet(source)
    second = refresh(spark, job)
    assert first.row_count < second.row_count == events.count()


def held(folder):
    """Every text in every file below a folder."""
    import pathlib

    import pyarrow.parquet as pq

    found = set()
    for path in pathlib.Path(folder).rglob("*"):
        if path.suffix == ".parquet":
            found |= {str(v) for row in pq.ParquetFile(path).read().to_pylist() for v in row.values()}
        elif path.is_file() and path.suffix in (".json", ".txt", ""):
            found.add(path.read_text(errors="replace"))
    return "\n".join(found)


def test_nothing_stays_of_a_column_that_turned_sensitive(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source / "1.csv", "date,revenue,supplier\n2026-01-05,10,Jane Roe\n")
    job = ReportingJob(source=str(source), destination=str(tmp_path / "out"), private=str(tmp_path / "private"))
    refresh(spark, job)
    assert "Jane Roe" in held(tmp_path / "out")
    write(source / "2.csv", "supplier,units,revenue,date\njane@x.co,3,5,2026-01-06\n")
    row = refresh(spark, job)
    assert (row.row_count, row.total_revenue) == (2, 15.0)
    assert "Jane Roe" not in held(tmp_path / "out") and "jane@x.co" not in held(tmp_path / "out")
    assert "Jane Roe" not in held(tmp_path / "private" / "typed")
    with pytest.raises(ValueError, match="private folder"):
        refresh_stream(spark, ReportingJob(source=str(source), destination=str(tmp_path / "out"), private=str(tmp_path / "out" / "p")))


def test_a_failed_run_leaves_the_last_one_in_place(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-05", "10", "a")], "date string, revenue string, product string")
    job = ReportingJob(source=df, destination=str(tmp_path))
    run_pipeline(spark, job)
    bad = ReportingJob(source=df.selectExpr("date", "raise_error('lost') as revenue", "product"), destination=str(tmp_path))
    with pytest.raises(Exception, match="lost"):
        run_pipeline(spark, bad)
    assert spark.read.parquet(job.table("kpis")).first().total_revenue == 10.0
    assert len(glob.glob(f"{tmp_path}/runs/*")) == 1


def test_a_third_drop_reads_no_earlier_row(spark, sf_dir, tmp_path):
    """Earlier raw rows and facts are made unreadable; sums and commits tell all that is needed."""
    table, source = ops(spark, sf_dir), str(tmp_path / "in")
    job = ReportingJob(source=source, destination=str(tmp_path / "out"), private=str(tmp_path / "private"), source_type="parquet")
    parts = [table.where(f"hash(transaction_id) % 3 = {k}") for k in (0, 1, 2)] + [table.where("hash(transaction_id) % 3 < 0")]
    for part in parts[:2]:
        part.write.mode("append").parquet(source)
        refresh(spark, job)
    for pattern in ("private/history", "out/facts"):
        for path in glob.glob(f"{tmp_path}/{pattern}/**/*.parquet", recursive=True):
            open(path, "wb").close()
    parts[2].union(parts[3]).write.mode("append").parquet(source)
    found = refresh(spark, job)
    whole = ReportingJob(source=table, destination=str(tmp_path / "whole"))
    run_pipeline(spark, whole)
    assert found == spark.read.parquet(whole.table("kpis")).first()
    for name in ("checks", "dim_date", "dim_product", "dim_channel", "weekly_trend", "status_mix"):
        rows = lambda j: sorted(map(str, spark.read.parquet(j.table(name)).collect()))
        assert rows(job) == rows(whole)


def test_refresh_reads_dates_anew_when_the_day_turns_out_to_come_first(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source / "1.csv", "date,revenue\n05/01/2026,10\n")
    job = ReportingJob(source=str(source), destination=str(tmp_path / "out"), private=str(tmp_path / "private"))
    assert refresh(spark, job).date_range.end == "2026-05-01"
    write(source / "2.csv", "date,revenue\n13/01/2026,5\n")
    row = refresh(spark, job)
    assert (row.date_range.start, row.date_range.end, row.current_week_revenue) == ("2026-01-05", "2026-01-13", 5.0)
    assert {str(r.date) for r in spark.read.parquet(job.table("fact_operations")).select(F.col("date").cast("date")).collect()} == {"2026-01-05", "2026-01-13"}


def test_superseded_runs_stay_for_their_readers(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-05", "10", "a")], "date string, revenue string, product string")
    job = ReportingJob(source=df, destination=str(tmp_path))
    for _ in range(3):
        run_pipeline(spark, job)
    assert len(listed(spark, f"{tmp_path}/runs")) == 3 and commit_numbers(spark, str(tmp_path)) == [1, 2, 3]
    run_pipeline(spark, dataclasses.replace(job, retention=0.0))
    assert len(listed(spark, f"{tmp_path}/runs")) == 1 and commit_numbers(spark, str(tmp_path)) == [4]
    clean(spark, str(tmp_path), 0.0)
    assert spark.read.parquet(job.table("kpis")).first().row_count == 1


def test_only_one_writer_gets_a_number(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: put_if_absent(spark, f"{tmp_path}/c/000000000001.json", str(i) * 100), range(8)))
    assert won.count(True) == 1 and open(f"{tmp_path}/c/000000000001.json").read() == str(won.index(True)) * 100
    with ThreadPoolExecutor(8) as pool:
        commits = list(pool.map(lambda i: publish_run(spark, str(tmp_path / "d"), f"{i}-x", retention=99.0), range(8)))
    assert sorted(c.number for c in commits) == list(range(1, 9))
    assert current_run(spark, str(tmp_path / "d")) == next(c.run for c in commits if c.number == 8)


def test_abandoned_runs_go_and_running_ones_stay(spark, tmp_path):
    for run in ("00000000000000000005-old", new_run()):
        spark.range(1).write.parquet(f"{tmp_path}/runs/{run}/t")
    publish_run(spark, str(tmp_path), new_run())
    assert len(listed(spark, f"{tmp_path}/runs")) == 1 and "old" not in listed(spark, f"{tmp_path}/runs")[0]
    (tmp_path / "commits" / "000000000009.json").write_text('{"number": 9, "ru')
    assert latest_commit(spark, str(tmp_path)).number == 1


def test_masking(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("Ann", "call 555-123-4567 or a@b.co now", "4111-1111", 5, None), (None, "nothing here", "x", None, None), ("Ann", "a@b.co", "", 7, None)],
                               "name string, note string, card string, phone int, zip string")
    found = find_sensitive(df, "PII Baseline")
    assert set(found) == {"name", "note", "card", "phone", "zip"}
    rows = masked(df, found, "k").collect()
    tag = lambda text: hmac.new(b"k", text.encode(), hashlib.sha256).hexdigest()

    def digits(text):
        d = [c for c in text if c.isdigit()]
        n, left = len(d), len(d) // 2
        a, b = int("".join(d[:left]) or 0), int("".join(d[left:]))
        for i in range(8):
            added = int(tag(f"{i}:{n}:{b if i % 2 == 0 else a}")[:15], 16)
            a, b = ((a + added) % 10 ** left, b) if i % 2 == 0 else (a, (b + added) % 10 ** (n - left))
        new = iter((f"{a:0{left}d}" if left else "") + f"{b:0{n - left}d}")
        return "".join(next(new) if c.isdigit() else c for c in text)

    assert [r.name for r in rows] == ["x" + tag("Ann")[:16], None, "x" + tag("Ann")[:16]]
    assert rows[0].note == f"call {digits('555-123-4567')} or x{tag('a@b.co')[:16]} now"
    assert rows[1].note == "nothing here" and rows[2].note == f"x{tag('a@b.co')[:16]}"
    assert rows[0].card == digits("4111-1111") and rows[0].phone == digits("5") and rows[1].phone is None and rows[0].zip is None
    long = "k" * 100
    assert masked(df, found, long).first().name == "x" + hmac.new(long.encode(), b"Ann", hashlib.sha256).hexdigest()[:16]
    with pytest.raises(ValueError, match="key"):
        masked(df, found, "")
    for n in (1, 2, 3, 4):
        every = spark.range(10 ** n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        assert every.select(permuted("k", F.col("d")).alias("p")).where(f"p rlike '^[0-9]{{{n}}}$'").distinct().count() == 10 ** n
    sizes = spark.createDataFrame([("7" * n,) for n in (18, 35, 36, 37, 200)], "d string").select("d", permuted("k", F.col("d")).alias("p"))
    assert all(len(r.p) == len(r.d) and r.p.isdigit() and r.p != r.d for r in sizes.collect())


def test_masked_numbers_keep_every_sign(spark):
    from opslens.operators.masking import pseudonym

    texts = ["4111", "(555) 123-4567", "+1.5/5\t5", "12\n", "1\x0b2\f3\r4 5", "12\u0085"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pseudonym("k", F.col("t")).alias("p"),
                                                                         permuted("k", F.regexp_replace("t", r"\D", "")).alias("d")).collect()
    for r in rows:
        new = iter(r.d)
        assert r.p == "".join(next(new) if c in "0123456789" else c for c in r.t)


def test_a_file_of_one_row_group_is_masked_by_many_tasks(spark, sf_dir):
    from opslens.checks.queries import _masked_columns

    assert spark.read.parquet(f"{sf_dir}/customer.parquet").rdd.getNumPartitions() == 1
    assert _masked_columns(spark, sf_dir).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_masked_job_keeps_ids_countable_and_leaves_nothing_raw(spark, sf_dir, tmp_path):
    job = ReportingJob(source=ops(spark, sf_dir), destination=str(tmp_path), mask_key="secret")
    run_pipeline(spark, job)
    text = held(tmp_path)
    assert "@example.com" not in text and "Customer#" not in text and "secret" not in text and "secret" not in repr(job)
    names = spark.read.parquet(job.table("concepts")).where("concept = 'order_id'").first()
    assert names.column == "order_id"
    checks = {c["check"]: c["rows_impacted"] for c in spark.read.parquet(job.table("checks")).first().checks}
    assert checks["Duplicate transaction/order IDs"] > 0


def test_steps_are_logged_also_of_a_failed_run(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-05", "10")], "date string, revenue string")
    job = ReportingJob(source=df, destination=str(tmp_path))
    run_pipeline(spark, job)
    with pytest.raises(Exception, match="lost"):
        run_pipeline(spark, dataclasses.replace(job, source=df.selectExpr("date", "raise_error('lost') as revenue")))
    log = spark.read.parquet(job.table("step_log"))
    assert [r.step for r in log.where("status = 'done'").groupBy("step").count().where("count > 0").collect()] and log.count() == 13
    assert log.where("status = 'failed'").first().step == "scan_sensitive_fields"


def test_staged_rows_equal_those_joined_at_once(spark, tmp_path):
    """Also where keys repeat, are missing, or point to nothing."""
    at = datetime.datetime(2026, 1, 5)
    tables = {
        "lineitem": ([(o, p, s, n, 3.0, 10.5, "R") for n, (o, p, s) in enumerate(
            [(o, o % 5 + 1, 1) for o in range(40)] + [(None, 2, 1), (7, None, None), (7, 1, 1), (7, 1, 1), (900, 900, 9)])],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"),
        "orders": ([(o, o % 4, at, "1-URGENT") for o in range(30)] + [(7, 2, at, "twice"), (None, 1, at, "none"), (8, None, None, None)],
                   "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(0, "a", 0), (1, "b", 1), (1, "c", 9), (None, "d", None)], "c_custkey long, c_name string, c_nationkey int"),
        "part": ([(1, "axe", "tool", 4), (2, "saw", "tool", 5), (2, "saw", None, 5), (None, "x", "y", 1)], "p_partkey long, p_name string, p_type string, p_size int"),
        "nation": ([(0, 0), (1, None)], "n_nationkey int, n_regionkey int"),
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for i, columns in enumerate((OPS_COLUMNS, (*OPS_COLUMNS, "region"), ("order_id", "revenue"), ("product", "revenue"))):
        staged, joined = staged_ops(spark, str(tmp_path), f"{tmp_path}/staged{i}", columns), ops(spark, str(tmp_path), columns)
        assert staged.columns == joined.columns and staged.count() == joined.count() >= 45
        assert staged.exceptAll(joined).count() == joined.exceptAll(staged).count() == 0


@pytest.mark.parametrize("name", ["job_rerun_stricter", "job_slow_reader", "job_two_writers", "reporting_job", "job_payload", "masked_job"])
def test_jobs_read_rows_that_are_joined_already(spark, sf_dir, monkeypatch, name):
    """Each run reads its source more than once, and a join of large tables shuffles them all each time."""
    seen = []

    def job(source, **options):
        seen.append((source._jdf.queryExecution().optimizedPlan().toString(), source.count(), source.inputFiles()))
        raise InterruptedError

    monkeypatch.setattr(queries, "ReportingJob", job)
    with pytest.raises(InterruptedError):
        queries.queries()[name](spark, sf_dir)
    (plan, rows, files), = seen
    assert "Join" not in plan and rows == 6000 and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_a_run_leaves_no_shuffle_files_behind(spark, tmp_path):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    shuffled = lambda: {f for folder in folders for f in glob.glob(f"{folder.getPath()}/*/shuffle_*.data")}
    before = shuffled()
    dates = spark.range(2000).selectExpr("id as k", "cast(date_add(date'2026-01-01', cast(id % 90 as int)) as string) as date")
    sales = spark.range(2000).selectExpr("id as k", "cast(id as string) as revenue", "concat('p', id % 50) as product")
    job = ReportingJob(source=dates.hint("merge").join(sales, "k").drop("k"), destination=str(tmp_path))
    run_pipeline(spark, job)
    assert spark.read.parquet(job.table("kpis")).first().row_count == 2000
    until = time.time() + 20
    while shuffled() - before and time.time() < until:  # files go a moment after their query
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
