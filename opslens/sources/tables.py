"""Table sources: CSV text, Parquet, catalog tables, and previews of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from opslens.functions.coerce import is_number_text
from opslens.sources.csv_records import records

# CSV texts that mean "missing".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "emptyValue": "", "nullValue": ""}


def _unique_headers(names: Sequence[str | None]) -> list[str]:
    """Header texts made unique: a repeat gets ".1", ".2", …; a blank one gets its position."""
    seen: Counter = Counter()
    result = []
    for i, name in enumerate(names):
        text = (name or "").lstrip("﻿") or f"Unnamed: {i}"
        unique = text
        while unique in result or unique != text and unique in names:
            seen[text] += 1
            unique = f"{text}.{seen[text]}"
        result.append(unique)
    return result


def csv_headers(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> list[str]:
    """The header row of a CSV file or folder."""
    first = spark.read.options(**CSV_OPTIONS, header=False, sep=sep, inferSchema=False).csv(path).head(1)
    if not first:
        raise ValueError(f"no header row in {path}")
    return _unique_headers(list(first[0]))


def missing_tokens(df: DataFrame, na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Turn texts that mean "missing" into NULL in every text column."""
    def clean(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.when(~c.isin(*na_tokens), c).alias(f.name) if isinstance(f.dataType, T.StringType) else c
    return df.select(*[clean(f) for f in df.schema.fields])


def read_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",", na_tokens: Sequence[str] = NA_TOKENS,
             multi_line: bool = False, infer_types: bool = False, order_column: str | None = None) -> DataFrame:
    """Read CSV with a header row, every column as text, tokens for "missing" as NULL.

    Files are read in splits. ``multi_line=True`` is for quoted line breaks, also in splits but with one more pass that
    counts quotes (see ``csv_records``); header names must not hold line breaks.
    ``infer_types=True`` takes one more pass and turns columns that hold only numbers into numbers.
    ``order_column`` names a column to add that sorts rows as they stand in the files, for previews and
    for samples of first values.
    """
    headers = csv_headers(spark, path, sep)
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    if multi_line:
        paths = [path] if isinstance(path, str) else path
        found = records(spark, paths).where((F.col("split") > 0) | (F.col("seq") > 0))  # the first record is the header
        fields = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(headers))), {**CSV_OPTIONS, "sep": sep})
        place = [F.struct("file", "split", F.col("seq").alias("row")).alias(order_column)] if order_column else []
        df = missing_tokens(found.select(fields.alias("fields"), *place).select(
            *[F.col("fields")[f"c{i}"].alias(h) for i, h in enumerate(headers)], *[F.col(f"`{order_column}`") for _ in place]))
        return narrow_numbers(df) if infer_types else df
    # Where the names are the file's own, every file of a folder is checked against them.
    plain = all("." not in h and not h.startswith("Unnamed: ") for h in headers)
    raw = spark.read.schema(schema).options(
        **CSV_OPTIONS, header=True, sep=sep, enforceSchema=not plain).csv(path)
    if order_column:
        raw = raw.withColumn(order_column, F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row")))
    df = missing_tokens(raw, na_tokens)
    return narrow_numbers(df) if infer_types else df


def narrow_numbers(df: DataFrame) -> DataFrame:
    """Cast text columns whose every value is a number to BIGINT, DECIMAL(38,0) or DOUBLE. Runs one job.

    Whole numbers stay exact at any length: those too long for a decimal stay text.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    whole = r"^\s*[+-]?\d+\s*$"
    tests = []
    for i, name in enumerate(names):
        c = F.col(f"`{name}`")
        fits = lambda kind: F.bool_and(F.trim(c).try_cast(kind).isNotNull() | c.isNull())
        tests += [F.bool_and(is_number_text(c)).alias(f"number{i}"), F.bool_and(c.rlike(whole)).alias(f"whole{i}"),
                  fits("bigint").alias(f"bigint{i}"), fits("decimal(38,0)").alias(f"decimal{i}")]
    found = df.agg(*tests).first()
    kinds = {}
    for i, name in enumerate(names):
        if found[f"whole{i}"]:
            kinds[name] = "bigint" if found[f"bigint{i}"] else "decimal(38,0)" if found[f"decimal{i}"] else None
        elif found[f"number{i}"]:
            kinds[name] = "double"
    return df.select(*[
        F.trim(F.col(f"`{c}`")).try_cast(kinds[c]).alias(c) if kinds.get(c) else F.col(f"`{c}`") for c in df.columns])


def csv_faults(spark: SparkSession, path: str | Sequence[str], sep: str = ",", multi_line: bool = False, **_) -> DataFrame:
    """Rows a CSV reader cannot place, counted in one pass over the text: ``surplus`` rows have more fields than the first
    file's header, ``broken`` lines hold an open quote (none are counted if quoted line breaks are read)."""
    paths = [path] if isinstance(path, str) else list(path)
    width = len(csv_headers(spark, paths[0], sep))
    fields = ", ".join(f"c{i} string" for i in range(width + 1))
    lines = spark.read.text(paths)
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    broken = (quotes % 2 == 1) & F.lit(not multi_line)
    surplus = F.from_csv(line, fields, {**CSV_OPTIONS, "sep": sep})[f"c{width}"].isNotNull() & (quotes % 2 == 0)
    return lines.agg(F.count_if(surplus).alias("surplus"), F.count_if(broken).alias("broken"))


def check_csv(spark: SparkSession, path: str | Sequence[str], limit: int = 0, **options) -> None:
    """Raise if more rows than ``limit`` cannot be placed."""
    found = csv_faults(spark, path, **{k: v for k, v in options.items() if k in ("sep", "multi_line")}).first()
    if found.surplus + found.broken > limit:
        raise ValueError(f"{found.surplus} rows of {path} have surplus fields and {found.broken} lines open quotes; "
                         f"{limit} are allowed (multi_line=True reads quoted line breaks)")


def read_csv_files(spark: SparkSession, paths: Sequence[str], sep: str = ",", **options) -> DataFrame:
    """Read CSV files that may differ in their headers: columns are matched by name, one missing in a file is NULL there."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(8) as pool:  # one short job for each file
        for path, header in zip(paths, pool.map(lambda p: tuple(csv_headers(spark, p, sep)), paths)):
            by_header.setdefault(header, []).append(path)
    tables = [read_csv(spark, files, sep=sep, **options) for files in by_header.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_table(spark: SparkSession, source: str, kind: str = "csv", **options) -> DataFrame:
    """Read a CSV path, a Parquet path, or a catalog table."""
    if kind == "csv":
        return read_csv(spark, source, **options)
    if kind == "parquet":
        return spark.read.parquet(source)
    if kind == "table":
        return spark.table(source)
    raise ValueError(f"unknown source kind {kind!r}")


def preview(df: DataFrame, order_by: Sequence[str], n: int = 12) -> DataFrame:
    """The first ``n`` rows under an explicit order."""
    return df.orderBy(*[F.col(f"`{c}`") for c in order_by]).limit(n)
