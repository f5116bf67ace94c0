"""Finding columns that hold sensitive data, by header and by value, and leaving them out."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T

from opslens.functions.coerce import is_number_text, plain_text
from opslens.functions.dates import DateReading, layout_facts, readings
from opslens.operators.columns import date_columns

BASELINE = "PII Baseline"
HIPAA = "HIPAA-aware"
GDPR = "GDPR-aware"
PCI = "PCI-aware"
STRICT = "Strict: PII + HIPAA + GDPR + PCI"

# Header patterns of each rule set, in the order they are tried.
BASE_PATTERNS = (
    "name", "email", "phone", "mobile", "address", "street", "city", "state", "zip", "postal",
    "customer_id", "client_id", "order_id", "ssn", "dob", "date_of_birth", "credit", "card", "ip_address",
)
HIPAA_PATTERNS = (
    "patient", "member", "medical_record", "mrn", "health_plan", "diagnosis", "condition", "procedure",
    "prescription", "appointment", "provider", "clinic", "insurance", "claim", "birth", "admission", "discharge",
)
GDPR_PATTERNS = (
    "user", "data_subject", "consent", "location", "geo", "ip", "device", "cookie", "identifier",
    "nationality", "passport", "biometric",
)
PCI_PATTERNS = (
    "card", "payment", "cvv", "cvc", "expiration", "expiry", "pan", "billing", "bank", "account_number",
)

# Patterns of sensitive values.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:\d[ -]*?){13,16}\b"
POSTAL = r"\b\d{5}(?:-\d{4})?\b"

# Header parts that let the card, postal and identifier rules apply.
CARD_HEADERS = ("card", "payment", "cc", "pan")
POSTAL_HEADERS = ("zip", "postal", "address")
IDENTIFIER_HEADERS = ("id", "key", "uuid")

# Rule -> (pattern, header parts it needs, reason text), in reporting order.
VALUE_RULES: dict[str, tuple[str, tuple[str, ...], str]] = {
    "email": (EMAIL, (), "sample values look like email addresses"),
    "phone": (PHONE, (), "sample values look like phone numbers"),
    "ssn": (SSN, (), "sample values look like SSNs"),
    "card": (CARD, CARD_HEADERS, "sample values may contain payment-card-like numbers"),
    "postal": (POSTAL, POSTAL_HEADERS, "sample values look like postal/address information"),
}
IDENTIFIER_REASON = "high-cardinality identifier-like field"
IDENTIFIER_FLOOR = 20
IDENTIFIER_SHARE = 0.8

# What each mode says about itself.
MODE_DESCRIPTIONS = {
    BASELINE: "Flags common personally identifiable fields such as names, emails, phone numbers, addresses, "
              "customer IDs, and order IDs.",
    HIPAA: "Adds healthcare-oriented patterns such as patient/member identifiers, claims, provider, diagnosis, "
           "appointment, and medical-record-like fields. Prototype only; not legal compliance advice.",
    GDPR: "Adds broader personal-data patterns such as user identifiers, consent, location, device, cookie, IP, "
          "passport, and biometric-like fields. Prototype only; not legal compliance advice.",
    PCI: "Adds payment-card and billing-oriented patterns such as card, CVV/CVC, expiration, payment, and "
         "bank/account fields. Prototype only; not legal compliance advice.",
    STRICT: "Most conservative prototype mode. Combines baseline PII, healthcare, GDPR-style personal data, and "
            "payment-card/billing patterns.",
}
OTHER_MODE = "Prototype privacy scan mode."

Findings = Mapping[str, Sequence[str]]


def mode_description(standard: str) -> str:
    return MODE_DESCRIPTIONS.get(standard, OTHER_MODE)


def header_patterns(standard: str | None) -> list[str]:
    """Header patterns of a mode: the baseline plus every set its name mentions, each pattern once."""
    mode = (standard or BASELINE).lower()
    everything = "strict" in mode or "all" in mode
    sets = [BASE_PATTERNS] + [
        patterns for word, patterns in (("hipaa", HIPAA_PATTERNS), ("gdpr", GDPR_PATTERNS), ("pci", PCI_PATTERNS))
        if everything or word in mode
    ]
    return list(dict.fromkeys(p for patterns in sets for p in patterns))


def header_reasons(columns: Sequence[str], standard: str) -> dict[str, str]:
    """Reason for each column whose header matches; only the first matching pattern counts."""
    patterns = header_patterns(standard)
    reasons = {}
    for col in columns:
        hit = next((p for p in patterns if re.search(p, col.lower().strip())), None)
        if hit:
            reasons[col] = f"column name matched '{hit}' under {standard}"
    return reasons


# Length of the shortest value a pattern fits; shorter texts need no search.
_SHORTEST = {"email": 6, "phone": 10, "ssn": 11, "card": 13, "postal": 5}


def value_pattern(rule: str) -> str:
    """A rule's pattern for searching. Digits and word edges are Unicode-aware.

    For e-mail, one character before the "@" decides as well as the whole run of them, and the run is not
    rescanned from each of its characters; matches end at the same place after the same "@".
    """
    return EMAIL.replace("+@", "@", 1) if rule == "email" else "(?U)" + VALUE_RULES[rule][0]


def may_match(c: Column, rule: str) -> Column:
    """A cheap test that every text holding a value of the rule's kind passes."""
    long_enough = F.length(c) >= _SHORTEST[rule]
    needed = {"email": "@", "ssn": "-"}.get(rule)
    return long_enough & c.contains(needed) if needed else long_enough


def value_match(c: Column, rule: str) -> Column:
    """True where a text holds a value of the rule's kind."""
    return may_match(c, rule) & c.rlike(value_pattern(rule))


def _whole_number_match(c: Column, rule: str) -> Column | None:
    """The value rules on whole numbers, by their digit count; None where a rule cannot apply."""
    value = c.cast("bigint")
    at_least = lambda digits: (value >= 10 ** (digits - 1)) | (value <= -(10 ** (digits - 1)))
    return {
        "phone": at_least(10),
        "card": at_least(13) & ~at_least(17),
        "postal": at_least(5) & ~at_least(6),
    }.get(rule)


def _column_match(field: T.StructField, rule: str) -> Column | None:
    """Condition that one value of a column matches a rule, or None if it never can."""
    needed = VALUE_RULES[rule][1]
    if needed and not any(part in field.name.lower() for part in needed):
        return None
    c, dtype = F.col(f"`{field.name}`"), field.dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)):
        return None
    if isinstance(dtype, T.IntegralType):
        return _whole_number_match(c, rule)
    return value_match(plain_text(c, dtype), rule)


def _rule_tests(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], Column]:
    """An aggregate per (column, rule) that says whether any value matches."""
    fields = [f for f in df.schema.fields if f.name in columns]
    tests = {(f.name, rule): _column_match(f, rule) for f in fields for rule in VALUE_RULES}
    return {pair: F.bool_or(match) for pair, match in tests.items() if match is not None}


def _identifier_names(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Text columns with an identifier's header."""
    return [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, T.StringType)
            and any(part in f.name.lower().strip() for part in IDENTIFIER_HEADERS)]


def _identifier_facts(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], Column]:
    """Aggregates that tell which text columns with an identifier's header can have too many distinct values."""
    facts = {}
    for name in _identifier_names(df, columns):
        c = F.col(f"`{name}`")
        facts[name, "rows"] = F.count(F.lit(1))
        facts[name, "filled"] = F.count(c)
        # A text column of numbers only would have been read as numbers, so it is no identifier text.
        facts[name, "text"] = F.bool_or(~is_number_text(c))
    return facts


def _one_pass(df: DataFrame, aggregates: Mapping[tuple[str, str], Column]) -> dict[tuple[str, str], object]:
    """All aggregates in one job; one row comes back."""
    if not aggregates:
        return {}
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates.values())]).first()
    return {name: row[f"a{i}"] for i, name in enumerate(aggregates)}


def _sample_hits(df: DataFrame, columns: Sequence[str], order_by: Sequence[str],
                 sample_size: int) -> set[tuple[str, str]]:
    """The pairs that match the first values of each column, read as one text joined by spaces. The first rows of the table hold
    them for most columns; the first rows with a value of the others are looked at next, and so on. Each task keeps its least
    rows; the whole is never sorted."""
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = [f"o{j}" for j in range(len(order_by))]
    rows = df.select(*[F.col(f"`{o}`").alias(k) for k, o in zip(keys, order_by)],
                     *[plain_text(F.col(f"`{c}`"), types[c]).alias(f"c{i}") for i, c in enumerate(columns)])
    left, hits = list(range(len(columns))), set()
    while left:
        found = _joined_rules(_first_cells(rows, keys, left, sample_size * max(10, len(left))), keys, sample_size)
        done = set(left) if _WHOLE in found else {i for i, r in found.items() if r["n"] == sample_size}
        if not done:  # too many rows share a key
            found, done = _joined_rules(_first_of_each(rows, keys, left, sample_size), keys, sample_size), set(left)
        hits |= {(columns[i], rule) for i in done & found.keys() for rule, (_, needed, _) in VALUE_RULES.items()
                 if found[i][rule] and (not needed or any(part in columns[i].lower() for part in needed))}
        left = [i for i in left if i not in done]
    return hits


#: Stands for a column where all rows have been looked at.
_WHOLE = -1


def _first_cells(rows: DataFrame, keys: Sequence[str], left: Sequence[int], n: int) -> DataFrame:
    """(keys..., i, text) of the first ``n`` rows that have a value in any of these columns. Of rows that share the last key some may
    be cut off, so none of them counts."""
    # Rows without a value go last. A filter on all these columns would make the planner look for each of its forms.
    empty = reduce(Column.__and__, [F.col(f"c{i}").isNull() for i in left])
    first = rows.select(*keys, *[f"c{i}" for i in left], empty.alias("empty")).orderBy("empty", *keys).limit(n)
    every = Window.partitionBy()
    placed = first.select("*", ((F.count(F.lit(1)).over(every) < n) | F.bool_or("empty").over(every)).alias("whole"),
                          (F.rank().over(Window.orderBy(*[F.desc_nulls_last(k) for k in keys])) == 1).alias("last"))
    cells = [F.struct(F.lit(i).alias("i"), F.when(F.col("whole") | ~F.col("last"), F.col(f"c{i}")).alias("text")) for i in left]
    told = F.struct(F.lit(_WHOLE).alias("i"), F.when(F.col("whole"), F.lit("")).alias("text"))
    return placed.select(*keys, F.explode(F.array(*cells, told)).alias("cell")).select(*keys, "cell.i", "cell.text").where("text is not null")


def _first_of_each(rows: DataFrame, keys: Sequence[str], left: Sequence[int], sample_size: int) -> DataFrame:
    """The same for the first values of each of these columns, in a scan for each."""
    parts = [rows.where(F.col(f"c{i}").isNotNull()).select(*keys, F.lit(i).alias("i"), F.col(f"c{i}").alias("text"))
             .orderBy(*keys, "text").limit(sample_size) for i in left]
    return reduce(DataFrame.union, parts)


def _joined_rules(cells: DataFrame, keys: Sequence[str], sample_size: int) -> dict[int, Row]:
    """By column: how many of its first values there are, and which rules they match when joined."""
    value = F.struct(*keys, "text")
    place = F.row_number().over(Window.partitionBy("i").orderBy("value"))
    first = cells.select("i", value.alias("value")).withColumn("place", place).where(F.col("place") <= sample_size)
    texts = first.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.array_join(
        F.transform(F.array_sort(F.collect_list("value")), lambda v: v["text"]), " ").alias("joined"))
    return {r["i"]: r for r in texts.select("i", "n", *[value_match(F.col("joined"), rule).alias(rule) for rule in VALUE_RULES]).collect()}


def identifier_facts(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, int, int, bool | None]]:
    """(column, rows, filled, whether any value is not a number) of the columns with an identifier's header; one pass."""
    found = _one_pass(df, _identifier_facts(df, columns))
    return [(c, found[c, "rows"], found[c, "filled"], found[c, "text"]) for c in _identifier_names(df, columns)]


def identifier_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, hash) of the distinct values of the given identifier columns, in one scan for all of them."""
    names = _identifier_names(df, columns)
    cells = [F.struct(F.lit(c).alias("column"), F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`"))).alias("hash"))
             for c in names]
    empty = F.array().cast("array<struct<column:string,hash:bigint>>")
    stacked = df.select(F.explode(F.array(*cells) if cells else empty).alias("c")).select("c.column", "c.hash")
    return stacked.where("hash is not null").distinct()


def identifiers_among(facts: Mapping[str, tuple[int, int, bool | None]], values: DataFrame) -> list[str]:
    """Columns with more distinct values than the limit. ``facts``: rows, filled and text of each column."""
    limit = {c: max(IDENTIFIER_FLOOR, rows * IDENTIFIER_SHARE) for c, (rows, _, _) in facts.items()}
    possible = [c for c, (_, filled, text) in facts.items() if text and filled > limit[c]]
    if not possible:
        return []
    counts = values.where(F.col("column").isin(possible)).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    large = {r["column"] for r in counts.collect() if r["n"] > limit[r["column"]]}
    return [c for c in facts if c in large]


def identifier_columns(df: DataFrame, columns: Sequence[str], facts: Mapping | None = None) -> list[str]:
    """Text columns with an identifier's header and more distinct values than the limit.

    ``facts`` are the answers to ``_identifier_facts`` where a pass has found them already. Values are told apart by
    64-bit hashes.
    """
    found = _one_pass(df, _identifier_facts(df, columns)) if facts is None else facts
    names = _identifier_names(df, columns)
    known = {c: (found[c, "rows"], found[c, "filled"], found[c, "text"]) for c in names}
    limit = lambda rows: max(IDENTIFIER_FLOOR, rows * IDENTIFIER_SHARE)
    possible = [c for c, (rows, filled, text) in known.items() if text and filled > limit(rows)]
    return identifiers_among(known, identifier_values(df, possible)) if possible else []


def value_rules_hit(df: DataFrame, columns: Sequence[str]) -> set[tuple[str, str]]:
    """The (column, value rule) pairs that match in some row; every value is tested, in one pass."""
    return {pair for pair, hit in _one_pass(df, _rule_tests(df, columns)).items() if hit}


def combine(columns: Sequence[str], by_header: Mapping[str, str], hits: set[tuple[str, str]],
            identifiers: Sequence[str]) -> dict[str, list[str]]:
    """Every reason of every flagged column: header, value rules, identifier; in column order."""
    reasons = {
        col: ([by_header[col]] if col in by_header else [])
        + [reason for rule, (_, _, reason) in VALUE_RULES.items() if (col, rule) in hits]
        + ([IDENTIFIER_REASON] if col in identifiers else [])
        for col in columns
    }
    return {col: found for col, found in reasons.items() if found}


def find_sensitive(df: DataFrame, standard: str = BASELINE, mode: str = "full",
                   order_by: Sequence[str] | None = None, sample_size: int = 50,
                   skip: Sequence[str] = (), all_reasons: bool = True) -> dict[str, list[str]]:
    """Columns that look sensitive, with every reason, in column order. Runs one or two jobs.

    ``mode="full"`` tests every value of every row. ``mode="sample"`` tests the first ``sample_size``
    values of each column under ``order_by``, joined by spaces, so a match may straddle two values.
    ``all_reasons=False`` skips value tests for columns whose header already decides. Columns in
    ``skip`` are left alone.
    """
    return scan_columns(df, standard, mode, order_by, sample_size, skip, all_reasons, with_dates=False)[0]


def scan_columns(df: DataFrame, standard: str = BASELINE, mode: str = "full", order_by: Sequence[str] | None = None,
                 sample_size: int = 50, skip: Sequence[str] = (),
                 all_reasons: bool = True, with_dates: bool = True) -> tuple[dict[str, list[str]], dict[str, DateReading]]:
    """What ``find_sensitive`` finds, and in the same pass how each date column is read (see ``elect_dates``;
    none if ``with_dates`` is off)."""
    if mode not in ("full", "sample"):
        raise ValueError(f"unknown scan mode {mode!r}")
    if mode == "sample" and not order_by:
        raise ValueError("a sample needs order_by: rows have no order of their own")
    columns = [c for c in df.columns if c not in skip]
    by_header = header_reasons(columns, standard)
    tested = columns if all_reasons else [c for c in columns if c not in by_header]
    tests = _rule_tests(df, tested) if mode == "full" else {}
    laid_out, layouts = layout_facts(df, date_columns(df.columns) if with_dates else ())
    facts = _one_pass(laid_out, {**tests, **_identifier_facts(df, tested), **layouts})
    if mode == "full":
        hits = {pair for pair in tests if facts[pair]}
    else:
        hits = _sample_hits(df, tested, order_by, sample_size) if tested else set()
    found = combine(columns, by_header, hits, identifier_columns(df, tested, facts))
    return found, readings({name: facts[name] for name in layouts})


def scan(df: DataFrame, standard: str = BASELINE, **options) -> DataFrame:
    """Findings as a table: (column, reasons)."""
    found = find_sensitive(df, standard, **options)
    return df.sparkSession.createDataFrame(list(found.items()), "column string, reasons array<string>")


def findings_table(spark: SparkSession, findings: Findings) -> DataFrame:
    """Findings for display: (column, why flagged), the reasons joined by "; "."""
    found = spark.createDataFrame([(c, list(r)) for c, r in findings.items()], "column string, reasons array<string>")
    return found.select("column", F.array_join("reasons", "; ").alias("why flagged"))


def split(df: DataFrame, findings: Findings) -> tuple[DataFrame, DataFrame]:
    """The safe columns and the sensitive columns, both in table order."""
    flagged = [c for c in df.columns if c in findings]
    return df.drop(*flagged), df.select(*[F.col(f"`{c}`") for c in flagged])
