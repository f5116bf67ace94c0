"""Headers, concepts and the privacy scan."""

import pytest

from opslens.checks.fixture import OPS_COLUMNS, SAFE_COLUMNS, STRICT_COLUMNS, ops
from opslens.operators.columns import concept_table, infer_columns, normalize_columns
from opslens.operators.privacy import (
    BASELINE, GDPR, HIPAA, MODE_DESCRIPTIONS, PCI, STRICT, find_sensitive, findings_table, header_patterns,
    header_reasons, mode_description, scan, split,
)
from opslens.operators.text_scan import scan_text, text_hit_rates

CANONICAL = ["order_id", "order_date", "customer_name", "customer_email", "product_name", "product_category",
             "sales_channel", "supplier_name", "units_sold", "revenue", "inventory_on_hand", "delivery_days",
             "shipping_status", "return_flag", "return_reason"]


def texts(spark, **columns):
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"`{c}` string" for c in columns))


def test_headers_are_normalised(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], [" Order Date ", "Order  Date", "A-B", "X\tY"])
    assert normalize_columns(df).columns == ["order_date", "order__date", "a-b", "x\ty"]


def test_headers_that_meet_are_an_error(spark):
    df = spark.createDataFrame([(1, 2)], ["A", "a "])
    with pytest.raises(ValueError, match="'A' and 'a '"):
        normalize_columns(df)


def test_concepts_of_the_canonical_headers():
    safe = [c for c in CANONICAL if c not in header_reasons(CANONICAL, BASELINE)]
    found = infer_columns(safe)
    assert found["product"] == found["category"] == "product_category"
    assert found["supplier"] is None and found["order_id"] is None
    assert found["shipping_status"] == "shipping_status" and found["return_reason"] == "return_reason"
    strict = infer_columns([c for c in CANONICAL if c not in header_reasons(CANONICAL, STRICT)])
    assert strict["shipping_status"] is None


def test_concepts_prefer_exact_candidates_then_column_order():
    found = infer_columns(["grand_total", "my_sales", "amount", "ship_date", "date"])
    assert found["revenue"] == "amount" and found["date"] == "date"
    assert infer_columns(["grand_total", "my_sales"])["revenue"] == "grand_total"
    assert infer_columns([])["date"] is None


def test_concept_table(spark):
    rows = concept_table(spark, infer_columns(["sku"])).collect()
    assert len(rows) == 13
    assert ("product", "sku") in [tuple(r) for r in rows] and ("date", "not detected") in [tuple(r) for r in rows]


def test_patterns_of_each_mode():
    assert len(header_patterns(None)) == len(header_patterns(BASELINE)) == 19
    assert len(header_patterns(HIPAA)) == 36 and len(header_patterns(GDPR)) == 31
    assert len(header_patterns(PCI)) == 28 and len(header_patterns(STRICT)) == 57
    assert header_patterns("everything, all") == header_patterns(STRICT)
    assert header_patterns("Other") == header_patterns(BASELINE)


@pytest.mark.parametrize("header, modes", [
    ("company", {PCI, STRICT}), ("description", {GDPR, STRICT}), ("capacity", set(MODE_DESCRIPTIONS)),
    ("estate", set(MODE_DESCRIPTIONS)), ("user_id", {GDPR, STRICT}), ("l_shipdate", {GDPR, STRICT}),
    ("transaction_id", set()), ("vendor", set()), ("sku", set()), ("patient_no", {HIPAA, STRICT}),
])
def test_header_rules(header, modes):
    assert {m for m in MODE_DESCRIPTIONS if header_reasons([header], m)} == modes


def test_only_the_first_header_pattern_is_named():
    assert header_reasons(["customer_name_email"], BASELINE) == {
        "customer_name_email": "column name matched 'name' under PII Baseline"}


@pytest.mark.parametrize("value, header, reasons", [
    ("a@b.co", "note", ["sample values look like email addresses"]),
    ("(415) 555-1234", "note", ["sample values look like phone numbers"]),
    ("123 456 7890", "note", ["sample values look like phone numbers"]),
    ("123-45-6789", "note", ["sample values look like SSNs"]),
    ("4111 1111 1111 1111", "cc", ["sample values may contain payment-card-like numbers"]),
    ("4111 1111 1111 1111", "note", []),
    ("4111 1111 1111 11", "note", []),
    ("x94110y", "note", []),
    ("94110-1234", "note", []),
    ("a@b", "note", []),
])
def test_value_rules(spark, value, header, reasons):
    found = find_sensitive(texts(spark, **{header: ["plain", value, None]}), BASELINE)
    assert found == ({header: reasons} if reasons else {})


def test_postal_rule_needs_its_header(spark):
    found = find_sensitive(texts(spark, zip=["94110-1234"], area=["94110-1234"]), BASELINE)
    assert found == {"zip": ["column name matched 'zip' under PII Baseline",
                             "sample values look like postal/address information"]}


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("value, header, hit", [
    (4155551234, "n", "phone"), (415555123, "n", None), (-4155551234, "n", "phone"),
    (4111111111111111, "pan_no", "card"), (411111111111, "pan_no", None), (41111111111111111, "pan_no", None),
    (94110, "zipped", "postal"), (941100, "zipped", None), (9411, "zipped", None),
])
def test_whole_numbers_and_their_text_agree(spark, kind, value, header, hit):
    df = spark.createDataFrame([(value if kind == "bigint" else str(value),)], f"{header} {kind}")
    reasons = " ".join(find_sensitive(df).get(header, []))
    assert ("phone" in reasons) == (len(str(abs(value))) >= 10)
    for rule, word in (("card", "payment-card"), ("postal", "postal/address")):
        assert (word in reasons) == (rule == hit)


def test_doubles_are_scanned_as_written_out(spark):
    df = spark.createDataFrame([(4155551234.0, 12.5)], "a double, b double")
    assert list(find_sensitive(df)) == ["a"]


def test_sample_mode_reads_values_joined(spark):
    df = spark.createDataFrame([(1, "250"), (2, "300"), (3, None), (4, "1200")], "k int, size string")
    assert find_sensitive(df, mode="sample", order_by=["k"]) == {"size": ["sample values look like phone numbers"]}
    assert find_sensitive(df, mode="sample", order_by=["k"], sample_size=2) == {}
    assert find_sensitive(df) == {}
    with pytest.raises(ValueError):
        find_sensitive(df, mode="sample")


@pytest.mark.parametrize("key", ["k", "tied"])
def test_sample_finds_the_first_values_of_columns_filled_late(spark, key):
    row = lambda i: (i, 1, "a", None if i < 3000 else "b@c.de" if i >= 3050 else "x", "b@c.de" if i == 2900 else None, None)
    df = spark.createDataFrame([row(i) for i in range(4000)], "k int, tied int, always string, late string, once string, never string").repartition(3)
    email = ["sample values look like email addresses"]
    assert find_sensitive(df, mode="sample", order_by=[key], skip=["k"]) == ({"once": email} if key == "k" else {"late": email, "once": email})
    assert find_sensitive(df, mode="sample", order_by=[key], skip=["k"], sample_size=51) == {"late": email, "once": email}


def test_a_sample_sorts_no_whole_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from opslens.operators.privacy import _first_cells

    cells = _first_cells(spark.range(10 ** 6).select(F.col("id").alias("o0"), F.col("id").cast("string").alias("c0")).repartition(3), ["o0"], [0], 500)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=500" in plan and plan.count("Sort [") == 1  # of these 500


def test_high_cardinality_identifiers(spark):
    rows = [(f"K{i}", f"K{i % 20}", str(i), f"K{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "key_a string, key_b string, key_c string, other string")
    assert find_sensitive(df) == {"key_a": ["high-cardinality identifier-like field"]}
    assert find_sensitive(df.limit(20)) == {}


def test_split_and_tables(spark):
    df = texts(spark, a=["x"], email=["q@r.st"], b=["y"])
    found = find_sensitive(df)
    safe, sensitive = split(df, found)
    assert safe.columns == ["a", "b"] and sensitive.columns == ["email"]
    assert findings_table(spark, found).collect()[0] == (
        "email", "column name matched 'email' under PII Baseline; sample values look like email addresses")
    assert scan(df).first().reasons == found["email"]
    assert split(df, {})[1].columns == [] and findings_table(spark, {}).count() == 0


def test_header_decision_skips_value_tests(spark):
    df = texts(spark, email=["q@r.st"], note=["z"])
    assert find_sensitive(df, all_reasons=False) == {"email": ["column name matched 'email' under PII Baseline"]}


def test_empty_table(spark):
    df = spark.createDataFrame([], "email string, key string")
    assert list(find_sensitive(df)) == ["email"]


def test_fixture_columns_per_mode(spark, sf_dir):
    table = ops(spark, sf_dir)
    assert set(OPS_COLUMNS) - set(find_sensitive(table, BASELINE)) == set(SAFE_COLUMNS)
    strict = set(find_sensitive(table, STRICT))
    assert set(OPS_COLUMNS) - strict == set(STRICT_COLUMNS)
    for mode in MODE_DESCRIPTIONS:
        assert set(find_sensitive(table, mode, all_reasons=False)) <= strict


def test_mode_descriptions():
    assert mode_description("other") == "Prototype privacy scan mode."
    assert mode_description(PCI).startswith("Adds payment-card")


def test_text_scan(spark):
    df = spark.createDataFrame([(1, "a@b.co and c@d.org, call 415-555-1234"), (2, None), (3, "none")], "k int, text string")
    rows = {r.k: r for r in scan_text(df, ["k"], "text").collect()}
    assert rows[1].email_count == 2 and rows[1].phone_hit and not rows[2].email_hit and rows[3].phone_count == 0
    rates = {r.rule: r for r in text_hit_rates(df, ["text"]).collect()}
    assert rates["email"].rows_hit == 1 and rates["email"].rows == 3 and rates["ssn"].hit_rate == 0


def test_spans_hold_the_same_values_as_the_whole_text(spark):
    import random

    from pyspark.sql import functions as F

    from opslens.operators.privacy import VALUE_RULES, value_pattern
    from opslens.operators.text_scan import number_spans, value_counts

    rng = random.Random(7)
    parts = ["555-123-4567", "(555) 123 4567", "+1.555.123.4567", "123-45-6789", "4111 1111 1111 1111", "12345-6789", "12345", "9", "a", "b c", " ", "#", "x@y.co", "é",
             "_", "\n", "-", ".", "(", ")", "word", "\u0665\u0666\u0667\u0668\u0669", "\u3000", "\U0001f600", "7 - 8"]
    texts = [None, "", *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(4000)), "no digits " * 3000 + "12345a67890 12345"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(4)
    plain = F.struct(*[F.coalesce(F.regexp_count("t", F.lit(value_pattern(r))), F.lit(0)).alias(r) for r in VALUE_RULES])
    rows = df.select("t", value_counts(F.col("t")).alias("spans"), plain.alias("plain"), number_spans(F.col("t")).alias("left")).collect()
    assert all(r.spans == r.plain for r in rows)
    assert max(len(r.left) for r in rows if r.t and r.t.startswith("no digits")) < 40
