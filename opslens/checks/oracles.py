"""The results of the queries as DuckDB SQL, written without the library."""

from __future__ import annotations

from opslens.checks.fixture import OPS_COLUMNS, PEOPLE, SAFE_COLUMNS, ops_sql

# Patterns and reasons, written here once more so that the results do not rest on the library.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:\d[ -]*?){13,16}\b"
POSTAL = r"\b\d{5}(?:-\d{4})?\b"
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity)\s*$"

EMAIL_REASON = "sample values look like email addresses"
PHONE_REASON = "sample values look like phone numbers"
SSN_REASON = "sample values look like SSNs"
CARD_REASON = "sample values may contain payment-card-like numbers"
POSTAL_REASON = "sample values look like postal/address information"
KEY_REASON = "high-cardinality identifier-like field"

STEPS = (
    "ingest_source_data", "normalize_column_names", "scan_sensitive_fields", "exclude_or_mask_sensitive_fields",
    "validate_data_quality", "build_analytics_ready_model", "compute_business_metrics", "generate_safe_ai_payload",
    "generate_report", "publish_or_export_report",
)

MODES = {
    "baseline": "PII Baseline", "hipaa": "HIPAA-aware", "gdpr": "GDPR-aware", "pci": "PCI-aware",
    "strict": "Strict: PII + HIPAA + GDPR + PCI",
}


def r(x: str, places: int) -> str:
    """Round on the exact binary value."""
    return f"cast(printf('%.{places}f', cast({x} as double)) as double)"


def typed(select: str, more: str = "") -> str:
    """``select`` over the typed fixture ``t`` (group key ``region``); ``more`` adds further CTEs."""
    return f"""
with ops as ({ops_sql()}),
t as (
  select *, try_cast(order_date as timestamp) as ts,
    try_cast(revenue as decimal(18,2)) as read_revenue,
    coalesce(try_cast(revenue as decimal(18,2)), 0) as rev,
    case when units_sold = 'x' then null else cast(units_sold as double) end as units,
    coalesce(lower(return_flag) in ('1', 'true', 'yes', 'y'), false) as returned,
    coalesce(regexp_matches(lower(shipping_status), 'delay|late|exception'), false) as late
  from ops
){more}
{select}"""


def top(key: str, name: str, value: str, order: str, out: str, k: int = 5, where: str = "true",
        by: str = "", final: str = "") -> str:
    """The first ``k`` keys under an order, numbered."""
    lead = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    return typed(f"""
select {lead}position, {out}{final} from (
  select {lead}{name}, v, row_number() over ({part} order by {order}) as position
  from (select {lead}{key} as {name}, {value} as v from t where {where} group by {lead}{key}))
where position <= {k}""")


def weekly(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    joined = f"t join last using ({by})" if by else "t, last"
    return f"""
last as (select {lead}max(ts) as latest from t {group}),
sums as (
  select {lead}cast(coalesce(sum(rev) filter (ts >= latest - interval 6 day), 0) as double) as cur,
    cast(coalesce(sum(rev) filter (ts >= latest - interval 13 day and ts < latest - interval 6 day), 0) as double) as prev
  from {joined} {group}),
week as (
  select {lead}{r('case when prev <> 0 then (cur - prev) / prev * 100 end', 2)} as weekly_revenue_change_percent,
    {r('cur', 2)} as current_week_revenue, {r('prev', 2)} as previous_week_revenue
  from sums)"""


def totals(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""
totals as (
  select {lead}cast(min(cast(ts as date)) as varchar) as start_date, cast(max(cast(ts as date)) as varchar) as end_date,
    {r('sum(rev)', 2)} as total_revenue, {r('cast(sum(rev) as double) / count(*)', 2)} as avg_order_value,
    count(*) as row_count, count(*) as order_count,
    {r('avg(cast(returned as int))', 4)} as return_rate, {r('avg(cast(late as int))', 4)} as delay_rate
  from t {group})"""


def trend(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"{by}, 1" if by else "1"
    weeks = f"select {lead}cast(date_trunc('week', ts) as date) + 6 as week_end, sum(rev) as v from t where ts is not null group by all"
    span = f"select {lead}unnest(generate_series(min(week_end), max(week_end), interval 7 day)) as w from weeks " + (
        f"group by {by}" if by else "")
    on = "weeks.week_end = cast(w as date)" + (f" and weeks.{by} = span.{by}" if by else "")
    pick = f"span.{by}, " if by else ""
    return typed(
        f"select {pick}cast(w as date) as week_end, coalesce({r('v', 2)}, 0) as revenue from span left join weeks on {on}",
        f", weeks as ({weeks}), span as ({span})")


CHECKS = [
    ("Invalid or missing dates", "High", "count(*) filter (ts is null)", "Rows with dates that could not be parsed."),
    ("Duplicate transaction/order IDs", "Medium", "count(*) filter (copies > 1)",
     "Duplicate identifiers can distort counts and revenue."),
    ("Missing revenue values", "Medium", "count(*) filter (read_revenue is null)",
     "Rows with revenue that could not be read as a number."),
    ("Negative revenue values", "Medium", "count(*) filter (read_revenue < 0)",
     "Negative revenue can be valid for refunds but should be reviewed."),
    ("Invalid unit quantities", "Medium", "count(*) filter (units is null or units < 0)",
     "Missing or negative quantities should be reviewed."),
    ("Missing product names", "Low", "count(*) filter (product is null or trim(product) = '')",
     "Rows without product names reduce usefulness of product analysis."),
]


def checks(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    marked = f", marked as (select *, count(*) over (partition by {lead}transaction_id) as copies from t)"
    rows = " union all ".join(
        f"select {lead}'{name}' as check_name, case when {n} > 0 then '{severity}' else 'Pass' end as severity, "
        f"{n} as rows_impacted, '{detail}' as detail from marked {group}" for name, severity, n, detail in CHECKS)
    return typed(rows, marked)


def p75(select: str, by: str = "") -> str:
    """``select`` over rows ``m`` flagged by the group's 75th percentile of delivery days."""
    lead = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    joined = f"t join q using ({by})" if by else "t, q"
    return typed(select, f", q as (select {lead}quantile_cont(cast(delivery_days as double), 0.75) as p75_days from t {group})"
                         f", m as (select *, delivery_days > p75_days as slow from {joined})")


def findings(columns: dict[str, str], headers: dict[str, str], mode: str, source: str,
             extra: str = "", identifiers: tuple[str, ...] = (), cards: tuple[str, ...] = (), postal: tuple[str, ...] = ()) -> str:
    """(column, why_flagged) rows: header reasons given, value rules tested on every row of ``source``."""
    parts = []
    for column, text in columns.items():
        reasons = [f"'column name matched ''{headers[column]}'' under {mode}'"] if column in headers else []
        reasons += [f"case when bool_or(regexp_matches({text}, '{p}')) then '{reason}' end"
                    for p, reason in ((EMAIL, EMAIL_REASON), (PHONE, PHONE_REASON), (SSN, SSN_REASON),
                                      *[(CARD, CARD_REASON)] * (column in cards), *[(POSTAL, POSTAL_REASON)] * (column in postal))]
        if column in identifiers:
            reasons.append(
                f"case when count(distinct {text}) > greatest(20, count(*) * 0.8) "
                f"and bool_or(not regexp_matches({text}, '{NUMBER}')) then '{KEY_REASON}' end")
        parts.append(f"select {extra}'{column}' as \"column\", concat_ws('; ', {', '.join(reasons)}) as why_flagged "
                     f"from {source}")
    return " union all ".join(f"select * from ({p}) where why_flagged <> ''" for p in parts)


def ops_findings(mode: str) -> str:
    headers = {"order_id": "order_id", "customer_name": "name"}
    if mode.startswith(("GDPR", "Strict")):
        headers["shipping_status"] = "ip"
    columns = {c: f"cast({c} as varchar)" for c in OPS_COLUMNS}
    return f"with ops as ({ops_sql()}) " + findings(
        columns, headers, mode, "ops", identifiers=("transaction_id", "order_id"))


def people_findings() -> str:
    """Strict findings over the columns made for the rarer rules; ``batch_no`` and ``area_no`` hold the same kinds of values as
    ``card_no`` and ``zip_area`` under headers that announce neither."""
    source = "select " + ", ".join(f"{sql.format(text='varchar')} as {c}" for c, sql in PEOPLE.items()) + " from customer"
    headers = {"member_ref": "member", "order_id": "order_id", "card_no": "card", "zip_area": "zip"}
    return f"with people as ({source}) " + findings(
        {c: c for c in PEOPLE}, headers, MODES["strict"], "people", identifiers=("order_id", "invoice_id"),
        cards=("card_no",), postal=("zip_area",))


def table_findings() -> str:
    tables = {
        "customer": (["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], {"c_name": "name"}),
        "orders": (["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], {}),
        "events": (["event_id", "user_id", "event_type", "value", "props"], {"user_id": "user"}),
        "documents": (["doc_id", "text", "lang", "source", "n_chars"], {}),
        "pages": (["page_id", "url", "html"], {}),
    }
    return " union all ".join(
        findings({c: f"cast({c} as varchar)" for c in columns}, headers, MODES["strict"], name, f"'{name}' as table_name, ")
        for name, (columns, headers) in tables.items())


def sample_findings() -> str:
    """The first fifty values of each column, joined."""
    parts = []
    for column in OPS_COLUMNS:
        header = {"order_id": "order_id", "customer_name": "name"}.get(column)
        reasons = [f"'column name matched ''{header}'' under PII Baseline'"] if header else []
        reasons += [f"case when regexp_matches(joined, '{p}') then '{reason}' end"
                    for p, reason in ((EMAIL, EMAIL_REASON), (PHONE, PHONE_REASON), (SSN, SSN_REASON))]
        parts.append(
            f"select '{column}' as \"column\", concat_ws('; ', {', '.join(reasons)}) as why_flagged from ("
            f"select string_agg(v, ' ' order by transaction_id, contact, revenue nulls first, v) as joined from ("
            f"select cast({column} as varchar) as v, transaction_id, contact, revenue from ops where {column} is not null "
            f"order by transaction_id, contact, revenue nulls first limit 50))")
    return f"with ops as ({ops_sql()}) " + " union all ".join(
        f"select * from ({p}) where why_flagged <> ''" for p in parts)


def privacy_modes() -> str:
    described = [
        ("PII Baseline", "Flags common personally identifiable fields such as names, emails, phone numbers, addresses, "
                         "customer IDs, and order IDs.", ""),
        ("HIPAA-aware", "Adds healthcare-oriented patterns such as patient/member identifiers, claims, provider, diagnosis, "
                        "appointment, and medical-record-like fields. Prototype only; not legal compliance advice.", ""),
        ("GDPR-aware", "Adds broader personal-data patterns such as user identifiers, consent, location, device, cookie, IP, "
                       "passport, and biometric-like fields. Prototype only; not legal compliance advice.",
         ", shipping_status"),
        ("PCI-aware", "Adds payment-card and billing-oriented patterns such as card, CVV/CVC, expiration, payment, and "
                      "bank/account fields. Prototype only; not legal compliance advice.", ""),
        ("Strict: PII + HIPAA + GDPR + PCI", "Most conservative prototype mode. Combines baseline PII, healthcare, GDPR-style "
                                             "personal data, and payment-card/billing patterns.", ", shipping_status"),
    ]
    return f"with ops as ({ops_sql()}) " + " union all ".join(
        f"select '{mode}' as mode, '{text}' as description, concat('order_id, customer_name', "
        f"case when bool_or(regexp_matches(contact, '{EMAIL}')) then ', contact' else '' end, '{more}') as excluded "
        f"from ops" for mode, text, more in described)


CONCEPTS = {
    "date": "order_date", "order_id": "transaction_id", "product": "product", "category": "category",
    "channel": "channel", "supplier": "supplier", "units": "units_sold", "revenue": "revenue",
    "inventory": "inventory_on_hand", "delivery_days": "delivery_days", "shipping_status": "shipping_status",
    "return_flag": "return_flag", "return_reason": "not detected",
}


def pack(by: str) -> str:
    """CTEs of the whole KPI pack per group ``by``, and the report lines (a, b) built from it."""
    def ranked(name, key, value, order, where="true"):
        return (f"{name} as (select * from (select {by}, {key} as k, {value} as v, row_number() over (partition by {by} "
                f"order by {order}) as n from t where {where} group by {by}, {key}) where n <= 5)")

    pct = lambda x: f"cast({r(f'{x} * 100', 1)} as varchar)"
    money = lambda x: f"format('${{:,.2f}}', {x})"
    lists = [
        ranked("products", "product", "sum(rev)", "sum(rev) desc, product asc nulls last"),
        ranked("stock", "product", "min(inventory_on_hand)", "min(inventory_on_hand) asc nulls last, product",
               "product is not null"),
        ranked("suppliers", "supplier", "avg(cast(late as int))", "avg(cast(late as int)) desc, supplier",
               "supplier is not null"),
    ]
    base = f"(select * from totals join week using ({by}))"
    risks = f"""
risks as (
  select {by}, 1 as n, concat('Revenue declined ', cast(abs(weekly_revenue_change_percent) as varchar), '% versus the previous week.') as risk
    from {base} where weekly_revenue_change_percent < -5
  union all select {by}, 2, concat('Delay rate is elevated at ', {pct('delay_rate')}, '%.') from {base} where delay_rate > 0.12
  union all select {by}, 3, concat('Return rate is elevated at ', {pct('return_rate')}, '%.') from {base} where return_rate > 0.08
  union all select {by}, 3 + n, concat(k, ' has low inventory (', cast(v as varchar), ' units on hand).') from stock where n <= 3 and v <= 20),
flags as (
  select * from risks
  union all select {by}, 1, 'No major risk flags from the current rules.' from totals where {by} not in (select {by} from risks))"""
    actions = f"""
actions as (
  select distinct {by}, 1 as n, 'Review low-inventory products and decide whether to reorder within the next 48 hours.' as step
    from flags where contains(lower(risk), 'low inventory')
  union all select {by}, 2, 'Investigate delayed shipments by supplier, warehouse, or fulfillment workflow.' from {base} where delay_rate > 0.12
  union all select {by}, 3, 'Review return reasons and identify product or fulfillment issues driving returns.' from {base} where return_rate > 0.08
  union all select {by}, 4, 'Review declining products and channels to determine whether pricing, inventory, or marketing changes are needed.'
    from {base} where weekly_revenue_change_percent < -5
  union all select {by}, 5, 'Use this report as a starting point for owner/operator review, not as an automated final decision.' from totals)"""

    heads = ["Executive Summary", "Key Metrics", "Operational Risk Flags", "Top Revenue Products",
             "Inventory Items to Review", "Supplier or Fulfillment Delay Review", "Recommended Next Actions",
             "Privacy Note"]
    fixed = [(0, 0, "Title", "# Privacy-Safe Weekly Operations Report"), (0, 1, "Title", "")]
    for i, head in enumerate(heads, 1):
        fixed.append((i, 0, head, f"## {head}"))
        if i < len(heads):
            fixed.append((i, 99, head, ""))
    fixed += [
        (8, 1, heads[7], "The following sensitive or identifying columns were excluded before AI report generation: "
                         "order_id, customer_name, contact."),
        (8, 2, heads[7], "The AI layer receives only aggregated metrics and data-quality findings, not raw customer-level "
                         "records."),
    ]
    values = ", ".join(f"({a}, {b}, '{s}', '{text}')" for a, b, s, text in fixed)
    moved = ("case when weekly_revenue_change_percent is null then '' else concat(' Weekly revenue ', "
             "case when weekly_revenue_change_percent >= 0 then 'increased' else 'decreased' end, ' by ', "
             "cast(abs(weekly_revenue_change_percent) as varchar), '% compared with the previous week.') end")
    lines = f"""
lines as (
  select {by}, a, b, section, line from totals, (values {values}) as f(a, b, section, line)
  union all select {by}, 1, 1, '{heads[0]}', concat('The business processed ', format('{{:,}}', order_count),
    ' records with total revenue of ', {money('total_revenue')}, '.', {moved}) from {base}
  union all select {by}, 2, 1, '{heads[1]}', concat('- Total revenue: ', {money('total_revenue')}) from {base}
  union all select {by}, 2, 2, '{heads[1]}', concat('- Average order value: ', {money('avg_order_value')}) from {base}
  union all select {by}, 2, 3, '{heads[1]}', concat('- Shipping or fulfillment delay rate: ', {pct('delay_rate')}, '%') from {base}
  union all select {by}, 2, 4, '{heads[1]}', concat('- Return rate: ', {pct('return_rate')}, '%') from {base}
  union all select {by}, 3, n, '{heads[2]}', concat('- ', risk) from flags
  union all select {by}, 4, n, '{heads[3]}', concat('- ', coalesce(k, 'nan'), ': ', {money('cast(v as double)')}) from products
  union all select {by}, 5, n, '{heads[4]}', concat('- ', k, ': ', cast(v as varchar), ' units on hand') from stock
  union all select {by}, 6, n, '{heads[5]}', concat('- ', k, ': ', {pct(r('v', 4))}, '% delay rate') from suppliers where n <= 3
  union all select {by}, 7, n, '{heads[6]}', concat('- ', step) from actions)"""
    return ", " + ",".join([totals(by), weekly(by), *lists, risks, actions, lines])


def whole(select: str) -> str:
    """``select`` over the pack of all rows as one group."""
    sql = typed(select, pack("g"))
    return sql.replace("select *, try_cast(order_date", "select *, 'all' as g, try_cast(order_date", 1)


def payload_text() -> str:
    """The payload's JSON, put together by the other engine."""
    pairs = lambda key, value, source: (f"(select list({{'{key}': coalesce(k, 'nan'), '{value}': {r('v', 4 if value == 'delay_rate' else 2)}}} order by n) "
                                        f"from {source})")
    stock = "(select list({'product': k, 'inventory_on_hand': cast(v as bigint)} order by n) from stock)"
    categories = "(select category as k, sum(rev) as v, row_number() over (order by sum(rev) desc, category nulls last) as n from t group by category) where n <= 5"
    found = ", ".join(
        f"{{'check': '{name}', 'severity': case when {count} > 0 then '{severity}' else 'Pass' end, 'rows_impacted': {count}, 'detail': '{detail}'}}"
        for name, severity, count, detail in CHECKS)
    return whole(f"""
select cast(to_json({{
  'purpose': 'Generate a privacy-safe weekly operations report for a small business.',
  'metrics': {{'date_range': {{'start': start_date, 'end': end_date}}, 'total_revenue': total_revenue, 'avg_order_value': avg_order_value,
    'row_count': row_count, 'order_count': order_count, 'return_rate': return_rate, 'delay_rate': delay_rate,
    'top_products': {pairs('product', 'revenue', 'products')}, 'top_categories': {pairs('category', 'revenue', categories)},
    'inventory_risks': {stock}, 'supplier_delay_risks': {pairs('supplier', 'delay_rate', 'suppliers')},
    'weekly_revenue_change_percent': weekly_revenue_change_percent, 'current_week_revenue': current_week_revenue,
    'previous_week_revenue': previous_week_revenue, 'risk_summary': (select list(risk order by n) from flags)}},
  'data_quality_findings': (select [{found}] from (select *, count(*) over (partition by transaction_id) as copies from t)),
  'privacy_controls': {{'excluded_sensitive_columns': ['order_id', 'customer_name', 'contact'], 'raw_rows_sent_to_ai': false,
    'only_aggregated_metrics_sent_to_ai': true, 'selected_privacy_standard': 'PII Baseline'}}}}) as varchar) as payload
from totals join week using (g)""")


def text_counts(table: str, keys: str) -> str:
    rules = {"email": EMAIL, "phone": PHONE, "ssn": SSN, "card": CARD, "postal": POSTAL}
    counts = ", ".join(f"cast(len(regexp_extract_all(text, '{p}')) as integer) as {n}_count" for n, p in rules.items())
    hits = ", ".join(f"regexp_matches(text, '{p}') as {n}_hit" for n, p in rules.items())
    return f"select {keys}, {hits}, {counts} from {table}"


def hit_rates() -> str:
    rules = {"email": EMAIL, "phone": PHONE, "ssn": SSN, "card": CARD, "postal": POSTAL}
    return " union all ".join(
        f"select '{c}' as \"column\", '{n}' as rule, count(*) as rows, count(*) filter (regexp_matches({c}, '{p}')) as rows_hit, "
        f"count(*) filter (regexp_matches({c}, '{p}')) / count(*) as hit_rate from documents"
        for c in ("text", "source") for n, p in rules.items())


RUNS = ("select event_type as dataset, 'E-commerce operations' as business_area, 'PII Baseline' as privacy_standard, "
        "'Daily at 8:00 AM' as schedule, ts as last_run, case when value > 100 then 'Needs review' else 'Successful' end "
        "as status, value as run_seconds, concat('run ', cast(event_id as varchar)) as output from events")
LATEST = f"select * from ({RUNS}) qualify row_number() over (partition by dataset order by last_run desc) = 1"


def job_tables(extra: dict[str, str] | None = None, without: tuple[str, ...] = ()) -> str:
    """Row counts of the tables the whole job writes."""
    counts = {
        "safe_operations": "count(*)", "fact_operations": "count(*)", "dim_date": "count(distinct cast(ts as date))",
        **{f"dim_{c}": f"count(distinct {c})" for c in ("product", "category", "channel", "supplier")},
        "sensitive_columns": "case when bool_or(contains(contact, '@')) then 3 else 2 end",
        "product_chart": "least(10, count(distinct product))", "status_mix": "count(distinct shipping_status)",
        "supplier_chart": "least(5, count(distinct supplier))", "kpis": "1", "run_log": "1",
        "weekly_trend": "cast(date_diff('day', min(date_trunc('week', ts)), max(date_trunc('week', ts))) / 7 + 1 as bigint)",
    }
    counts = {name: n for name, n in (counts | (extra or {})).items() if name not in without}
    return typed(" union all ".join(
        f"select '{name}' as table_name, cast({n} as bigint) as n" + ("" if n == "1" else " from t")
        for name, n in counts.items()))


#: After the second run nothing is left of the column that the stricter mode drops, nor of the first run.
RERUN = {"sensitive_columns": "case when bool_or(contains(contact, '@')) then 4 else 3 end", "checks": "1", "concepts": "13 + 0 * count(*)",
         "summary_cards": "5 + 0 * count(*)", "kpi_cards": "4 + 0 * count(*)", "runs": "1"}


EVENTS = "select case when event_id % 17 <> 0 then ts end as ts, value, event_id from events"


def refreshed() -> str:
    return f"""
with t as (select ts, cast(value as decimal(18,4)) as rev, false as returned, false as late from ({EVENTS})),
{totals()},{weekly()}
select start_date, end_date, row_count, total_revenue, avg_order_value, weekly_revenue_change_percent,
  current_week_revenue, previous_week_revenue from totals, week"""


def turned_sensitive() -> str:
    return (f"select count(*) as row_count, {r('sum(cast(value as decimal(18,4)))', 2)} as total_revenue, 'channel,date,revenue' as fact_columns, "
            "'note' as sensitive, cast(2 as bigint) as folders_held from events")


def by_region(name: str) -> str:
    select = {
        "fact_operations": "select region, ts as order_date, product, category, channel, supplier, units_sold, revenue, "
                           "inventory_on_hand, delivery_days, shipping_status, return_flag from t",
        "dim_product": "select distinct region, product from t where product is not null",
        "dim_date": "select distinct region, cast(ts as date) as date, strftime(ts, '%Y-%m') as month, "
                    "cast(weekofyear(ts) as integer) as week from t where ts is not null",
    }
    return typed(select[name])


def after_drops() -> str:
    """What readers find after the last of three drops: the same as over all rows at once."""
    check = lambda name, count: f"union all select 'check', '{name}', cast(({count}) as double) "
    return typed(
        f"select 'top product' as what, coalesce(product, 'nan') as name, {r('v', 2)} as value from "
        "(select product, sum(rev) as v from t group by product order by v desc, product limit 5) "
        + check("Invalid or missing dates", "select count(*) from t where ts is null")
        + check("Duplicate transaction/order IDs", "select coalesce(sum(c), 0) from (select count(*) as c from t group by transaction_id having count(*) > 1)")
        + check("Missing revenue values", "select count(*) from t where read_revenue is null")
        + check("Negative revenue values", "select count(*) from t where read_revenue < 0")
        + check("Invalid unit quantities", "select count(*) from t where units is null or units < 0")
        + check("Missing product names", "select count(*) from t where product is null or trim(product) = ''")
        + "union all select 'facts', null, cast(count(*) as double) from t "
        "union all select 'dates', null, cast(count(distinct cast(ts as date)) as double) from t")


def masked_people(key: str = "a key for tests") -> str:
    """HMAC by its definition, over the same values."""
    pad = lambda byte: "".join(f"\\x{b ^ byte:02X}" for b in key.encode().ljust(64, b"\0"))
    hmac = lambda x: f"sha256('{pad(0x5C)}'::blob || unhex(sha256('{pad(0x36)}'::blob || encode({x}))))"
    word = lambda x: f"'x' || substr({hmac(x)}, 1, 16)"
    people = ", ".join(f"{sql.format(text='varchar')} as {c}" for c, sql in PEOPLE.items())
    # column -> (its digits, how many, their groups); eight rounds change the left and the right half in turn
    numbers = {"ssn": ("replace(substr(tax_note, 4), '-', '')", 9, (3, 2, 4), "-"), "card": ("replace(card_no, ' ', '')", 16, (4, 4, 4, 4), " "),
               "area": ("zip_area", 5, (5,), "")}
    half = lambda n: (n // 2, n - n // 2)
    steps = "select *, " + ", ".join(f"substr({x}, 1, {half(n)[0]})::bigint as {c}_a, substr({x}, {half(n)[0] + 1})::bigint as {c}_b"
                                     for c, (x, n, _, _) in numbers.items()) + " from people"
    for i in range(8):
        own, other = "ab" if i % 2 == 0 else "ba"
        turned = ", ".join(f"({c}_{own} + ('0x' || substr({hmac(f'{i!r}::varchar || {chr(39)}:{n}:{chr(39)} || {c}_{other}::varchar')}, 1, 15))::bigint) "
                           f"% {10 ** half(n)[i % 2]} as {c}_{own}" for c, (_, n, _, _) in numbers.items())
        kept = ", ".join(f"{c}_{other}" for c in numbers)
        steps = f"select {', '.join(PEOPLE)}, {kept}, {turned} from ({steps})"

    def written(c):
        _, n, groups, between = numbers[c]
        text = f"lpad({c}_a::varchar, {half(n)[0]}, '0') || lpad({c}_b::varchar, {half(n)[1]}, '0')"
        return f" || '{between}' || ".join(f"substr({text}, {sum(groups[:k]) + 1}, {g})" for k, g in enumerate(groups))

    return (f"with people as (select {people} from customer) "
            f"select {word('member_ref')} as member_ref, {word('order_id')} as order_id, invoice_id, 'no ' || {written('ssn')} as tax_note, tax_near, "
            f"{written('card')} as card_no, batch_no, {written('area')} as zip_area, area_no from ({steps})")


def oracle_sql() -> dict[str, str]:
    sql = {
        "kpi_revenue": typed("select total_revenue, avg_order_value, row_count, order_count from totals", "," + totals()),
        "kpi_date_range": typed("select start_date, end_date from totals", "," + totals()),
        "kpi_return_rate": typed("select return_rate from totals", "," + totals()),
        "kpi_delay_rate": typed("select delay_rate from totals", "," + totals()),
        "kpi_delay_rate_p75": p75(f"select {r('avg(cast(slow as int))', 4)} as delay_rate from m"),
        "delay_threshold": p75("select p75_days from q"),
        "delay_threshold_by_region": p75("select region, p75_days from q", "region"),
        "delay_rate_p75_by_region": p75(
            f"select region, {r('avg(cast(slow as int))', 4)} as delay_rate from m group by region", "region"),
        "top_products": top("product", "product", "sum(rev)", "v desc, product asc nulls last",
                            f"coalesce(product, 'nan') as product, {r('v', 2)} as revenue"),
        "top_categories": top("category", "category", "sum(rev)", "v desc, category asc nulls last",
                              f"coalesce(category, 'nan') as category, {r('v', 2)} as revenue"),
        "top_products_by_region": top("product", "product", "sum(rev)", "v desc, product asc nulls last",
                                      f"coalesce(product, 'nan') as product, {r('v', 2)} as revenue", by="region"),
        "inventory_risks": top("product", "product", "min(inventory_on_hand)", "v asc nulls last, product",
                               "product, cast(v as bigint) as inventory_on_hand", where="product is not null"),
        "supplier_delay_risks": top("supplier", "supplier", "avg(cast(late as int))", "v desc, supplier",
                                    f"supplier, {r('v', 4)} as delay_rate", where="supplier is not null"),
        "supplier_delay_risks_p75": p75(
            f"select supplier, {r('avg(cast(slow as int))', 4)} as delay_rate from m where supplier is not null "
            f"group by supplier order by avg(cast(slow as int)) desc, supplier limit 5"),
        "supplier_delay_risks_p75_by_region": p75(
            f"select region, supplier, {r('v', 4)} as delay_rate from (select region, supplier, avg(cast(slow as int)) as v, "
            f"row_number() over (partition by region order by avg(cast(slow as int)) desc, supplier) as n from m "
            f"where supplier is not null group by region, supplier) where n <= 5", "region"),
        "supplier_delay_percent": typed(
            f"select supplier, {r(r('avg(cast(late as int))', 4) + ' * 100', 2)} as delay_percent from t "
            f"where supplier is not null group by supplier order by avg(cast(late as int)) desc, supplier limit 5"),
        "weekly_change": typed("select * from week", "," + weekly()),
        "weekly_change_by_region": typed("select * from week", "," + weekly("region")),
        "weekly_trend": trend(),
        "weekly_trend_by_region": trend("region"),
        "dashboard_top_products": typed(
            f"select product, {r('sum(rev)', 2)} as revenue from t where product is not null group by product "
            f"order by sum(rev) desc, product limit 10"),
        "status_mix": typed("select shipping_status as status, count(*) as n from t where shipping_status is not null "
                            "group by shipping_status"),
        "quality_checks": checks(),
        "quality_checks_by_region": checks("region"),
        "quality_schema_only":
            "select 'Basic schema check' as check_name, 'Pass' as severity, cast(0 as bigint) as rows_impacted, "
            "concat('Loaded ', count(*), ' rows. No common order/operations fields were inferred.') as detail from embeddings",
        "privacy_findings_sample": sample_findings(),
        "privacy_findings_tables": table_findings(),
        "privacy_modes": privacy_modes(),
        "safe_columns": f"select {', '.join(SAFE_COLUMNS)} from ({ops_sql()})",
        "sensitive_columns": f"select order_id, customer_name, contact, shipping_status from ({ops_sql()})",
        "concept_map": "select c as concept, case when c = 'return_reason' or n > 0 then d end as detected_column from (values "
                       + ", ".join(f"('{c}', '{d}')" for c, d in CONCEPTS.items())
                       + ") as m(c, d), (select count(*) as n from lineitem)",
        "normalized_preview": 'select p_partkey as part_key, p_name as product__name, p_brand as "brand-code", p_type as type '
                              "from part order by p_partkey limit 12",
        "csv_roundtrip": f"select {', '.join(_csv_text(c) for c in OPS_COLUMNS)} from ({ops_sql()})",
        "numeric_coercion": typed("select transaction_id, units, cast(read_revenue as double) as revenue from t"),
        "date_coercion": "select o_orderkey, case when o_orderkey % 13 < 12 then cast(o_orderdate as date) end as parsed, "
                         "case when o_orderkey % 13 in (1, 10, 11) then cast(o_orderdate as date) end as parsed_strict from orders",
        "csv_multiline": "select doc_id, nullif(text, '') as text, nullif(source, '') as source from documents",
        "date_coercion_day_first": "select o_orderkey, d as slashes, d as dots, d as american, d as mixed from "
                                   "(select o_orderkey, case when o_orderkey % 19 <> 0 then cast(o_orderdate as date) end as d from orders)",
        "date_readings": "select * from (values ('slashes', 'd/M/yyyy', true, true), ('dots', 'd.M.yyyy', true, false), "
                         "('american', 'M/d/yyyy', false, true), ('mixed', null, true, false)) v(column_name, layout, day_first, plain)",
        "blank_and_flag": typed("select product is null or trim(product) = '' as blank_product, returned, late as is_late, "
                                "count(*) as n from t group by all"),
        "risk_flags": whole("select cast(row_number() over (order by n) - 1 as integer) as seq, risk from flags"),
        "recommended_actions": whole(
            "select cast(row_number() over (order by n) - 1 as integer) as seq, step as action from actions"),
        "kpi_cards": typed(
            "select 'Orders / Records' as label, format('{:,}', order_count) as value from totals "
            "union all select 'Revenue', format('${:,.0f}', total_revenue) from totals "
            "union all select 'Return rate', printf('%.1f%%', return_rate * 100) from totals "
            "union all select 'Week-over-week', printf('%.1f%%', coalesce(weekly_revenue_change_percent, 0)) from week",
            "," + totals() + "," + weekly()),
        "summary_cards": typed(
            "select 'Records loaded' as label, format('{:,}', order_count) as value from totals "
            "union all select 'Sensitive columns excluded', '3' union all select 'Safe analytics columns', '12' "
            "union all select 'Total revenue', format('${:,.0f}', total_revenue) from totals "
            "union all select 'Delay rate', printf('%.1f%%', delay_rate * 100) from totals", "," + totals()),
        "payload_values": whole(
            "select total_revenue, row_count, delay_rate, current_week_revenue, coalesce(p.k, 'nan') as best_product, "
            f"{r('p.v', 2)} as best_revenue, (select count(*) from flags) as risks, "
            "(select cast(sum(c) as bigint) from (select count(*) as c from t group by transaction_id having count(*) > 1)) "
            "as duplicate_rows, 'order_id,customer_name,contact' as excluded, false as raw_rows_sent_to_ai, "
            "'PII Baseline' as selected_privacy_standard from totals join week using (g) join products p using (g) where p.n = 1"),
        "weekly_report": whole(
            "select section, cast(row_number() over (order by a, b) - 1 as integer) as seq, line from lines"),
        "payload_json": payload_text(),
        "report_footer": "select unnest(['', '---', 'Generated by prototype on ' || (select strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') from events) "
                         "|| ' UTC. Uses synthetic or user-provided data in-memory only.']) as line",
        "weekly_report_by_region": typed(
            "select region, string_agg(line, chr(10) order by a, b) as report from lines group by region", pack("region")),
        "kpi_by_region": typed(
            "select region, start_date, end_date, total_revenue, avg_order_value, row_count, return_rate, delay_rate, "
            "weekly_revenue_change_percent, current_week_revenue, previous_week_revenue "
            "from totals join week using (region)", "," + totals("region") + "," + weekly("region")),
        "run_log_latest": LATEST,
        "run_table":
            "select dataset as reporting_dataset, business_area, privacy_standard, schedule, "
            "strftime(last_run, '%Y-%m-%d %I:%M %p') as last_run, status, "
            "printf('%d min %02d sec', cast(floor(run_seconds / 60) as bigint), cast(floor(run_seconds) as bigint) % 60) "
            f"as run_time, output from ({LATEST})",
        "pii_in_documents": text_counts("documents", "doc_id"),
        "pii_in_conversations": text_counts("conversations", "conv_id, turn"),
        "text_hit_rates": hit_rates(),
        "reporting_job": job_tables(),
        "refresh_job": refreshed(),
        "job_rerun_stricter": job_tables(RERUN, without=("status_mix", "run_log")),
        "job_with_sample": f"select * from ({sample_findings()}) where \"column\" <> 'contact'",
        "job_payload": typed("select total_revenue, row_count, return_rate, cast(9 as bigint) as headings from totals", "," + totals()),
        "refresh_turns_sensitive": turned_sensitive(),
        "refresh_three_drops": after_drops(),
        "job_two_writers": typed(
            f"select 'between' as seen, count(*) as row_count, {r('sum(rev)', 2)} as total_revenue, cast(4 as bigint) as kept from t where supplier is not null "
            f"union all select 'after', count(*), {r('sum(rev)', 2)}, 4 from t"),
        "job_slow_reader": typed("select 'slow' as reader, count(*) as n from t union all select 'new', count(*) from t where supplier is not null"),
        "step_log": "select cast(row_number() over () - 1 as integer) as position, step, 'done' as status, true as timed from (select unnest(["
                    + ", ".join(f"'{step}'" for step in STEPS) + "]) as step)",
        "masked_columns": masked_people(),
        "masked_job": "select count(*) as n, count(distinct l_orderkey) as order_ids, count(distinct c_name) as names, "
                      "count(distinct c_custkey) as contacts, cast(0 as bigint) as raw from lineitem left join orders on l_orderkey = o_orderkey "
                      "left join customer on o_custkey = c_custkey",
        "csv_inferred_types": "select cast(o_orderkey as bigint) as k, cast(o_orderkey as bigint) + 1000000000000000000 as id19, "
                              "cast(cast(o_orderkey as hugeint) + 10000000000000000000000000 as varchar) as id26, "
                              "cast(cast(o_totalprice as decimal(18,2)) as varchar) as price from orders",
        "privacy_rules": people_findings(),
        **{f"{name}_by_region": by_region(name) for name in ("fact_operations", "dim_product", "dim_date")},
        "dim_date": typed("select distinct cast(ts as date) as date, strftime(ts, '%Y-%m') as month, "
                          "cast(weekofyear(ts) as integer) as week from t where ts is not null"),
        "fact_operations": typed("select ts as order_date, product, category, channel, supplier, units_sold, revenue, "
                                 "inventory_on_hand, delivery_days, shipping_status, return_flag from t"),
    }
    for name in ("product", "category", "channel", "supplier"):
        sql[f"dim_{name}"] = typed(f"select distinct {name} from t where {name} is not null")
    for short, mode in MODES.items():
        sql[f"privacy_findings_{short}"] = ops_findings(mode)
    return sql


def _csv_text(column: str) -> str:
    text = f"cast({column} as varchar)"
    return f"case when {text} = 'n/a' then null else {text} end as {column}"
