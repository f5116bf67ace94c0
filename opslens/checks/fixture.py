"""A table of business operations derived from the benchmark tables, with dirt added.

One row per ``lineitem`` row. The column expressions are SQL that both engines read the same way; only
the name of the text type differs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.sources.staging import CODEC, shuffles_removed

_M = "((l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 14)"

# Column -> (tables it needs beside lineitem, SQL expression).
COLUMNS: dict[str, tuple[tuple[str, ...], str]] = {
    "transaction_id": ((), "cast(l_orderkey * 10 + l_linenumber as {text})"),
    "order_id": ((), "cast(l_orderkey as {text})"),
    "customer_name": (("orders", "customer"), "c_name"),
    "contact": (("orders", "customer"), "concat('buyer', cast(c_custkey as {text}), '@example.com')"),
    "order_date": (("orders",), "case when l_orderkey % 101 = 0 then 'not-a-date' when l_orderkey % 103 = 0 then null "
                                "else cast(cast(o_orderdate as date) as {text}) end"),
    "product": (("part",), "case when l_partkey % 97 = 0 then null when l_partkey % 89 = 0 then '  ' else p_name end"),
    "category": (("part",), "p_type"),
    "channel": (("orders",), "o_orderpriority"),
    "supplier": ((), "case when l_suppkey % 37 = 0 then null else concat('SUP-', cast(l_suppkey as {text})) end"),
    "units_sold": ((), "case when l_partkey % 83 = 0 then '-1' when l_partkey % 79 = 0 then 'x' "
                       "else cast(cast(l_quantity as int) as {text}) end"),
    "revenue": ((), "case when l_suppkey % 53 = 0 then 'n/a' when l_linenumber = 7 and l_returnflag = 'R' "
                    "then cast(-cast(l_extendedprice as decimal(18,2)) as {text}) "
                    "else cast(cast(l_extendedprice as decimal(18,2)) as {text}) end"),
    "inventory_on_hand": (("part",), "p_size"),
    "delivery_days": ((), f"1 + {_M}"),
    "shipping_status": ((), f"case {_M} when 13 then 'Delayed' when 12 then 'LATE - carrier' when 7 then 'Exception' "
                            f"when 5 then 'exception: address' when 10 then null else 'Delivered' end"),
    "return_flag": ((), "case l_returnflag when 'R' then 'Yes' when 'A' then 'no' end"),
    "region": (("orders", "customer", "nation", "region"), "r_name"),
}
OPS_COLUMNS = tuple(c for c in COLUMNS if c != "region")
# What is left under the baseline mode: two columns go by header, one by its values.
SAFE_COLUMNS = tuple(c for c in OPS_COLUMNS if c not in ("order_id", "customer_name", "contact"))
# Strict mode also drops the status, so delays are judged by duration.
STRICT_COLUMNS = tuple(c for c in SAFE_COLUMNS if c != "shipping_status")

# Dimension -> (its key, the key that points to it), in join order.
_JOINS = {
    "orders": ("o_orderkey", "l_orderkey"),
    "part": ("p_partkey", "l_partkey"),
    "customer": ("c_custkey", "o_custkey"),
    "nation": ("n_nationkey", "c_nationkey"),
    "region": ("r_regionkey", "n_regionkey"),
}


# Column -> SQL over ``customer``. Headers announce cards and postal codes for some columns only, so the same values
# count in one column and not in another.
PEOPLE: dict[str, str] = {
    "member_ref": "concat('M', cast(c_custkey as {text}), 'x')",
    "order_id": "concat('K', cast(c_custkey as {text}))",
    "invoice_id": "cast(c_custkey % 7 as {text})",
    "tax_note": "concat('no ', lpad(cast(c_custkey % 900 + 100 as {text}), 3, '0'), '-', '45', '-', lpad(cast(c_custkey as {text}), 4, '0'))",
    "tax_near": "concat('12-', lpad(cast(c_custkey as {text}), 4, '0'))",
    "card_no": "concat('4111 1111 1111 ', lpad(cast(c_custkey % 10000 as {text}), 4, '0'))",
    "batch_no": "concat('4111 1111 1111 ', lpad(cast(c_custkey % 10000 as {text}), 4, '0'))",
    "zip_area": "lpad(cast(c_custkey % 90000 + 10000 as {text}), 5, '0')",
    "area_no": "lpad(cast(c_custkey % 90000 + 10000 as {text}), 5, '0')",
}


#: Portions that ``staged_ops`` joins one after the other.
PORTIONS = 4


def _shown(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select(*[F.expr(COLUMNS[c][1].format(text="string")).alias(c) for c in columns])


def ops(spark: SparkSession, sf_dir: str, columns: Sequence[str] = OPS_COLUMNS) -> DataFrame:
    """The fixture with the columns asked for.

    Dimensions are joined from the left on their primary keys, so leaving out one whose columns are not
    asked for changes no row.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needed = {table for c in columns for table in COLUMNS[c][0]}
    rows = read("lineitem")
    for table, (key, pointer) in _JOINS.items():
        if table in needed:
            rows = rows.join(read(table), F.col(pointer) == F.col(key), "left")
    return _shown(rows, columns)


def staged_ops(spark: SparkSession, sf_dir: str, folder: str, columns: Sequence[str] = OPS_COLUMNS) -> DataFrame:
    """The same rows, joined once and written to a folder, for jobs that read their source several times.

    Rows are dealt by order key into portions that are joined one after the other, so that the shuffle files of one are on the
    disks at a time. Orders meet their customers before they meet the rows, which are shuffled for their part and their order only.
    """
    needed = {table for c in columns for table in COLUMNS[c][0]}

    def joined(rows: DataFrame, table: str, other: DataFrame | None = None) -> DataFrame:
        key, pointer = _JOINS[table]
        return rows.join(spark.read.parquet(f"{sf_dir}/{table}.parquet") if other is None else other, F.col(pointer) == F.col(key), "left")

    with shuffles_removed(spark):
        for i in range(PORTIONS):
            portion = lambda table, key: spark.read.parquet(f"{sf_dir}/{table}.parquet").where(F.pmod(F.xxhash64(key), F.lit(PORTIONS)) == i)
            rows = portion("lineitem", "l_orderkey")
            if "part" in needed:
                rows = joined(rows, "part")
            if "orders" in needed:
                orders = portion("orders", "o_orderkey")
                for table in _JOINS:
                    if table in needed - {"orders", "part"}:
                        orders = joined(orders, table)
                rows = joined(rows, "orders", orders)
            shown = _shown(rows, columns)
            shown.write.mode("append").option("compression", CODEC).parquet(folder)
    return spark.read.schema(shown.schema).parquet(folder)


def ops_sql() -> str:
    """The same rows, all columns, as SQL for the other engine."""
    joins = " ".join(f"left join {t} on {pointer} = {key}" for t, (key, pointer) in _JOINS.items())
    columns = ", ".join(f"{sql.format(text='varchar')} as {c}" for c, (_, sql) in COLUMNS.items())
    return f"select {columns} from lineitem {joins}"
