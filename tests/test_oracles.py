"""Every query against its SQL counterpart in DuckDB."""

import datetime
import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
OWN = lambda found: {name: x for name, x in found.items() if name != "pipeline" and not re.match(r"op\d+_", name)}
QUERIES, ORACLES = OWN(entry.queries()), OWN(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(plain(row[i])) for i in order) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    expected = duck.execute(ORACLES[name])
    types = {c[0]: str(c[1]) for c in expected.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert canonical(df.columns, df.collect()) == canonical(list(types), expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
