"""Queries with SQL against DuckDB, and the pipeline against plain versions of its stages."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from opslens.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    expected = con.execute(oracles.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, expected.fetchall()))


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.queries()) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.staged(stage(spark, kept[-1], sf_dir), "test-stage"))
        assert name == "tokens" or kept[-1].columns == columns
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept[:5]]
    assert set(rows[1]) < set(rows[0]) and set(rows[2]) < set(rows[1]) and set(rows[3]) < set(rows[2]) and set(rows[4]) <= set(rows[3])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = set(rows[0]) - set(rows[1])
    assert sum(labels.get(i) == 1 for i in gone) > 0.6 * sum(labels.get(i) == 1 for i in rows[0])
    sets = {}
    for i, text in rows[1].items():
        w = text.encode().lower().split()
        sets[i] = set(zip(w, w[1:], w[2:], strict=False)) or {tuple(w)}
    for a in rows[2]:
        for b in rows[2]:
            assert b <= a or 100 * len(sets[a] & sets[b]) < 90 * len(sets[a] | sets[b])
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(item in text for text in rows[3].values() for item in items)
    assert all(any(item[:60] in text or item[-60:] in text for item in items) for i, text in rows[2].items() if i not in rows[3])
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    start = 0
    final = sorted(kept[5].collect(), key=lambda r: r.start)
    for r in final:
        ids = tokenizer.encode(rows[4][r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(final) == kept[4].count()
