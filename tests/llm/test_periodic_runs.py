"""Runs against every lag compared word by word, and the query against a plain version of all its columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.llm import periodic_runs
from opslens.llm.queries import op12_periodic_runs


def plain_runs(words):
    found = []
    for q in range(1, len(words) // 3 + 1):
        same = [a == b for a, b in zip(words, words[q:])] + [False]
        start = None
        for x, agrees in enumerate(same):
            if agrees and start is None:
                start = x
            if not agrees and start is not None:
                part = words[start:x + q]
                if len(part) >= max(24, 3 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((start, len(part), q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rnd):
    words, kinds, n = [], rnd.choice([1, 2, 3, 5, 50]), rnd.randint(0, 260)
    while len(words) < n:
        unit = [rnd.randrange(kinds) for _ in range(rnd.randint(1, 30))]
        if rnd.random() < 0.4:
            words += unit
        else:
            other = [*unit[:len(unit) // 2], 99, *unit[len(unit) // 2 + 1:]]
            unit = unit + unit + other + other if rnd.random() < 0.5 else unit
            words += (unit * 6)[:rnd.randint(1, 5 * len(unit))]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_all_lags(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        words = random_words(rnd)
        assert periodic_runs.runs_of(np.array(words, np.int64)) == plain_runs(words)


def test_units_in_which_every_seed_occurs_twice():
    border = list(range(20))
    x, y = [*border, 100, *border], [*border, 200, 201, *border]
    words = [7, 7, 7, *(x + x + y + y) * 4, 8, 9]
    assert periodic_runs.runs_of(np.array(words)) == plain_runs(words) == [(3, 664, 166)]


def test_long_texts_take_time_in_proportion():
    n = 400_000
    assert periodic_runs.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic_runs.runs_of(np.arange(n) % 70_000) == [(0, n, 70_000)]
    assert periodic_runs.runs_of(np.arange(n)) == []


def test_strongest_and_collapsed():
    assert periodic_runs.strongest([(0, 30, 10), (5, 24, 8), (40, 24, 8)]) == (0, 30, 10)
    assert periodic_runs.strongest([]) is None
    words = [str(i % 3).encode() for i in range(30)] + [b"x"]
    assert periodic_runs.collapsed(words, [(0, 30, 3)]) == "0 1 2 x"


def test_odd_rows(odd, nothing):
    rows = {r.doc_id: r for r in periodic_runs.with_runs(odd).where("doc_id is not null").collect()}
    assert rows[6].collapsed == "word" and rows[6].runs == [(0, 30_000, 1)] and rows[6].strongest == (0, 30_000, 1)
    assert [rows[i].collapsed for i in (1, 2, 3)] == ["", "", ""] and rows[1].strongest is None and rows[1].score == "score!"
    assert periodic_runs.with_runs(odd).count() == odd.count() and periodic_runs.with_runs(nothing).count() == 0
    named = odd.selectExpr("doc_id", "text", "1 as runs", "2 as collapsed", "'x' as search")
    assert periodic_runs.with_runs(named).columns == ["doc_id", "text", "search", "runs", "strongest", "collapsed"]


def test_query_against_a_plain_version(spark, sf_dir, tmp_path):
    from opslens.llm.periodic_runs import digests, planted, with_runs

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(i, t) for i, t in zip(range(10_000, 10_400), ["", None, "a", "a b", " \n", "x y " * 40, " ".join(map(str, range(100)))] * 60)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([*extra, (None, "a " * 30)], "doc_id long, text string"))
    found = {r.doc_id: r for r in digests(with_runs(more, planted(F.col("doc_id"), F.col("text")), ["doc_id"])).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted_some = 0
    for row in more.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        h = zlib.crc32(str(row.doc_id).encode()) if row.doc_id is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted_some += 1
        runs = plain_runs(words) if len(words) < 1500 else periodic_runs.runs_of(periodic_runs.numbers_of([w.encode() for w in words]))
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        milli = best[1] * 1000 // best[2] if runs else None
        assert tuple(found[row.doc_id]) == (row.doc_id, len(runs), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
                                            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    assert planted_some > 30
    assert op12_periodic_runs(spark, sf_dir).count() == docs.count()
