"""Mixing and sharding: targets against water filling, copies, and even cuts."""

from collections import Counter, defaultdict

import pytest

from opslens.llm.mixing import mix, mixed
from opslens.llm.sharding import shard


def filled(sizes, weights, cap=3):
    left, open_, found = sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > cap * sizes[s]}
        for s in over or open_:
            found[s] = cap * sizes[s] if over else level * weights[s]
        left -= sum(found[s] for s in over)
        open_ = open_ - over if over else set()
    return found


@pytest.mark.parametrize("sizes", [[10, 10, 10, 10], [1, 500, 1000, 3], [1, 1, 1, 1, 1, 5000], [7], [0, 9, 0]])
def test_targets(spark, sizes):
    rows = [(s * 10_000 + i, None if s == len(sizes) - 1 else f"s{s}", 1) for s, n in enumerate(sizes) for i in range(max(n, 1))]
    rows = [(i, s, 0 if n_of == 0 else z) for (i, s, z), n_of in zip(rows, [n for n in sizes for _ in range(max(n, 1))], strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long")
    from pyspark.sql import functions as F

    got = mix(docs, size=F.col("words")).collect()
    wanted = filled(dict(enumerate(sizes)), {i: (5, 2, 1)[i % 3] for i in range(len(sizes))})
    number = {**{f"s{i}": i for i in range(len(sizes) - 1)}, None: len(sizes) - 1}
    taken = Counter()
    for r in got:
        k = number[r.source]
        assert r.source_size == sizes[k] and r.target == pytest.approx(wanted[k]) and 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[k] += r.taken
    assert all(abs(taken[k] - wanted[k]) <= 1 for k in wanted)
    again = {(r.doc_id, r.copies) for r in mix(docs.repartition(3), size=F.col("words")).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_mix_of_odd_documents(odd, nothing):
    rows = mix(odd).collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(mix(odd).columns)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[1][0].size == by_id[2][0].size == by_id[3][0].size == 0 and by_id[6][0].size == 30_000 and by_id[7][0].size == 3
    out = mixed(odd)
    assert out.columns == odd.columns
    assert sum(len((r.text or "").split()) for r in out.where("doc_id <> 7").collect()) == sum(r.taken for r in rows if r.doc_id != 7 and r.doc_id is not None)
    assert mix(nothing).count() == 0 and mixed(nothing).count() == 0


def test_shards(spark, odd, nothing):
    docs = spark.range(1003).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('s', id % 7) end as source")
    rows = shard(docs, 16).collect()
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for k, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(n))
    whole = Counter(r.source for r in rows)
    for s, n in whole.items():
        held = Counter(r.shard for r in rows if r.source == s)
        assert all(abs(held[k] - n / 16) < 2 for k in range(16))
    assert {(r.doc_id, r.shard, r.slot) for r in shard(docs.repartition(5), 16).collect()} == {(r.doc_id, r.shard, r.slot) for r in rows}
    few = shard(odd, 4).collect()
    assert len(few) == odd.count() and max(Counter(r.shard for r in few).values()) <= 3
    assert shard(nothing, 4).count() == 0
    assert sorted(r.shard for r in shard(docs.limit(2), 16).collect()) == [0, 8]
