"""Clusters against plain distances in Python's whole numbers."""

import hashlib
import random

import numpy as np
import pytest

from opslens.llm import bisectors

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, k, dim, rounds):
    import math

    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (key(r), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else old for c, old in enumerate(centroids)]
    near = [(i, c := nearest(v), far(v, centroids[c])) for i, v in kept]
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return [(i, c, d, sum(e for _, o, e in near if o == c), sum(e for *_, e in near), sha(c)) for i, c, d in near]


def checked(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "own") for i, v in rows], SCHEMA)
    found = [tuple(r) for r in bisectors.clustered(frame, **options).collect()]
    # components as the table holds them
    stored = [(r.vec_id, r.embedding) for r in frame.collect()]
    expected = plain(stored, options.get("k", 8), options.get("dim", 64), options.get("rounds", 10))
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    return found


def test_odd_vectors(spark):
    rnd = random.Random(1)
    vector = lambda: [rnd.gauss(0, 1) for _ in range(64)]
    rows = [(i, vector()) for i in range(60)]
    rows += [(100, None), (101, []), (102, vector()[:63]), (103, vector()[:63] + [None]), (104, vector()[:63] + [float("nan")]),
             (105, vector()[:63] + [float("inf")]), (106, [0.0] * 64), (107, [-0.0] * 64), (None, vector()), rows[0], rows[0], (3, vector())]
    found = checked(spark, rows)
    assert len(found) == 66


def test_ties_go_to_the_smaller_number(spark):
    # two values only: many points lie on bisectors, clusters run empty
    rnd = random.Random(2)
    checked(spark, [(i, [float(rnd.randint(0, 1)) for _ in range(4)]) for i in range(120)], dim=4, k=9, rounds=4)
    checked(spark, [(i, [1.0, 2.0]) for i in range(30)], dim=2, k=5, rounds=2)


def test_few_and_no_vectors(spark):
    checked(spark, [(1, [0.5, 1.0]), (2, [3.0, 1.0])], dim=2)
    assert bisectors.clustered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_components_are_cut_off(spark):
    frame = spark.createDataFrame([(1, [3e38] * 64, ""), (2, [-3e38] * 64, ""), (3, [0.0] * 64, "")], SCHEMA)
    rows = {r.vec_id: r for r in bisectors.clustered(frame, k=1, rounds=1).collect()}
    assert rows[1].distance == rows[2].distance == 64 * (1 << 26) ** 2 and rows[3].distance == 0


@pytest.mark.parametrize("k", [1, 2, 7])
def test_winners_are_the_nearest(k):
    rng = np.random.default_rng(k)
    centroids, points = rng.integers(-9, 9, (k, 3)), rng.integers(-9, 9, (2000, 3))
    found = bisectors.Bisectors.of(centroids.tolist())
    winners = found.winners(points)
    apart = ((points[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (winners == apart.argmin(axis=1)).all() and (found.distances(points, winners) == apart.min(axis=1)).all()
