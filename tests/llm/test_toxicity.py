"""Toxicity: the kernel, held-out accuracy, and disguised words."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from opslens.llm import toxicity as t


def slow_kernel(a, b):
    """Subsequences of three characters over words with borders, weighted by the stretch they cover."""
    def counts(word):
        codes = [t._START, *(t._letter(c) for c in word), t._END]
        found = {}
        for i in range(len(codes)):
            for j in range(i + 1, len(codes)):
                for k in range(j + 1, min(len(codes), i + t.SPAN)):
                    u = (codes[i], codes[j], codes[k])
                    found[u] = found.get(u, 0) + t.DECAY ** (k - i + 1)
        return found

    x, y = counts(a), counts(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_kernel():
    words = ["idiot", "idiiot", "banana", "xy", "anthropomorphization", "élan"]
    got = t.features(words, t.Spread.of(words))
    expected = [[slow_kernel(a, b) for b in words] for a in words]
    assert np.allclose(got, expected, atol=1e-4)


def test_tokens():
    distinct, numbers, sizes = t.tokens(pa.array(["An i d i o t here", "", "a b", "x"], pa.large_string()))
    words = [[distinct[k] for k in run] for run in np.split(numbers, np.cumsum(sizes)[:-1])]
    assert words == [["an", "i", "d", "i", "o", "t", "here", "idiot"], [""], ["a", "b"], ["x"]]
    assert t.parts("i.d-i*o_t!") == ["idiot"] and t.parts("!") == [] and t.parts("ab" * 40)[-1].endswith("ab")
    assert len("".join(t.parts("x" * 500))) >= 500


@pytest.fixture(scope="module")
def rows(spark):
    d = "/root/testdata/sf0.1"
    joined = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    return joined.select("doc_id", "text", "toxic").orderBy("doc_id").collect()


def test_held_out_accuracy(rows):
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    learn = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    model = t.fit([r.text for r in learn], [r.toxic for r in learn])
    scorer = t.Scorer(model)
    score, y = scorer.scores(pa.array([r.text for r in out], pa.large_string())), np.array([r.toxic for r in out]) == 1
    said = score >= t.THRESHOLD
    assert (said & y).sum() / y.sum() > 0.85 and (said & y).sum() / said.sum() > 0.92 and (said & ~y).mean() < 0.01
    clean = "The of and is onent thor reand ble tion. " * 5
    texts = [clean + x for x in ("", " an idiot", " an i.d.i.o.t", " an i d i o t", " an idiiot", " an id-iot")]
    scores = scorer.scores(pa.array(texts, pa.large_string()))
    assert (scores[1:] > 10 * scores[0]).all() and (scores[2:] > 0.7 * scores[1]).all()
    assert scorer.scores(pa.array([None, ""], pa.large_string())).tolist() == scorer.scores(pa.array(["", ""], pa.large_string())).tolist()


def test_without_labels_of_both_classes():
    model = t.fit(["a b", "c"], [0, 0])
    assert 0 < t.Scorer(model).scores(pa.array(["x"], pa.large_string()))[0] < 0.5
    assert t.fit([], []).bias == -1.0


def test_driver_does_not_fit(spark, monkeypatch):
    learn = [(i, f"some words {'moron' if i % 2 else 'lovely'} and {i % 7} more", i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, x) for i, x, _ in learn], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in learn], "doc_id long, toxic int")
    order = sorted(learn, key=lambda r: hashlib.md5(f"{r[0]}/{r[1]}".encode()).hexdigest())
    expected = t.fit([x for _, x, _ in order], [k for *_, k in order])

    def fit(texts, toxic):
        raise AssertionError("fitted by the driver")

    monkeypatch.setattr(t, "fit", fit)
    model = t.trained(docs, labels)
    assert model.direction.any() and (model.direction == expected.direction).all()
    assert model.bias == expected.bias and (model.curve == expected.curve).all()
    monkeypatch.undo()
    assert t.trained(docs.where("false"), labels).bias == -1.0 and not t.trained(docs, labels.where("toxic = 0")).direction.any()


def test_frames(spark, odd, nothing):
    learn = [(i, f"some words {w} and more of them {i % 7}", k) for i in range(60) for w, k in ((("moron" if i % 2 else "lovely"), i % 2),)]
    docs = spark.createDataFrame([(i, x) for i, x, _ in learn], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in learn] + [(None, 1), (3, None), (4000, 1)], "doc_id long, toxic int")
    model = t.trained(docs, labels)
    found = t.scored(odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    more = odd.unionByName(spark.createDataFrame([(70, "you moron you")], "doc_id long, text string"), allowMissingColumns=True)
    kept = t.clean(more, model)
    assert kept.columns == more.columns and kept.where("doc_id = 70").count() == 0 and kept.where("doc_id = 0").count() == 1
    assert t.scored(nothing, model).count() == 0
    ids = [0, 5, 17, None]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    assert [r[0] for r in frame.select(t.held_out(frame["doc_id"])).collect()] == [zlib.crc32(str(i).encode()) % 3 == 1 if i is not None else False for i in ids]
