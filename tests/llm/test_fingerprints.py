"""Prefix hashes, likenesses and edited documents against brute force."""

import hashlib
import os
import random

from hypothesis import given, settings, strategies as st

from opslens.llm.fingerprints import PrefixHashes, common_extensions, edited_fingerprints, fingerprint_column, fingerprints, grid, likeness

SHORT = st.text(alphabet="abé", max_size=30)


@settings(max_examples=200, deadline=None)
@given(SHORT, SHORT, st.integers(0, 30), st.integers(0, 30))
def test_extensions_and_spans(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    x, y = PrefixHashes(a), PrefixHashes(b)
    n = x.extension(i, y, j)
    assert n == len(os.path.commonprefix([a[i:], b[j:]])) and x.span(i, i + n) == y.span(j, j + n)


@settings(max_examples=200, deadline=None)
@given(SHORT, SHORT)
def test_likeness_follows_common_ends(a, b):
    x, y = fingerprints([a, b])
    assert (x == y) == (a == b) and fingerprints([b])[0] == y
    if a == b:
        return
    front, back = len(os.path.commonprefix([a, b])), len(os.path.commonprefix([a[::-1], b[::-1]]))
    steps = grid(min(len(a), len(b))).tolist()
    down = lambda n: max([s for s in steps if s <= n], default=0)
    assert likeness(x, y) == (min(down(front) + down(back), len(a), len(b)) / max(len(a), len(b)) if steps else 0.0)


def test_likeness_of_scattered_edits():
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9))) for _ in range(n))
    for words, least in ((150, 0.6), (600, 0.85), (620, 0.85), (640, 0.85), (3000, 0.9), (20_000, 0.9)):
        text = prose(words)
        cut = len(text) // 10
        edited = text[:cut] + "X" + text[cut + 1 : -cut] + " and more" + text[-cut:]  # an edit near each end
        a, b, other = fingerprints([text, edited, prose(words)])
        assert least < likeness(a, b) < 1 and likeness(a, b) == likeness(b, a) and likeness(a, other) < 0.05
        assert fingerprints([edited])[0] == b and len(a) < 40_000
    # a move keeps most spans, and so does a length just over the border of a class
    text = prose(1200)[:4090]
    a, b, c = fingerprints([text, text[2000:] + text[:2000], "Y" + text[:3000] + "123456789" + text[3000:] + "Z"])
    assert likeness(a, b) > 0.85 and likeness(a, c) > 0.8
    assert len(fingerprints(["word " * 30_000])[0]) < 40_000


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + following[:half], following


def test_edited_documents(spark):
    rows = [(i * 3 % 101, None if i % 9 == 4 else "é" * (i % 4) + f"text {i} " * (i % 13)) for i in range(101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 as part", "'x' as closing")
    for parts in (1, 7, 300):
        got = {r.doc_id: r for r in edited_fingerprints(docs, parts).collect()}
        assert len(got) == 101
        for i, text, edited, following in brute(rows):
            prints = fingerprints([text, edited, following])
            r = got[i]
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (
                len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1])
            assert (r.near_edited, r.near_next) == (likeness(*prints[:2]), likeness(prints[0], prints[2]))


def test_odd_documents(odd, nothing, spark):
    rows = edited_fingerprints(odd, 4).collect()
    assert len(rows) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2)} == set(fingerprints([""]))
    assert edited_fingerprints(nothing, 4).count() == 0
    one = edited_fingerprints(odd.where("doc_id = 0"), 4).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    text = odd.where("doc_id = 0").first().text
    half = len(text) // 2
    assert one[0].edited_sha256 == hashlib.sha256((text[: len(text) - half] + text[:half]).encode()).hexdigest()
    assert fingerprint_column(odd).where("fingerprint = 'fingerprint!'").count() == 0
    pairs = spark.createDataFrame([("hello world", 6, "a world", 2), (None, 0, "x", 0), ("a", 5, "a", 0)], "a string, i long, b string, j long")
    assert [r.length for r in common_extensions(pairs).collect()] == [5, 0, 0]
