"""Document fingerprints from prefix polynomial hashes.

With H(i) the sum of c(j) * b**j over the first i code points, modulo a prime, the hash of any span is a difference of two
prefix hashes, so spans compare in constant time and the longest common extension of two places is a binary search.

A fingerprint holds the length and hash of a text, and hashes of its prefixes and suffixes of geometrically growing lengths.
Whether two texts share a prefix is monotone in its length, so two fingerprints give the longest common prefix and
suffix, down to the next smaller grid length, by binary search.

It also holds the spans between anchors: places that the characters before them make anchors, so an edit changes the spans it
touches and no others. The likeness is the share of the longer text that the common prefix, the common suffix and the common spans cover.
Longer texts have longer spans, so that there are some hundreds at most; a text keeps the spans of the next longer class too.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
#: Grid lengths in each doubling.
STEPS = 6
#: Code points hashed together.
CHUNK = 1_000_000
HEX = 8
#: Texts of fewer code points have no spans.
SPANNED = 64
#: Characters of a span are about 2 ** LEVEL, twice that for each doubling from 2 ** FINE characters on.
LEVEL, FINE = 5, 12
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9))


class _Powers:
    """Powers of the bases and of their inverses, as far as needed so far."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def upto(self, n: int) -> None:
        while len(self.up[0]) < n:
            for table, factors in ((self.up, BASES), (self.down, [pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True)])):
                for k, p in enumerate(PRIMES):
                    step = pow(factors[k], len(table[k]), p)
                    table[k] = np.concatenate([table[k], table[k] * np.uint64(step) % np.uint64(p)])


_powers = _Powers()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class PrefixHashes:
    """Prefix hashes of one text."""

    def __init__(self, text: str):
        points = _points(text).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        _powers.upto(self.n + 1)
        self.sums = [
            np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * _powers.up[k][: self.n] % np.uint64(p))]) for k, p in enumerate(PRIMES)]

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Hash of a span, alike for equal texts wherever they stand."""
        return tuple(
            int(s[end] - s[start]) % p * int(_powers.down[k][start]) % p for k, (s, p) in enumerate(zip(self.sums, PRIMES, strict=True)))

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common text from place ``i`` here and place ``j`` there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low


def grid(n: int) -> np.ndarray:
    """Grid lengths up to ``n``, ascending; the same for all texts."""
    if n < 1:
        return np.zeros(0, np.int64)
    steps = np.floor(2.0 ** (np.arange(STEPS * (int(n).bit_length() + 1)) / STEPS)).astype(np.int64)
    steps = np.unique(steps)
    return steps[steps <= n]


def level(n: int) -> int:
    """The class of the spans of a text of ``n`` code points."""
    return LEVEL + max(0, n.bit_length() - FINE)


def _anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places after which a span may end, and the hash of the eight characters before each."""
    mixed = points
    for step, factor in zip((1, 2, 4), _MIX, strict=False):
        mixed = np.concatenate([mixed[:step], mixed[:-step] * factor + mixed[step:]])
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[3]
    at = np.flatnonzero(mixed >> np.uint64(64 - LEVEL) == 0)
    return at + 1, mixed[at]


def _cuts(places: np.ndarray, hashes: np.ndarray, n: int, of: int) -> np.ndarray:
    """Bounds of the spans of class ``of`` of a text, from 0 to ``n``; none is shorter than a quarter of the usual length but
    the last."""
    cuts, least = places[hashes >> np.uint64(64 - of) == 0], 1 << (of - 2)
    if len(cuts) and (cuts[0] < least or (np.diff(cuts) < least).any()):
        kept, last = [], 0
        for c in cuts.tolist():
            if c - last >= least:
                kept.append(c)
                last = c
        cuts = np.array(kept, np.int64)
    return np.concatenate([[0], cuts, [n]])


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of some texts, hashed together."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts])
    points = _points("".join(texts)).astype(np.uint64) + np.uint64(1)
    longest = int(sizes.max())
    _powers.upto(longest + 1)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    places = np.arange(len(points)) - np.repeat(starts, sizes)
    full = grid(longest)
    many = np.searchsorted(full, sizes, side="right")
    doc = np.repeat(np.arange(len(texts)), many)
    first = np.cumsum(many) - many
    length = full[np.arange(len(doc)) - np.repeat(first, many)]
    totals, edges = [], None
    for k, p in enumerate(PRIMES):
        prime = np.uint64(p)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * _powers.up[k][places] % prime)])
        totals.append((sums[ends] - sums[starts]) % prime)
        if k == 0:
            front = (sums[starts[doc] + length] - sums[starts[doc]]) % prime
            left = sizes[doc] - length
            back = (sums[ends[doc]] - sums[ends[doc] - length]) % prime * _powers.down[k][left] % prime
            edges = np.stack([front, back], axis=1).astype(">u4")
            spans, bounds = _spans(points, sums, starts, sizes)
    found = []
    for i, n in enumerate(sizes.tolist()):
        own = edges[first[i] : first[i] + many[i]]
        found.append(f"{n}.{int(totals[0][i]):08x}{int(totals[1][i]):08x}.{own[:, 0].tobytes().hex()}.{own[:, 1].tobytes().hex()}"
                     f".{spans[bounds[2 * i] : bounds[2 * i + 1]].tobytes().hex()}.{spans[bounds[2 * i + 1] : bounds[2 * i + 2]].tobytes().hex()}")
    return found


def _spans(points: np.ndarray, sums: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, length) of the spans of each text, of its own class and of the next longer one; and where each begins."""
    places, hashes = _anchors(points)
    first, last = np.searchsorted(places, starts + HEX), np.searchsorted(places, starts + sizes)
    begins, ends, bases, many = [], [], [], [0]
    for a, b, start, n in zip(first.tolist(), last.tolist(), starts.tolist(), sizes.tolist(), strict=True):
        own = level(n)
        for of in (own, own + 1):
            # texts below half of the next class differ too much from those in it
            if n < SPANNED or of > own and n < 1 << (FINE - 1):
                many.append(0)
                continue
            cuts = _cuts(places[a:b] - start, hashes[a:b], n, of)
            begins.append(cuts[:-1])
            ends.append(cuts[1:])
            bases.append(np.full(len(cuts) - 1, start))
            many.append(len(cuts) - 1)
    if not begins:
        return np.zeros((0, 2), ">u4"), np.zeros(len(many), np.int64)
    begin, end, base = np.concatenate(begins), np.concatenate(ends), np.concatenate(bases)
    prime = np.uint64(PRIMES[0])
    hashed = (sums[base + end] - sums[base + begin]) % prime * _powers.down[0][begin] % prime
    return np.stack([hashed, (end - begin).astype(np.uint64)], axis=1).astype(">u4"), np.cumsum(many)


def _listed(x: list[str], of: int) -> list[str]:
    """The spans of class ``of`` of a fingerprint's parts; none where it has no such class."""
    own = level(int(x[0]))
    part = x[4] if of == own else x[5] if of == own + 1 else ""
    return [part[i : i + 2 * HEX] for i in range(0, len(part), 2 * HEX)]


def _covered(spans: list[str], n: int, head: int, tail: int, common: Counter) -> int:
    """Characters of a text in common spans, in its first ``head`` or in its last ``tail`` characters."""
    left, at, found = dict(common), 0, 0
    for s in spans:
        end = at + int(s[HEX:], 16)
        if left.get(s, 0):
            left[s] -= 1
            found += end - at
        else:
            found += min(end - at, max(0, min(end, head) - at) + max(0, end - max(at, n - tail)))
        at = end
    return found


def likeness(a: str, b: str) -> float:
    """Share of the longer text that the common prefix, the common suffix and the common spans of two fingerprinted texts cover; 1
    for equal texts. Texts below SPANNED code points, and one of less than half the length of the other at a class
    border, are compared by prefix and suffix alone."""
    x, y = a.split("."), b.split(".")
    if x[:2] == y[:2]:
        return 1.0
    n, m = int(x[0]), int(y[0])
    if not n or not m:
        return 0.0
    lengths, ends = grid(min(n, m)), []
    for part in (2, 3):
        low, high = 0, len(lengths)
        while low < high:
            mid = (low + high + 1) // 2
            at = slice((mid - 1) * HEX, mid * HEX)
            if x[part][at] == y[part][at]:
                low = mid
            else:
                high = mid - 1
        ends.append(int(lengths[low - 1]) if low else 0)
    covered = min(sum(ends), n, m)
    of = max(level(n), level(m))
    own, others = _listed(x, of), _listed(y, of)
    if not set(own).isdisjoint(others):
        common = Counter(own) & Counter(others)
        covered = min(_covered(own, n, *ends, common), _covered(others, m, *ends, common))
    return covered / max(n, m)


def _batches(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield work(batch)


def fingerprint_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows with a column ``fingerprint`` of their text; null texts count as empty. An input column of that name gives
    way."""
    @pandas_udf("string")
    def of(texts):
        found, held, size = [], [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size > CHUNK:
                found, held, size = found + fingerprints(held), [], 0
        return pd.Series(found + fingerprints(held), dtype=object)

    return docs.withColumn("fingerprint", of(F.col(text).cast("string")))


def common_extensions(pairs: DataFrame) -> DataFrame:
    """Rows (a, i, b, j) with a column ``length``: the longest common text from place i of a and place j of b. Nulls count as
    empty texts and place 0; places beyond a text have length 0."""
    names = list(pairs.columns)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for r in batch.select(["a", "i", "b", "j"]).to_pylist():
            a, b, i, j = r["a"] or "", r["b"] or "", max(0, r["i"] or 0), max(0, r["j"] or 0)
            inside = i <= len(a) and j <= len(b)
            found.append(PrefixHashes(a).extension(i, PrefixHashes(b), j) if inside else 0)
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.int64())], names=[*names, "length"])

    schema = pairs.select(*names, F.lit(0).cast("long").alias("length")).schema
    return pairs.mapInArrow(lambda it: _batches(it, work), schema)


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, closing, doc_id, text): the documents cut into ranges of ascending doc_id, each range followed by a closing
    row with the first document after it (after the last range, the first of all).

    Range bounds are approximate quantiles of the ids (``parts`` numbers on the driver, of any input), so a row's range
    follows from its id alone and a lost task comes back the same. Null ids are in the first range and sort first; equal
    ids sort by their texts' hash.
    """
    shares = [i / parts for i in range(1, parts)]
    bounds = np.unique(docs.approxQuantile("doc_id", shares, 0.25 / parts)) if shares else np.zeros(0)

    @pandas_udf("long")
    def part_of(ids):
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(-np.inf).to_numpy(float), side="right")))

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "part": part_of(F.col("doc_id").cast("double"))})
    # one row for each range
    firsts = rows.groupBy("part").agg(F.min(F.struct("doc_id", "hash")).alias("first")).select("part", "first.*")
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ahead = firsts.select("part", F.col("doc_id").alias("first_id"), F.col("hash").alias("first_hash"), before.alias("closes"))
    same = rows["doc_id"].eqNullSafe(ahead["first_id"]) & (rows["hash"] == ahead["first_hash"]) & (rows["part"] == ahead["part"])
    closing = (
        rows.join(F.broadcast(ahead), same).select(F.col("closes").alias("part"), F.lit(True).alias("closing"), "doc_id", "hash", "text")
        .dropDuplicates(["part"]))
    both = rows.select("part", F.lit(False).alias("closing"), "doc_id", "hash", "text").unionByName(closing)
    return both.repartition("part").sortWithinPartitions("part", "closing", "doc_id", "hash").select("part", "closing", "doc_id", "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def work() -> pa.RecordBatch:
        """All rows held but the last, whose next is not known yet."""
        own, after, ids, edited = [], [], [], []
        for (_, closing, doc_id, text), (_, _, _, following) in zip(held, held[1:], strict=False):
            if closing:
                continue
            half = len(text) // 2
            own.append(text)
            after.append(following)
            ids.append(doc_id)
            edited.append(text[: len(text) - half] + following[:half])
        prints = fingerprints(own)
        changed = fingerprints(edited)
        known = dict(zip(own, prints, strict=True))
        missing = [t for t in after if t not in known]
        known.update(zip(missing, fingerprints(missing), strict=True))
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(prints, pa.string()), pa.array(changed, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(prints, changed, strict=True)], pa.float64()),
            pa.array([likeness(a, known[t]) for a, t in zip(prints, after, strict=True)], pa.float64()),
        ], names=[x.split()[0] for x in EDITED.split(", ")])

    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            held.append(row)
            size += len(row[3])
            if size > CHUNK and len(held) > 1:
                yield work()
                held, size = held[-1:], len(held[-1][3])
    yield work()


def edited_fingerprints(docs: DataFrame, parts: int) -> DataFrame:
    """For each document, fingerprints of its text and of its edited text (the second half, rounded down, replaced by as much
    of the beginning of the next document by id), the edited text's sha256, and the likenesses to it and to the next text.

    Null texts are empty; an empty text is edited into an empty one, likeness 1. The next document of the last is the
    first, that of a single one itself. Repeated rows are neighbours like any others. An empty table gives an empty result.
    """
    return neighbours(docs, parts).mapInArrow(_edited, EDITED)
