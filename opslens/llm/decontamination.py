"""Benchmark decontamination by the q-gram lemma.

Texts are compared by their letters and digits in lower case. A benchmark item is cut into overlapping patterns of up to
WINDOW characters, STRIDE apart, so a passage of an item is found too: one of WINDOW + STRIDE - 1 characters or more holds a
whole pattern, and one of WINDOW characters all but STRIDE / 2 characters of one, which count as edits. A pattern of m characters that occurs with at most e edits leaves
m - q + 1 - q * e of its q-grams in place, and all of these lie on neighbouring diagonals (place in the document minus
place in the pattern), e + 1 of them at most. Shared q-grams are counted in bands of 2 (e + 1) diagonals that overlap by half, so
that one band holds them all; bands that reach the count are aligned within the band, and those with at most e edits stay.

Items are looked up in blocks of a bounded size, so the benchmark may grow; documents are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

Q = 10
WINDOW = 100
STRIDE = 10
#: Edits allowed for each character of a pattern.
ERROR_RATE = 0.06
#: Items with fewer letters and digits than this are found unedited only, and as whole words; with fewer than Q not at all.
SHORTEST = 30
#: Scripts that put no spaces between words.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: Characters of a block of items, which every task holds, and of documents compared together.
BLOCK = 4_000_000
CHUNK = 150_000
#: Candidates aligned together.
TOGETHER = 256
#: q-grams in more places of items than this are left out of the count where enough others remain.
COMMON, ENOUGH = 32, 8
MATCHES = "array<struct<item_id: long, start: long, end: long, edits: long, patterns: long>>"
#: Patterns whose q-grams are counted together at first.
RUN = 2 * (WINDOW // STRIDE + 2)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22

_plain: np.ndarray | None = None


def _classes() -> np.ndarray:
    """For each code point its lower-case letter or digit, or 0."""
    global _plain
    if _plain is None:
        _plain = np.zeros(0x110000, np.uint32)
        for c in range(0x30000):
            if chr(c).isalnum():
                low = chr(c).lower()
                _plain[c] = ord(low) if len(low) == 1 else c
    return _plain


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of a text in lower case, and their places in it."""
    points = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    places = np.flatnonzero(points)
    return points[places], places


def _grams(points: np.ndarray) -> np.ndarray:
    """A hash of the q-gram at each place that has one."""
    n = len(points) - Q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    power, found, size = 1099511628211, points.astype(np.uint64), 1
    done, length = None, 0  # the polynomial over Q characters from those over 1, 2, 4, ...
    while True:
        if Q & size:
            part = found[length:][:n] if done is None else found[length : length + n]
            done = part if done is None else done[:n] * np.uint64(power) + part
            length += size
        if 2 * size > Q:
            return done[:n] * _MIX
        found = found[:-size] * np.uint64(power) + found[size:]
        power, size = power * power % (1 << 64), 2 * size


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


@dataclass
class Patterns:
    """Patterns of some items, and an index of the items' q-grams."""

    items: np.ndarray
    letters: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    budget: np.ndarray
    least: np.ndarray
    table: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Patterns:
        ids, starts, sizes, letters, base = [], [], [], [], 0
        for item, text in items:
            points, _ = normalized(text or "")
            n = len(points)
            if n < Q:
                continue
            own = [0] if n <= WINDOW else sorted({*range(0, n - WINDOW + 1, STRIDE), n - WINDOW})
            ids += [item] * len(own)
            starts += [base + a for a in own]
            sizes += [min(n, WINDOW)] * len(own)
            letters.append(points)
            base += n
        starts, sizes = np.array(starts, np.int64), np.array(sizes, np.int64)
        budget = np.where(sizes < SHORTEST, 0, np.floor(sizes * ERROR_RATE)).astype(np.int64)
        grams = [_grams(x) for x in letters]
        bases = np.cumsum([0] + [len(x) for x in letters])[:-1]
        place = np.concatenate([at + np.arange(len(g)) for at, g in zip(bases, grams, strict=True)]) if letters else np.zeros(0, np.int64)
        flat = np.concatenate(grams) if letters else np.zeros(0, np.uint64)
        distinct, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
        common = times[inverse] > COMMON

        def counted(places: np.ndarray) -> np.ndarray:
            """How many of some ascending places of q-grams each pattern holds."""
            return np.searchsorted(places, starts + sizes - Q, side="right") - np.searchsorted(places, starts)

        # a common q-gram stays where some pattern that holds it needs it
        needy = np.flatnonzero(counted(place[~common]) - Q * budget < ENOUGH)
        needed = np.zeros(base + 1, np.int64)
        np.add.at(needed, starts[needy], 1)
        np.add.at(needed, starts[needy] + sizes[needy] - Q + 1, -1)
        keep = ~common | (np.cumsum(needed)[place] > 0)
        flat, place = flat[keep], place[keep]
        least = np.maximum(1, counted(place) - Q * budget)
        order = np.argsort(flat, kind="stable")
        flat, place = flat[order], place[order]
        distinct, first = np.unique(flat, return_index=True)
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[_slot(distinct)] = True
        whole = np.concatenate(letters) if letters else np.zeros(0, np.uint32)
        return cls(np.array(ids, np.int64), whole, starts, sizes, budget, least, table, distinct, np.append(first, len(flat)), place)

    def code(self, pattern: int) -> np.ndarray:
        """The letters of a pattern."""
        return self.letters[self.starts[pattern] : self.starts[pattern] + self.sizes[pattern]]

    @property
    def codes(self) -> list[np.ndarray]:
        """The letters of all patterns."""
        return [self.code(p) for p in range(len(self.starts))]

    def candidates(self, points: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pattern, lowest diagonal of the band) with enough shared q-grams. ``doc``: document of each place;
        places are those in ``points``."""
        none = (np.zeros(0, np.int64),) * 3
        grams = _grams(points)
        at = np.flatnonzero(self.table[_slot(grams)])
        at = at[doc[at] == doc[at + Q - 1]] if len(at) else at
        where = np.minimum(np.searchsorted(self.grams, grams[at]), max(0, len(self.grams) - 1))
        hit = self.grams[where] == grams[at] if len(at) else np.zeros(0, bool)
        at, where = at[hit], where[hit]
        if not len(at):
            return none
        many = self.first[where + 1] - self.first[where]
        ends = np.cumsum(many)
        entry = np.arange(ends[-1]) + np.repeat(self.first[where] - (ends - many), many)
        place, inside = np.repeat(at, many), self.place[entry]
        # the patterns that hold a place of an item stand together
        low = np.searchsorted(self.starts + self.sizes, inside + Q)
        high = np.searchsorted(self.starts, inside, side="right")
        # patterns that hold a place together number WINDOW / STRIDE + 2 at most, so a count over a run of patterns that is
        # too small for any of them settles them all
        run = low // RUN
        keys, number, counts = np.unique(doc[place] * (len(self.starts) // RUN + 2) + run, return_inverse=True, return_counts=True)
        near = counts.copy()
        for step in (-1, 1):
            beside = np.minimum(np.searchsorted(keys, keys + step), len(keys) - 1)
            near += np.where(keys[beside] == keys + step, counts[beside], 0)
        fewest = np.minimum.reduceat(self.least, np.arange(0, len(self.least), RUN))
        open_ = near[number] >= np.minimum(fewest, np.append(fewest[1:], fewest[-1]))[run]
        place, inside, low, high = place[open_], inside[open_], low[open_], high[open_]
        many = high - low
        ends = np.cumsum(many)
        if not len(ends) or not ends[-1]:
            return none
        pattern = np.arange(ends[-1]) + np.repeat(low - (ends - many), many)
        place, inside = np.repeat(place, many), np.repeat(inside, many) - self.starts[pattern]
        diagonal = place - inside
        shift = int(self.budget.max()) + len(points) + WINDOW  # keeps band numbers positive
        width = self.budget[pattern] + 1
        found = []
        for half in (0, 1):
            band = ((diagonal + WINDOW) // width + half) // 2
            key = (doc[place] * len(self.starts) + pattern) * (2 * shift) + band
            # a q-gram of the pattern counts once in a band
            keys, counts = np.unique(_distinct(key, inside), return_counts=True)
            own = (keys // (2 * shift)) % len(self.starts)
            enough = counts >= self.least[own]
            keys, own = keys[enough], own[enough]
            lowest = (2 * (keys % (2 * shift)) - half) * (self.budget[own] + 1) - WINDOW
            found.append((keys // (2 * shift) // len(self.starts), own, lowest))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _distinct(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The keys of the distinct (key, place) pairs."""
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
    return key[new]


def align(patterns: list[np.ndarray], texts: list[np.ndarray], lows: list[int], width: int) -> np.ndarray:
    """For each pattern, the fewest edits to any part of its text whose alignment stays on diagonals low to low + width - 1, and
    the start and end of that part. All bands advance together, one pattern character at a time."""
    sizes = np.array([len(p) for p in patterns])
    longest, count = int(sizes.max()), len(patterns)
    letters = np.zeros((count, longest), np.uint32)
    window = np.zeros((count, longest + width), np.uint32)  # the text from place low on; 0 where there is none
    ends = np.array([len(t) for t in texts])[:, None]
    low = np.array(lows)[:, None]
    for k, (pattern, text, at) in enumerate(zip(patterns, texts, lows, strict=True)):
        letters[k, : len(pattern)] = pattern
        part = text[max(0, at) : max(0, at + longest + width)]
        window[k, max(0, -at) : max(0, -at) + len(part)] = part
    far = longest + 1
    column = np.arange(width)
    at = low + column  # place in the text before which row 0 stands
    cost = np.where((at >= 0) & (at <= ends), 0, far)
    start = at.copy()
    found = np.zeros((count, 3), np.int64)
    for i in range(1, longest + 1):
        at = at + 1  # row i, column k stands before place low + k + i
        diagonal = cost + (window[:, i - 1 : i - 1 + width] != letters[:, i - 1 : i])
        skipped = np.full_like(cost, far)  # a pattern character without a counterpart
        skipped[:, :-1] = cost[:, 1:] + 1
        begin = start.copy()
        begin[:, :-1] = np.where(diagonal[:, :-1] <= skipped[:, :-1], start[:, :-1], start[:, 1:])
        best = np.where((at >= 0) & (at <= ends), np.minimum(diagonal, skipped), far)
        # a text character without a counterpart: the cheapest column to the left plus the distance
        running = np.minimum.accumulate(best - column, axis=1)
        source = np.maximum.accumulate(np.where(best - column == running, column, 0), axis=1)
        cost = np.where((at >= 0) & (at <= ends), np.minimum(running + column, far), far)
        start = np.take_along_axis(begin, source, axis=1)
        over = np.flatnonzero(sizes == i)
        if len(over):
            k = np.argmin(cost[over], axis=1)
            found[over] = np.stack([cost[over, k], start[over, k], at[over, k]], axis=1)
    return found


def _whole_words(points: np.ndarray, places: np.ndarray, a: int, b: int) -> bool:
    """Whether a part of a text begins and ends where words do, or in a script that does not show it."""
    unspaced = lambda c: any(x <= c <= y for x, y in UNSPACED)
    return ((a == 0 or places[a - 1] < places[a] - 1 or unspaced(points[a]))
            and (b == len(places) or places[b] > places[b - 1] + 1 or unspaced(points[b - 1])))


def find(texts: list[str], patterns: Patterns) -> list[list[dict]]:
    """For each text, the items found in it: item_id, start and end (code points), fewest edits and patterns found."""
    found: list[dict] = [{} for _ in texts]
    if not len(patterns.starts):
        return [[] for _ in texts]
    width = 2 * (int(patterns.budget.max()) + 1)
    held, size, base = [], 0, 0
    waiting: list[tuple] = []

    def candidates() -> None:
        parts = [normalized(t) for t in held]
        sizes = np.array([len(p) for p, _ in parts])
        starts = np.cumsum(sizes) - sizes
        points = np.concatenate([p for p, _ in parts])
        doc = np.repeat(np.arange(len(held)), sizes)
        for d, p, low in zip(*(x.tolist() for x in patterns.candidates(points, doc)), strict=True):
            waiting.append((base + d, p, low - int(starts[d]), *parts[d]))

    def verify() -> None:
        aligned = align([patterns.code(x[1]) for x in waiting], [x[3] for x in waiting], [x[2] for x in waiting], width)
        for (d, p, _, points, places), (edits, a, b) in zip(waiting, aligned.tolist(), strict=True):
            if edits > patterns.budget[p] or b <= a:
                continue
            if patterns.sizes[p] < SHORTEST and not _whole_words(points, places, a, b):
                continue
            first, last, item = int(places[a]), int(places[b - 1]) + 1, int(patterns.items[p])
            seen = found[d].setdefault(item, {"item_id": item, "start": first, "end": last, "edits": edits, "patterns": set()})
            seen |= {"start": min(seen["start"], first), "end": max(seen["end"], last), "edits": min(seen["edits"], edits)}
            seen["patterns"].add(p)
        waiting.clear()

    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size > CHUNK or i == len(texts) - 1:
            candidates()
            held, size, base = [], 0, i + 1
        if waiting and (len(waiting) > TOGETHER or i == len(texts) - 1):
            verify()
    return [sorted((r | {"patterns": len(r["patterns"])} for r in x.values()), key=lambda r: r["item_id"]) for x in found]


def _matcher(shared):
    @pandas_udf(MATCHES)
    def matches(texts: pd.Series) -> pd.Series:
        return pd.Series(find([t or "" for t in texts], shared.value), dtype=object)

    return matches


def _blocks(benchmark: DataFrame, item_id: str, text: str):
    """The benchmark's items in blocks of about BLOCK characters, one at a time on the driver."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append((row.item_id, row.text))
        size += len(row.text or "")
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def with_matches(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All rows of ``docs`` with an array ``matches`` of the benchmark items found in their text: item_id, start and end in code
    points of the text (from the first to the last pattern found), the fewest edits of a pattern, and how many
    patterns were found.

    Null and empty texts match nothing, nor do items with fewer than Q letters and digits (see ``not_searched``); those with fewer
    than SHORTEST match unedited, as whole words. Items without an id are
    reported as -1; repeated items count once for each id. Documents of equal text get equal matches. An input column
    named matches gives way. Without items every array is empty.
    """
    context = docs.sparkSession.sparkContext
    own: Column = F.array().cast(MATCHES)
    for block in _blocks(benchmark, item_id, item_text):
        named = [(-1 if i is None else i, t) for i, t in block]
        own = F.concat(own, _matcher(context.broadcast(Patterns.of(named)))(F.col(text).cast("string")))
    return docs.withColumn("matches", own)


def matches(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """A row (doc_id, item_id, start, end, edits, patterns) for each document and item found in it."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(options.get("text", "text")).alias("text"))
    found = with_matches(slim, benchmark, **(options | {"text": "text"}))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def not_searched(benchmark: DataFrame, *, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row (item_id, n_letters) for each benchmark item that is too short to be searched for."""
    @pandas_udf("long")
    def letters(texts: pd.Series) -> pd.Series:
        return pd.Series([len(normalized(t or "")[0]) for t in texts], dtype="int64")

    counted = benchmark.select(F.col(item_id).cast("long").alias("item_id"), letters(F.col(item_text).cast("string")).alias("n_letters"))
    return counted.where(F.col("n_letters") < Q)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in whose text no item was found, with their own columns."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    text = options.pop("text", "text")
    slim = docs.select(whole, F.col(f"`{text}`").alias("text"))
    return with_matches(slim, benchmark, **options).where(F.size("matches") == 0).select("whole.*")
