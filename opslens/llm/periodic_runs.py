"""Periodic runs of words: stretches that repeat a smallest period, found by seeds on diagonals.

A run of smallest period q and length L >= max(LEAST, TIMES * q) agrees with itself q words further on over L - q words.
Lags are taken in classes [a, 1.5 a); a run whose lag is in a class agrees over 2 a words at least (16 in the first
class), the guaranteed overlap. So a class indexes the k-grams of that many words by exact names and pairs each occurrence
with the next two of the same name. Two are enough: a k-gram of the run whose own period p is no divisor of q has p + q
over k, so its occurrences lie more than a / 2 apart, and there are two at most before the one at lag q and it; below lag 8
the next one is at lag q. Pairs of one lag go in order of position, and a table that holds how far each lag is covered passes
over those that lie in a stretch already extended. The work on a text of n words is n log n for each of its log n classes,
also where one word fills it; classes end when no k-gram occurs twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opslens.llm.staging import packed, unpacked

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 24, 3
#: Below this lag a k-gram of the first class fixes its run's period by itself.
SHORT = LEAST // TIMES
#: Rows handed back at once, so that a task holds few collapsed texts.
PORTION = 500

RUN = "struct<start: long, length: long, period: long>"


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, in UTF-8."""
    return text.encode().split() if text else []


def numbers_of(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


class Names:
    """Numbers of the k-grams of a sequence, equal for equal ones: those of 2 k words are pairs of those of k."""

    def __init__(self, words: np.ndarray):
        self.powers = [words]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]

    def of(self, k: int) -> np.ndarray:
        """One number for each place where k words begin."""
        while 1 << len(self.powers) <= k:
            half, last = 1 << (len(self.powers) - 1), self.powers[-1]
            self.powers.append(self._pairs(last[:-half], last[half:]))
        power = k.bit_length() - 1
        names, step = self.powers[power], k - (1 << power)
        return self._pairs(names[:-step], names[step:]) if step else names


def _classes(n: int) -> Iterator[tuple[int, int, int]]:
    """Lags from and to (excluded), and the words of the k-grams that runs of such lags hold twice."""
    low, high = 1, SHORT * 3 // 2
    k = 2 * SHORT
    while TIMES * low <= n:
        yield low, high, k
        low, high, k = high, high * 3 // 2, 2 * high


def _seeds(names: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Lags and places of occurrence pairs, by lag and place; None where nothing occurs twice."""
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    if not (sorted_names[1:] == sorted_names[:-1]).any():
        return None
    lags, places = [], []
    for ahead in (1, 2):
        same = sorted_names[ahead:] == sorted_names[:-ahead]
        lag = (order[ahead:] - order[:-ahead])
        take = same & (lag >= low) & (lag < high)
        lags.append(lag[take])
        places.append(order[:-ahead][take])
    lag, place = np.concatenate(lags), np.concatenate(places)
    by = np.lexsort((place, lag))
    return lag[by], place[by]


def _agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items of two sequences agree; compared in growing portions."""
    done, size, n = 0, 64, min(len(a), len(b))
    while done < n:
        differ = a[done:min(done + size, n)] != b[done:min(done + size, n)]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + size, 2 * size
    return n


def _primes_of(q: int) -> list[int]:
    found, d = [], 2
    while d * d <= q:
        if q % d == 0:
            found.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return found + ([q] if q > 1 else [])


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    n, found, names = len(words), [], Names(words)
    if n < LEAST:
        return []
    covered: dict[int, int] = {}
    for low, high, k in _classes(n):
        if k + low > n:
            break
        seeds = _seeds(names.of(k), low, high)
        if seeds is None:
            break
        lag, place = seeds
        first = np.ones(len(lag), bool)
        first[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
        for q, x in zip(lag[first].tolist(), place[first].tolist()):
            if x < covered.get(q, 0):
                continue
            left, right = words[:x], words[:x + q]
            start = x - _agreement(left[::-1], right[::-1])
            stop = x + k + _agreement(words[x + k:], words[x + q + k:])
            covered[q] = stop
            length = stop + q - start
            if length >= max(LEAST, TIMES * q) and not any(
                    _agreement(words[start:], words[start + q // r:stop + q]) >= length - q // r for r in _primes_of(q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length for its period, compared exactly; ties go to the smaller start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """Words joined by blanks, without those that a run holds behind its first period."""
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    keep = np.cumsum(dropped)[:-1] == 0
    return b" ".join(w for w, k in zip(words, keep) if k).decode()


def with_runs(docs: DataFrame, text: Column | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Each row with its text's ``runs`` (by start, then period), the ``strongest`` of them and the text ``collapsed``.

    ``text`` is what to search (the column of that name), ``keep`` the columns to carry along (all). Words are what stands between ASCII white space. A null or empty text has no runs, a null strongest run and an
    empty collapsed text; whole texts are searched, however long. Repeated rows stay; input columns named like the
    three added ones give way. Nothing is shuffled: a text is searched where it is read.
    """
    kept_columns = docs.columns if keep is None else list(keep)
    source = docs.select(packed(docs.select(*(F.col(f"`{c}`") for c in kept_columns))), (F.col("text") if text is None else text).cast("string").alias("search"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        fields = lambda r: dict(zip(("start", "length", "period"), r)) if r else None
        for batch in (b.slice(at, PORTION) for b in batches for at in range(0, b.num_rows, PORTION)):
            runs, best, kept = [], [], []
            for value in batch.column("search"):
                words = words_of(value.as_py())
                here = runs_of(numbers_of(words))
                runs.append([fields(r) for r in here])
                best.append(fields(strongest(here)))
                kept.append(collapsed(words, here))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(kept, pa.string())],
                ["row", "runs", "strongest", "collapsed"])

    kind = source.schema["row"].dataType.simpleString()
    found = source.mapInArrow(search, f"row {kind}, runs array<{RUN}>, strongest {RUN}, collapsed string")
    return unpacked(found, kept_columns, ["runs", "strongest", "collapsed"])


def planted(doc_id: Column, text: Column) -> Column:
    """The text of a document, of which one in ten by checksum of its id repeats its words from a place on.

    With h the checksum, g = floor(h / 10) and n words, word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). A null id plants nothing.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    bound = lambda value, then: F.transform(F.array(value), then)[0]
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def whole(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, bound(F.struct(w.alias("w"), n.alias("n"), a.alias("a"), p.alias("p")), lambda s: F.array_join(
            F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(
                s["a"] + (i - s["a"]) % s["p"]).cast("int"))), " ")))

    return F.when((h % 10 == 0) & text.isNotNull(), F.coalesce(bound(words, whole), text)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Per document: the number of runs, the strongest one, and checksums of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
