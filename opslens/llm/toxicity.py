"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

The kernel compares two words by their common subsequences of three characters, which may have gaps: a subsequence counts
DECAY to the power of the stretch it covers, up to SPAN characters, word borders being characters too. So a word with
characters put in, left out or doubled stays near its plain form. A text is the bag of its words, with signs
inside words taken out and spaced-out letters put together, and a sentence is as toxic as its words make it.

Learning is multiple-instance: a sentence is labelled, its words are not. First the words that labelled toxic texts hold far more
often than others stand for their label; landmarks are these and words of the other texts; a linear machine is trained on the
Nyström features of the words; then words of clean texts on the wrong side, and the best word of each toxic text that has none,
join the training words, and it is trained again. A logistic model over a text's word margins gives the score.

A linear machine on Nyström features is a weighted sum of kernel values at the landmarks, and each kernel value is a
product of subsequence counts, so scoring a word takes one pass over its subsequences, whatever the number of landmarks.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from opslens.llm.staging import give_back_memory, make_room, tidy

DECAY = 0.6
SPAN = 6
#: Letters of a word that are compared at once; longer words are cut into overlapping parts.
LONGEST = 22
LANDMARKS = 200
#: Labelled texts that a model is fitted on at most, of each class; taken by a hash of the id.
SAMPLE = 2000
#: Characters scored together, and words whose margins a worker keeps.
CHUNK = 1_000_000
KEPT = 200_000
#: Words whose subsequences or features are held at once.
PORTION = 2000
THRESHOLD = 0.7
#: Margin from which a word surely counts as toxic.
SURE = 0.6
#: Weight of disguised forms of toxic words in training, against the words.
VIRTUAL = 0.05

_CLASSES = 64
_START, _END = 1, 2
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]\s){2,}[^\W\d_](?!\S)")
SIGNS = re.compile(r"[\W_]+")


def _letter(c: str) -> int:
    """Class of a character: a letter without its accents, a digit, or one of few others."""
    c = unicodedata.normalize("NFD", c)[0]
    if "a" <= c <= "z":
        return 3 + ord(c) - 97
    if c.isdigit():
        return 29 + (unicodedata.digit(c, 0) or 0)
    return 39 + ord(c) % (_CLASSES - 39)


_letters: dict[str, int] = {}


def parts(token: str) -> list[str]:
    """The words to compare in a token: its letters and digits, in overlapping parts if there are many."""
    word = SIGNS.sub("", token)
    if len(word) <= LONGEST:
        return [word] if len(word) > 1 else []
    step = LONGEST // 2
    return [word[i : i + LONGEST] for i in range(0, len(word) - step, step)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence codes of each word, and their weights; 0 weight where there is none."""
    n = len(words)
    grid = np.zeros((n, LONGEST + 2 + SPAN), np.int32)
    for c in set("".join(words)) - _letters.keys():
        _letters[c] = _letter(c)
    sizes = np.array([len(w) for w in words])
    flat = np.array([_letters[c] for c in "".join(words)], np.int32)
    rows = np.repeat(np.arange(n), sizes)
    columns = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grid[:, 0] = _START
    grid[rows, columns + 1] = flat
    grid[np.arange(n), sizes + 1] = _END
    width = int(sizes.max()) + 2 if n else 2
    found, weights = [], []
    for a, b in _OFFSETS:
        code = (grid[:, :width] * _CLASSES + grid[:, a : a + width]) * _CLASSES + grid[:, b : b + width]
        there = grid[:, b : b + width] > 0
        found.append(np.where(there, code, 0))
        weights.append(np.where(there, DECAY ** (b + 1), 0.0))
    return np.concatenate(found, axis=1), np.concatenate(weights, axis=1)


def _normalized(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights divided by the square root of the word's kernel with itself; a subsequence that occurs twice counts as a sum."""
    order = np.argsort(codes, axis=1)
    c, w = np.take_along_axis(codes, order, 1), np.take_along_axis(weights, order, 1)
    sums = np.cumsum(w, axis=1)
    last = np.ones(c.shape, bool)
    last[:, :-1] = c[:, 1:] != c[:, :-1]
    upto = np.where(last, sums, 0.0)
    before = np.maximum.accumulate(upto, axis=1)
    runs = np.where(last, sums - np.concatenate([np.zeros((len(c), 1)), before[:, :-1]], axis=1), 0.0)
    own = np.sqrt((runs**2).sum(axis=1, keepdims=True))
    return weights / np.maximum(own, 1e-12)


@dataclass
class Spread:
    """Normalized subsequence counts of some words, a column for each; ``row`` says where a code's counts are, row 0 is empty."""

    row: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Spread:
        codes, weights = _codes(words)
        weights = _normalized(codes, weights)
        used = np.unique(codes[weights > 0])
        row = np.zeros(_CLASSES**3, np.int32)
        row[used] = np.arange(1, len(used) + 1)
        counts = np.zeros((len(used) + 1, len(words)), np.float32)
        np.add.at(counts, (row[codes], np.arange(len(words))[:, None]), weights)
        counts[0] = 0
        return cls(row, counts)

    def direction(self, weights: np.ndarray) -> np.ndarray:
        """Weight of each code in a weighted sum of the words."""
        return (self.counts @ weights.astype(np.float32))[self.row]


def features(words: list[str], spread: Spread) -> np.ndarray:
    """Kernel of words with the words of ``spread``."""
    found = np.zeros((len(words), spread.counts.shape[1]), np.float32)
    step = 500
    for i in range(0, len(words), step):
        codes, weights = _codes(words[i : i + step])
        weights = _normalized(codes, weights).astype(np.float32)
        rows = spread.row[codes]
        for k in range(codes.shape[1]):
            if rows[:, k].any():
                found[i : i + step] += weights[:, k, None] * spread.counts[rows[:, k]]
    return found


def disguised(word: str) -> list[str]:
    """A word with a letter doubled, or a sign's worth of another letter put in, at places spread over it."""
    if len(word) < 4:
        return []
    places = range(1, len(word), max(1, len(word) // 4))
    return [word[:i] + c + word[i:] for i in places for c in (word[i - 1], "x", "0")]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps; the last weight is the bias."""
    size = x.shape[1] + 1
    v = np.zeros(size)
    penalty = ridge * np.eye(size)
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        left, right = penalty.copy(), np.zeros(size)
        for at in range(0, len(x), PORTION):  # sums over portions, so that no copy of all features is made
            own = np.concatenate([x[at : at + PORTION], np.ones((len(x[at : at + PORTION]), 1))], axis=1, dtype=np.float64)
            labels = y[at : at + PORTION]
            active = labels * (own @ v) < 1
            weighed = own[active] * weight[at : at + PORTION][active, None]
            left += weighed.T @ own[active]
            right += weighed.T @ labels[active]
        new = np.linalg.solve(left, right)
        if np.abs(new - v).max() < 1e-6:
            break
        v = new
    return v


@dataclass
class Model:
    """``direction``: weight of each subsequence; ``bias``; ``curve``: logistic weights of a text's summary."""

    direction: np.ndarray
    bias: float
    curve: np.ndarray

    def margins(self, words: list[str]) -> np.ndarray:
        """Distances of words from the border, toxic ones positive."""
        if not words:
            return np.zeros(0)
        found = np.empty(len(words))
        order = np.argsort([len(w) for w in words], kind="stable")  # words of like length together
        for i in range(0, len(words), PORTION):
            own = order[i : i + PORTION]
            codes, weights = _codes([words[k] for k in own])
            found[own] = (_normalized(codes, weights) * self.direction[codes]).sum(axis=1) + self.bias
        return found


def summary(margins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What a text's score is made of, from the margins of its words one after the other: the largest, how many are positive and
    surely so, and their share."""
    n = len(sizes)
    found = np.zeros((n, 5))
    full = np.flatnonzero(sizes > 0)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        add = lambda x: np.add.reduceat(x, starts)
        positive, sure = add((margins > 0).astype(float)), add((margins > SURE).astype(float))
        found[full] = np.stack([
            np.maximum.reduceat(np.clip(margins, -1, 1), starts), np.log1p(positive), np.log1p(sure), sure / np.sqrt(sizes[full]),
            np.log1p(sizes[full])], axis=1)
    found[sizes == 0, 0] = -1
    return found


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the first weight is the constant."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    v, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve(penalty + (x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p) - penalty @ v)
        v += step
        if np.abs(step).max() < 1e-8:
            break
    return v


def tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct tokens of some texts in lower case, the number of each token in order, and each text's tokens. Letters that
    stand apart one by one are a token more."""
    lower = pc.utf8_lower(texts)
    split = pc.utf8_split_whitespace(lower)
    words = pc.dictionary_encode(split.values)
    distinct, numbers = words.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(words.indices)
    sizes = np.diff(np.asarray(split.offsets))
    spaced = np.flatnonzero(np.asarray(pc.match_substring_regex(lower, r"(^|\s)\pL(\s\pL){2,}(\s|$)")))
    if len(spaced):
        known, runs = {w: i for i, w in enumerate(distinct)}, np.split(numbers, np.cumsum(sizes)[:-1])
        for i in spaced.tolist():
            more = ["".join(m[0].split()) for m in SPACED.finditer(lower[i].as_py())]
            runs[i] = np.concatenate([runs[i], [known.setdefault(w, len(known)) for w in more]]).astype(np.int64)
            sizes[i] += len(more)
        distinct, numbers = list(known), np.concatenate(runs)
    return distinct, numbers, sizes


class Scorer:
    """Scores texts with a model, keeping the margins of tokens met before."""

    def __init__(self, model: Model):
        self.model, self.kept = model, {}

    def _token_margins(self, distinct: list[str]) -> np.ndarray:
        if len(self.kept) > KEPT:
            self.kept = {}
        new = [t for t in distinct if t not in self.kept]
        if new:
            own = [parts(t) for t in new]
            words = list({w for p in own for w in p})
            margin = dict(zip(words, self.model.margins(words).tolist(), strict=True))
            self.kept.update((t, max((margin[w] for w in p), default=-2.0)) for t, p in zip(new, own, strict=True))
        return np.fromiter(map(self.kept.__getitem__, distinct), float, len(distinct))

    def summaries(self, texts: pa.Array) -> np.ndarray:
        """Summaries of texts, worked out in portions."""
        upto = np.cumsum(np.concatenate([[0], np.asarray(pc.fill_null(pc.binary_length(texts), 0))]))
        found, at = [], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + CHUNK, side="right")) - 1)
            distinct, numbers, sizes = tokens(pc.fill_null(texts.slice(at, end - at).cast(pa.large_string()), ""))
            margins = self._token_margins(distinct)
            found.append(summary(margins[numbers], sizes))
            at = end
        return np.concatenate(found) if found else np.zeros((0, 5))

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of being toxic."""
        x = self.summaries(texts)
        return 1 / (1 + np.exp(-np.clip(self.model.curve[0] + x @ self.model.curve[1:], -30, 30)))


def _bags(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of some texts, and the distinct (text, word) pairs as two arrays of numbers."""
    number: dict[str, int] = {}
    docs, words = [], []
    for at in range(0, len(texts), 250):
        distinct, numbers, sizes = tokens(pa.array([t or "" for t in texts[at : at + 250]], pa.large_string()))
        own = [[number.setdefault(w, len(number)) for w in parts(t)] for t in distinct]
        many = np.array([len(x) for x in own], np.int64)
        flat, ends = np.array([w for x in own for w in x], np.int64), np.cumsum(many)
        doc = np.repeat(np.repeat(np.arange(len(sizes)), sizes), many[numbers])
        last = np.cumsum(many[numbers])
        place = np.arange(len(doc)) + np.repeat((ends - many)[numbers] - (last - many[numbers]), many[numbers])
        pairs = np.unique(np.stack([doc, flat[place]]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
        docs.append((pairs[0] + at).astype(np.int32))
        words.append(pairs[1].astype(np.int32))
    none = [np.zeros(0, np.int32)]
    return list(number), np.concatenate(docs or none), np.concatenate(words or none)


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A model from labelled texts. Without texts of both classes every score is about the share of toxic ones."""
    y = np.array(toxic, bool)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    flat = Model(np.zeros(_CLASSES**3, np.float32), -1.0, np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0]))
    if y.all() or not y.any():
        return flat
    words, doc, word = _bags(texts)
    n_bad, n_good = int(y.sum()), int((~y).sum())
    bad = np.bincount(word[y[doc]], minlength=len(words))
    good = np.bincount(word[~y[doc]], minlength=len(words))
    # how many standard errors a word's rate among toxic texts lies above its rate among others
    p = (bad + good + 1) / (n_bad + n_good + 2)
    apart = (bad / n_bad - good / n_good) / np.sqrt(p * (1 - p) * (1 / n_bad + 1 / n_good))
    names = np.array(words, object)
    by = lambda *keys: np.lexsort((names.astype(str), *keys))
    strong = [k for k in by(-apart) if bad[k] >= 3 and apart[k] > 4 and bad[k] / n_bad > 4 * good[k] / n_good][:LANDMARKS]
    if not strong:
        return flat
    common = by(-good)[: int((good > 0).sum())]
    common = common[~np.isin(common, strong)]
    clean = [*common[:2000], *common[2000 :: max(1, len(common) // 12000)]]
    landmarks = [*strong, *clean[:: max(1, len(clean) // LANDMARKS)][:LANDMARKS]]
    spread = Spread.of([words[k] for k in landmarks])
    kernel = spread.counts.T @ spread.counts
    values, vectors = np.linalg.eigh(kernel + 1e-6 * np.eye(len(landmarks)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    known = set(words)
    virtual = features(sorted({v for k in strong for v in disguised(words[k])} - known), spread) @ root.astype(np.float32)
    positive, negative = list(strong), list(clean)
    for step in range(2):
        x = features([words[k] for k in [*positive, *negative]], spread) @ root.astype(np.float32)
        labels = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        times = np.concatenate([bad[positive], 1.0 + np.log1p(good[negative])])
        weight = np.where(labels > 0, times / times[labels > 0].sum(), times / times[labels < 0].sum()) * len(labels) / 2
        # disguised words, as virtual examples, weigh VIRTUAL as much as the words themselves
        shade = np.full(len(virtual), VIRTUAL * weight[labels > 0].sum() / max(1, len(virtual)))
        v = _machine(np.concatenate([x, virtual]), np.append(labels, np.ones(len(virtual))), np.append(weight, shade))
        model = Model(spread.direction(root @ v[:-1]), float(v[-1]), np.zeros(6))
        if step == 1:
            break
        margin = model.margins(words)
        # words of clean texts on the wrong side, and the best word of each toxic text that has none
        wrong = np.flatnonzero((margin > -0.3) & (good > 0) & (bad / n_bad <= 2 * good / n_good))
        order = np.lexsort((word, -margin[word], doc))
        first = np.append(True, np.diff(doc[order]) > 0) if len(order) else np.zeros(0, bool)
        best = np.unique(word[order[first]][y[doc[order[first]]]])
        more = best[(margin[best] > 0) & (good[best] == 0)]
        negative = list(dict.fromkeys([*negative, *wrong.tolist()]))
        taken = set(negative)
        positive = [k for k in dict.fromkeys([*positive, *more.tolist()]) if k not in taken]
    summaries = Scorer(model).summaries(pa.array([t or "" for t in texts], pa.large_string()))
    model.curve = _logistic(summaries, y.astype(float))
    return model


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the model of the labelled texts in all batches."""
    make_room()
    texts, toxic = [], []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        toxic += batch.column(1).to_pylist()
    model = fit(texts, toxic)
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.direction.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.curve.tolist()])],
        names=["direction", "bias", "curve"])


def trained(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model fitted on at most ``sample`` labelled ids of each class, taken by a hash of the id, and on four times as many of
    their texts, taken by a hash of id and text. Labels without an id or a label, or without a text, play no part; an id
    labelled twice counts as often. An executor's task fits it on that sample, and the driver gets the weights alone."""
    named = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    by_hash = lambda k: named.where(f"label = {k}").orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample)
    chosen = by_hash(0).unionByName(by_hash(1))  # 2 * sample rows at most
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    found = rows.join(F.broadcast(chosen), "id").orderBy(
        F.md5(F.concat_ws("/", F.col("id").cast("string"), "text")), "label").limit(4 * sample).select("text", "label")
    row = found.mapInArrow(tidy(_fitted), "direction binary, bias double, curve array<double>").first()
    return Model(np.frombuffer(bytes(row.direction), np.float32), row.bias, np.array(row.curve)) if row else fit([], [])


def scored(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """All rows with a column ``name``, the probability of their text being toxic (0 to 1). Null texts count as empty; empty
    texts have a score like any others. An input column of that name gives way. Texts of any length are scored whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make_room()
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pa.array(scorer.scores(texts), pa.float64())
        give_back_memory()

    return docs.withColumn(name, score(F.col(f"`{text}`").cast("string")))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def clean(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their own columns."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in map("score_{}".format, itertools.count()) if n not in taken)
    return scored(docs, model, text=text, name=name).where(F.col(name) < threshold).drop(name)
