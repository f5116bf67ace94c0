"""Encoding by pieces: texts are cut where the vocabulary's pre-tokenizer always cuts, and each distinct piece is encoded once.

A byte-level vocabulary never joins characters across the start of a run of white space, and only one space can belong
to the word after it. So the ids of a text are the ids of its pieces in order, and a piece met before needs no encoding.
Texts with control characters or other white space than ASCII's are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from opslens.llm.staging import kept_in_worker

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space that pieces are cut at.
SPACE = r"\t-\r "
#: Characters that some definitions count as white space, and the mark used below.
DOUBTFUL = "\\x00-\\x08\\x0e-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff"
PIECE = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WHOLE = re.compile(f"[{DOUBTFUL}]")
CUT = re.compile(rf"(?<=[^{SPACE}])[{SPACE}]")
#: Texts that hold more than single spaces and single line feeds between their words, for Arrow's matcher.
IRREGULAR = re.sub(r"\\u(....)", r"\\x{\1}", f"[{DOUBTFUL}\\t\\v\\f\\r]|[ \\n][ \\n]").replace(r"\x85\xa0", r"\x{85}\x{a0}")
#: A stop or comma behind a letter, which is always a piece of its own: words with and without one count as one word.
STOP = r"(\pL)([.,])( |$)"
#: The same for any marks but apostrophes.
MARKS = r"([\pL0-9])([!-&(-/:-@\[-`{-~]+)( |$)"
#: Characters parsed together, characters whose pieces are looked up together, new pieces encoded together, and pieces
#: kept, of LENGTH characters on average at most; they bound a worker's memory.
CHUNK = 1_000_000
GROUP = 8_000_000
BLOCK = 20_000
KEPT = 800_000
LENGTH = 16
#: Stands before a piece that no space belongs to.
MARK = "\x00"


def pieces(text: str) -> list[str]:
    """Parts of ``text``, in order, whose ids can be worked out one by one."""
    if not text:
        return []
    return [text] if WHOLE.search(text) else PIECE.findall(text)


def chunks(text: str) -> list[str]:
    """``text`` in parts of about CHUNK characters, cut in front of white space."""
    parts, at = [], 0
    while len(text) - at > CHUNK:
        cut = CUT.search(text, at + CHUNK)
        if not cut or WHOLE.search(text, at, cut.start() + 1):
            break
        parts.append(text[at:cut.start()])
        at = cut.start()
    return [*parts, text[at:]]


def _key(piece: str) -> str:
    """What stands for a piece: the word after its space, a line feed, or the marked piece."""
    if piece == "\n" or piece == " ":
        return piece.strip(" ")
    return piece[1:] if piece[0] == " " and not piece[1:2].isspace() and MARK not in piece else MARK + piece


def _piece(key: str) -> str:
    return key if key == "\n" else key[1:] if key[:1] == MARK else " " + key


def _portions(texts: pa.Array) -> Iterator[tuple[pa.Array, bool]]:
    """``texts`` in runs of about CHUNK bytes, of one text at least; a longer text comes in parts, all but the last with False."""
    upto = np.cumsum(np.concatenate([[0], np.asarray(pc.binary_length(texts))]))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + CHUNK, side="right")) - 1)
        some = texts.slice(at, end - at)
        if len(some) == 1 and len(text := some[0].as_py()) > CHUNK:
            *head, tail = chunks(text)
            for part in head:
                yield pa.array([part], pa.large_string()), False
            some = pa.array([tail], pa.large_string())
        yield some, True
        at = end


class PieceEncoder:
    """Encodes texts with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # pieces are text; ``encode`` cuts texts at added tokens itself
        self.added = {token.content: i for i, token in self.tokenizer.get_added_tokens_decoder().items() if token.content}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._keys = pa.array([], pa.large_string())
        self._flat = np.zeros(1 << 16, np.uint32)
        self._starts = np.zeros(1 << 16, np.int64)
        self._chars = np.zeros(1 << 16, np.int64)
        self._met = np.zeros(1 << 16, np.int32)
        self._counts: dict[str, int] = {}
        self._counted = 0
        self._numbered(pa.array(["\n", "", MARK], pa.large_string()), plain=False)

    @property
    def _known(self) -> int:
        return len(self._keys)

    @property
    def _numbers(self) -> list[str]:
        """The pieces kept, each at the place of its number."""
        return self._keys.to_pylist()

    def _forget(self) -> None:
        """Where the pieces kept are too many or too long, keep short ones met in most groups, a quarter of the room, and
        forget the others: most words are rare, and what is forgotten is only encoded again."""
        if self._known <= KEPT and self._chars[: self._known].sum() <= LENGTH * KEPT:
            return
        met = np.where(self._chars[: self._known] <= 2 * LENGTH, self._met[: self._known], 0)
        met[:3] = met.max() + 2  # those of __init__
        often = np.flatnonzero(met > 1)
        if len(often) > KEPT // 4:
            often = np.sort(np.argpartition(met, -max(KEPT // 4, 3))[-max(KEPT // 4, 3) :])
        sizes = self._starts[often + 1] - self._starts[often]
        ends = np.cumsum(sizes)
        flat = self._flat[np.arange(sizes.sum()) + np.repeat(self._starts[often] - ends + sizes, sizes)]
        self._keys, chars = self._keys.take(pa.array(often)), self._chars[often]
        room = max(1 << 16, 2 * len(often))
        self._starts, self._chars, self._met = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int32)
        self._starts[1 : len(often) + 1], self._chars[: len(often)], self._flat = ends, chars, flat

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.Array, plain: bool) -> None:
        """Encode new pieces: plain words in one go with line feeds between them, others one by one."""
        ids = None
        if plain:
            lines = "\n ".join(new.to_pylist())
            ids = np.array(self._encoded([f"\n {lines}\n".replace(f"\n {MARK}", "\n")])[0], np.uint32)
            ends = np.flatnonzero(ids == ids[0])
            if len(ends) == len(new) + 1:
                sizes = np.diff(ends) - 1
                ids = np.delete(ids, ends)
            else:
                ids = None
        if ids is None:
            found = self._encoded([_piece(k) for k in new.to_pylist()])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.array([i for x in found for i in x], np.uint32)
        known = self._known
        start = int(self._starts[known])
        end = start + len(ids)
        if end > len(self._flat):
            self._flat = np.concatenate([self._flat[:start], np.zeros(max(len(self._flat), end), np.uint32)])
        if known + len(new) >= len(self._starts):
            more = np.zeros(len(self._starts) + len(new), np.int64)
            self._starts, self._chars = np.concatenate([self._starts, more]), np.concatenate([self._chars, more])
            self._met = np.concatenate([self._met, more.astype(np.int32)])
        self._flat[start:end] = ids
        self._starts[known + 1 : known + len(new) + 1] = start + np.cumsum(sizes)
        marked = np.asarray(pc.starts_with(new, MARK))
        spaced = ~marked & np.asarray(pc.not_equal(new, "\n"))
        self._chars[known : known + len(new)] = np.asarray(pc.utf8_length(new)) - marked + spaced
        self._keys = pa.concat_arrays([self._keys, new])

    def _numbered(self, keys: pa.Array, plain: bool) -> np.ndarray:
        """Numbers of different keys."""
        if not len(keys):
            return np.zeros(0, np.int64)
        numbers = np.asarray(pc.fill_null(pc.index_in(keys, value_set=self._keys), -1)).astype(np.int64)
        missing = numbers < 0
        if missing.any():
            new = keys.filter(pa.array(missing))
            numbers[missing] = self._known + np.arange(len(new))
            for at in range(0, len(new), BLOCK):
                self._learn(new.slice(at, BLOCK), plain)
        self._met[numbers] += 1  # once for each group, however often a piece occurs there
        return numbers

    def counts(self, parts: list[str]) -> np.ndarray:
        """Number of ids of each piece."""
        if len(self._counts) > KEPT or self._counted > LENGTH * KEPT:
            self._counts, self._counted = {}, 0
        new = [p for p in dict.fromkeys(parts) if p not in self._counts]
        if new:
            self._counts.update(zip(new, map(len, self._encoded(new)), strict=True))
            self._counted += sum(map(len, new))
        return np.fromiter(map(self._counts.__getitem__, parts), np.int64, len(parts))

    @staticmethod
    def _split(texts: pa.Array, stop: str) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray, pa.DictionaryArray]:
        """Which texts are irregular, how many pieces each text has, the keys of the regular texts in order, and those of the others."""
        odd = np.asarray(pc.match_substring_regex(texts, IRREGULAR))
        lines = pc.replace_substring(texts.filter(pa.array(~odd)), "\n", f" \n {MARK}")
        lines = pc.replace_substring_regex(lines, stop, rf"\1 {MARK}\2\3")
        marked = pc.binary_join_element_wise(pa.scalar(MARK, lines.type), lines, pa.scalar("", lines.type))
        split = pc.split_pattern(marked, " ")
        words = pc.dictionary_encode(split.values if isinstance(split, pa.ListArray) else split.flatten())
        own = [[_key(p) for p in pieces(t)] for t in texts.filter(pa.array(odd)).to_pylist()]
        sizes = np.zeros(len(texts), np.int64)
        sizes[~odd] = np.diff(np.asarray(split.offsets))
        sizes[odd] = [len(keys) for keys in own]
        return odd, sizes, words, pc.dictionary_encode(pa.array([k for keys in own for k in keys], pa.large_string()))

    def _looked_up(self, parts: list[pa.DictionaryArray], plain: bool) -> Iterator[np.ndarray]:
        """Numbers of the keys of each part."""
        whole = pa.chunked_array(parts).unify_dictionaries()
        numbers = self._numbered(whole.chunk(0).dictionary, plain)
        return (numbers[np.asarray(part.indices)] for part in whole.chunks)

    def _parsed(self, texts: pa.Array, stop: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """For each portion of the texts, the numbers of the pieces in order, how many each text has, and whether it ends a text."""
        group, size = [], 0
        for some, ends in _portions(texts):
            group.append((some, ends))
            size += some.nbytes
            if size >= GROUP:
                yield from self._parsed_together(group, stop)
                group, size = [], 0
        if group:
            yield from self._parsed_together(group, stop)

    def _parsed_together(self, group: list[tuple[pa.Array, bool]], stop: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        self._forget()
        found = [self._split(some, stop) for some, _ in group]
        words = self._looked_up([x for _, _, x, _ in found], plain=True)
        odd_words = self._looked_up([x for _, _, _, x in found], plain=False)
        for (odd, sizes, _, _), numbers, more, (_, ends) in zip(found, words, odd_words, group, strict=True):
            if odd.any():
                place = np.repeat(odd, sizes)
                both = np.empty(len(place), np.int64)
                both[place], both[~place] = more, numbers
                numbers = both
            yield numbers, sizes, ends

    def _sized(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters and ids of pieces."""
        return self._chars[numbers], self._starts[numbers + 1] - self._starts[numbers]

    def _ids(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a portion, and how many each has."""
        starts = self._starts[numbers]
        lengths = self._starts[numbers + 1] - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(ends[-1])
        at += np.repeat(starts - ends[:-1], lengths)
        return self._flat[at], np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])

    def measure(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text in order, the characters and the ids of each of its pieces."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        head: list[tuple[np.ndarray, np.ndarray]] = []
        for numbers, sizes, whole in self._parsed(texts, STOP):
            chars, ids = self._sized(numbers)
            if not whole or head:
                head.append((chars, ids))
                if whole:
                    yield np.concatenate([x for x, _ in head]), np.concatenate([x for _, x in head])
                    head = []
                continue
            ends = np.cumsum(sizes)
            for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                yield chars[a:b], ids[a:b]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (ids of some texts one after the other, their numbers of ids); a very long text comes in parts, all but
        the last with the number -1 and alone. Null texts are empty. A string that the vocabulary names as an added token has
        that token's id, as in the tokenizers library, and the text on both sides of it is encoded by itself."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self._cut or not any(pc.any(pc.match_substring(texts, token)).as_py() for token in self.added):
            yield from self._plain(texts)
            return
        cut = [self._cut.split(t) for t in texts.to_pylist()]  # every second one is an added token
        after = np.array([self.added.get(t, -1) for parts in cut for t in (*parts[1::2], None)], np.int64)  # -1: the text ends
        at = 0
        for ids, counts in self._plain(pa.array([t for parts in cut for t in parts[::2]], pa.large_string())):
            if counts[0] < 0:
                yield ids, counts
                continue
            added = after[at : at + len(counts)]
            at += len(counts)
            ids = np.insert(ids, np.cumsum(counts)[added >= 0], added[added >= 0])
            ends = np.cumsum(counts + (added >= 0))[added < 0]
            if len(ends):
                yield ids[: ends[-1]], np.diff(ends, prepend=0)
                ids = ids[ends[-1] :]
            if len(ids):
                yield ids, np.array([-1])

    def _plain(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of texts in which no added token counts as one."""
        for numbers, sizes, whole in self._parsed(texts, MARKS):
            ids, counts = self._ids(numbers, sizes)
            yield ids, counts if whole else np.array([-1])


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    return kept_in_worker(("encoder", path), lambda: PieceEncoder(path))
