"""Token counts that follow edits.

A document's pieces (parts whose ids do not depend on what stands around them) are grouped into leaves of a segment
tree that sums characters and ids. An edit looks up the leaves it touches by their characters, takes neighbours until
the text on both sides holds a place where pieces are cut whatever the edit did, encodes that region anew, and updates
the sums above its leaves. Everything else keeps its counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opslens.llm.pieces import CUT, WHOLE, PieceEncoder, encoder, pieces

#: Pieces in a leaf when a tree is built.
LEAF = 32
EDITS = "array<struct<start: long, end: long, replacement: string>>"


class CountTree:
    """Characters and ids of a text's leaves, and their sums."""

    def __init__(self, text: str, chars: np.ndarray, ids: np.ndarray, tokens: PieceEncoder):
        self.text, self.tokens, self.encoded = text, tokens, 0
        self._plant(chars, ids)

    def _plant(self, chars: np.ndarray, ids: np.ndarray) -> None:
        starts = np.arange(0, max(1, len(chars)), LEAF)
        add = lambda x: np.add.reduceat(x, starts) if len(x) else np.zeros(1, np.int64)
        self._grow(add(chars), add(ids))

    def _grow(self, chars: np.ndarray, ids: np.ndarray) -> None:
        self.leaves = len(chars)
        self.width = 1 << max(0, self.leaves - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + self.leaves, 0] = chars
        self.sums[self.width : self.width + self.leaves, 1] = ids
        lo = self.width
        while lo > 1:
            self.sums[lo // 2 : lo] = self.sums[lo : 2 * lo : 2] + self.sums[lo + 1 : 2 * lo : 2]
            lo //= 2

    @property
    def n_ids(self) -> int:
        """Ids of the whole text."""
        return int(self.sums[1, 1])

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last leaf for the end of the text), and where it starts."""
        node, start = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            node *= 2
            if at >= left and self.sums[node + 1, 0] > 0:
                at, start, node = at - left, start + left, node + 1
        return node - self.width, start

    def _put(self, leaf: int, chars: int, ids: int) -> None:
        node = self.width + leaf
        change = np.array([chars, ids]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters from start to end (excluded); places beyond the text count as its end."""
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        (first, a), (last, b) = self._leaf(start), self._leaf(max(start, end - 1))
        b += int(self.sums[self.width + last, 0])
        whole = WHOLE.search(self.text[a:b]) or WHOLE.search(replacement)
        while first > 0 and (whole or not self.text[a:start].strip(" \t\n\r\x0b\x0c")):
            first -= 1
            a -= int(self.sums[self.width + first, 0])
        while last < self.leaves - 1 and (whole or self.text[b - 1].isspace() or not CUT.search(self.text[end:b])):
            last += 1
            b += int(self.sums[self.width + last, 0])
        region = self.text[a:start] + replacement + self.text[end:b]
        self.text = self.text[:start] + replacement + self.text[end:]
        self.encoded += len(region)
        parts = pieces(region)
        chars, ids = np.array([len(p) for p in parts], np.int64), self.tokens.counts(parts)
        held = last - first + 1
        for k in range(held):  # the pieces go to the same leaves in equal numbers, so the tree keeps its shape
            own = slice(k * len(parts) // held, (k + 1) * len(parts) // held)
            self._put(first + k, int(chars[own].sum()), int(ids[own].sum()))
        if len(parts) > 8 * LEAF * held:
            self._split(first, held, chars, ids)

    def _split(self, first: int, held: int, chars: np.ndarray, ids: np.ndarray) -> None:
        """Give leaves that have grown too large leaves of their own; only sums move, nothing is encoded."""
        leaves = self.sums[self.width : self.width + self.leaves]
        starts = np.arange(0, len(chars), LEAF)
        new = np.stack([np.add.reduceat(chars, starts), np.add.reduceat(ids, starts)], axis=1)
        merged = np.concatenate([leaves[:first], new, leaves[first + held :]])
        self._grow(merged[:, 0], merged[:, 1])


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            rows, out = batch.column("row"), []
            edits = batch.column("edits")
            for text, changes, (chars, ids) in zip(batch.column("text"), edits, tokens.measure(batch.column("text")), strict=True):
                tree = CountTree(text.as_py() or "", chars, ids, tokens)
                before = (len(tree.text), tree.n_ids)
                for e in changes.as_py() or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                out.append((*before, len(tree.text), tree.n_ids, tree.encoded))
            names = ["n_chars", "n_tokens", "edited_chars", "edited_tokens", "encoded_chars"]
            yield pa.RecordBatch.from_arrays(
                [rows, *(pa.array([x[i] for x in out], pa.int64()) for i in range(5))], names=["row", *names])

    return count


ADDED = ["n_chars", "n_tokens", "edited_chars", "edited_tokens", "encoded_chars"]


def count_edited(docs: DataFrame, tokenizer: str, *, text: str = "text", edits: str = "edits", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with n_chars and n_tokens of each text, edited_chars and edited_tokens after its edits, and
    encoded_chars, the characters that were encoded again for them.

    ``edits``: an array of (start, end, replacement) by code point, applied in order, each to what the one before left.
    Null and empty texts have no tokens; null edits, and null members of one, change nothing (a null start or end is 0, a
    null replacement is empty); places beyond the text are its end. Every row is counted by itself, so repeated rows and
    ids do not matter, and no row leaves its task. Kept columns named like an added one give way.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    slim = docs.select(row, F.col(text).cast("string").alias("text"), F.col(edits).cast(EDITS).alias("edits"))
    kind = slim.schema["row"].dataType.simpleString()
    counted = slim.mapInArrow(_counter(tokenizer), f"row {kind}, " + ", ".join(f"{c} long" for c in ADDED))
    return counted.select(*(F.col(f"row.`{c}`") for c in keep if c not in ADDED), *ADDED)


def tokens_of(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Token counts without edits."""
    bare = docs.withColumn("edits", F.lit(None).cast(EDITS))
    return count_edited(bare, tokenizer, **options).drop("edited_chars", "edited_tokens", "encoded_chars")
