"""CSV records with quoted line breaks, read in splits.

A line break ends a record where an even number of quotes stands before it. So quotes are counted for each split of a file, the
counts of earlier splits tell whether a split begins inside quotes, and every split is then cut from its right state. What a
record has in several splits is put together by a shuffle of those pieces alone, two for each split at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: What a piece of text is: a whole record, or the first, a middle or the last part of one that goes over splits.
WHOLE, FIRST, MIDDLE, LAST = 0, 1, 2, 3
_SCHEMA = "file string, split long, seq long, kind int, record string"


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, split, line) in the order of the file within each split."""
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def _open_splits(lines: DataFrame) -> set[tuple[str, int]]:
    """Splits that begin inside quotes. One short row for each of them reaches the driver."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "split").agg(F.sum(quotes).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    found = counts.withColumn("before", before).where("before % 2 = 1")
    return {(r["file"], r["split"]) for r in found.select("file", "split").collect()}


class _Cutter:
    """Cuts the lines of one split into records."""

    def __init__(self, file: str, split: int, inside: bool):
        self.file, self.split, self.inside, self.seq = file, split, inside, 0
        self.held: list[str] | None = [] if inside else None
        self.kind = LAST if inside else WHOLE

    def _row(self, kind: int, text: str) -> tuple:
        self.seq += 1
        return self.file, self.split, self.seq - 1, kind, text

    def cut(self, lines: pa.Array) -> Iterator[tuple]:
        """Records that end in these lines."""
        counts = pc.fill_null(pc.count_substring(lines, '"'), 0).to_numpy(zero_copy_only=False)
        texts = lines.to_pylist()
        for text, odd in zip(texts, (counts & 1).astype(bool)):
            text = text or ""
            if self.held is None and not odd:
                if text.strip():
                    yield self._row(WHOLE, text)
            elif self.held is None:
                self.held, self.kind = [text], WHOLE
            else:
                self.held.append(text)
                if odd:
                    yield self._row(self.kind, "\n".join(self.held))
                    self.held = None

    def end(self) -> Iterator[tuple]:
        """What is left when the split ends: the beginning or the middle of a record."""
        if self.held is not None:
            yield self._row(MIDDLE if self.kind == LAST else FIRST, "\n".join(self.held))
            self.held = None


def records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, split, seq, record) of every record that is not blank, in file order by the first three.

    Lines end with a line feed; a carriage return before it at the end of a record is left off. A file whose last quote
    is not closed ends with the record it opens. Files are read twice, once for counting quotes.
    """
    lines = _lines(spark, paths)
    inside = _open_splits(lines)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        names = ("file", "split", "seq", "kind", "record")
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        cutter = None
        for batch in batches:
            split, found = batch.column("split").to_numpy(), []
            file = batch.column("file").dictionary_encode()
            place = file.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (split[1:] != split[:-1]) | (place[1:] != place[:-1])]) if len(split) else []
            for start, stop in zip(starts, [*starts[1:], len(split)]):
                here = (file.dictionary[int(place[start])].as_py(), int(split[start]))
                if cutter is None or (cutter.file, cutter.split) != here:
                    found += cutter.end() if cutter else ()
                    cutter = _Cutter(*here, here in inside)
                found += cutter.cut(batch.column("line").slice(start, stop - start))
            yield batch_of(found)
        if cutter:
            yield batch_of(list(cutter.end()))

    pieces = lines.mapInArrow(cut, _SCHEMA)
    whole = pieces.where(F.col("kind") == WHOLE).drop("kind")
    parts = pieces.where(F.col("kind") != WHOLE)
    # A record's first part names it; the parts of a file are few and in order of their splits.
    begun = F.last(F.when(F.col("kind") == FIRST, F.struct("split", "seq")), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("split", "seq"))
    joined = parts.withColumn("begun", begun).groupBy("file", "begun").agg(
        F.array_sort(F.collect_list(F.struct("split", "seq", "record"))).alias("parts"))
    stitched = joined.select("file", "begun.split", "begun.seq", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return whole.union(stitched).withColumn("record", F.regexp_replace("record", "\r$", ""))
