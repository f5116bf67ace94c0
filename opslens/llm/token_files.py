"""Token ids in wavelet-matrix files.

Documents are put in ascending order of their id, encoded, closed with an end id, and packed into shards of a bounded
number of ids. A shard is one Parquet file of one row, compressed by Parquet: the bit-planes with their rank directory,
and the ids and lengths of its documents. Spark's own writer commits the files, so any store works that Spark can write
to, and a task that is lost and run again leaves no half-written file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opslens.llm.pieces import encoder
from opslens.llm.staging import tidy
from opslens.llm.wavelet import WaveletMatrix

END_ID = 0
#: Ids after which a shard is closed; a document is never cut. 32 MB of planes, about 300 MB of a worker's memory.
SHARD_IDS = 16_000_000
FILE_SCHEMA = (
    "shard long, n long, zeros array<long>, planes array<binary>, ranks array<binary>, "
    "doc_ids binary, doc_nulls binary, doc_sizes binary"
)
_FILE = pa.schema([
    ("shard", pa.int64()), ("n", pa.int64()), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
    ("ranks", pa.list_(pa.binary())), ("doc_ids", pa.binary()), ("doc_nulls", pa.binary()), ("doc_sizes", pa.binary())])


def _blobs(parts: list[np.ndarray]) -> pa.ListArray:
    """One row: the bytes of each part."""
    ends = np.cumsum([0, *(p.nbytes for p in parts)]).astype(np.int32)
    held = pa.py_buffer(np.concatenate(parts).view(np.uint8))
    return pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends), held]))


def _row(shard: int, ids: list[np.ndarray], doc_ids: list, sizes: list[int]) -> pa.RecordBatch:
    """A shard's row; ``ids`` is emptied, so that they are held once while the planes are built."""
    whole = [np.concatenate(ids)]
    ids.clear()
    matrix = WaveletMatrix.build(whole.pop())
    missing = np.array([x is None for x in doc_ids], np.uint8)
    numbers = np.array([0 if x is None else x for x in doc_ids], "<i8")
    planes, ranks = _blobs(matrix.planes), _blobs([r.astype("<u4") for r in matrix.ranks])
    blob = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.array([shard]), pa.array([matrix.n]), pa.array([matrix.zeros], pa.list_(pa.int64())), planes, ranks, blob(numbers), blob(missing),
        blob(np.array(sizes, "<i8"))], schema=_FILE)


def _packer(path: str, shard_ids: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        shard = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        doc_ids, sizes, held, open_size = [], [], 0, 0
        end = np.array([END_ID], np.uint16)
        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for found, counts in tokens.encode(batch.column(1)):
                found = found.astype(np.uint16) if not len(found) or found.max() < 1 << 16 else found
                at = 0
                for count in counts.tolist():
                    if count < 0:  # a part of a long text
                        ids.append(found)
                        open_size += len(found)
                        continue
                    ids += [found[at : at + count], end]
                    at += count
                    doc_ids.append(next(names))
                    sizes.append(open_size + count + 1)
                    held += sizes[-1]
                    open_size = 0
                    if held >= shard_ids:
                        yield _row(shard, ids, doc_ids, sizes)
                        shard, ids, doc_ids, sizes, held = shard + 1, [], [], [], 0
        if doc_ids:
            yield _row(shard, ids, doc_ids, sizes)

    return pack


def write(docs: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` into shard files under ``folder``.

    ``tokenizer``: path of a vocabulary file for the tokenizers library, the same on every machine. Null and empty texts
    have the end id alone. Null ids come first. Repeated rows are written each; rows of equal id come in the order of
    their texts' hash. Other columns are not read. An empty table leaves a folder without shards.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ranges = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    (ranges.mapInArrow(tidy(_packer(tokenizer, shard_ids)), FILE_SCHEMA)
     .write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(folder))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The shard files, one row each."""
    return spark.read.schema(FILE_SCHEMA).parquet(folder)


def matrix(row: dict) -> WaveletMatrix:
    """The wavelet matrix of a shard's row."""
    return WaveletMatrix(
        row["n"], list(row["zeros"]), [np.frombuffer(p, np.uint8) for p in row["planes"]],
        [np.frombuffer(r, "<u4") for r in row["ranks"]])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            bits = [np.frombuffer(p.as_buffer(), np.uint8) for p in batch["planes"][i].values]
            ids = WaveletMatrix(batch["n"][i].as_py(), batch["zeros"][i].as_py(), bits, []).decode()
            sizes = np.frombuffer(batch["doc_sizes"][i].as_buffer(), "<i8")
            missing = np.frombuffer(batch["doc_nulls"][i].as_buffer(), np.uint8).astype(bool)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(sizes), batch["shard"][i].as_py())), pa.array(np.arange(len(sizes))),
                pa.array(np.frombuffer(batch["doc_ids"][i].as_buffer(), "<i8"), mask=missing), pa.array(ends - sizes), pa.array(sizes),
                pa.array([zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(ends - sizes, ends, strict=True)], pa.int64()),
            ], names=["shard", "place", "doc_id", "start", "n_tokens", "ids_crc32"])


def documents(shards: DataFrame) -> DataFrame:
    """Each document as read back from its shard: shard, place in it, doc_id, start (ids of all documents before it in
    all shards), n_tokens (with the end id) and the unsigned crc32 of its ids as little-endian 32-bit integers."""
    # one row per shard of SHARD_IDS ids passes through one task
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = shards.select("shard", "n").select("shard", before.alias("ahead"))
    rows = shards.mapInArrow(tidy(_documents), "shard long, place long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, "shard").withColumn("start", F.col("start") + F.col("ahead")).drop("ahead")


def occurrences(shards: DataFrame, tokens: list[int], limit: int | None = None) -> DataFrame:
    """Places (shard, token, place in the shard) of given ids, found by select; ``limit``: the first so many in a shard."""
    def find(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                held = matrix(row)
                for token in tokens:
                    n = held.count(token)
                    places = [held.select(token, k) for k in range(n if limit is None else min(n, limit))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["shard"]] * len(places), pa.int64()), pa.array([token] * len(places), pa.int64()), pa.array(places, pa.int64())],
                        names=["shard", "token", "place"])

    return shards.select("shard", "n", "zeros", "planes", "ranks").mapInArrow(find, "shard long, token long, place long")


def counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """How often given ids occur, by rank at both ends of each shard."""
    def count(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held = matrix(batch.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens, pa.int64()), pa.array([held.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    slim = shards.select("shard", "n", "zeros", "planes", "ranks")
    return slim.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
