"""WARC archives with one gzip member for each record, and the index of their records.

Crawls often come as archives compressed as one gzip stream, which can only be read from the start. ``normalised`` inflates
such a stream once, in portions, writes every record anew as a gzip member of its own, and writes beside each archive
an index with offset and length of each member, so that one record can be read without the others.

Archives are files in a folder that Spark writes and reads, so they may lie in any store that Spark reaches:
``archive=<name>/kind=warc`` holds the archive, ``archive=<name>/kind=index`` its index (JSON lines, compressed). Spark's text
writer puts them there as they are: it ends each value with a zero byte, and so does every gzip member of fewer than 16 MiB
(the last byte of its length), so that byte is left to the writer. Behind a longer member an empty one is put.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.llm.staging import staged

#: An archive is closed when its records reach this many bytes before compression.
ARCHIVE_BYTES = 12 << 20
#: Records of a common payload are dealt over so many keys.
SALTS = 32
#: Bytes inflated at once.
PORTION = 1 << 20
#: Fixed date of records, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"

PAGE = "urn:page:"
FILES = "archive string, kind string, content binary"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The record of a page: its response, or where the payload stands in another record, a revisit of that one.

    Characters that a header cannot hold are percent-encoded in the address. A revisit keeps digest and length of the payload.
    """
    name = lambda i: f"{PAGE}{'' if i is None else i}"
    fields = [] if url is None else [("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~ "))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _record("response", name(page_id), [*fields, ("Content-Type", "application/http; msgtype=response")], head + payload)
    fields += [("WARC-Refers-To", f"<{name(refers_to)}>"), ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _record("revisit", name(page_id), fields, head)


def _portions(content: bytes) -> Iterator[bytes]:
    """A file inflated once from start to end, in portions; one stream, several members, or plain text."""
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(content), PORTION):
            yield content[at:at + PORTION]
        return
    rest = content
    while rest:
        stream = zlib.decompressobj(31)
        while not stream.eof:
            data = stream.decompress(rest, PORTION)
            rest = stream.unconsumed_tail
            if not data and not stream.eof and not rest:
                raise ValueError("an archive ends within a gzip member")
            yield data
        rest = stream.unused_data.lstrip(b"\0")


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields in lower case, block, whole record) of every record of an archive, in order."""
    portions, held = _portions(content), bytearray()

    def fill() -> bool:
        more = next(portions, None)
        if more is not None:
            held.extend(more)
        return more is not None

    while True:
        while not held.strip(b"\r\n") and fill():
            del held[:len(held) - len(held.lstrip(b"\r\n"))]
        if not held.strip(b"\r\n"):
            return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                raise ValueError("an archive ends within a record's header")
        lines = held[:end].decode().split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        if not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
            raise ValueError(f"no WARC record begins at {lines[0][:40]!r}")
        stop = end + 4 + int(fields["content-length"])
        while len(held) < stop + 4 and fill():
            pass
        if len(held) < stop:
            raise ValueError("an archive ends within a record")
        whole = bytes(held[:stop])
        del held[:stop + 4 if held[stop:stop + 4] == b"\r\n\r\n" else stop]
        yield fields, whole[end + 4:], whole + b"\r\n\r\n"


def _written(files: DataFrame, folder: str) -> None:
    """Write (archive, kind, content) as files. Contents end with the zero byte that the writer adds."""
    value = F.expr("cast(substring(content, 1, length(content) - 1) as string)")
    files.select("archive", "kind", value.alias("value")).write.partitionBy("archive", "kind").option("lineSep", "\0").text(folder)


def _closed(content: bytes) -> bytes:
    """Gzip members that end with a zero byte."""
    return content if content[-1:] == b"\0" else content + member(b"")


def _files(rows: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], ["archive", "kind", "content"])


def with_references(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to): of pages with equal payloads, all but that of the largest id refer to it.

    Only payloads that occur twice are looked up, by checksum and one of ``SALTS`` keys of the page, so a payload that a third
    of all pages share is dealt over as many tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("key"),
                       F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    common = own.groupBy("key").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = staged(common.drop("n"), "warc-common").select("key", "newest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return own.join(dealt, ["key", "salt"], "left").select(
        "page_id", "url", "payload", F.when(~F.col("newest").eqNullSafe(F.col("page_id")), F.col("newest")).alias("refers_to"))


def write_streams(pages: DataFrame, folder: str) -> None:
    """Write a record for each page into archives that are one gzip stream each.

    ``pages`` has page_id, url and html (null: an empty payload). Of records with equal payloads that of the largest
    page_id is the response and the others revisit it; rows that repeat this id are responses too, and where all ids are
    null, all are. Other columns are left out. A task closes an archive at ``ARCHIVE_BYTES``, so no row grows with the table.
    """
    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, size = TaskContext.get().partitionId(), 0, 0
        packer, parts = None, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                record = page_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())
                packer = packer or zlib.compressobj(1, zlib.DEFLATED, 31)
                parts.append(packer.compress(record))
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield _files([(f"{task:06d}-{count:06d}", "warc", _closed(b"".join([*parts, packer.flush()])))])
                    packer, parts, count, size = None, [], count + 1, 0
        if packer:
            yield _files([(f"{task:06d}-{count:06d}", "warc", _closed(b"".join([*parts, packer.flush()])))])

    _written(with_references(pages).mapInArrow(archives, FILES), folder)


def _contents(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(archive, content) of the files of a kind below a folder; none where there are none."""
    try:
        found = spark.read.format("binaryFile").load(f"{folder}/archive=*/kind={kind}/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "archive string, content binary")
    return found.select(F.regexp_extract("path", r"archive=([^/]+)/", 1).alias("archive"), "content")


def normalised(spark: SparkSession, source: str, target: str) -> None:
    """Write the archives of ``source`` anew with a gzip member for each record, and their indexes.

    Every archive is inflated once, in portions; a new one is closed at ``ARCHIVE_BYTES`` of records, so an archive of any
    length is never held inflated. One that ends within a record is an error that names it.
    """
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content")):
                yield from _rewritten(name.as_py(), content.as_py())

    _written(_contents(spark, source, "warc").mapInArrow(rewrite, FILES), target)


def _rewritten(name: str, content: bytes) -> Iterator[pa.RecordBatch]:
    members, lines, offset, size, count = [], [], 0, 0, 0

    def closed() -> pa.RecordBatch:
        own = f"{name}-{count:04d}"
        index = "".join(json.dumps(line) + "\n" for line in lines)
        return _files([(own, "warc", _closed(b"".join(members))), (own, "index", _closed(member(index.encode())))])

    try:
        for fields, _, whole in records(content):
            packed = member(whole)
            members.append(packed)
            lines.append({"offset": offset, "length": len(packed), "type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"),
                          "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")})
            offset, size = offset + len(packed), size + len(whole)
            if size >= ARCHIVE_BYTES:
                yield closed()
                members, lines, offset, size, count = [], [], 0, 0, count + 1
    except (ValueError, zlib.error) as e:
        raise ValueError(f"archive {name}: {e}") from e
    if members:
        yield closed()


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, offset, length, type, record_id, uri, digest) of every record."""
    line = "offset long, length long, type string, record_id string, uri string, digest string"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content")):
                text = b"".join(_portions(content.as_py())).decode().splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(text), pa.string()), pa.array(text, pa.string())], ["archive", "line"])

    found = _contents(spark, folder, "index").mapInArrow(lines, "archive string, line string")
    return found.select("archive", F.from_json("line", line).alias("r")).select("archive", "r.*")


def read_record(spark: SparkSession, folder: str, archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record, inflated by its place alone; no other record is touched."""
    file = spark.read.format("binaryFile").load(f"{folder}/archive={archive}/kind=warc/*")
    cut = file.select(F.expr(f"substring(content, {offset + 1}, {length})").alias("c")).first()["c"]
    fields, block, _ = next(records(bytes(cut)))
    return fields, block


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    """Per record of a page, as read from its archive: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken from its payload, those of a revisit from its header. Records of other kinds
    are passed over.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    number = lambda value: int(value.strip("<>").removeprefix(PAGE)) if value and value.strip("<>") != PAGE else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block, _ in records(content.as_py()):
                    if fields.get("warc-type") not in ("response", "revisit") or not fields.get("warc-record-id", "").startswith(f"<{PAGE}"):
                        continue
                    if fields["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        size, sha1 = len(payload), digest(payload)
                    else:
                        size, sha1 = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((number(fields["warc-record-id"]), fields.get("warc-target-uri"), size, sha1, fields["warc-type"],
                                 number(fields.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return _contents(spark, folder, "warc").mapInArrow(read, schema)
