"""Archives written, rewritten, read back whole and record by record; bytes held against gzip and plain parsing."""

import base64
import glob
import gzip
import hashlib
import random
import string

import pytest

from opslens.llm import warc

SCHEMA = "page_id long, url string, html string, archive string, kind string, content string"
LONG = "".join(random.Random(3).choices(string.printable + "é日", k=300_000))
ROWS = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "http://a/é\r\nX: y", None), (4, "u", ""),
        (None, "n", "<p>null id</p>"), (None, "m", "<p>null id</p>"), (None, "m", ""), (5, "x", LONG), (6, "x", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
        (7, "same", "twice"), (7, "same", "twice"), (8, "z", "\r\n\r\n\x00"), (-4, "z", "minus")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "a", "k", "c") for r in ROWS], SCHEMA)


def expected(rows):
    newest, found = {}, []
    for i, _, html in rows:
        found_id = newest.get(html or "")
        newest[html or ""] = i if found_id is None or i is not None and i > found_id else found_id
    for i, _, html in rows:
        data, last = (html or "").encode(), newest[html or ""]
        found.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == last else "revisit", None if i == last else last))
    return sorted(map(repr, found))


def round_trip(spark, pages, folder):
    warc.write_streams(pages, f"{folder}/streams")
    warc.normalised(spark, f"{folder}/streams", f"{folder}/members")
    return sorted(repr(tuple(r)) for r in warc.pages_of(spark, f"{folder}/members").drop("url").collect())


def test_round_trip(spark, pages, tmp_path):
    assert round_trip(spark, pages, str(tmp_path)) == expected(ROWS)
    assert sorted(repr(tuple(r)) for r in warc.pages_of(spark, f"{tmp_path}/streams").drop("url").collect()) == expected(ROWS)
    for path in glob.glob(f"{tmp_path}/*/archive=*/kind=*/*.txt"):
        assert gzip.decompress(open(path, "rb").read())


def test_every_record_is_a_member_at_its_place(spark, pages, tmp_path):
    round_trip(spark, pages.coalesce(2), str(tmp_path))
    places = warc.index(spark, f"{tmp_path}/members").collect()
    assert len(places) == len(ROWS)
    for archive in {p.archive for p in places}:
        (path,) = glob.glob(f"{tmp_path}/members/archive={archive}/kind=warc/*.txt")
        data, at = open(path, "rb").read(), 0
        for p in sorted((p for p in places if p.archive == archive), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            whole = gzip.decompress(data[p.offset:at])
            assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")
        assert at == len(data)
    one = next(p for p in places if p.record_id == "<urn:page:5>")
    fields, block = warc.read_record(spark, f"{tmp_path}/members", one.archive, one.offset, one.length)
    assert block.endswith(LONG.encode()) and fields["warc-payload-digest"] == one.digest


def test_archives_are_closed_by_size(monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)
    rows = list(warc._rewritten("a", b"".join(warc.member(warc.page_record(i, "u", b"x" * 90, None)) for i in range(7))))
    assert [r.column("archive").to_pylist() for r in rows] == [[f"a-{i:04d}"] * 2 for i in range(7)]


def test_streams_of_any_form():
    whole = [warc.page_record(i, "u", b"y" * (i * 700_000), None) for i in range(5)]
    for content in (warc.member(b"".join(whole)), b"".join(map(warc.member, whole)), b"".join(whole), warc.member(b"".join(whole)) + warc.member(b"")):
        assert [r[2] for r in warc.records(content)] == whole
    assert list(warc.records(b"")) == list(warc.records(warc.member(b""))) == []


@pytest.mark.parametrize("cut", [-9, 50, 200])
def test_a_broken_archive_is_named(cut):
    content = warc.member(warc.page_record(1, "u", bytes(random.Random(1).randbytes(5000)), None))[:cut]
    with pytest.raises(ValueError, match="archive torn"):
        list(warc._rewritten("torn", content))


def test_long_members_end_with_a_zero_byte():
    assert warc._closed(b"\x1f\x8bx\x01")[-1:] == b"\0" and warc._closed(b"\x1f\x8bx\0") == b"\x1f\x8bx\0"
    data = b"a" * ((1 << 24) + 5)
    assert gzip.decompress(warc._closed(warc.member(data))) == data


def test_no_pages(spark, pages, tmp_path):
    assert round_trip(spark, pages.where("false"), str(tmp_path)) == []
    assert warc.index(spark, f"{tmp_path}/members").count() == 0
