"""WARC packages: round trips, ZIP64 directories, archives without an index."""

import io
import random
import zipfile

import pytest
from corpus_helpers import query_rows, sql_rows

from newslens.llm import web_archives
from newslens.session import scratch_path

SCHEMA = "page_id long, url string, html string, digest string, payload string"


def round_trip(spark, rows, **options):
    path = scratch_path(spark, "warc")
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    web_archives.write_packages(frame, path, **options)
    return web_archives.read_packages(spark, path, with_payload=True).collect()


def uri(page_id):
    return f"{web_archives.ID_PREFIX}{page_id}"


def test_round_trip(spark):
    big = "é" * 300000
    rows = [
        (1, "http://a/", "same"), (2, "http://b/ x\n", "same"), (3, None, None), (4, "http://d/", ""),
        (5, "http://e/", big), (None, "http://f/", "only without id"), (None, "http://g/", "same"),
        (6, "http://h/", "a\r\n\r\nb\0"), (6, "http://h/", "a\r\n\r\nb\0"), (7, "http://i/", "twice"), (7, "http://j/", "other"),
    ]
    got = round_trip(spark, rows, package_bytes=300)
    want = [
        (uri(1), "revisit", uri(2), b""), (uri(2), "response", None, b"same"), (uri(3), "revisit", uri(4), b""),
        (uri(4), "response", None, b""), (uri(5), "response", None, big.encode()),
        (uri(None), "response", None, b"only without id"), (uri(None), "revisit", uri(2), b""),
        (uri(6), "response", None, b"a\r\n\r\nb\0"), (uri(6), "response", None, b"a\r\n\r\nb\0"),
        (uri(7), "response", None, b"twice"), (uri(7), "response", None, b"other"),
    ]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.record_id, r.record_type, r.refers_to, bytes(r.payload)) for r in got], key=key) == sorted(want, key=key)
    assert {r.payload_bytes for r in got if r.record_id == uri(1)} == {4}
    assert {r.url for r in got if r.record_id == uri(2)} == {"http://b/%20x%0A"}
    assert len({r.digest for r in got if r.record_id in (uri(1), uri(2))}) == 1


def test_short_payloads_are_written_each_time(spark):
    got = round_trip(spark, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "long text"), (4, "u", "long text")], min_revisit_bytes=5)
    assert sorted((r.record_id, r.record_type) for r in got) == [
        (uri(1), "response"), (uri(2), "response"), (uri(3), "revisit"), (uri(4), "response")]


def test_empty_table(spark):
    assert round_trip(spark, []) == []


def members(records=3):
    return [(f"page:{i}", web_archives._gzip_member(
        web_archives.warc_record(i, "u", web_archives.base32_digest(b"x" * i), b"x" * i, i, None))) for i in range(records)]


class Opened(io.BytesIO):
    pass


@pytest.mark.parametrize("wide", [False, True])
def test_directories(monkeypatch, wide):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 0)
    content = web_archives.package(members())
    monkeypatch.undo()
    assert (b"PK\x06\x06" in content) == wide
    found = web_archives.zip_members(Opened(content), len(content))
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        assert set(found) == set(archive.namelist())
        for name, (start, length) in found.items():
            assert content[start : start + length] == archive.read(name)


def test_archive_without_index_and_other_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("archive/a.warc.gz", b"".join(m for _, m in members()), zipfile.ZIP_STORED)
        archive.writestr("pages/list.json", "packed " * 50, zipfile.ZIP_DEFLATED)
    content = out.getvalue()
    places = list(web_archives.record_places(Opened(content), len(content)))
    assert [length for _, length in places] == [len(m) for _, m in members()]
    with pytest.raises(ValueError, match="end record"):
        web_archives.zip_members(Opened(b"text"), 4)


def test_query(spark):
    assert query_rows(spark, "op4_warc_packages") == sql_rows("op4_warc_packages")


def test_packages_are_read_in_as_many_tasks_as_their_bytes_ask_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(web_archives, "RANGE_BYTES", 2000)
    rows = [(i, f"http://h/{i}", "".join(random.Random(i).choices("abcdefgh ", k=400))) for i in range(90)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "packages")
    web_archives.write_packages(frame, path)
    total = sum(f.stat().st_size for f in (tmp_path / "packages").rglob("*") if f.is_file() and f.name[0] not in "._")
    found = web_archives.read_packages(spark, path)
    tasks = found.selectExpr("spark_partition_id() AS task").distinct().count()
    assert found.count() == 90 and tasks >= total / 2000 > 5
