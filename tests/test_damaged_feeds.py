"""Damaged rows and archives: the quarantine, checked windows, archives dealt out by member."""

import hashlib
import zipfile
from datetime import datetime

import pytest

from newslens import session
from newslens.plans.ingest import ingest, ingest_checked_window, read_quarantine
from newslens.schemas import RAW_EVENT
from newslens.sources import archives
from newslens.sources.archives import lines_from_archives, lines_from_members, read_zipped_events, scan_archives
from newslens.sources.manifest import feed_check
from newslens.sources.tables import read_events

from test_sources import tsv, write, zip_file

SOUND = tsv(GLOBALEVENTID=1, SQLDATE=20240301, EventCode="010", NumArticles=5)
DAMAGED = [
    ("2\t20240301", 2, "number of fields", False),
    ("3", 3, "number of fields", True),
    (tsv(GLOBALEVENTID=4, SQLDATE=20240301, EventCode="010") + "\textra", 4, "number of fields", False),
    (tsv(GLOBALEVENTID=5, SQLDATE=20240301, EventCode="010", NumMentions="many"), 5, "unreadable field", False),
    (tsv(GLOBALEVENTID=6, EventCode="010"), 6, "no day", True),
    (tsv(GLOBALEVENTID=7, SQLDATE=20240231, EventCode="010"), 7, "no calendar day", True),
    (tsv(SQLDATE=20240301, EventCode="010"), None, "no id", False),
]


@pytest.fixture
def codes(tmp_path):
    return write(tmp_path / "codes.txt", "h", "010 Make statement")


@pytest.mark.parametrize("zipped", [False, True])
def test_damaged_rows_are_quarantined_once(spark, tmp_path, codes, zipped):
    root = str(tmp_path / "db")
    quote = tsv(GLOBALEVENTID=8, SQLDATE=20240301, EventCode="010", Actor1Name='"PARIS')
    lines = [SOUND, quote, *(d[0] for d in DAMAGED)]
    feed = zip_file(tmp_path / "f.zip", a_CSV="\n".join(lines)) if zipped else write(tmp_path / "f.CSV", *lines)
    for _ in range(2):
        counts = ingest(spark, feed, codes, root)
        assert counts == {"read": 9, "cleaned": 6, "staged": 5}
        got = read_quarantine(spark, root).collect()
        assert sorted(map(repr, ((r.line, r.GLOBALEVENTID, r.reason, r.dropped) for r in got))) == sorted(map(repr, DAMAGED))
    stored = {r.GLOBALEVENTID: r for r in read_events(spark, root).collect()}
    # Rows 2 and 3 have no code, so no description; the others keep what could be read.
    assert set(stored) == {1, 4, 5, 8, None}
    assert stored[5].num_mentions is None and stored[8].Actor1Name == '"PARIS'


def test_checked_window(spark, tmp_path, codes):
    folder, root = tmp_path / "in", str(tmp_path / "db")
    folder.mkdir()
    names = [f"2024030{n}000000.export.CSV.zip" for n in range(1, 7)]
    listed = []
    for n, name in enumerate(names):
        zip_file(folder / name, a_CSV=tsv(GLOBALEVENTID=n, SQLDATE=20240301, EventCode="010"))
        content = (folder / name).read_bytes()
        listed.append(f"{len(content)} {hashlib.md5(content).hexdigest().upper()} http://h/{name}")
        if n == 1:
            (folder / name).write_bytes(content[:-5])
        elif n == 2:
            (folder / name).write_bytes(content[:-1] + b"\x7f")
        elif n == 3:
            (folder / name).unlink()
        elif n == 4:
            listed[-1] = f"large {hashlib.md5(content).hexdigest()} http://h/{name}"
    zip_file(folder / "20240307000000.export.CSV.zip", a_CSV=tsv(GLOBALEVENTID=99, SQLDATE=20240301, EventCode="010"))
    manifest = write(tmp_path / "list.txt", *listed)
    check = ingest_checked_window(spark, manifest, str(folder), codes, root, datetime(2024, 3, 7), 300)
    states = ["sound", "wrong size", "wrong hash", "missing", "wrong size", "sound"]
    assert {r.name: r.state for r in check.collect()} == dict(zip(names, states, strict=True))
    assert sorted(r.GLOBALEVENTID for r in read_events(spark, root).collect()) == [0, 5]
    none = feed_check(spark, manifest, str(tmp_path / "db"), "export", datetime(2024, 3, 7), 300)
    assert {r.state for r in none.collect()} == {"missing"}


def large_archive(path, method):
    with zipfile.ZipFile(path, "w", method) as target:
        for n in range(12):
            target.writestr(f"{n}.CSV", "\r\n".join(tsv(GLOBALEVENTID=n * 1000 + i, Actor1Name="é") for i in range(300)))
        target.writestr("readme.md", "no rows")
        target.writestr("sub/x.CSV", "no rows")
        target.writestr("empty.csv", "")
    return str(path)


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_a_large_archive_is_dealt_out_by_member(spark, tmp_path, method):
    found = scan_archives(spark, large_archive(tmp_path / "a.zip", method))
    by_member = lines_from_members(found, 8)
    assert sorted(by_member.collect()) == sorted(lines_from_archives(found).collect())
    assert by_member.count() == 3600
    tasks = by_member.selectExpr("spark_partition_id() AS task").distinct().count()
    assert lines_from_archives(found).selectExpr("spark_partition_id() AS task").distinct().count() == 1
    assert tasks >= 5
    for large in (0, 1 << 30):
        rows = read_zipped_events(spark, str(tmp_path), large)
        assert (rows.count(), rows.where("Actor1Name = 'é'").count()) == (3600, 3600)


def test_a_damaged_member_is_an_error(spark, tmp_path):
    path = large_archive(tmp_path / "a.zip", zipfile.ZIP_STORED)
    content = open(path, "rb").read()
    spot = content.index(b"\t\xc3\xa9")
    open(path, "wb").write(content[:spot] + b"\tX" + content[spot + 2 :])
    with pytest.raises(Exception, match="cut off or damaged"):
        lines_from_members(scan_archives(spark, path), 2).collect()


def test_inflated_bytes_of_any_size():
    import io
    import zlib

    data = bytes(range(256)) * 20_000
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    for method, body in ((zipfile.ZIP_DEFLATED, packed), (zipfile.ZIP_STORED, data)):
        read = io.BufferedReader(archives._Inflated(method, body, zlib.crc32(data), len(data)), 777)
        assert read.read() == data
    assert len(RAW_EVENT.split(",")) == 61


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Session())
