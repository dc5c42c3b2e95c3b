import zipfile
from datetime import datetime

import pytest

from newslens.operators.clean import clean_events
from newslens.operators.enrich import enrich_events
from newslens.plans.ingest import read_feed
from newslens.schemas import RAW_EVENT, RAW_GKG, fields
from newslens.sources.archives import read_zipped_events, read_zipped_gkg
from newslens.sources.codes import read_event_codes
from newslens.sources.delimited import read_raw_events, read_raw_gkg, scan_quality
from newslens.sources.manifest import select_feed_files

from helpers import events, plan

NAMES = [name for name, _ in fields(RAW_EVENT)]


def tsv(**values):
    return "\t".join(str(values.get(name, "")) for name in NAMES)


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_schemas_have_the_feed_widths():
    assert len(fields(RAW_EVENT)) == 61
    assert len(fields(RAW_GKG)) == 27


def test_codes_keep_leading_zeros_and_empty_fields_are_null(spark, tmp_path):
    path = write(tmp_path / "a.tsv", tsv(GLOBALEVENTID=1, EventCode="010", AvgTone="-1.5"))
    row = read_raw_events(spark, path).first()
    assert (row.GLOBALEVENTID, row.EventCode, row.AvgTone) == (1, "010", -1.5)
    assert row.Actor1Name is None and row.SOURCEURL is None


def test_list_of_files(spark, tmp_path):
    paths = [write(tmp_path / f"{i}.tsv", tsv(GLOBALEVENTID=i)) for i in range(3)]
    assert read_raw_events(spark, paths).count() == 3


def test_impossible_missing_and_good_dates(spark, tmp_path):
    path = write(
        tmp_path / "bad_dates.tsv",
        tsv(GLOBALEVENTID=1, SQLDATE=20260231), tsv(GLOBALEVENTID=2),
        tsv(GLOBALEVENTID=3, SQLDATE=20260408, MonthYear=202604, IsRootEvent=1,
            DATEADDED=20260409123000, GoldsteinScale="2.5"),
    )
    rows = clean_events(
        read_raw_events(spark, path), extra=["is_root_event", "date_added"]
    ).collect()
    assert [r.GLOBALEVENTID for r in rows] == [3]
    assert rows[0].event_date == datetime(2026, 4, 8)
    assert rows[0].date_added == datetime(2026, 4, 9)
    assert rows[0].is_root_event is True and rows[0].year_month == "202604"


def test_clean_types_and_pruned_scan(spark, tmp_path):
    path = write(tmp_path / "a.tsv", tsv(GLOBALEVENTID=1, SQLDATE=20260408))
    clean = clean_events(read_raw_events(spark, path))
    types = dict(clean.dtypes)
    assert len(types) == 22
    assert types["event_date"] == "timestamp"
    assert types["goldstein_scale"] == types["avg_tone"] == "float"
    assert types["num_mentions"] == "int" and types["EventCode"] == "string"
    read_schema = plan(clean.select("GLOBALEVENTID", "event_date")).split("ReadSchema")[1]
    assert "SQLDATE" in read_schema and "Actor1Name" not in read_schema


def test_stray_quote_does_not_shift_columns(spark, tmp_path):
    path = write(
        tmp_path / "quotes.tsv",
        tsv(GLOBALEVENTID=1, Actor1Name='"PARIS', Actor1CountryCode="FRA", SOURCEURL="u\\1"),
    )
    row = read_raw_events(spark, path).first()
    assert (row.Actor1Name, row.Actor1CountryCode, row.SOURCEURL) == ('"PARIS', "FRA", "u\\1")


def test_short_and_long_rows_are_counted_not_lost(spark, tmp_path):
    path = write(
        tmp_path / "odd.tsv", tsv(GLOBALEVENTID=1), "2\t20260408", tsv(GLOBALEVENTID=3) + "\tx\ty"
    )
    assert read_raw_events(spark, path).count() == 3
    quality = scan_quality(read_raw_events(spark, path, keep_corrupt=True)).first()
    assert (quality.total_rows, quality.malformed_rows, quality.rows_without_id) == (3, 2, 0)


def test_gkg_dotted_columns(spark, tmp_path):
    names = [name for name, _ in fields(RAW_GKG)]
    values = {"GKGRECORDID": "r1", "V1.5TONE": "1,2", "SOURCECOLLECTIONIDENTIFIER": "1"}
    path = write(tmp_path / "a.gkg.csv", "\t".join(values.get(n, "") for n in names))
    row = read_raw_gkg(spark, path).select("GKGRECORDID", "`V1.5TONE`").first()
    assert tuple(row) == ("r1", "1,2")
    assert scan_quality(read_raw_gkg(spark, path, keep_corrupt=True)).first().total_rows == 1


def test_event_codes(spark, tmp_path):
    path = write(
        tmp_path / "codes.txt",
        "CODE\tDESCRIPTION", "", "01\tMAKE  PUBLIC   STATEMENT", "   ",
        '0311 Express "intent', "057", "01 Second text",
    )
    codes = {tuple(r) for r in read_event_codes(spark, path).collect()}
    assert codes == {
        ("01", "MAKE PUBLIC STATEMENT"), ("0311", 'Express "intent'), ("057", ""),
        ("01", "Second text"),
    }


def test_each_code_file_loses_its_own_first_line(spark, tmp_path):
    for i in range(2):
        write(tmp_path / f"c{i}.txt", "CODE TEXT", f"{i} text")
    assert read_event_codes(spark, str(tmp_path)).count() == 2


def test_enrichment_drops_unknown_codes_and_fans_out_duplicates(spark, tmp_path):
    path = write(tmp_path / "codes.txt", "h", "010 First", "010 Second", "020 Other")
    codes = read_event_codes(spark, path)
    rows = events(spark, [{"EventCode": c} for c in ("010", "020", "999", None)])
    joined = enrich_events(rows.drop("EventDescription"), codes)
    got = sorted((r.GLOBALEVENTID, r.EventDescription) for r in joined.collect())
    assert got == [(0, "First"), (0, "Second"), (1, "Other")]
    assert joined.columns[-1] == "EventDescription"


def test_lookup_is_broadcast_by_its_size_and_merged_beyond(spark, tmp_path):
    codes = read_event_codes(spark, write(tmp_path / "codes.txt", "h", "010 First", "020 Other"))
    rows = events(spark, [{"EventCode": c} for c in ("010", "020", "010")]).drop("EventDescription")
    small = enrich_events(rows, codes)
    assert "BroadcastHashJoin" in plan(small) and "BuildRight" in plan(small)
    expected = sorted(small.collect())
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        large = enrich_events(rows, codes)
        assert "SortMergeJoin" in plan(large)
        assert sorted(large.collect()) == expected
    finally:
        spark.conf.set(key, before)


def zip_file(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as target:
        for name, text in members.items():
            target.writestr(name.replace("__", "/").replace("_", "."), text)
    return str(path)


def test_zipped_events_are_read_in_place(spark, tmp_path):
    line = tsv(GLOBALEVENTID=7, EventCode="010", Actor1Name='"A')
    zip_file(
        tmp_path / "a.zip", one_CSV=line + "\r\n\n", empty_csv="", readme_md="no rows",
        sub__two_CSV=tsv(GLOBALEVENTID=99),
    )
    assert [(r.GLOBALEVENTID, r.Actor1Name) for r in
            read_zipped_events(spark, str(tmp_path)).collect()] == [(7, '"A')]
    zip_file(tmp_path / "b.zip", three_txt=tsv(GLOBALEVENTID=8) + "\n" + tsv(GLOBALEVENTID=9))
    got = read_zipped_events(spark, str(tmp_path))
    assert sorted(r.GLOBALEVENTID for r in got.collect()) == [7, 8, 9]
    assert (tmp_path / "a.zip").exists() and (tmp_path / "b.zip").exists()


def test_zipped_gkg(spark, tmp_path):
    zip_file(tmp_path / "a.zip", one_csv="r1\t2024\t1\tsrc" + "\t" * 23)
    row = read_zipped_gkg(spark, str(tmp_path)).first()
    assert (row.GKGRECORDID, row.SOURCECOLLECTIONIDENTIFIER, row.SOURCECOMMONNAME) == ("r1", 1, "src")


def test_feed_of_zip_and_text_files(spark, tmp_path):
    zipped = zip_file(tmp_path / "a.zip", one_CSV=tsv(GLOBALEVENTID=1))
    plain = write(tmp_path / "b.CSV", tsv(GLOBALEVENTID=2))
    assert {r.GLOBALEVENTID for r in read_feed(spark, [zipped, plain]).collect()} == {1, 2}
    with pytest.raises(ValueError):
        read_feed(spark, [])


def test_manifest_window(spark, tmp_path):
    base = "http://feed.example/v2/"
    path = write(
        tmp_path / "manifest.txt",
        f"10 aa {base}20240310120000.export.CSV.zip",
        f"10 aa {base}20240310070000.export.CSV.zip",  # exactly now - (2 + 3) hours
        f"10  aa   {base}20240310070100.export.CSV.zip",
        f"10 aa {base}20240310120000.gkg.csv.zip",
        f"10 {base}20240310120000.export.CSV.zip",
        f"10 aa {base}notadate.export.CSV.zip",
        "",
    )
    now = datetime(2024, 3, 10, 12)
    files = select_feed_files(spark, path, "export", now, 2).orderBy("file_time").collect()
    assert [r.url.rsplit("/")[-1] for r in files] == [
        "20240310070100.export.CSV.zip", "20240310120000.export.CSV.zip",
    ]
    assert files[-1].file_time == datetime(2024, 3, 10, 12)
    assert select_feed_files(spark, path, "gkg", now, 2).count() == 1
    assert select_feed_files(spark, path, "export", now, 24).count() == 3
