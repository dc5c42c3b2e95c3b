from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newslens.operators.search import SearchSpec
from newslens.plans.analysis import SUMMARY_TABLES, clear, run_analysis, run_story_analysis
from newslens.plans.dashboard import country_insights, event_spikes, global_trends
from newslens.plans.ingest import ingest, ingest_window, one_row_per_event
from newslens.session import scratch_path
from newslens.sinks import tables
from newslens.sinks.tables import merge_events, write_events
from newslens.sources.tables import (
    SUMMARY_ORDER,
    read_events,
    read_stored_events,
    read_table,
    summary_head,
)
from newslens.streaming.feed import ingest_landed

from helpers import day, events, plan
from test_sources import tsv, write, zip_file

LINES = [
    tsv(GLOBALEVENTID=i, SQLDATE=20240301 + i % 3, EventCode="010", EventBaseCode="010",
        QuadClass=1, GoldsteinScale=-1.5, AvgTone=i / 2, NumMentions=i, NumArticles=i,
        NumSources=30, ActionGeo_FullName="Paris", ActionGeo_CountryCode="FR",
        ActionGeo_Lat=48.5, ActionGeo_Long=2.25, SOURCEURL=f"u{i}")
    for i in range(1, 13)
]


@pytest.fixture
def codes(tmp_path):
    return write(tmp_path / "codes.txt", "h", "010 Make statement")


def stored_rows(spark, root):
    return sorted(map(str, read_events(spark, root).collect()))


def test_zip_ingest_twice_leaves_the_table_as_it_is(spark, tmp_path, codes):
    root = str(tmp_path / "db")
    bad = [tsv(GLOBALEVENTID=90, SQLDATE=20240231, EventCode="010"),
           tsv(GLOBALEVENTID=91, SQLDATE=20240301, EventCode="999")]
    feed = zip_file(tmp_path / "f.zip", a_CSV="\n".join(LINES + LINES[:2] + bad))
    counts = ingest(spark, feed, codes, root)
    assert counts == {"read": 16, "cleaned": 15, "staged": 12}
    first = stored_rows(spark, root)
    assert len(first) == 12
    ingest(spark, feed, codes, root)
    assert stored_rows(spark, root) == first
    types = dict(read_events(spark, root).dtypes)
    assert types["event_date"] == "timestamp" and types["avg_tone"] == "float"


def test_later_feed_adds_to_a_day_and_keeps_the_others(spark, tmp_path, codes):
    root = str(tmp_path / "db")
    ingest(spark, write(tmp_path / "a.CSV", *LINES), codes, root)
    late = tsv(GLOBALEVENTID=50, SQLDATE=20240302, EventCode="010", NumArticles=1)
    changed = tsv(GLOBALEVENTID=1, SQLDATE=20240302, EventCode="010", NumArticles=77)
    ingest(spark, write(tmp_path / "b.CSV", late, changed), codes, root)
    rows = {r.GLOBALEVENTID: r for r in read_events(spark, root).collect()}
    assert set(rows) == {*range(1, 13), 50}
    assert rows[1].num_articles == 77 and rows[50].event_date == day(2)


def test_rows_without_id_are_kept_and_not_repeated(spark, tmp_path):
    root = str(tmp_path / "db")
    rows = events(spark, [dict(GLOBALEVENTID=None, SOURCEURL=u) for u in ("a", "b", "b")])
    rows.write.parquet(f"{tmp_path}/staged")
    staged = spark.read.parquet(f"{tmp_path}/staged")
    assert one_row_per_event(staged).count() == 2
    write_events(one_row_per_event(staged), root)
    merge_events(spark, one_row_per_event(staged), root)
    assert read_events(spark, root).count() == 2


def test_repeated_event_keeps_one_deterministic_row(spark):
    rows = events(spark, [
        dict(GLOBALEVENTID=1, num_articles=3), dict(GLOBALEVENTID=1, num_articles=9),
        dict(GLOBALEVENTID=2),
    ])
    for n in (1, 5):
        got = one_row_per_event(rows.repartition(n)).orderBy("GLOBALEVENTID").collect()
        assert [(r.GLOBALEVENTID, r.num_articles) for r in got] == [(1, 9), (2, 1)]


def test_rows_that_come_once_are_not_shuffled(spark, tmp_path):
    rows = [dict(GLOBALEVENTID=i, SOURCEURL=f"http://news.example/{i * 7919}") for i in range(3000)]
    events(spark, [*rows, dict(GLOBALEVENTID=7, num_articles=9)]).write.parquet(f"{tmp_path}/staged")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        # The feed is larger than what is broadcast, its repeated keys are not.
        spark.conf.set(name, "2k")
        once = one_row_per_event(spark.read.parquet(f"{tmp_path}/staged"))
        assert "SortMergeJoin" not in plan(once) and "BroadcastHashJoin" in plan(once)
        assert once.count() == 3000
        assert once.where("GLOBALEVENTID = 7").first().num_articles == 9
    finally:
        spark.conf.set(name, before)


def test_day_filter_prunes_folders_and_columns(spark, tmp_path):
    root = str(tmp_path / "db")
    write_events(events(spark, [dict(event_date=day(n)) for n in (1, 2, 3)]), root)
    assert sorted(p.name for p in (tmp_path / "db" / "events").glob("event_date=*")) == [
        "event_date=2024-03-01", "event_date=2024-03-02", "event_date=2024-03-03"]
    one = read_events(spark, root).where(F.col("event_date") == F.lit("2024-03-02").cast("timestamp"))
    one = one.where("num_articles >= 1").select("GLOBALEVENTID")
    text = plan(one)
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(event_date" in text
    assert "GreaterThanOrEqual(num_articles,1)" in text and "SOURCEURL" not in text


def test_missing_table_raises(spark, tmp_path):
    assert read_stored_events(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        read_events(spark, str(tmp_path / "none"))


def test_failed_write_raises(spark, tmp_path):
    blocked = tmp_path / "blocked"
    blocked.write_text("a file, not a folder")
    with pytest.raises(Exception):
        write_events(events(spark, [{}]), str(blocked))


def test_moved_id_leaves_its_old_day(spark, tmp_path):
    root = str(tmp_path / "db")
    write_events(events(spark, [dict(GLOBALEVENTID=1), dict(GLOBALEVENTID=2, event_date=day(2))]), root)
    merge_events(spark, events(spark, [dict(GLOBALEVENTID=1, event_date=day(3))]), root)
    rows = {r.GLOBALEVENTID: r.event_date for r in read_events(spark, root).collect()}
    assert rows == {1: day(3), 2: day(2)}
    assert not (tmp_path / "db" / "events" / "event_date=2024-03-01").exists()


def test_repeated_rows_rewrite_nothing(spark, tmp_path):
    root = str(tmp_path / "db")
    rows = events(spark, [dict(GLOBALEVENTID=i, event_date=day(1 + i % 2)) for i in range(4)])
    write_events(rows, root)
    files = sorted(p.name for p in (tmp_path / "db" / "events").rglob("*.parquet"))
    merge_events(spark, rows.limit(3), root)
    assert sorted(p.name for p in (tmp_path / "db" / "events").rglob("*.parquet")) == files


def test_a_run_that_died_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "db")
    write_events(events(spark, [dict(GLOBALEVENTID=1), dict(GLOBALEVENTID=2)]), root)

    def die(*_):
        raise RuntimeError("died")

    monkeypatch.setattr(tables, "write_events", die)
    with pytest.raises(RuntimeError, match="died"):
        merge_events(spark, events(spark, [dict(GLOBALEVENTID=3)]), root)
    monkeypatch.undo()
    # The write had begun: the day it was to replace is gone.
    for file in (tmp_path / "db" / "events").rglob("*.parquet"):
        file.write_bytes(b"")
        file.unlink()
    merge_events(spark, events(spark, [dict(GLOBALEVENTID=4, event_date=day(2))]), root)
    assert sorted(r.GLOBALEVENTID for r in read_events(spark, root).collect()) == [1, 2, 3, 4]
    assert not list((tmp_path / "db" / "_staging").glob("*"))


def test_folder_of_mixed_files_and_empty_feed(spark, tmp_path, codes):
    folder, root = tmp_path / "in", str(tmp_path / "db")
    folder.mkdir()
    zip_file(folder / "a.zip", a_CSV="\n".join(LINES[:5]))
    write(folder / "b.CSV", *LINES[5:])
    assert ingest(spark, str(folder), codes, root)["staged"] == 12
    assert ingest(spark, f"{folder}/*.zip", codes, root)["read"] == 5
    with pytest.raises(ValueError, match="no event"):
        ingest(spark, write(tmp_path / "other.txt", "no", "events"), codes, root)
    with pytest.raises(ValueError, match="no feed files"):
        ingest(spark, [], codes, root)


def test_window_of_landed_archives(spark, tmp_path, codes):
    folder, root = tmp_path / "in", str(tmp_path / "db")
    folder.mkdir()
    stamps = ["20240301000000", "20240302000000", "20240303000000"]
    for n, stamp in enumerate(stamps):
        zip_file(folder / f"{stamp}.export.CSV.zip", a_CSV="\n".join(LINES[n * 4 : n * 4 + 4]))
    manifest = write(tmp_path / "list.txt", *(f"1 x http://h/{s}.export.CSV.zip" for s in stamps))
    ingest_window(spark, manifest, str(folder), codes, root, datetime(2024, 3, 3, 1), hours=24)
    assert sorted(r.GLOBALEVENTID for r in read_events(spark, root).collect()) == list(range(5, 13))


def test_analysis_and_dashboard(spark, tmp_path, codes):
    root = str(tmp_path / "db")
    ingest(spark, write(tmp_path / "a.CSV", *LINES), codes, root)
    for _ in range(2):  # summaries are replaced, not appended to
        run_analysis(spark, root, hours=48, min_baseline=0.0)
        run_story_analysis(spark, root)
    page = global_trends(spark, root, now=datetime(2024, 3, 4), day=day(3))
    assert [tuple(r) for r in page["country_totals"].collect()] == [("Paris", 12)]
    assert page["tone_extremes"].count() == 2
    assert [r.label for r in page["available_dates"].collect()] == [
        "Mar 01, 2024", "Mar 02, 2024", "Mar 03, 2024"]
    assert page["map_points"].count() == 4
    insights = country_insights(spark, root, SearchSpec(country="paris", mentions_min=10))
    assert [r.SOURCEURL for r in insights["found"].collect()] == ["u12", "u11", "u10"]
    assert insights["kpis"].first().total_articles == 33
    assert insights["display"].columns[0] == "event_date"
    spikes = event_spikes(spark, root)
    assert [tuple(r) for r in spikes["chart"].collect()] == [("FR", 0.0)]
    assert tuple(spikes["kpis"].first()) == (1, 0)
    assert spikes["flagged"].count() == 0
    stories = read_table(spark, root, "separate_events")
    assert stories.count() == 3 and dict(stories.dtypes)["event_date"] == "timestamp"
    ranked = read_table(spark, root, "top_impact_events").orderBy("impact_score").collect()
    assert [r.impact_score for r in ranked] == [-1.5 * a for a in (30, 26, 22)]
    assert read_table(spark, root, "events_by_time_and_country").count() == 3
    assert set(SUMMARY_ORDER) == set(SUMMARY_TABLES)
    heads = {name: summary_head(spark, root, name, 1).first() for name in SUMMARY_TABLES}
    assert heads["top_events"].GLOBALEVENTID == 12
    assert heads["separate_events"].total_articles == 30
    assert heads["top_impact_events"].impact_score == -45.0
    assert heads["events_by_time_and_country"].event_ts == day(3)

    clear(spark, root, events_too=False)
    assert all(read_table(spark, root, t).count() == 0 for t in SUMMARY_TABLES)
    assert read_events(spark, root).count() == 12
    clear(spark, root, events_too=True)
    assert read_events(spark, root).count() == 0
    ingest(spark, write(tmp_path / "a.CSV", *LINES), codes, root)
    run_analysis(spark, root, hours=48, min_baseline=0.0)
    assert read_events(spark, root).count() == 12
    assert event_spikes(spark, root)["report"].count() == 1


def test_clearing_nothing(spark, tmp_path):
    clear(spark, str(tmp_path / "none"), events_too=True)


def test_stream_picks_up_new_files_once(spark, tmp_path, codes):
    root, folder, state = str(tmp_path / "db"), tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()

    def run():
        ingest_landed(spark, str(folder), codes, root, state).awaitTermination()
        return sorted(r.GLOBALEVENTID for r in read_events(spark, root).collect())

    write(folder / "a.CSV", *LINES[:4])
    assert run() == [1, 2, 3, 4]
    write(folder / "b.CSV", *LINES[2:6])
    assert run() == [1, 2, 3, 4, 5, 6]
    assert run() == [1, 2, 3, 4, 5, 6]


def test_stream_of_archives(spark, tmp_path, codes):
    root, folder = str(tmp_path / "db"), tmp_path / "in"
    folder.mkdir()
    zip_file(folder / "a.zip", a_CSV="\n".join(LINES[:3]))
    query = ingest_landed(spark, str(folder), codes, root, str(tmp_path / "state"), zipped=True)
    query.awaitTermination()
    assert sorted(r.GLOBALEVENTID for r in read_events(spark, root).collect()) == [1, 2, 3]


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("event", [1, None])
@pytest.mark.parametrize("later", [["a", "b", "c"], ["a", "reworded"], ["a"], ["a", "a", "b"]])
def test_descriptions_of_an_event_are_replaced_together(spark, tmp_path, event, later):
    root = str(tmp_path / "db")
    rows = lambda texts: [dict(GLOBALEVENTID=event, EventDescription=t) for t in texts]
    other = dict(GLOBALEVENTID=2, EventDescription="a")
    write_events(events(spark, [*rows(["a", "b"]), other]), root)
    merge_events(spark, events(spark, rows(later)), root)
    stored = [(r.GLOBALEVENTID, r.EventDescription) for r in read_events(spark, root).collect()]
    assert sorted(stored, key=str) == sorted([*((event, t) for t in later), (2, "a")], key=str)
