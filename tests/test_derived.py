"""What is derived from the stored events: the key index, the text values, the tables of days."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from newslens.operators.search import SearchSpec, search_events, with_matching_values
from newslens.plans.analysis import refresh_days, run_analysis
from newslens.plans.dashboard import search_stored
from newslens.sinks import tables
from newslens.sinks.tables import merge_events, rebuild_derived, write_events
from newslens.sources.tables import (
    DAY_PLACES,
    changed_days,
    is_open,
    read_event_index,
    read_event_values,
    read_events,
    read_table,
)

from helpers import day, events, plan

NAMES = ["United States", "France (Nord)", "Paris, France", None]


@pytest.fixture
def root(spark, tmp_path):
    root = str(tmp_path / "db")
    rows = [dict(event_date=day(1 + i % 3), ActionGeo_FullName=NAMES[i % 4], Actor1Name=f"A{i}", Actor2Name=None,
                 num_articles=i, SOURCEURL=f"u{i}") for i in range(24)]
    write_events(events(spark, rows), root)
    return root


def ids(df):
    return sorted(r.GLOBALEVENTID for r in df.collect())


def spoil(root, day_name):
    """Make the stored events of a day unreadable."""
    from pathlib import Path

    for file in Path(root, "events", f"event_date={day_name}").glob("*.parquet"):
        file.write_bytes(b"spoilt")
        file.with_name(f".{file.name}.crc").unlink()


def test_index_follows_the_events(spark, root):
    index = {(r._key, r.event_date): r.n for r in read_event_index(spark, root).collect()}
    assert index == {(i, date(2024, 3, 1 + i % 3)): 1 for i in range(24)}
    merge_events(spark, events(spark, [dict(GLOBALEVENTID=0, event_date=day(9)), dict(GLOBALEVENTID=99)]), root)
    index = {r._key: r.event_date for r in read_event_index(spark, root).collect()}
    assert len(index) == 25 and index[0] == date(2024, 3, 9) and index[99] == date(2024, 3, 1)


def test_a_late_event_reads_the_index_and_its_day_alone(spark, root):
    for name in ("2024-03-01", "2024-03-02"):
        spoil(root, name)
    late = dict(GLOBALEVENTID=50, event_date=day(1).replace(year=2022))
    repeated = dict(GLOBALEVENTID=2, event_date=day(3), ActionGeo_FullName="moved", SOURCEURL="new")
    merge_events(spark, events(spark, [late, repeated]), root)
    stored = read_events(spark, root).where(F.year("event_date") == 2022)
    assert ids(stored) == [50]
    third = read_events(spark, root).where(F.col("event_date") == F.lit("2024-03-03").cast("timestamp"))
    assert {r.GLOBALEVENTID: r.SOURCEURL for r in third.collect()}[2] == "new"
    assert not is_open(spark, root)


def test_a_dead_writer_leaves_a_mark_and_all_is_derived_again(spark, root, monkeypatch):
    def die(*_):
        raise RuntimeError("died")

    monkeypatch.setattr(tables, "_derive", die)
    with pytest.raises(RuntimeError):
        write_events(events(spark, [dict(GLOBALEVENTID=70, event_date=day(8), Actor1Name="Late Name")]), root)
    monkeypatch.undo()
    assert is_open(spark, root)
    # Searches do not trust the values meanwhile.
    assert [r.SOURCEURL for r in search_stored(spark, root, SearchSpec(actor1="late name")).collect()] == [None]
    merge_events(spark, events(spark, [dict(GLOBALEVENTID=71, event_date=day(8))]), root)
    assert not is_open(spark, root)
    assert read_event_values(spark, root).where("value = 'Late Name'").count() == 1
    assert read_event_index(spark, root).count() == 26
    merge_events(spark, events(spark, [dict(GLOBALEVENTID=70, event_date=day(9))]), root)
    assert ids(read_events(spark, root)) == [*range(24), 70, 71]


def test_tables_without_an_index_get_one(spark, root, tmp_path):
    tables.delete(spark, f"{root}/event_index")
    tables.delete(spark, f"{root}/event_values")
    merge_events(spark, events(spark, [dict(GLOBALEVENTID=3, event_date=day(5))]), root)
    assert ids(read_events(spark, root)) == list(range(24))
    assert read_event_index(spark, root).count() == 24
    assert read_event_values(spark, root).where("value = 'A7'").count() == 1


@pytest.mark.parametrize("spec", [
    SearchSpec(country="france"), SearchSpec(country="(nord)", literal=True), SearchSpec(country="^united|paris", actor1="A[0-9]$"),
    SearchSpec(country="nowhere"), SearchSpec(country=" "), SearchSpec(actor2="x"),
])
def test_search_by_values_equals_search_by_pattern(spark, root, spec):
    direct = search_events(read_events(spark, root), spec).collect()
    assert search_stored(spark, root, spec).collect() == direct
    assert "RLIKE" not in plan(search_stored(spark, root, spec)).upper()
    values = read_event_values(spark, root)
    for listed in (0, 1):
        found = read_events(spark, root)
        for column, pattern in (("ActionGeo_FullName", spec.country), ("Actor1Name", spec.actor1), ("Actor2Name", spec.actor2)):
            if (pattern or "").strip():
                found = with_matching_values(found, values, column, pattern, spec.literal, listed)
        rest = replace(spec, country=None, actor1=None, actor2=None)
        assert search_events(found, rest).collect() == direct


def test_new_values_are_found_after_a_merge(spark, root):
    merge_events(spark, events(spark, [dict(GLOBALEVENTID=80, Actor2Name="some ünïque name")]), root)
    assert search_stored(spark, root, SearchSpec(actor2="ünïQUE")).count() == 1
    assert read_event_values(spark, root).groupBy("field", "value").count().where("count > 1").count() == 0


def test_row_groups_without_a_name_are_skipped(spark, tmp_path):
    """Names between the smallest and largest of every row group, told apart by their Bloom filter."""
    root = str(tmp_path / "db")
    names = F.concat(F.md5(F.col("GLOBALEVENTID").cast("string")), F.repeat(F.lit("x"), 60))
    rows = events(spark, [{}]).select("*").drop("GLOBALEVENTID").crossJoin(
        spark.range(40_000).withColumnRenamed("id", "GLOBALEVENTID")
    ).withColumn("Actor1Name", names)
    spark.conf.set("parquet.block.size", 1 << 20)
    try:
        write_events(rows, root)
    finally:
        spark.conf.unset("parquet.block.size")
    hashed = spark.sql("SELECT concat(md5('17'), repeat('x', 60)) AS v").first().v
    read = {}
    for value in (hashed, hashed.replace("x", "y")):
        found = read_events(spark, root).where(F.col("Actor1Name") == value).select("GLOBALEVENTID")
        group = f"bloom-{value[-1]}"
        spark.sparkContext.setJobGroup(group, "bloom")
        assert len(found.collect()) == (value == hashed)
        tracker = spark.sparkContext.statusTracker()
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
        read[value[-1]] = sum(store.lastStageAttempt(s).inputRecords() for s in stages)
        spark.sparkContext._jsc.clearJobGroup()
    assert read["y"] == 0 and 0 < read["x"] < 40_000


def test_a_second_analysis_reads_the_changed_days(spark, root):
    def summaries():
        names = ("events_per_country", "tone_by_country", "events_by_time_and_country", "top_events")
        return [sorted(map(str, read_table(spark, root, name).collect())) for name in names]

    assert run_analysis(spark, root, min_baseline=0.0) is None
    assert run_analysis(spark, root, min_baseline=0.0) == []
    merge_events(spark, events(spark, [
        dict(GLOBALEVENTID=0, event_date=day(7)), dict(GLOBALEVENTID=60, event_date=day(7), num_articles=500),
    ]), root)
    assert changed_days(spark, root)[1] == [date(2024, 3, 1), date(2024, 3, 7)]
    spoil(root, "2024-03-02")
    assert run_analysis(spark, root, min_baseline=0.0) == [date(2024, 3, 1), date(2024, 3, 7)]
    found = summaries()
    # The same from all events of the same content.
    rows = [dict(event_date=day(1 + i % 3), ActionGeo_FullName=NAMES[i % 4], Actor1Name=f"A{i}", Actor2Name=None,
                 num_articles=i, SOURCEURL=f"u{i}") for i in range(24)]
    rows[0] = dict(GLOBALEVENTID=0, event_date=day(7))
    rows.append(dict(GLOBALEVENTID=60, event_date=day(7), num_articles=500))
    tables.delete(spark, root)
    write_events(events(spark, rows), root)
    run_analysis(spark, root, min_baseline=0.0)
    assert summaries() == found


def test_a_day_that_lost_its_events_leaves_the_tables_of_days(spark, tmp_path):
    root = str(tmp_path / "db")
    write_events(events(spark, [dict(GLOBALEVENTID=1), dict(GLOBALEVENTID=2, event_date=day(2))]), root)
    refresh_days(spark, root)
    merge_events(spark, events(spark, [dict(GLOBALEVENTID=1, event_date=day(2))]), root)
    assert refresh_days(spark, root) == [date(2024, 3, 1), date(2024, 3, 2)]
    assert [(r.event_date, r.n) for r in read_table(spark, root, DAY_PLACES).collect()] == [(day(2), 2)]
    rebuild_derived(spark, root)
    assert refresh_days(spark, root) is None
