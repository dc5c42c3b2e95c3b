import random
from datetime import date, datetime, timedelta, timezone

import pytest

from newslens.functions.topk import order_value, top_by_measure, top_cutoff
from newslens.operators.search import (
    SEARCH_COLUMNS,
    SearchSpec,
    available_dates,
    display_columns,
    map_points,
    matching_events,
    search_events,
    search_kpis,
    top_events,
)
from newslens.sinks.export import export_csv, read_export
from newslens.sinks.tables import write_events
from newslens.sources.tables import read_events
from pyspark.sql import functions as F

from helpers import day, events


def ids(df):
    return sorted(r.GLOBALEVENTID for r in df.collect())


def test_text_filters(spark):
    names = ["United States", "united kingdom", "France (Nord)", None]
    df = events(spark, [dict(ActionGeo_FullName=n, Actor1Name=n, Actor2Name=n) for n in names])
    for field in ("country", "actor1", "actor2"):
        assert ids(matching_events(df, SearchSpec(**{field: " UNITED "}))) == [0, 1]
    assert ids(matching_events(df, SearchSpec(country="^united k|nord"))) == [1, 2]
    assert ids(matching_events(df, SearchSpec(country="(nord)", literal=True))) == [2]
    assert ids(matching_events(df, SearchSpec(country="  ", actor1=""))) == [0, 1, 2, 3]


def test_bad_pattern_raises_and_literal_does_not(spark):
    df = events(spark, [dict(ActionGeo_FullName="a(b")])
    with pytest.raises(Exception, match="(?i)pattern|unclosed"):
        matching_events(df, SearchSpec(country="(")).collect()
    assert ids(matching_events(df, SearchSpec(country="(", literal=True))) == [0]


def test_ranges_are_inclusive_and_nulls_never_match(spark):
    df = events(spark, [
        dict(goldstein_scale=g, avg_tone=t, num_mentions=m)
        for g, t, m in [(-10.0, 1.0, 5), (10.0, 1.0, 5), (None, 1.0, 5), (1.0, None, 5),
                        (1.0, 1.0, None), (1.0, -100.0, 0), (1.0, 100.0, 9)]
    ])
    assert ids(matching_events(df, SearchSpec())) == [0, 1, 5, 6]
    assert ids(matching_events(df, SearchSpec(mentions_min=5))) == [0, 1, 6]
    assert ids(matching_events(df, SearchSpec(mentions_min=5, mentions_max=5))) == [0, 1]
    assert ids(matching_events(df, SearchSpec(goldstein_min=-10, goldstein_max=-10))) == [0]
    assert ids(matching_events(df, SearchSpec(tone_min=1.0, tone_max=1.0))) == [0, 1]


def test_date_bounds(spark):
    df = events(spark, [dict(event_date=day(n)) for n in (1, 2, 3)])
    assert ids(matching_events(df, SearchSpec(date_min=date(2024, 3, 2)))) == [1, 2]
    assert ids(matching_events(df, SearchSpec(date_max=datetime(2024, 3, 2)))) == [0, 1]
    assert ids(matching_events(df, SearchSpec(date_min=datetime(2024, 3, 1, 21)))) == [1, 2]
    # Rows with a DATE column instead of a timestamp compare the same way.
    dates = df.withColumn("event_date", F.col("event_date").cast("date"))
    spec = SearchSpec(date_min=date(2024, 3, 2), date_max=date(2024, 3, 2))
    assert ids(matching_events(dates, spec)) == [1]


def test_spec_checks():
    with pytest.raises(ValueError):
        SearchSpec(date_min=date(2024, 3, 2), date_max=datetime(2024, 3, 1, 23))
    aware = datetime(2024, 3, 2, 1, tzinfo=timezone(timedelta(hours=2)))
    assert SearchSpec(date_min=aware, date_max=date(2024, 3, 2)).date_min is aware
    spec = SearchSpec(goldstein_min=5, goldstein_max=-5, tone_min=3, tone_max=1)
    assert (spec.goldstein_min, spec.goldstein_max) == (-5, 5)
    assert (spec.tone_min, spec.tone_max) == (1, 3)


def test_search_order_limit_and_kpis_of_the_limited_rows(spark):
    df = events(spark, [
        dict(num_articles=a, num_mentions=10, goldstein_scale=float(i), SOURCEURL=f"u{i}")
        for i, a in enumerate([3, None, 7, 7, 1])
    ]).repartition(3)
    found = search_events(df, SearchSpec(limit=3))
    assert found.columns == SEARCH_COLUMNS
    assert [r.SOURCEURL for r in found.collect()] == ["u2", "u3", "u0"]
    kpis = search_kpis(found).first()
    assert (kpis.n, kpis.total_mentions, kpis.total_articles) == (3, 30, 17)
    assert kpis.avg_goldstein == pytest.approx(5 / 3)
    assert kpis.avg_tone == 1.0
    assert search_kpis(search_events(df, SearchSpec(country="zzz"))).first().n == 0


def test_large_limit_gives_the_same_order(spark):
    df = events(spark, [dict(num_articles=i % 7, SOURCEURL=f"u{i}") for i in range(60)])
    small = [r.SOURCEURL for r in search_events(df.repartition(4), SearchSpec(limit=1000)).collect()]
    large = [r.SOURCEURL for r in search_events(df.repartition(4), SearchSpec(limit=1001)).collect()]
    assert small == large and len(small) == 60


def test_display_and_csv(spark, tmp_path):
    df = events(spark, [dict(Actor1Name='a,"b"', Actor2Name=None, SOURCEURL="http://x/?a=1,2")])
    shown = display_columns(search_events(df, SearchSpec()))
    assert shown.columns[:2] == ["event_date", "ActionGeo_FullName"]
    assert not {"lon", "lat"} & set(shown.columns)
    assert display_columns(df.select("lon", "year_month", "QuadClass")).columns == [
        "QuadClass", "year_month"]
    export_csv(shown, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.csv"))) == 1
    assert read_export(spark, str(tmp_path / "out"), shown.schema).collect() == shown.collect()


def expected_top(rows, k):
    located = [(i, r) for i, r in enumerate(rows) if r["lat"] is not None and r["lon"] is not None]
    key = lambda m: (m[1]["num_articles"] is None, -(m[1]["num_articles"] or 0), m[0])
    return [i for i, _ in sorted(located, key=key)[:k]]


@pytest.mark.parametrize("k", [1, 7, 60, 1000])
@pytest.mark.parametrize("shape", ["spread", "ties", "nulls", "negative"])
def test_top_events_equal_a_full_sort(spark, shape, k):
    rng = random.Random(k)
    articles = {
        "spread": lambda: rng.randrange(100_000),
        "ties": lambda: rng.choice([7, 7, 7, 3, 900]),
        "nulls": lambda: rng.choice([None, None, 2]),
        "negative": lambda: rng.randrange(-50, 3),
    }[shape]
    rows = [dict(num_articles=articles(), lat=rng.choice([1.0, 2.0, None]), lon=rng.choice([3.0, None]))
            for _ in range(150)]
    got = top_events(events(spark, rows).repartition(5), k).collect()
    assert [r.GLOBALEVENTID for r in got] == expected_top(rows, k)


def test_cutoff_keeps_the_top_and_drops_most_rows(spark):
    df = spark.range(100_000).withColumn("m", F.col("id").cast("int"))
    cut = top_cutoff(df, "m", 100, "id").first().cut
    assert 99_000 < cut.cutoff <= 99_901 and cut.low <= 99_900 and cut.n == 100_000
    top = top_by_measure(df, "m", 100, "id")
    assert [r.id for r in top.collect()] == list(range(99_999, 99_899, -1))
    assert top_by_measure(df.where("m < 0"), "m", 5, "id").count() == 0


def test_few_tied_rows_pass_before_the_sort(spark):
    df = spark.range(100_000).withColumn("m", F.expr("IF(id % 4 = 0, NULL, 7)"))
    cut = top_cutoff(df, "m", 50, "id").first().cut
    assert cut.low == 7
    passing = df.where(order_value("m", "id") >= cut.cutoff)
    assert 50 <= passing.count() < 2_000
    assert [r.id for r in top_by_measure(df, "m", 4, "id").collect()] == [1, 2, 3, 5]
    rest = [r.id for r in top_by_measure(df, "m", 75_002, "id").collect()][-2:]
    assert rest == [0, 4]


def test_order_value_follows_the_order(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, -3, 0, 5, 2**31 - 1]), rng.choice([None, -7, 0, 1, 2, 10**9, 10**9 + 1, 2**62]))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "m int, id long").orderBy(F.desc("m"), "id")
    values = [r[0] for r in df.select(order_value("m", "id")).collect()]
    assert values == sorted(values, reverse=True)


def test_top_events_scan_twice_and_search_once(spark, tmp_path):
    write_events(events(spark, [dict(num_articles=i % 9) for i in range(50)]), str(tmp_path))
    stored = read_events(spark, str(tmp_path))
    top = plan_that_ran(top_events(stored, 10))
    # Mentions of one subquery are one execution.
    assert top.count("kll_sketch_agg_double") and "num_articles" in top
    assert scans_that_ran(spark, top_events(stored, 10)) == 2
    assert scans_that_ran(spark, search_events(stored, SearchSpec(limit=10))) == 1


def plan_that_ran(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def scans_that_ran(spark, df):
    """Stages that read files, over all jobs of the query."""
    group = f"scans-{id(df)}"
    spark.sparkContext.setJobGroup(group, "scans")
    df.collect()
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    spark.sparkContext._jsc.clearJobGroup()
    store = spark.sparkContext._jsc.sc().statusStore()
    read = [store.lastStageAttempt(s).inputRecords() for s in stages]
    return sum(n > 0 for n in read)


def test_map_points_and_dates(spark):
    rows = [
        dict(event_date=day(d), num_articles=a, lon=float(i), lat=float(-i))
        for i, (d, a) in enumerate([(1, 5), (2, 1), (2, 9), (2, 9), (4, 2)])
    ]
    top = top_events(events(spark, rows))
    assert [tuple(r) for r in map_points(top, day(2), 2).collect()] == [(2.0, -2.0), (3.0, -3.0)]
    assert map_points(top, date(2024, 3, 4)).count() == 1
    dates = available_dates(top, datetime(2024, 3, 10), hours=8 * 24).collect()
    assert [(r.event_date, r.label) for r in dates] == [
        (day(2), "Mar 02, 2024"), (day(4), "Mar 04, 2024")]


def test_top_k_is_a_prefix_of_a_larger_top_k(spark):
    df = events(spark, [dict(num_articles=i % 9) for i in range(50)])
    ten = [r.GLOBALEVENTID for r in top_events(df, 10).collect()]
    assert ten == [r.GLOBALEVENTID for r in top_events(df, 30).collect()][:10]
