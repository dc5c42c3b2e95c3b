from newslens.operators.spikes import (
    country_event_spike,
    day_ranks,
    flagged_spikes,
    spike_kpis,
    spike_report,
    spike_top,
)

from helpers import day, events, plan, repeat


def on(n, count, country="FR"):
    return repeat(count, event_date=day(n), ActionGeo_CountryCode=country)


def by_country(df, **kw):
    kw = {"baseline_days": 3, "min_baseline": 0.0} | kw
    return {r.ActionGeo_CountryCode: r for r in country_event_spike(df, **kw).collect()}


def test_gaps_absent_countries_and_days_without_any_country(spark):
    df = events(spark, [
        *on(20, 50),  # newest day, ignored
        *on(19, 9), *on(19, 4, "DE"),  # spike day
        *repeat(5, event_date=day(18), ActionGeo_CountryCode=None),  # no ranked day
        *on(17, 4), *on(15, 5), *on(10, 6), *on(10, 2, "DE"),  # the three baseline days
        *on(9, 100),  # beyond the baseline
    ])
    assert [r.event_ts for r in day_ranks(df).collect()] == [
        day(n) for n in (20, 19, 17, 15, 10, 9)
    ]
    got = by_country(df)
    fr, de = got["FR"], got["DE"]
    assert (fr.spike_events, fr.baseline_events, fr.baseline_days_count) == (9, 15, 3)
    assert (fr.avg_baseline_per_day, fr.spike_score, fr.is_spike) == (5.0, 0.8, True)
    # DE was there on one baseline day only, and its average is over that day.
    assert (de.baseline_days_count, de.avg_baseline_per_day, de.spike_score) == (1, 2.0, 1.0)


def test_score_at_the_threshold_is_no_spike(spark):
    df = events(spark, [*on(5, 1), *on(4, 3), *on(3, 2)])
    assert by_country(df)["FR"].spike_score == 0.5
    assert by_country(df)["FR"].is_spike is False
    assert by_country(df, spike_threshold=0.4999)["FR"].is_spike is True


def test_countries_without_baseline(spark):
    df = events(spark, [
        *on(5, 1), *on(4, 7, "NEW"), *on(3, 2), *on(1, 1, "OLD"), *on(2, 3), *on(4, 1),
    ])
    assert set(by_country(df, baseline_days=2)) == {"FR"}
    got = by_country(df, baseline_days=2, min_baseline=-1.0)
    assert (got["NEW"].avg_baseline_per_day, got["NEW"].spike_score) == (0.0, 7.0)
    assert got["NEW"].is_spike is True
    assert (got["OLD"].spike_events, got["OLD"].spike_score, got["OLD"].is_spike) == (0, 0.0, False)


def test_fractional_baseline_days_are_floored(spark):
    df = events(spark, [row for n in range(1, 10) for row in on(n, n)])
    # Ranks 3 to 6 are days 7, 6, 5 and 4.
    assert by_country(df, baseline_days=100 / 24)["FR"].baseline_events == 22
    assert by_country(df, baseline_days=4)["FR"].baseline_events == 22


def test_min_baseline_is_exclusive_and_defaults_to_the_live_feed(spark):
    df = events(spark, [*on(5, 1), *on(4, 3), *on(3, 2)])
    assert by_country(df, min_baseline=2.0) == {}
    assert country_event_spike(df).count() == 0


def test_single_day_has_no_spike_rows(spark):
    assert by_country(events(spark, on(5, 3))) == {}


def test_result_does_not_depend_on_row_order_or_partitions(spark):
    rows = [row for n in range(1, 8) for row in on(n, n * 3 % 5 + 1) + on(n, n * 2 % 3 + 1, "DE")]
    one = country_event_spike(events(spark, rows).coalesce(1), min_baseline=0.0).collect()
    many = country_event_spike(
        events(spark, rows[::-1]).repartition(9), min_baseline=0.0
    ).collect()
    assert one == many


def test_one_scan_and_a_bounded_broadcast(spark, tmp_path):
    events(spark, [row for n in range(1, 8) for row in on(n, n)]).write.parquet(f"{tmp_path}/e")
    df = country_event_spike(spark.read.parquet(f"{tmp_path}/e"), min_baseline=0.0)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
    assert "TakeOrderedAndProject(limit=7" in final


def test_report_top_and_kpis(spark):
    rows = []
    for i, country in enumerate(["A", "B", "C", "D"]):
        rows += on(5, 1, country) + on(4, i + 1, country) + on(3, 2, country)
    spikes = country_event_spike(events(spark, rows), min_baseline=0.0)
    assert [r.ActionGeo_CountryCode for r in spike_report(spikes).collect()] == ["D", "C", "B", "A"]
    assert [r.ActionGeo_CountryCode for r in spike_report(spikes, True).collect()] == ["D"]
    assert spike_report(spikes, limit=2).count() == 2
    assert [tuple(r) for r in spike_top(spikes, 2).collect()] == [("D", 1.0), ("C", 0.5)]
    assert tuple(spike_kpis(spike_report(spikes)).first()) == (4, 1)
    flagged = flagged_spikes(spike_report(spikes))
    assert flagged.columns[1:3] == ["spike_events", "avg_baseline_per_day"]
    assert [r.ActionGeo_CountryCode for r in flagged.collect()] == ["D"]
