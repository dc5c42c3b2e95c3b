import random

from newslens.operators.countries import (
    country_names,
    events_by_time_and_country,
    events_per_country,
    place_counts,
    tone_by_country,
    tone_extremes,
)

from helpers import day, events, repeat


def totals(df):
    return [tuple(r) for r in events_per_country(place_counts(df)).collect()]


def test_mode_ties_go_to_the_smallest_name_and_nulls_never_win(spark):
    df = events(spark, [
        *repeat(2, ActionGeo_FullName="Nice"), *repeat(2, ActionGeo_FullName="Lyon"),
        *repeat(5, ActionGeo_FullName=None),
        *repeat(3, ActionGeo_CountryCode="XX", ActionGeo_FullName=None),
    ])
    assert totals(df) == [("Lyon", 9), (None, 3)]


def test_null_codes_are_left_out_of_totals_but_kept_for_tone(spark):
    df = events(spark, [
        *repeat(2, ActionGeo_CountryCode=None, ActionGeo_FullName="Nowhere", avg_tone=5.0),
        *repeat(1, ActionGeo_CountryCode="DE", ActionGeo_FullName=None),
        *repeat(1, avg_tone=2.0), *repeat(1, avg_tone=4.0), *repeat(1, avg_tone=None),
    ])
    assert totals(df) == [("Paris", 3), (None, 1)]
    tones = [tuple(r) for r in tone_by_country(place_counts(df)).collect()]
    assert tones == [("Nowhere", 5.0), ("Paris", 3.0)]


def test_codes_with_the_same_name_stay_apart(spark):
    df = events(spark, [
        *repeat(2, ActionGeo_CountryCode="A"), *repeat(1, ActionGeo_CountryCode="B"),
    ])
    assert totals(df) == [("Paris", 2), ("Paris", 1)]
    kept = events_per_country(place_counts(df), keep_code=True).collect()
    assert [r.ActionGeo_CountryCode for r in kept] == ["A", "B"]
    assert "ActionGeo_CountryCode" in tone_by_country(place_counts(df), keep_code=True).columns


def test_country_without_any_tone_is_most_negative(spark):
    df = events(spark, [
        dict(ActionGeo_CountryCode=c, ActionGeo_FullName=c, avg_tone=t)
        for c, t in [("A", 3.0), ("B", -3.0), ("C", None), ("D", 1.0)]
    ])
    got = [tuple(r) for r in tone_extremes(tone_by_country(place_counts(df)), 2).collect()]
    assert got == [
        ("most_positive", "A", 3.0), ("most_positive", "D", 1.0),
        ("most_negative", "C", None), ("most_negative", "B", -3.0),
    ]


def test_day_counts_newest_first(spark):
    df = events(spark, [
        dict(event_date=day(1)), dict(event_date=day(3)), dict(event_date=day(3)),
        dict(event_date=day(3), ActionGeo_CountryCode=None), dict(event_date=None),
    ])
    rows = events_by_time_and_country(df).collect()
    assert [(r.event_ts, r.total_events) for r in rows] == [(day(3), 2), (day(1), 1)]


def test_against_plain_python_with_one_country_holding_most_rows(spark):
    rng = random.Random(5)
    rows = [
        dict(
            ActionGeo_CountryCode="HOT" if rng.random() < 0.6 else rng.choice(["A", "B", None]),
            ActionGeo_FullName=rng.choice(["p", "q", "r", None]),
            avg_tone=rng.choice([None, 0.5, -1.25, 2.0]),
        )
        for _ in range(400)
    ]
    expected = {}
    for row in rows:
        places = expected.setdefault(row["ActionGeo_CountryCode"], [0, {}])
        places[0] += 1
        if row["ActionGeo_FullName"] is not None:
            name = row["ActionGeo_FullName"]
            places[1][name] = places[1].get(name, 0) + 1
    names = {c: min(p, key=lambda v: (-p[v], v)) for c, (_, p) in expected.items()}
    df = events(spark, rows).repartition(7)
    assert {tuple(r) for r in country_names(place_counts(df)).collect()} == set(names.items())
    assert sum(n for _, n in totals(df)) == sum(
        1 for r in rows if r["ActionGeo_CountryCode"] is not None
    )
