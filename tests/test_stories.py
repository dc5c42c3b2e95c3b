import random
from collections import Counter

from newslens.operators.stories import STORY_KEYS, impact_ranking, story_groups, story_urls

from helpers import day, events, plan, repeat


def test_one_story(spark):
    df = events(spark, [
        dict(num_mentions=5, num_articles=2, num_sources=15, avg_tone=1.0, goldstein_scale=-2.0,
             Actor1Name="B", lon=1.0, lat=5.0, SOURCEURL="u0"),
        dict(num_mentions=9, num_articles=3, num_sources=10, avg_tone=2.0, goldstein_scale=None,
             Actor1Name="A", lon=2.0, lat=4.0, SOURCEURL="u1"),
        dict(num_mentions=9, num_articles=4, num_sources=None, avg_tone=None, goldstein_scale=-4.0,
             Actor1Name="A", Actor2Name=None, lon=2.0, lat=5.0, SOURCEURL=None),
        dict(num_sources=20, QuadClass=2, SOURCEURL="other"),  # not above the threshold
        dict(num_sources=50, ActionGeo_CountryCode=None),
    ])
    (row,) = story_groups(df).collect()
    assert [row[k] for k in STORY_KEYS] == ["FR", day(1), 1, "010"]
    assert (row.total_events, row.total_mentions, row.total_articles, row.total_sources) == (
        3, 23, 9, 25)
    assert (row.average_tone, row.avg_goldstein_scale) == (1.5, -3.0)
    assert (row.top_location, row.top_actor_1_name, row.top_actor_2_name) == ("Paris", "A", None)
    # Longitude and latitude modes are independent of each other.
    assert (row.top_lon, row.top_lat) == (2.0, 5.0)
    assert row.top_event_description == "Make statement"
    assert row.sample_urls == ["u1", "u0"]


def test_null_urls_take_a_rank_but_are_not_listed(spark):
    df = events(spark, [
        dict(num_mentions=10 - i, num_sources=30, SOURCEURL=None if i == 1 else f"u{i}")
        for i in range(5)
    ])
    (row,) = story_groups(df, max_urls=3).collect()
    assert row.sample_urls == ["u0", "u2"]
    ranked = story_urls(df, 3).orderBy("url_rank").collect()
    assert [(r.url_rank, r.SOURCEURL) for r in ranked] == [(1, "u0"), (2, None), (3, "u2")]


def test_story_without_urls_has_an_empty_list(spark):
    (row,) = story_groups(events(spark, [dict(num_sources=30, SOURCEURL=None)])).collect()
    assert row.sample_urls == []


def test_null_keys_form_groups(spark):
    df = events(spark, [
        *repeat(2, QuadClass=None, EventBaseCode=None, num_sources=30, SOURCEURL="u"),
        dict(QuadClass=1, num_sources=30),
    ])
    rows = {r.QuadClass: r for r in story_groups(df).collect()}
    assert rows[None].total_events == 2 and rows[None].sample_urls == ["u", "u"]
    assert rows[1].total_events == 1


def test_against_plain_python_with_one_story_holding_most_rows(spark):
    rng = random.Random(11)
    rows = [
        dict(
            ActionGeo_CountryCode="HOT" if rng.random() < 0.5 else rng.choice(["A", "B"]),
            QuadClass=rng.choice([1, 2]) if rng.random() < 0.3 else 1,
            Actor1Name=rng.choice(["x", "y", "z", None]),
            lon=rng.choice([1.5, -2.0, 10.0, None]),
            num_mentions=rng.randrange(8),
            num_sources=rng.randrange(5),
            SOURCEURL=f"u{i}",
        )
        for i, _ in enumerate(range(500))
    ]
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault((row["ActionGeo_CountryCode"], row["QuadClass"]), []).append((i, row))

    def mode(members, column):
        counts = Counter(r[column] for _, r in members if r[column] is not None)
        return min(counts, key=lambda v: (-counts[v], v))

    expected = {}
    for key, members in groups.items():
        sources = sum(r["num_sources"] for _, r in members)
        if sources > 20:
            ranked = sorted(members, key=lambda m: (-m[1]["num_mentions"], m[0]))
            expected[key] = (
                len(members), sources, mode(members, "Actor1Name"), mode(members, "lon"),
                [r["SOURCEURL"] for _, r in ranked[:20]],
            )
    got = {
        (r.ActionGeo_CountryCode, r.QuadClass): (
            r.total_events, r.total_sources, r.top_actor_1_name, r.top_lon, r.sample_urls)
        for r in story_groups(events(spark, rows).repartition(6)).collect()
    }
    assert got == expected


def test_top_urls_are_cut_before_the_shuffle(spark):
    final = plan(story_urls(events(spark, repeat(3)), 3))
    assert "Partial" in final and final.count("WindowGroupLimit") == 2


def test_impact_is_ranked_from_most_destabilising(spark):
    df = events(spark, [
        dict(EventBaseCode=code, goldstein_scale=g, num_articles=a, num_sources=30)
        for code, g, a in [("010", 2.0, 5), ("020", -1.0, 30), ("030", -9.0, 2), ("040", None, 9)]
    ])
    ranked = impact_ranking(story_groups(df)).collect()
    assert [(r.EventBaseCode, r.impact_score) for r in ranked] == [
        ("040", None), ("020", -30.0), ("030", -18.0), ("010", 10.0),
    ]
