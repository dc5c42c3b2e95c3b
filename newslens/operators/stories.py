"""Groups of events that tell one story: country x day x quad class x base code."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from newslens.functions.aggregates import modal_value
from newslens.operators.countries import CODE

STORY_KEYS = [CODE, "event_date", "QuadClass", "EventBaseCode"]
# Output name -> column whose most frequent value is reported.
STORY_MODES = {
    "top_location": "ActionGeo_FullName",
    "top_actor_1_name": "Actor1Name",
    "top_actor_2_name": "Actor2Name",
    "top_lon": "lon",
    "top_lat": "lat",
    "top_event_description": "EventDescription",
}


def story_urls(events, max_urls=20):
    """Most mentioned events per story, ranked; ties go to the lower event id.

    The rank filter lets Spark keep `max_urls` rows per story in each map task before the
    shuffle, so a story with a large share of all events is not sorted in one task.
    """
    order = [F.desc("num_mentions"), F.asc("GLOBALEVENTID")]
    rank = F.row_number().over(Window.partitionBy(*STORY_KEYS).orderBy(*order))
    return (
        events.where(F.col(CODE).isNotNull())
        .select(*STORY_KEYS, "num_mentions", "GLOBALEVENTID", "SOURCEURL")
        .withColumn("url_rank", rank)
        .where(F.col("url_rank") <= max_urls)
        .select(*STORY_KEYS, "url_rank", "SOURCEURL")
    )


# Sums that totals and averages are made of.
_SUMS = ["num_mentions", "num_articles", "num_sources", "avg_tone", "goldstein_scale"]


def _counted(events):
    """Events per story and combination of the mode columns, with their sums.

    Feeds repeat places, actors and coordinates, so these rows are fewer than the events; totals
    and all six modes are made from them.
    """
    located = events.where(F.col(CODE).isNotNull())
    return located.groupBy(*STORY_KEYS, *STORY_MODES.values()).agg(
        F.count("*").alias("n"),
        *(F.sum(c).alias(f"sum_{c}") for c in _SUMS),
        *(F.count(c).alias(f"n_{c}") for c in ("avg_tone", "goldstein_scale")),
    )


def _totals(counted, min_sources):
    total = lambda c: F.sum(f"sum_{c}")
    average = lambda c: F.try_divide(total(c), F.sum(f"n_{c}"))
    totals = counted.groupBy(*STORY_KEYS).agg(
        F.sum("n").alias("total_events"),
        total("num_mentions").alias("total_mentions"),
        total("num_articles").alias("total_articles"),
        total("num_sources").alias("total_sources"),
        average("avg_tone").alias("average_tone"),
        average("goldstein_scale").alias("avg_goldstein_scale"),
    )
    return totals.where(F.col("total_sources") > min_sources)


def story_totals(events, min_sources=20):
    """Counts, sums and averages of each story with more than `min_sources` sources in total."""
    totals = events.where(F.col(CODE).isNotNull()).groupBy(*STORY_KEYS).agg(
        F.count("*").alias("total_events"),
        F.sum("num_mentions").alias("total_mentions"),
        F.sum("num_articles").alias("total_articles"),
        F.sum("num_sources").alias("total_sources"),
        F.avg("avg_tone").alias("average_tone"),
        F.avg("goldstein_scale").alias("avg_goldstein_scale"),
    )
    return totals.where(F.col("total_sources") > min_sources)


def _modes(counted):
    """Modal values per story, all six from the counted rows.

    Grouping sets expand each counted row in its task, where equal (story, value) pairs are added
    up before anything moves.
    """
    columns = list(STORY_MODES.values())
    by_value = (
        counted.select(*STORY_KEYS, *columns, "n")
        .groupingSets([[*STORY_KEYS, column] for column in columns], *STORY_KEYS, *columns)
        .agg(F.grouping_id().alias("gid"), F.sum("n").alias("n"))
    )
    # In a grouping id, the bit of each column that the set leaves out is 1, last column lowest.
    all_out = 2 ** len(columns) - 1
    modes = []
    for position, (name, column) in enumerate(STORY_MODES.items()):
        in_its_set = F.col("gid") == all_out - 2 ** (len(columns) - 1 - position)
        modes.append(modal_value(F.when(in_its_set, F.col(column)), F.col("n")).alias(name))
    return by_value.groupBy(*STORY_KEYS).agg(*modes)


def _large(rows, totals):
    """Rows of the stories that have totals: those with enough sources."""
    kept = totals.select(*(F.col(k).alias(f"_{k}") for k in STORY_KEYS))
    same = reduce(lambda x, y: x & y, (rows[k].eqNullSafe(kept[f"_{k}"]) for k in STORY_KEYS))
    return rows.join(kept, same, "left_semi")


def _sample_urls(events, max_urls):
    """Listed URLs per story in rank order; a NULL URL takes a rank but is not listed."""
    ranked = F.sort_array(F.collect_list(F.struct("url_rank", "SOURCEURL")))
    return (
        story_urls(events, max_urls)
        .where(F.col("SOURCEURL").isNotNull())
        .groupBy(*STORY_KEYS)
        .agg(F.transform(ranked, lambda url: url["SOURCEURL"]).alias("sample_urls"))
    )


def story_groups(events, min_sources=20, max_urls=20):
    """One row per story with totals, averages, modal values and sample URLs, most covered first.

    Stories with at most `min_sources` sources in total drop out. The modal longitude and
    latitude are taken independently of each other.

    Events are counted once, per story and combination of mode columns; small stories are left
    out before modes and URLs are sought. Totals, modes and URLs are each reduced to one row per
    story, so that no task ever holds the events of a story. Grouping the union of those rows
    then brings them together; unlike joins, it matches NULL keys.
    """
    counted = _counted(events)
    totals = _totals(counted, min_sources)
    parts = totals.unionByName(_modes(_large(counted, totals)), allowMissingColumns=True).unionByName(
        _sample_urls(_large(events.where(F.col(CODE).isNotNull()), totals), max_urls), allowMissingColumns=True
    )
    columns = [c for c in parts.columns if c not in STORY_KEYS]
    # Each column has a value in one of the three rows only.
    stories = parts.groupBy(*STORY_KEYS).agg(*(F.max(c).alias(c) for c in columns))
    no_urls = F.array().cast("array<string>")
    return (
        stories.where(F.col("total_events").isNotNull())
        .withColumn("sample_urls", F.coalesce("sample_urls", no_urls))
        .orderBy(F.desc("total_articles"), *STORY_KEYS)
    )


def impact_ranking(stories):
    """Stories, or just their totals, by average Goldstein value times articles, most destabilising first."""
    score = F.col("avg_goldstein_scale") * F.col("total_articles")
    return stories.withColumn("impact_score", score).orderBy("impact_score", *STORY_KEYS)
