"""Filtered event search and the map of most-covered events."""

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from newslens.functions.parsing import as_utc, text_match, utc_literal
from newslens.functions.topk import top_by_measure

# Matching values of a text column that a search lists in its filter; more are joined.
LISTED_VALUES = 1000

# The 13 columns of a search result, in order.
SEARCH_COLUMNS = [
    "EventDescription", "event_date", "Actor1Name", "Actor2Name", "num_mentions", "num_articles",
    "goldstein_scale", "QuadClass", "avg_tone", "ActionGeo_FullName", "lon", "lat", "SOURCEURL",
]
# The columns shown first in a result table; coordinates are not shown.
DISPLAY_FIRST = [
    "event_date", "ActionGeo_FullName", "Actor1Name", "Actor2Name", "EventDescription",
    "QuadClass", "num_mentions", "num_articles", "goldstein_scale", "avg_tone", "SOURCEURL",
]
NOT_DISPLAYED = ["lon", "lat"]


@dataclass(frozen=True)
class SearchSpec:
    """Filters of one search; None or blank text leaves a filter out.

    Text filters are case-insensitive partial matches, Java regular expressions unless `literal`.
    Ranges are inclusive. Swapped Goldstein or tone ends are put in order; a swapped date range
    is an error.
    """

    country: str | None = None
    actor1: str | None = None
    actor2: str | None = None
    date_min: date | datetime | None = None
    date_max: date | datetime | None = None
    goldstein_min: float = -10.0
    goldstein_max: float = 10.0
    tone_min: float = -100.0
    tone_max: float = 100.0
    mentions_min: int = 0
    mentions_max: int | None = None
    limit: int = 50
    literal: bool = False

    def __post_init__(self):
        if self.date_min is not None and self.date_max is not None:
            if as_utc(self.date_min) > as_utc(self.date_max):
                raise ValueError("date_min must not be later than date_max")
        for low, high in (("goldstein_min", "goldstein_max"), ("tone_min", "tone_max")):
            ends = sorted((getattr(self, low), getattr(self, high)))
            object.__setattr__(self, low, ends[0])
            object.__setattr__(self, high, ends[1])


def matching_events(events, spec):
    """Events that pass every filter; a NULL never passes.

    Day and number filters compare bare columns, so they prune folders and row groups.
    """
    day = F.col("event_date")
    filters = [
        None if spec.date_min is None else day >= utc_literal(spec.date_min),
        None if spec.date_max is None else day <= utc_literal(spec.date_max),
        F.col("goldstein_scale").between(spec.goldstein_min, spec.goldstein_max),
        F.col("avg_tone").between(spec.tone_min, spec.tone_max),
        F.col("num_mentions") >= spec.mentions_min,
        None if spec.mentions_max is None else F.col("num_mentions") <= spec.mentions_max,
        text_match(F.col("ActionGeo_FullName"), spec.country, spec.literal),
        text_match(F.col("Actor1Name"), spec.actor1, spec.literal),
        text_match(F.col("Actor2Name"), spec.actor2, spec.literal),
    ]
    for condition in filters:
        if condition is not None:
            events = events.where(condition)
    return events


def text_filters(spec):
    """(column, pattern) of the text filters that a search has."""
    patterns = [
        ("ActionGeo_FullName", spec.country), ("Actor1Name", spec.actor1), ("Actor2Name", spec.actor2),
    ]
    return [(column, pattern) for column, pattern in patterns if (pattern or "").strip()]


def with_matching_values(events, values, column, pattern, literal=False, listed=LISTED_VALUES):
    """Events whose `column` has one of those `values` (field, value) that match the pattern.

    The pattern is tried on the distinct values, not on each event. Up to `listed` matches become
    a list of plain values, which the Parquet scan checks against statistics, dictionaries and
    Bloom filters; that many are fetched for it. More are joined, which needs no regular
    expression over the events either.
    """
    matching = values.where(F.col("field") == column).where(text_match(F.col("value"), pattern, literal))
    found = [r.value for r in matching.select("value").distinct().limit(listed + 1).collect()]
    if len(found) <= listed:
        return events.where(F.col(column).isin(found))
    return events.join(matching.select(F.col("value").alias(column)).distinct(), column, "left_semi").select(*events.columns)


def search_events(events, spec):
    """Most covered matching events; a code with several descriptions gives a row for each.

    A search page shows a few hundred rows, so each task passes that many on and no cutoff is
    sought first: one scan.
    """
    found = matching_events(events, spec).orderBy(
        F.desc("num_articles"), "GLOBALEVENTID", "EventDescription", "SOURCEURL"
    )
    return found.limit(spec.limit).select(*SEARCH_COLUMNS)


def search_kpis(found):
    """Totals and means over the returned rows, not over all matches."""
    return found.agg(
        F.count("*").alias("n"),
        F.sum("num_mentions").alias("total_mentions"),
        F.sum("num_articles").alias("total_articles"),
        F.avg("goldstein_scale").alias("avg_goldstein"),
        F.avg("avg_tone").alias("avg_tone"),
    )


def display_columns(found):
    """Preferred columns first, the rest after them, coordinates left out."""
    first = [c for c in DISPLAY_FIRST if c in found.columns]
    rest = [c for c in found.columns if c not in first and c not in NOT_DISPLAYED]
    return found.select(*first, *rest)


def top_events(events, limit=10_000):
    """Most covered events that have both coordinates, over all days."""
    located = events.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return top_by_measure(located, "num_articles", limit, "GLOBALEVENTID", "SOURCEURL")


def top_events_by_day(events, limit=10_000):
    """The `top_events` of each day. Each task passes on `limit` rows of a day at most."""
    located = events.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    order = [F.desc("num_articles"), F.asc("GLOBALEVENTID"), F.asc("SOURCEURL")]
    rank = F.row_number().over(Window.partitionBy("event_date").orderBy(*order))
    return located.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def map_points(top, day, limit=1000):
    """Coordinates of one day's top events, most covered first."""
    return (
        top.where(F.col("event_date") == utc_literal(day))
        .orderBy(F.desc("num_articles"), "GLOBALEVENTID")
        .limit(limit)
        .select("lon", "lat")
    )


def available_dates(top, now, hours=200):
    """Days present in the top events and not older than `now` - `hours`, with their label."""
    oldest = utc_literal(now - timedelta(hours=hours))
    return (
        top.where(F.col("event_date") >= oldest)
        .select("event_date")
        .distinct()
        .select("event_date", F.date_format("event_date", "MMM dd, yyyy").alias("label"))
        .orderBy("event_date")
    )
