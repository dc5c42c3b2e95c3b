"""Analysis: stored events -> summary tables.

What the summaries need of a day is kept per day: its events and tone per country and place, and
its most covered events. A run takes up the days that changed since the last one and adds up all
days' rows, so that its cost follows what is new and not what is stored.
"""

from pyspark.sql import functions as F

from newslens.operators.countries import (
    add_day_places,
    country_days,
    day_place_counts,
    events_per_country,
    tone_by_country,
)
from newslens.operators.search import top_events, top_events_by_day
from newslens.operators.spikes import spikes_of_counts
from newslens.operators.stories import impact_ranking, story_groups
from newslens.sinks.files import delete, exists
from newslens.sinks.tables import clear_tables, rebuild_derived, write_day_table, write_summary
from newslens.sources.tables import (
    DAY_PLACES,
    DAY_TABLES,
    DAY_TOPS,
    changed_days,
    is_open,
    read_events,
    read_stored_events,
    read_table,
)

DEFAULT_HOURS = 168
# Most covered events that are kept of each day; larger lists are made from all events.
TOP_PER_DAY = 10_000

# Names of the stored tables.
SUMMARY_TABLES = [
    "separate_events", "top_impact_events", "top_events", "events_per_country",
    "tone_by_country", "country_event_spike", "events_by_time_and_country",
]


def refresh_days(spark, root):
    """Bring the tables of days up to the events. Returns the days taken up, None for all.

    The notes of changed days are dropped last: if the job dies, the next takes the days up again.
    """
    if is_open(spark, root):
        rebuild_derived(spark, root)
    files, days = changed_days(spark, root)
    stored = read_stored_events(spark, root)
    if not all(exists(spark, f"{root}/{name}") for name in DAY_TABLES):
        days = None
    elif not files:
        return []
    else:
        stored = stored.where(F.col("event_date").isin(days))
    write_day_table(day_place_counts(stored), root, DAY_PLACES, days)
    write_day_table(top_events_by_day(stored, TOP_PER_DAY), root, DAY_TOPS, days)
    for file in files:
        delete(spark, file)
    return days


def run_analysis(spark, root, hours=DEFAULT_HOURS, top_limit=10_000, min_baseline=200.0):
    """The four dashboard summaries and the country-day counts. Each run replaces them.

    Only days with new, changed or dropped events are read. Returns those days, None for all.
    """
    events = read_events(spark, root)
    days = refresh_days(spark, root)
    # Each day's most covered events hold those of all days.
    tops = read_table(spark, root, DAY_TOPS) if top_limit <= TOP_PER_DAY else events
    write_summary(top_events(tops, top_limit).select(*events.columns), root, "top_events")
    by_day = read_table(spark, root, DAY_PLACES)
    # Small next to the events, and both country summaries start from it.
    places = add_day_places(by_day).persist()
    try:
        write_summary(events_per_country(places), root, "events_per_country")
        write_summary(tone_by_country(places), root, "tone_by_country")
    finally:
        places.unpersist()
    write_summary(country_days(by_day), root, "events_by_time_and_country")
    counts = read_table(spark, root, "events_by_time_and_country")
    spikes = spikes_of_counts(counts, baseline_days=hours / 24, min_baseline=min_baseline)
    write_summary(spikes, root, "country_event_spike")
    return days


def run_story_analysis(spark, root, min_sources=20, max_urls=20):
    """Story groups and their impact ranking; not part of the dashboard run."""
    events = read_events(spark, root)
    write_summary(story_groups(events, min_sources, max_urls), root, "separate_events")
    stories = read_table(spark, root, "separate_events")
    write_summary(impact_ranking(stories), root, "top_impact_events")


def clear(spark, root, events_too):
    """Empty the summaries, and the events as well if asked to."""
    clear_tables(spark, root, SUMMARY_TABLES + (["events"] if events_too else []))
