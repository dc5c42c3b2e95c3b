"""The data behind each dashboard page, from stored tables.

Nothing runs until it is shown, but for the few matching names that a text search looks up.
"""

from dataclasses import replace

from newslens.operators.countries import tone_extremes
from newslens.operators.search import (
    available_dates,
    display_columns,
    map_points,
    search_events,
    search_kpis,
    text_filters,
    with_matching_values,
)
from newslens.operators.spikes import flagged_spikes, spike_kpis, spike_report, spike_top
from newslens.sources.tables import is_open, read_event_values, read_events, read_table, summary_head


def global_trends(spark, root, now, day=None, n=15, hours=200):
    """Country totals, tone extremes, selectable days and, for one day, the map points."""
    top = read_table(spark, root, "top_events")
    page = {
        "country_totals": summary_head(spark, root, "events_per_country", n),
        "tone_extremes": tone_extremes(read_table(spark, root, "tone_by_country"), n),
        "available_dates": available_dates(top, now, hours),
    }
    if day is not None:
        page["map_points"] = map_points(top, day)
    return page


def search_stored(spark, root, spec):
    """`search_events` over the stored table, by way of its table of text values.

    While a writer is at work, or where there is no such table, patterns are tried on the events.
    """
    events = read_events(spark, root)
    values = None if is_open(spark, root) else read_event_values(spark, root)
    if values is None:
        return search_events(events, spec)
    for column, pattern in text_filters(spec):
        events = with_matching_values(events, values, column, pattern, spec.literal)
    return search_events(events, replace(spec, country=None, actor1=None, actor2=None))


def country_insights(spark, root, spec):
    """Search result, its KPIs and the table as displayed and exported."""
    found = search_stored(spark, root, spec)
    return {"found": found, "kpis": search_kpis(found), "display": display_columns(found)}


def event_spikes(spark, root, only_spikes=False, limit=50):
    """Spike rows, KPIs, flagged countries and the chart's top 20."""
    report = spike_report(read_table(spark, root, "country_event_spike"), only_spikes, limit)
    return {
        "report": report,
        "kpis": spike_kpis(report),
        "flagged": flagged_spikes(report),
        "chart": spike_top(report),
    }
