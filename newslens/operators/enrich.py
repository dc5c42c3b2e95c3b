"""Event descriptions from the code lookup."""

from newslens.schemas import require_columns


def enrich_events(events, codes):
    """Inner join on EventCode: events with an unknown code drop out, duplicate codes fan out.

    No join hint. `read_event_codes` is a file scan, so Catalyst compares the lookup's real size
    with spark.sql.autoBroadcastJoinThreshold and broadcasts it when it fits. A larger lookup
    becomes a sort-merge join, whose hot event codes adaptive execution splits.
    """
    require_columns(events, "EventCode")
    require_columns(codes, "EventCode", "EventDescription")
    return events.join(codes.select("EventCode", "EventDescription"), "EventCode", "inner").select(
        *events.columns, "EventDescription"
    )
