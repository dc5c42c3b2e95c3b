"""Raw 61-column events -> typed 22-column events."""

from pyspark.sql import functions as F

from newslens.functions.parsing import day_from_int, day_from_stamp
from newslens.schemas import CLEAN_COLUMNS

# Columns that can be derived but are not part of a cleaned event.
EXTRA_COLUMNS = {
    "is_root_event": lambda: F.col("IsRootEvent").cast("boolean"),
    "date_added": lambda: day_from_stamp(F.col("DATEADDED")),
}


def typed_events(raw, extra=()):
    """The columns of a cleaned event; event_date is NULL where there is no calendar day.

    `extra` may name `is_root_event` and `date_added`, or columns of `raw`.
    """
    derived = {
        "event_date": day_from_int(F.col("SQLDATE")),
        "year_month": F.col("MonthYear").cast("string"),
        "goldstein_scale": F.col("GoldsteinScale").cast("float"),
        "avg_tone": F.col("AvgTone").cast("float"),
        "num_mentions": F.col("NumMentions").cast("int"),
        "num_articles": F.col("NumArticles").cast("int"),
        "num_sources": F.col("NumSources").cast("int"),
        "lon": F.col("ActionGeo_Long"),
        "lat": F.col("ActionGeo_Lat"),
    }
    columns = [derived[c].alias(c) if c in derived else c for c in CLEAN_COLUMNS]
    columns += [EXTRA_COLUMNS[c]().alias(c) if c in EXTRA_COLUMNS else c for c in extra]
    return raw.select(*columns)


def clean_events(raw, extra=()):
    """`typed_events` without rows whose SQLDATE is missing or no calendar day."""
    return typed_events(raw, extra).where(F.col("event_date").isNotNull())
