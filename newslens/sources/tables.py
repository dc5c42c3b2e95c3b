"""Stored tables, read back with fixed schemas or as written."""

from pyspark.sql import functions as F

from newslens.schemas import STORED_EVENT
from newslens.sinks.files import children, exists

# Text columns of the events that searches match patterns against.
TEXT_COLUMNS = ["ActionGeo_FullName", "Actor1Name", "Actor2Name"]
# Tables derived from the events, beside them.
EVENT_INDEX = "event_index"
EVENT_VALUES = "event_values"
CHANGED_DAYS = "_changed_days"
DAY_PLACES = "day_places"
DAY_TOPS = "day_tops"
DAY_TABLES = [DAY_PLACES, DAY_TOPS]
INDEX_COLUMNS = ["_key", "n", "sum", "event_date"]
INDEX = "_key BIGINT, n BIGINT, sum DECIMAL(38,0), event_date DATE"


def open_mark(root):
    return f"{root}/_open"


def is_open(spark, root):
    """Whether a writer of the events is at work, or died: derived tables may lag behind."""
    return exists(spark, open_mark(root))


def read_event_index(spark, root):
    """(_key, n, sum, event_date): how many rows an event has on a day and the sum of their hashes."""
    if not exists(spark, f"{root}/{EVENT_INDEX}"):
        return None
    return spark.read.schema(INDEX).parquet(f"{root}/{EVENT_INDEX}")


def read_event_values(spark, root):
    """(field, value): every value of the text columns, perhaps some of rows that have gone."""
    if not exists(spark, f"{root}/{EVENT_VALUES}"):
        return None
    return spark.read.schema("value STRING, field STRING").parquet(f"{root}/{EVENT_VALUES}").select("field", "value")


def changed_days(spark, root):
    """(files, days): what has been noted since the summaries last took it up."""
    files = [f for f in children(spark, f"{root}/{CHANGED_DAYS}") if f.endswith(".parquet")]
    if not files:
        return [], []
    return files, sorted({r.event_date for r in spark.read.schema("event_date DATE").parquet(*files).collect()})


def read_stored_events(spark, root):
    """The events table as stored (event_date DATE), or None before the first ingest."""
    if not exists(spark, f"{root}/events"):
        return None
    return spark.read.schema(STORED_EVENT).parquet(f"{root}/events")


def _days_as_timestamps(df):
    return df.withColumn("event_date", F.col("event_date").cast("timestamp"))


def read_events(spark, root):
    """Events with event_date as UTC-midnight timestamp; day filters still prune folders."""
    stored = read_stored_events(spark, root)
    if stored is None:
        raise FileNotFoundError(f"no events table under {root}; run the ingest first")
    return _days_as_timestamps(stored)


def read_table(spark, root, name):
    """A summary table; event_date is a timestamp here as well."""
    table = spark.read.parquet(f"{root}/{name}")
    return _days_as_timestamps(table) if "event_date" in table.columns else table


# Order in which each summary is read, ending in columns that make it unique.
SUMMARY_ORDER = {
    "top_events": ["-num_articles", "GLOBALEVENTID"],
    "events_per_country": ["-Total_Events", "Country_Name"],
    "tone_by_country": ["-Average_Tone", "Country_Name"],
    "country_event_spike": ["-spike_score", "ActionGeo_CountryCode"],
    "events_by_time_and_country": ["-event_ts", "ActionGeo_CountryCode"],
    "separate_events": [
        "-total_articles", "ActionGeo_CountryCode", "event_date", "QuadClass", "EventBaseCode",
    ],
    "top_impact_events": [
        "impact_score", "ActionGeo_CountryCode", "event_date", "QuadClass", "EventBaseCode",
    ],
}


def summary_head(spark, root, name, limit=1000):
    """First rows of a stored summary. The order is explicit, since files keep none."""
    order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in SUMMARY_ORDER[name]]
    return read_table(spark, root, name).orderBy(*order).limit(limit)
