"""Hand-made events for the unit tests."""

from datetime import datetime

from newslens.schemas import STORED_EVENT, fields

COLUMNS = [name for name, _ in fields(STORED_EVENT)]
DDL = STORED_EVENT.replace("event_date DATE", "event_date TIMESTAMP")


def day(n):
    return datetime(2024, 3, n)


def events(spark, rows):
    """Stored-shape events from dicts; what a dict leaves out takes a default."""
    default = dict.fromkeys(COLUMNS)
    default |= {
        "event_date": day(1), "year_month": "202403", "EventCode": "010", "EventBaseCode": "010",
        "EventRootCode": "01", "QuadClass": 1, "goldstein_scale": 1.0, "avg_tone": 1.0,
        "num_mentions": 1, "num_articles": 1, "num_sources": 1, "ActionGeo_FullName": "Paris",
        "ActionGeo_CountryCode": "FR", "lon": 2.0, "lat": 48.0, "EventDescription": "Make statement",
    }
    full = [default | {"GLOBALEVENTID": i} | row for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(row[c] for c in COLUMNS) for row in full], DDL)


def repeat(n, **row):
    return [row] * n


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
