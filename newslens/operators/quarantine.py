"""Which feed rows are dropped or damaged, and why."""

from pyspark.sql import functions as F

from newslens.functions.parsing import day_from_int
from newslens.schemas import RAW_EVENT, fields
from newslens.sources.delimited import CORRUPT

# Columns that `read_feed_lines` gives beside those of the feed.
LINE = "_line"
WIDTH = len(fields(RAW_EVENT))
QUARANTINE_COLUMNS = ["GLOBALEVENTID", "reason", "dropped", "line"]


def with_reason(raw):
    """`raw` with `reason`, NULL for sound rows, and whether the row is `dropped`.

    The first that holds: another number of fields than the feed has, a field that is no value of
    its type, no day, a day that is not in the calendar, no id. Only rows without an event day are
    dropped; of the others the fields that could be read are kept.
    """
    no_day = day_from_int(F.col("SQLDATE")).isNull()
    n_fields = F.size(F.split(F.col(LINE), "\t"))
    reason = (
        F.when(n_fields != WIDTH, "number of fields")
        .when(F.col(CORRUPT).isNotNull(), "unreadable field")
        .when(F.col("SQLDATE").isNull(), "no day")
        .when(no_day, "no calendar day")
        .when(F.col("GLOBALEVENTID").isNull(), "no id")
    )
    return raw.withColumns({"reason": reason, "dropped": no_day})


def quarantined(sorted_out):
    """(GLOBALEVENTID, reason, dropped, line) of rows that have a reason."""
    rows = sorted_out.where(F.col("reason").isNotNull())
    return rows.select("GLOBALEVENTID", "reason", "dropped", F.col(LINE).alias("line"))
