"""Scalar expressions for the feed's text and integer encodings."""

from datetime import UTC, date, datetime

from pyspark.sql import functions as F


def day_from_int(day):
    """yyyyMMdd integer -> timestamp at midnight; NULL where it is no calendar day."""
    return F.try_to_timestamp(day.cast("string"), F.lit("yyyyMMdd"))


def day_from_stamp(stamp):
    """yyyyMMddHHmmss integer -> timestamp at midnight of its day."""
    return F.try_to_timestamp(F.substring(stamp.cast("string"), 1, 8), F.lit("yyyyMMdd"))


def as_utc(moment):
    """date or datetime -> naive datetime in UTC; a naive one is taken to be UTC already."""
    if isinstance(moment, datetime):
        return moment if moment.tzinfo is None else moment.astimezone(UTC).replace(tzinfo=None)
    if isinstance(moment, date):
        return datetime(moment.year, moment.month, moment.day)
    raise TypeError(f"expected a date or datetime, got {moment!r}")


def utc_literal(moment):
    """Timestamp literal of a date or datetime, whatever the machine's own zone is."""
    return F.lit(as_utc(moment).isoformat(sep=" ")).cast("timestamp")


def one_spaced(text):
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def text_match(column, pattern, literal=False):
    """Case-insensitive partial match, or None where the trimmed pattern is blank.

    `pattern` is a Java regular expression unless `literal` is set.
    """
    pattern = (pattern or "").strip()
    if not pattern:
        return None
    if literal:
        return F.contains(F.lower(column), F.lower(F.lit(pattern)))
    return column.rlike("(?i)" + pattern)
