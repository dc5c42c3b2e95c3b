"""Aggregates built to survive keys that hold a large share of all rows."""

from pyspark.sql import functions as F


def modal_value(value, n):
    """Most frequent value out of (value, n) rows that were counted beforehand.

    Equal counts go to the smallest value; NULL values never win. Counting by (key, value)
    first lets a hot key spread over its values, and this step then needs one row of state per
    key, where `mode` would hold every value of the key in one task's memory.
    """
    ranked = F.struct((-n).alias("n"), value.alias("v"))
    return F.min(F.when(value.isNotNull(), ranked))["v"]
