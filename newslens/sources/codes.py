"""Event-code lookup text: a header line, then `code description` lines."""

from pyspark.sql import functions as F

from newslens.functions.parsing import one_spaced


def read_event_codes(spark, paths):
    """EventCode and EventDescription, both strings; blank lines are skipped.

    Read as one-column CSV, because `header` drops the first line of each file exactly, and as a
    file scan, because Catalyst then knows the size and picks the join strategy from it.
    """
    lines = (
        spark.read.schema("line STRING")
        .options(header="true", sep="\u0001", quote="")
        .csv(paths)
        .select(one_spaced(F.col("line")).alias("line"))
        .where(F.col("line") != "")
    )
    return lines.select(
        F.split_part("line", F.lit(" "), F.lit(1)).alias("EventCode"),
        F.regexp_replace("line", r"^\S+ ?", "").alias("EventDescription"),
    )
