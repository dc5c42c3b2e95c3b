"""Tab-separated scans with fixed schemas."""

from pyspark.sql import functions as F

from newslens.schemas import RAW_EVENT, RAW_GKG

CORRUPT = "_corrupt_record"

# Quoting is off: the feed does not quote, and one stray quote would swallow the next tab.
TSV = {"sep": "\t", "header": "false", "mode": "PERMISSIVE", "quote": ""}


def _scan(spark, paths, ddl, keep_corrupt):
    reader = spark.read.options(**TSV)
    if keep_corrupt:
        # Short and long rows only show when every column is parsed.
        reader = reader.option("columnPruning", "false").option("columnNameOfCorruptRecord", CORRUPT)
        ddl = f"{ddl}, {CORRUPT} STRING"
    return reader.schema(ddl).csv(paths)


def parsed_lines(lines, ddl, line_column=None):
    """Rows of a column `line` of text, parsed in the JVM; blank lines are skipped.

    With `line_column` the row keeps its text under that name, and a column CORRUPT holds it where
    it has too few or too many fields or one that is no value of its type. `inline` keeps later
    filters above the parse; pushed below it, they would parse each line a second time.
    """
    lines = lines.where(F.col("line").rlike(r"\S"))
    if line_column is None:
        return lines.select(F.inline(F.array(F.from_csv("line", ddl, TSV))))
    whole = F.from_csv("line", f"{ddl}, {CORRUPT} STRING", TSV | {"columnNameOfCorruptRecord": CORRUPT})
    return lines.select(F.col("line").alias(line_column), F.inline(F.array(whole)))


def read_raw_events(spark, paths, keep_corrupt=False):
    """Event rows of one path or a list of paths, 61 columns as delivered."""
    return _scan(spark, paths, RAW_EVENT, keep_corrupt)


def read_raw_gkg(spark, paths, keep_corrupt=False):
    """Knowledge-graph rows, 27 columns as delivered; dotted names need back-ticks."""
    return _scan(spark, paths, RAW_GKG, keep_corrupt)


def scan_quality(raw):
    """Row and malformed-row counts of a scan made with `keep_corrupt`."""
    first = F.col(f"`{raw.columns[0]}`")
    return raw.agg(
        F.count("*").alias("total_rows"),
        F.count(CORRUPT).alias("malformed_rows"),
        F.count_if(first.isNull()).alias("rows_without_id"),
    )
