"""Feed manifest: which published files fall into the wanted time window."""

from datetime import timedelta

from pyspark.sql import functions as F

from newslens.functions.parsing import utc_literal
from newslens.sinks.files import exists

# File-name endings by list type, the time stamp format and the slack in hours.
FEED_ENDINGS = {"export": ".export.CSV.zip", "gkg": ".gkg.csv.zip"}
STAMP_FORMAT = "yyyyMMddHHmmss"
SLACK_HOURS = 3


def listed_files(lines, list_type, now, hours):
    """(url, file_time, size, hash) of `size hash url` lines newer than now - (hours + slack).

    `lines` has one string column `value`; `now` is a UTC datetime. Lines with fewer than three
    parts or without a time stamp are skipped; a size that is no number is NULL.
    """
    part = lambda n: F.try_element_at(F.split(F.trim("value"), r"\s+"), F.lit(n))
    stamp = F.regexp_extract(F.element_at(F.split("url", "/"), -1), r"^([^.]*)", 1)
    cutoff = now - timedelta(hours=hours + SLACK_HOURS)
    return (
        lines.where(F.contains("value", F.lit(FEED_ENDINGS[list_type])))
        .select(part(3).alias("url"), part(1).try_cast("bigint").alias("size"), F.lower(part(2)).alias("hash"))
        .where(F.col("url").isNotNull())
        .select("url", F.try_to_timestamp(stamp, F.lit(STAMP_FORMAT)).alias("file_time"), "size", "hash")
        .where(F.col("file_time") > utc_literal(cutoff))
    )


def feed_files(lines, list_type, now, hours):
    """url and file_time of the `listed_files`."""
    return listed_files(lines, list_type, now, hours).select("url", "file_time")


def select_feed_files(spark, paths, list_type, now, hours):
    return feed_files(spark.read.text(paths), list_type, now, hours)


def feed_check(spark, manifest, landed, list_type, now, hours):
    """(name, state) of each listed file: `sound`, `missing`, `wrong size` or `wrong hash`.

    Sizes and MD5 sums are made by the tasks that read the landed files; a name that is listed
    again with other values is sound if one of them fits.
    """
    name = F.element_at(F.split("url", "/"), -1)
    listed = listed_files(spark.read.text(manifest), list_type, now, hours).select(
        name.alias("name"), "size", "hash"
    ).distinct()
    # One name per 15 minutes of the window.
    paths = [f"{landed.rstrip('/')}/{r.name}" for r in listed.select("name").distinct().collect()]
    paths = [path for path in paths if exists(spark, path)]
    if not paths:
        return listed.select("name", F.lit("missing").alias("state")).distinct()
    found = spark.read.format("binaryFile").load(paths).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.md5("content").alias("md5")
    )
    state = (
        F.when(F.col("length").isNull(), "missing")
        .when(~F.col("length").eqNullSafe(F.col("size")), "wrong size")
        .when(~F.col("md5").eqNullSafe(F.col("hash")), "wrong hash")
        .otherwise("sound")
    )
    # In the alphabet "sound" comes before both kinds of damage.
    return listed.join(found, "name", "left").groupBy("name").agg(F.min(state).alias("state"))
