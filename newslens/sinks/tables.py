"""Result tables as Parquet folders under one root."""

import uuid

from pyspark.sql import functions as F

from newslens.schemas import STORED_EVENT, fields, require_columns
from newslens.sinks.files import children, delete, exists, touch
from newslens.sources.tables import (
    CHANGED_DAYS,
    DAY_TABLES,
    EVENT_INDEX,
    EVENT_VALUES,
    INDEX_COLUMNS,
    TEXT_COLUMNS,
    is_open,
    open_mark,
    read_event_index,
    read_event_values,
    read_stored_events,
)

# Row order inside the tables with day folders, next to the day itself. The last column splits
# even one country's single day over several files.
LAYOUTS = {
    "events": ["ActionGeo_CountryCode", "num_articles", "GLOBALEVENTID"],
    "separate_events": ["ActionGeo_CountryCode", "total_articles", "EventBaseCode"],
    "top_impact_events": ["ActionGeo_CountryCode", "total_articles", "EventBaseCode"],
}
DESCENDING = {"num_articles", "total_articles"}
# Names are looked up one at a time: a Bloom filter tells which row groups may hold one.
BLOOM_FILTERS = {
    "parquet.bloom.filter.adaptive.enabled": "true",
    **{f"parquet.bloom.filter.enabled#{c}": "true" for c in TEXT_COLUMNS},
}


def _write_by_day(df, path, layout, overwrite_mode, **options):
    """Range-partition and sort, so that each file covers a narrow range of its day's keys.

    Day and country lookups then skip folders, files and pages, as an index would, and a day
    with a large share of all rows is written by many tasks.
    """
    df = df.withColumn("event_date", F.col("event_date").cast("date"))
    keys = [F.asc("event_date")]
    keys += [F.desc(c) if c in DESCENDING else F.asc(c) for c in layout]
    (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .options(partitionOverwriteMode=overwrite_mode, **options)
        .partitionBy("event_date")
        .parquet(path)
    )


def as_stored(rows):
    """Columns and types of the stored events table."""
    require_columns(rows, *(name for name, _ in fields(STORED_EVENT)))
    return rows.select(*(F.col(name).cast(kind) for name, kind in fields(STORED_EVENT)))


def write_events(rows, root):
    """Write event rows into day folders, replacing exactly the days that occur in `rows`.

    What is derived from the events follows for the same days: the index of keys, the values of
    the text columns, and the days that summaries have to take up again. An open mark says while
    it lags behind; where a writer died and left the mark, all of it is derived again.
    """
    spark = rows.sparkSession
    rows = as_stored(rows)
    # At most the days of the calendar.
    days = [r.event_date for r in rows.select("event_date").distinct().collect()]
    first = read_stored_events(spark, root) is None
    whole = is_open(spark, root) or not first and read_event_index(spark, root) is None
    touch(spark, open_mark(root))
    _write_by_day(rows, f"{root}/events", LAYOUTS["events"], "dynamic", **BLOOM_FILTERS)
    if whole:
        rebuild_derived(spark, root)
    else:
        _derive(spark, root, days)
    delete(spark, open_mark(root))


def event_key(df):
    """Identity of an event: its id, or a hash of the row, descriptions aside, where the id is missing."""
    own = [F.col(c) for c in df.columns if c != "EventDescription"]
    return F.coalesce(F.col("GLOBALEVENTID"), F.xxhash64(*own))


def _keyed(df, *columns):
    """The columns with the event's key and a hash of the whole row."""
    # A hash passes over NULLs, so they are hashed as flags.
    whole = F.xxhash64(*df.columns, *(F.col(c).isNull() for c in df.columns))
    return df.select(*columns, event_key(df).alias("_key"), whole.alias("_hash"))


def _row_sets(keyed, *keys):
    """(keys, n, sum): what tells the set of rows of an event, one per description, from another."""
    # The sum of a great many hashes has no place in a long.
    return keyed.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("_hash").cast("decimal(20,0)")).cast("decimal(38,0)").alias("sum")
    )


def _write_index(spark, events, root, overwrite_mode):
    """(_key, n, sum) of each event, by day: what merges need to know of stored events."""
    sets = _row_sets(_keyed(events, "event_date"), "event_date", "_key").select(*INDEX_COLUMNS)
    sets.repartitionByRange("event_date", "_key").sortWithinPartitions("event_date", "_key").write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", overwrite_mode).partitionBy("event_date").parquet(f"{root}/{EVENT_INDEX}")


def _add_values(spark, events, root, known):
    """Append values of the text columns that the table of values does not have yet."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in TEXT_COLUMNS)))
    found = events.select(pairs.alias("pair")).select("pair.*").where("value IS NOT NULL").distinct()
    if known is not None:
        found = found.join(known, ["field", "value"], "left_anti")
    found.write.mode("append").partitionBy("field").parquet(f"{root}/{EVENT_VALUES}")


def _note_changed(spark, root, days):
    dated = spark.createDataFrame([(d,) for d in days], "event_date DATE")
    dated.coalesce(1).write.mode("append").parquet(f"{root}/{CHANGED_DAYS}")


def _derive(spark, root, days):
    """Bring the index, the values and the list of changed days up to the events of some days."""
    if not days:
        return
    written = as_stored(read_stored_events(spark, root).where(F.col("event_date").isin(days)))
    _note_changed(spark, root, days)
    _add_values(spark, written, root, read_event_values(spark, root))
    _write_index(spark, written, root, "dynamic")


def rebuild_derived(spark, root):
    """Derive everything from all events: after a writer died, or for a table that has none of it."""
    touch(spark, open_mark(root))
    events = as_stored(read_stored_events(spark, root))
    _write_index(spark, events, root, "static")
    delete(spark, f"{root}/{EVENT_VALUES}")
    _add_values(spark, events, root, None)
    # Summaries without a table of days start from all events.
    for name in (*DAY_TABLES, CHANGED_DAYS):
        delete(spark, f"{root}/{name}")
    delete(spark, open_mark(root))


def merge_events(spark, new_rows, root):
    """Add already staged rows to the events table; an id that comes again is replaced.

    Events whose rows, all descriptions together, the table already has are left out, so a repeated
    feed rewrites nothing. Of the others all rows are replaced; the days they fall on and the days
    on which their ids are stored are rewritten as a whole. Which these are the index of keys
    tells; stored events are read on the rewritten days alone. The complete days are staged in a
    folder of this run before any is replaced; if the job dies in between, `recover` of the next
    run repeats the write. One writer at a time.
    """
    recover(spark, root)
    existing = read_stored_events(spark, root)
    new_rows = as_stored(new_rows)
    if existing is None:
        write_events(new_rows, root)
        return
    if is_open(spark, root) or read_event_index(spark, root) is None:
        rebuild_derived(spark, root)
    existing = as_stored(existing)
    run = f"{root}/_staging/{uuid.uuid4().hex}"
    _keyed(new_rows, *new_rows.columns).write.parquet(f"{run}/new")
    keyed = spark.read.parquet(f"{run}/new")
    ends = keyed.agg(F.min("_key").alias("low"), F.max("_key").alias("high")).first()
    # Sorted by key, the index is read where its row groups reach into the feed's range of keys.
    index = read_event_index(spark, root).where(F.col("_key").between(ends.low, ends.high))
    index.join(keyed.select("_key").distinct(), "_key", "left_semi").write.parquet(f"{run}/stored")
    stored = spark.read.parquet(f"{run}/stored")
    sets = stored.groupBy("_key").agg(F.sum("n").alias("n"), F.sum("sum").cast("decimal(38,0)").alias("sum"))
    differing = _row_sets(keyed, "_key").join(sets, ["_key", "n", "sum"], "left_anti")
    changed = keyed.join(differing.select("_key"), "_key", "left_semi")
    changed.select("_key", *new_rows.columns).write.parquet(f"{run}/changed")
    changed = spark.read.parquet(f"{run}/changed")
    if changed.isEmpty():
        delete(spark, run)
        return
    old_days = stored.join(changed.select("_key"), "_key", "left_semi").select("event_date")
    changed.select("event_date").union(old_days).distinct().coalesce(1).write.parquet(f"{run}/days")
    days = [r.event_date for r in spark.read.parquet(f"{run}/days").collect()]
    touched = existing.where(F.col("event_date").isin(days))
    kept = touched.withColumn("_key", event_key(touched)).join(changed.select("_key"), "_key", "left_anti")
    rows = kept.select(*new_rows.columns).unionByName(changed.select(*new_rows.columns))
    rows.write.parquet(f"{run}/merged")
    _publish(spark, run, root)


def _publish(spark, run, root):
    """Replace the days of a staged run, drop those that lost all their rows, forget the run."""
    merged = spark.read.schema(STORED_EVENT).parquet(f"{run}/merged")
    write_events(merged, root)
    days = spark.read.parquet(f"{run}/days")
    # At most as many as the run touches, and each is a folder to delete.
    empty = [r.event_date for r in days.join(merged.select("event_date"), "event_date", "left_anti").collect()]
    if empty:
        _note_changed(spark, root, empty)
    for day in empty:
        delete(spark, f"{root}/events/event_date={day}")
        delete(spark, f"{root}/{EVENT_INDEX}/event_date={day}")
    delete(spark, run)


def recover(spark, root):
    """Finish the write of a run that died after its days were staged; drop what is incomplete."""
    for run in children(spark, f"{root}/_staging"):
        if exists(spark, f"{run}/merged/_SUCCESS"):
            _publish(spark, run, root)
        else:
            delete(spark, run)


def write_summary(df, root, name):
    """Replace a summary table. Failures are raised."""
    path = f"{root}/{name}"
    if name in LAYOUTS:
        _write_by_day(df, path, LAYOUTS[name], "static")
    elif name == "top_events":
        # Read back one day at a time.
        df.sortWithinPartitions("event_date", F.desc("num_articles")).write.mode(
            "overwrite"
        ).parquet(path)
    else:
        # The summaries arrive in the order in which they are looked up.
        df.write.mode("overwrite").parquet(path)


def write_day_table(df, root, name, days):
    """Replace the rows of some days in a table with day folders; of all days if `days` is None."""
    mode = "static" if days is None else "dynamic"
    df.repartitionByRange("event_date", *df.columns[:2]).write.mode("overwrite").option(
        "partitionOverwriteMode", mode
    ).partitionBy("event_date").parquet(f"{root}/{name}")
    if days:
        left = {r.event_date for r in df.select("event_date").distinct().collect()}
        for day in set(days) - left:
            delete(df.sparkSession, f"{root}/{name}/event_date={day}")


def clear_tables(spark, root, names):
    """Empty the named tables. Works through Spark's own writer, so on any file system."""
    for name in names:
        path = f"{root}/{name}"
        if name == "events":
            if read_stored_events(spark, root) is not None:
                _write_by_day(
                    spark.createDataFrame([], STORED_EVENT), path, LAYOUTS["events"], "static"
                )
                for derived in (EVENT_INDEX, EVENT_VALUES, CHANGED_DAYS, *DAY_TABLES):
                    delete(spark, f"{root}/{derived}")
            continue
        if exists(spark, path):
            schema = spark.read.parquet(path).schema
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
