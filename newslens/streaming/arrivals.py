"""Arrivals: feed files are appended as they land, without repeats, and folded into the table later.

`ingest_landed` rewrites day folders in every micro-batch. Here a micro-batch only appends what is
new, and one compaction merges many batches at a time.
"""

from pyspark.sql import functions as F

from newslens.operators.clean import clean_events
from newslens.operators.enrich import enrich_events
from newslens.plans.ingest import one_row_per_event, staged_keys
from newslens.schemas import CLEAN_COLUMNS
from newslens.session import scratch_path
from newslens.sinks.files import children, delete
from newslens.sinks.tables import event_key, merge_events
from newslens.sources.codes import read_event_codes
from newslens.streaming.feed import stream_raw_events

ARRIVED = "_arrived"


def new_arrivals(raw, remember="7 days"):
    """Cleaned events of a stream, with the time of arrival; exact repeats within `remember` dropped.

    State holds a key and a row hash of each event for that long. Its clock is the arrival, not
    the event's own time, so an event about an old day, or one added late, is never dropped as
    late. A changed event passes; one that goes back to what it was within `remember` counts as a
    repeat. What repeats after that is merged without effect.
    """
    clean = clean_events(raw)
    whole = F.xxhash64(*clean.columns, *(F.col(c).isNull() for c in clean.columns))
    keyed = clean.withColumns({"_key": event_key(clean), "_hash": whole, "arrived": F.current_timestamp()})
    return keyed.withWatermark("arrived", remember).dropDuplicatesWithinWatermark(["_key", "_hash"])


def append_arrivals(spark, folder, root, checkpoint, remember="7 days", zipped=False, max_files=1000):
    """Append what has landed in `folder` since the last call, then stop. Returns the query.

    Each micro-batch has a folder of its own, named by the stream and the batch, and replaces it
    if it is replayed after a failure.
    """

    def append(batch, batch_id):
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.write.mode("overwrite").parquet(f"{root}/{ARRIVED}/{stream}-{batch_id}")

    raw = stream_raw_events(spark, folder, zipped, max_files)
    return (
        new_arrivals(raw, remember)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_arrivals(spark, root):
    """Rows that have arrived and are not in the events table yet, or None."""
    folders = children(spark, f"{root}/{ARRIVED}")
    return spark.read.parquet(*folders) if folders else None


def compact_arrivals(spark, code_paths, root):
    """Merge all arrivals into `events` and drop their folders; the latest arrival of an event counts.

    If the job dies before the folders are dropped, the next one merges them again, which changes
    nothing. Returns the number of folders.
    """
    folders = children(spark, f"{root}/{ARRIVED}")
    if not folders:
        return 0
    rows = spark.read.parquet(*folders)
    several = rows.groupBy("_key").agg(F.max("arrived").alias("arrived"), F.count("*").alias("n")).where("n > 1")
    # Few events arrive twice between compactions; only theirs are compared.
    latest = staged_keys(several.select("_key", "arrived"))
    single = rows.join(latest, "_key", "left_anti").select(*CLEAN_COLUMNS)
    last = rows.join(latest, ["_key", "arrived"], "left_semi").select(*CLEAN_COLUMNS)
    events = single.unionByName(one_row_per_event(last))
    staging = scratch_path(spark, "staged")
    enrich_events(events, read_event_codes(spark, code_paths)).write.parquet(staging)
    merge_events(spark, spark.read.parquet(staging), root)
    for folder in folders:
        delete(spark, folder)
    delete(spark, staging)
    return len(folders)
