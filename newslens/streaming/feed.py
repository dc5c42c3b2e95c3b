"""Incremental ingest: pick up feed files as they land.

The feed publishes every 15 minutes. The stream applies the batch ingest's own functions; Spark's
checkpoint remembers which files were read.
"""

from newslens.operators.clean import clean_events
from newslens.operators.enrich import enrich_events
from newslens.schemas import RAW_EVENT
from newslens.plans.ingest import one_row_per_event
from newslens.session import scratch_path
from newslens.sinks.files import delete
from newslens.sinks.tables import merge_events
from newslens.sources.archives import rows_from_archives
from newslens.sources.codes import read_event_codes
from newslens.sources.delimited import TSV

# The columns of Spark's binaryFile source, which a stream has to be told.
BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def stream_raw_events(spark, folder, zipped=False, max_files=1000):
    """Event files that appear in `folder`: tab-separated text, or zip archives."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    if zipped:
        archives = reader.format("binaryFile").schema(BINARY_FILE).load(folder)
        return rows_from_archives(archives.select("path", "content"), RAW_EVENT)
    return reader.schema(RAW_EVENT).options(**TSV).csv(folder)


def ingest_landed(spark, folder, code_paths, root, checkpoint, zipped=False):
    """Merge everything that has landed since the last call into `events`, then stop.

    Each micro-batch goes through the same staging and merge as the batch ingest. A batch that
    is replayed after a failure replaces its own rows, so no event is stored twice and no
    de-duplication state has to be kept for late reports about old days.
    """
    codes = read_event_codes(spark, code_paths)

    def merge_batch(batch, batch_id):
        spark = batch.sparkSession
        parsed, staging = scratch_path(spark, "parsed"), scratch_path(spark, "staged")
        clean_events(batch).write.parquet(parsed)
        events = enrich_events(one_row_per_event(spark.read.parquet(parsed)), codes)
        events.write.parquet(staging)
        merge_events(spark, spark.read.parquet(staging), root)
        delete(spark, parsed)
        delete(spark, staging)

    return (
        stream_raw_events(spark, folder, zipped)
        .writeStream.foreachBatch(merge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
