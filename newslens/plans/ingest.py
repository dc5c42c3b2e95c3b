"""Ingest: landed feed files -> enriched `events` table."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from newslens.operators.clean import typed_events
from newslens.operators.enrich import enrich_events
from newslens.operators.quarantine import LINE, QUARANTINE_COLUMNS, quarantined, with_reason
from newslens.schemas import CLEAN_COLUMNS, RAW_EVENT
from newslens.session import scratch_path
from newslens.sinks.files import delete, exists
from newslens.sinks.tables import event_key, merge_events
from newslens.sources.archives import archive_lines, read_zipped_events, read_zipped_gkg
from newslens.sources.codes import read_event_codes
from newslens.sources.delimited import parsed_lines, read_raw_events
from newslens.sources.manifest import feed_check, select_feed_files


def staged_keys(keys):
    """The rows of `keys` from a scratch table, whose size Catalyst knows."""
    spark = keys.sparkSession
    path = scratch_path(spark, "repeated")
    keys.write.parquet(path)
    return spark.read.schema(keys.schema).parquet(path)


def one_row_per_event(clean):
    """Drop repeated deliveries of an event; of differing ones the greatest row stays.

    Repeats are rare, so a count per key finds them first; only rows of repeated keys go through
    the aggregate over whole rows. The repeated keys are staged, so that the joins know how few they
    are and leave the other rows where they are read. The surviving row does not depend on task timing.
    """
    keyed = clean.withColumn("_key", event_key(clean))
    repeated = staged_keys(keyed.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"))
    row = F.struct(*(F.col(c) for c in clean.columns))
    several = keyed.join(repeated, "_key", "left_semi").groupBy("_key").agg(F.max(row).alias("row"))
    single = keyed.join(repeated, "_key", "left_anti").drop("_key")
    return single.unionByName(several.select("row.*"))


def feed_paths(spark, paths):
    """The files that paths, folders and globs name: (zip archives, tab-separated text)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no feed files given")
    files = spark.read.format("binaryFile").load(paths).inputFiles()
    if not files:
        raise ValueError(f"no feed files in {paths}")
    zipped = [f for f in files if f.lower().endswith(".zip")]
    return zipped, [f for f in files if not f.lower().endswith(".zip")]


def read_feed(spark, paths):
    """Raw events of landed files, zip archives and text mixed at will."""
    zipped, plain = feed_paths(spark, paths)
    scans = []
    if zipped:
        scans.append(read_zipped_events(spark, zipped))
    if plain:
        scans.append(read_raw_events(spark, plain))
    return scans[0] if len(scans) == 1 else scans[0].unionByName(scans[1])


def read_feed_lines(spark, paths):
    """As `read_feed`, with each row's text and, where it does not fit the columns, CORRUPT."""
    zipped, plain = feed_paths(spark, paths)
    scans = []
    if zipped:
        scans.append(archive_lines(spark, zipped))
    if plain:
        scans.append(spark.read.text(plain).select(F.col("value").alias("line")))
    lines = scans[0] if len(scans) == 1 else scans[0].unionByName(scans[1])
    return parsed_lines(lines, RAW_EVENT, LINE)


def read_quarantine(spark, root):
    """(GLOBALEVENTID, reason, dropped, line) of the feed rows that were dropped or damaged, or None."""
    path = f"{root}/quarantine"
    return spark.read.parquet(path) if exists(spark, path) else None


def _add_to_quarantine(spark, rows, root):
    """Append rows that are not there yet, so that a feed that comes again adds none."""
    known = read_quarantine(spark, root)
    rows = rows.distinct()
    if known is not None:
        rows = rows.join(known.select("line", "reason"), ["line", "reason"], "left_anti")
    rows.select(*QUARANTINE_COLUMNS).write.mode("append").parquet(f"{root}/quarantine")


def ingest(spark, feed, code_paths, root):
    """Parse the feed once into a scratch table, then merge it into `events`. Returns row counts.

    The same pass sorts out rows that are dropped or damaged; they go to the table `quarantine`,
    with the reason. Running it again on the same files leaves all tables as they are. A feed
    without any event id is an error: it is no event feed.
    """
    read, staged = Observation("read"), Observation("staged")
    rows = F.count(F.lit(1)).alias("rows")
    raw = with_reason(read_feed_lines(spark, feed)).observe(
        read, rows, F.count("GLOBALEVENTID").alias("ids"), F.count_if(~F.col("dropped")).alias("cleaned")
    )
    parsed = scratch_path(spark, "parsed")
    line = F.when(F.col("reason").isNotNull(), F.col(LINE)).alias(LINE)
    typed_events(raw.withColumn(LINE, line), ["reason", "dropped", LINE]).write.partitionBy("dropped").parquet(parsed)
    if not read.get["ids"]:
        raise ValueError(f"no event in the feed {feed}")
    # A folder's name is read back as text.
    sorted_out = spark.read.parquet(parsed).withColumn("dropped", F.col("dropped").cast("boolean"))
    _add_to_quarantine(spark, quarantined(sorted_out), root)
    once = one_row_per_event(sorted_out.where("NOT dropped").select(*CLEAN_COLUMNS))
    events = enrich_events(once, read_event_codes(spark, code_paths)).observe(staged, rows)
    staging = scratch_path(spark, "staged")
    events.write.parquet(staging)
    merge_events(spark, spark.read.parquet(staging), root)
    delete(spark, parsed)
    delete(spark, staging)
    return {"read": read.get["rows"], "cleaned": read.get["cleaned"], "staged": staged.get["rows"]}


def landed_files(spark, names, landed):
    """Paths of those of the named files that lie in the folder `landed`. The folder is not listed."""
    paths = [f"{landed.rstrip('/')}/{name}" for name in sorted(set(names))]
    return [path for path in paths if exists(spark, path)]


def window_files(spark, manifest, landed, list_type, now, hours):
    """Landed files that the manifest lists for the last `hours`."""
    listed = select_feed_files(spark, manifest, list_type, now, hours)
    # One name per 15 minutes of the window.
    names = [r.name for r in listed.select(F.element_at(F.split("url", "/"), -1).alias("name")).collect()]
    return landed_files(spark, names, landed)


def ingest_window(spark, manifest, landed, code_paths, root, now, hours=168):
    """Ingest of the last `hours` as the manifest lists them, from archives that have landed."""
    return ingest(spark, window_files(spark, manifest, landed, "export", now, hours), code_paths, root)


def read_gkg_window(spark, manifest, landed, now, hours=168):
    """Knowledge-graph rows of the last `hours` as the manifest lists them, from landed archives."""
    files = window_files(spark, manifest, landed, "gkg", now, hours)
    if not files:
        raise ValueError(f"no knowledge-graph archive of the window in {landed}")
    return read_zipped_gkg(spark, files)


def ingest_checked_window(spark, manifest, landed, code_paths, root, now, hours=168):
    """As `ingest_window`, but only of archives whose size and MD5 the manifest confirms.

    Returns the check, a row (name, state) per listed file; files that have not landed, or not
    whole, are left for a later call.
    """
    check = feed_check(spark, manifest, landed, "export", now, hours)
    path = scratch_path(spark, "feed-check")
    check.write.parquet(path)
    check = spark.read.parquet(path)
    sound = [f"{landed.rstrip('/')}/{r.name}" for r in check.where("state = 'sound'").select("name").collect()]
    if sound:
        ingest(spark, sound, code_paths, root)
    return check
