
from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable
from datetime import date, datetime
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newslens import adapter  # noqa: E402
from newslens.operators.clean import clean_events as clean  # noqa: E402
from newslens.operators.countries import (  # noqa: E402
    country_names,
    events_by_time_and_country,
    events_per_country as country_totals,
    place_counts,
    tone_by_country as country_tones,
    tone_extremes as extremes,
)
from newslens.operators.enrich import enrich_events as enrich  # noqa: E402
from newslens.operators.search import (  # noqa: E402
    SEARCH_COLUMNS,
    SearchSpec,
    available_dates as dates_of,
    display_columns,
    map_points as points_of,
    search_events as search,
    search_kpis as kpis_of_search,
    top_events as most_covered,
)
from newslens.operators.spikes import (  # noqa: E402
    country_event_spike as detect_spikes,
    day_ranks as ranks_of_days,
    flagged_spikes as flagged,
    spike_kpis as kpis_of_spikes,
    spike_report as report_of,
    spike_top,
)
from newslens.operators.stories import (  # noqa: E402
    STORY_KEYS,
    impact_ranking as rank_impact,
    story_groups as group_stories,
    story_totals,
    story_urls,
)
from newslens.plans.analysis import clear, run_analysis, run_story_analysis  # noqa: E402
from newslens.plans.dashboard import country_insights, search_stored  # noqa: E402
from newslens.plans.ingest import (  # noqa: E402
    ingest,
    ingest_checked_window,
    ingest_window,
    read_gkg_window,
    read_quarantine,
)
from newslens.schemas import CLEAN_COLUMNS, RAW_EVENT, RAW_GKG, fields  # noqa: E402
from newslens.session import scratch_path, use_compiled_methods, use_utc  # noqa: E402
from newslens.sinks.export import export_csv, read_export  # noqa: E402
from newslens.sinks.tables import write_events, write_summary  # noqa: E402
from newslens.sources.archives import read_zipped_events  # noqa: E402
from newslens.sources.codes import read_event_codes  # noqa: E402
from newslens.sources.delimited import read_raw_events, read_raw_gkg  # noqa: E402
from newslens.sources.manifest import feed_check as check_feed, select_feed_files as feed_window  # noqa: E402
from newslens.sources.tables import read_events, read_table, summary_head  # noqa: E402
from newslens.streaming.arrivals import append_arrivals, compact_arrivals  # noqa: E402



def _corpus_queries():
    """Queries and SQL of the corpus operators; none where that subpackage cannot be imported."""
    try:
        module = importlib.import_module("newslens.llm.queries")
    except ImportError:
        return {}, {}
    registered = dict(module.QUERIES)
    try:
        registered["pipeline"] = importlib.import_module("corpus_pipeline").run
    except ImportError:
        pass
    return registered, dict(module.ORACLE_SQL)


CORPUS_QUERIES, CORPUS_SQL = _corpus_queries()

# Parameters of the queries; the library's defaults are sized for the live feed.
BASELINE_DAYS = 7
MIN_BASELINE = 10.0
TOP_EVENTS = 100
MAP_DAY = date(2024, 1, 28)
NOW = datetime(2024, 1, 31)
DATE_HOURS = 200
FEED_HOURS = 48
MAX_URLS = 3
SPEC = SearchSpec(
    country="nation_1", date_min=date(2024, 1, 3), date_max=date(2024, 1, 28),
    goldstein_min=-8.0, tone_min=-9.0, mentions_min=5, limit=50,
)
SPIKES = dict(baseline_days=BASELINE_DAYS, spike_threshold=0.5)
ACTOR_SPEC = SearchSpec(
    actor1="CLICK|view", actor2="america", mentions_min=10, mentions_max=60, limit=200,
)
LITERAL_SPEC = SearchSpec(country="City1, NATION_1", literal=True, tone_max=5.0, limit=100)
RANGES_SPEC = SearchSpec(goldstein_min=-6.5, goldstein_max=7.0, tone_min=-9.5, tone_max=8.0, mentions_min=0, limit=300)
TOP_DEFAULT = 10_000
WINDOW_HOURS = 240


# ---------------------------------------------------------------------------------- inputs

def _g(spark, sf_dir):
    return adapter.news_events(use_compiled_methods(use_utc(spark)), sf_dir)


def _enriched(spark, sf_dir):
    return enrich(_g(spark, sf_dir), adapter.event_codes(spark))


def _published(query):
    """The query with event_date as TIMESTAMP_NTZ, which reads the same in every client zone."""

    @wraps(query)
    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        if "event_date" in df.columns:
            df = df.withColumn("event_date", F.col("event_date").cast("timestamp_ntz"))
        return df

    return run


def _measures_as_double(df):
    return df.withColumn("goldstein_scale", F.col("goldstein_scale").cast("double")).withColumn(
        "avg_tone", F.col("avg_tone").cast("double")
    )


def _urls_as_text(stories):
    return stories.withColumn("sample_urls", F.array_join("sample_urls", " "))


# ---------------------------------------------------------------------------------- queries

def country_event_spike(spark, sf_dir):
    return detect_spikes(_g(spark, sf_dir), min_baseline=MIN_BASELINE, **SPIKES)


def spike_all_countries(spark, sf_dir):
    return detect_spikes(_g(spark, sf_dir), min_baseline=-1.0, **SPIKES)


def spike_report(spark, sf_dir):
    return report_of(country_event_spike(spark, sf_dir), only_spikes=True, limit=50)


def spike_top20(spark, sf_dir):
    return spike_top(country_event_spike(spark, sf_dir), 20)


def spike_kpis(spark, sf_dir):
    return kpis_of_spikes(report_of(country_event_spike(spark, sf_dir), limit=50))


def flagged_spikes(spark, sf_dir):
    return flagged(report_of(country_event_spike(spark, sf_dir), limit=50))


def day_ranks(spark, sf_dir):
    ranks = ranks_of_days(_g(spark, sf_dir))
    return ranks.select(F.col("event_ts").alias("event_date"), "day_rank")


def events_by_day_country(spark, sf_dir):
    counts = events_by_time_and_country(_g(spark, sf_dir))
    return counts.select("ActionGeo_CountryCode", "event_date", "total_events")


def events_per_country(spark, sf_dir):
    return country_totals(place_counts(_g(spark, sf_dir)))


def country_totals_top15(spark, sf_dir):
    path = scratch_path(spark, "totals")
    write_summary(events_per_country(spark, sf_dir), path, "events_per_country")
    return summary_head(spark, path, "events_per_country", 15)


def tone_by_country(spark, sf_dir):
    return country_tones(place_counts(_g(spark, sf_dir)))


def tone_extremes(spark, sf_dir):
    return extremes(tone_by_country(spark, sf_dir), 10)


def mode_place(spark, sf_dir):
    return country_names(place_counts(_g(spark, sf_dir)))


def _top(spark, sf_dir):
    return most_covered(_g(spark, sf_dir), TOP_EVENTS)


def top_events(spark, sf_dir):
    return _top(spark, sf_dir).select(
        "GLOBALEVENTID", "event_date", "ActionGeo_CountryCode", "num_articles", "lat", "lon"
    )


def map_points(spark, sf_dir):
    return points_of(_top(spark, sf_dir), MAP_DAY, 1000)


def available_dates(spark, sf_dir):
    return dates_of(_top(spark, sf_dir), NOW, DATE_HOURS)


def search_events(spark, sf_dir):
    return search(_enriched(spark, sf_dir), SPEC)


def search_kpis(spark, sf_dir):
    return kpis_of_search(search_events(spark, sf_dir))


def search_export(spark, sf_dir):
    shown = display_columns(search_events(spark, sf_dir))
    path = scratch_path(spark, "search-export")
    export_csv(shown, path)
    return read_export(spark, path, shown.schema)


def spike_export(spark, sf_dir):
    report = report_of(country_event_spike(spark, sf_dir), limit=50)
    path = scratch_path(spark, "spike-export")
    export_csv(report, path)
    return read_export(spark, path, report.schema)


def story_groups(spark, sf_dir):
    return _urls_as_text(group_stories(_enriched(spark, sf_dir)))


def story_sample_urls(spark, sf_dir):
    return story_urls(_enriched(spark, sf_dir), MAX_URLS)


def impact_ranking(spark, sf_dir):
    ranked = rank_impact(story_totals(_enriched(spark, sf_dir)))
    return ranked.select(*STORY_KEYS, "avg_goldstein_scale", "total_articles", "impact_score")


def clean_events(spark, sf_dir):
    return _measures_as_double(clean(adapter.raw_events(_g(spark, sf_dir))))


def enrich_events(spark, sf_dir):
    return _enriched(spark, sf_dir)


def _landed_text(spark, lines, name):
    path = scratch_path(spark, name)
    lines.write.text(path)
    return path


def _event_lines(spark, sf_dir):
    return adapter.tsv_lines(adapter.raw_events(_g(spark, sf_dir)))


def scan_events_tsv(spark, sf_dir):
    """Every column of the scan; the dates as they stand in the file."""
    return read_raw_events(spark, _landed_text(spark, _event_lines(spark, sf_dir), "events-tsv"))


def scan_zipped_events(spark, sf_dir):
    """Every column of the scan, from zip archives."""
    folder = scratch_path(spark, "events-zip")
    adapter.land_archives(adapter.archives(_event_lines(spark, sf_dir)), folder)
    return read_zipped_events(spark, folder)


def scan_gkg_tsv(spark, sf_dir):
    documents = use_utc(spark).read.parquet(f"{sf_dir}/documents.parquet")
    path = _landed_text(spark, adapter.tsv_lines(adapter.raw_gkg(documents)), "gkg-tsv")
    return read_raw_gkg(spark, path)


def scan_gkg_window(spark, sf_dir):
    """Every column of the knowledge-graph archives that the manifest lists for the window."""
    folder = scratch_path(spark, "gkg-zip")
    documents = use_utc(spark).read.parquet(f"{sf_dir}/documents.parquet")
    adapter.land_archives(adapter.hourly_gkg_archives(documents), folder)
    manifest = _landed_text(spark, adapter.manifest_lines(spark, sf_dir), "manifest")
    return read_gkg_window(spark, manifest, folder, NOW, WINDOW_HOURS)


def load_event_codes(spark, sf_dir):
    """A lookup text with one code per customer, uneven white space, and a header in each file."""
    customer = use_utc(spark).read.parquet(f"{sf_dir}/customer.parquet")
    line = F.concat(
        F.lpad(F.col("c_custkey").cast("string"), 12, "0"),
        F.lit("\t "),
        F.regexp_replace("c_name", "#", "   number  "),
    )
    path = scratch_path(spark, "codes")
    customer.select(line.alias("CODE DESCRIPTION")).write.options(
        header="true", sep="\u0001", quote=""
    ).csv(path)
    return read_event_codes(spark, path)


def select_feed_files(spark, sf_dir):
    lines = adapter.manifest_lines(use_utc(spark), sf_dir)
    path = _landed_text(spark, lines, "manifest")
    files = feed_window(spark, path, "export", NOW, FEED_HOURS)
    return files.select("url", F.col("file_time").cast("timestamp_ntz").alias("file_time"))


def _landed_codes(spark):
    codes = scratch_path(spark, "feed-codes")
    adapter.event_codes(spark).select(
        F.concat_ws(" ", "EventCode", "EventDescription").alias("CODE DESCRIPTION")
    ).write.options(header="true", sep="\u0001", quote="").csv(codes)
    return codes


def _stored(spark, root):
    stored = _measures_as_double(read_events(spark, root))
    return stored.select(*CLEAN_COLUMNS, "EventDescription")


def events_table_rerun(spark, sf_dir):
    """The events table after the same landed feed was ingested twice."""
    feed = _landed_text(spark, _event_lines(spark, sf_dir), "feed")
    root = scratch_path(spark, "tables")
    for _ in range(2):
        ingest(spark, feed, _landed_codes(spark), root)
    return _stored(spark, root)


def _updated_tables(spark, sf_dir, after_each=lambda root: None):
    """Tables after two feeds, of which the second repeats, changes and moves events to another day."""
    raw = adapter.raw_events(_g(spark, sf_dir))
    moved = raw.where("GLOBALEVENTID % 5 < 2").withColumns({
        "SQLDATE": F.expr("IF(GLOBALEVENTID % 5 = 0, 20240229, SQLDATE)"),
        "MonthYear": F.expr("IF(GLOBALEVENTID % 5 = 0, 202402, MonthYear)"),
        "NumMentions": F.expr("IF(GLOBALEVENTID % 10 < 5, 500, NumMentions)"),
    })
    root, codes = scratch_path(spark, "tables"), _landed_codes(spark)
    for name, rows in (("first", raw.where("GLOBALEVENTID % 7 > 0")), ("second", moved)):
        ingest(spark, _landed_text(spark, adapter.tsv_lines(rows), name), codes, root)
        after_each(root)
    return root


def events_table_update(spark, sf_dir):
    """The events table after a second feed that repeats, changes and moves events to another day."""
    return _stored(spark, _updated_tables(spark, sf_dir))


def ingest_zipped_window(spark, sf_dir):
    """The events table from those landed archives, one per hour, that the manifest window lists."""
    folder = scratch_path(spark, "landed")
    adapter.land_archives(adapter.hourly_archives(_g(spark, sf_dir), spark, sf_dir), folder)
    manifest = _landed_text(spark, adapter.manifest_lines(use_utc(spark), sf_dir), "manifest")
    root = scratch_path(spark, "tables")
    ingest_window(spark, manifest, folder, _landed_codes(spark), root, NOW, WINDOW_HOURS)
    return _stored(spark, root)


def stream_events(spark, sf_dir):
    """The events table after a stream of feed files that repeat a third of the events each."""
    folder, root, state = (scratch_path(spark, name) for name in ("stream", "tables", "state"))
    raw = adapter.raw_events(_g(spark, sf_dir))
    # By the id and not by the text, which would be put together again for each comparison.
    number = F.pmod(F.coalesce("GLOBALEVENTID", F.lit(0)), F.lit(3))
    codes = _landed_codes(spark)
    for part in range(3):
        # Of each file the next one repeats a part; the last repeats the first.
        repeated = raw.where(number.isin(part, (part + 1) % 3))
        adapter.tsv_lines(repeated).write.mode("append").text(folder)
        append_arrivals(spark, folder, root, state, max_files=3).awaitTermination()
        if part:
            compact_arrivals(spark, codes, root)
    return _stored(spark, root)


def _damaged_tables(spark, sf_dir):
    lines = adapter.damaged_lines(adapter.raw_events(_g(spark, sf_dir)))
    root, feed = scratch_path(spark, "tables"), _landed_text(spark, lines, "damaged")
    for _ in range(2):
        ingest(spark, feed, _landed_codes(spark), root)
    return root


def quarantined_rows(spark, sf_dir):
    """Dropped and damaged rows of a feed that was ingested twice, with the reason and their fields."""
    rows = read_quarantine(spark, _damaged_tables(spark, sf_dir))
    return rows.select("GLOBALEVENTID", "reason", "dropped", F.size(F.split("line", "\t")).alias("n_fields"))


def events_table_damaged(spark, sf_dir):
    """The events of the same feed: what could be read, without rows that have no day."""
    return _stored(spark, _damaged_tables(spark, sf_dir))


def _checked_feed(spark, sf_dir):
    """(manifest, folder): landed archives of which some are cut off, altered or missing."""
    whole, folder = scratch_path(spark, "published"), scratch_path(spark, "landed")
    adapter.land_archives(adapter.hourly_archives(_g(spark, sf_dir), spark, sf_dir), whole)
    files = spark.read.format("binaryFile").load(whole).select(
        F.element_at(F.split("path", "/"), -1).alias("path"), "length", "content",
        F.substring(F.element_at(F.split("path", "/"), -1), 9, 2).cast("int").alias("hour"),
    )
    manifest = _landed_text(spark, files.select(F.concat_ws(
        " ", F.col("length").cast("string"), F.md5("content"), F.concat(F.lit("http://feed.example/v2/"), "path")
    ).alias("value")), "manifest")
    damaged = files.where("hour % 7 != 2").selectExpr(
        "path", "CASE hour % 7 WHEN 0 THEN substring(content, 1, length - 10) "
        "WHEN 1 THEN concat(substring(content, 1, length - 1), X'7F') ELSE content END AS content",
    )
    adapter.land_archives(damaged, folder)
    return manifest, folder


def feed_check(spark, sf_dir):
    """The state of each archive of the window, of which some are cut off, altered or missing."""
    manifest, folder = _checked_feed(spark, sf_dir)
    return check_feed(spark, manifest, folder, "export", NOW, WINDOW_HOURS)


def ingest_checked(spark, sf_dir):
    """The events table from the sound archives of the same window."""
    manifest, folder = _checked_feed(spark, sf_dir)
    root = scratch_path(spark, "tables")
    ingest_checked_window(spark, manifest, folder, _landed_codes(spark), root, NOW, WINDOW_HOURS)
    return _stored(spark, root)


def top_events_default(spark, sf_dir):
    """The library's default of 10,000 events, with heavy ties, over each event four times."""
    each = F.explode(F.expr("sequence(0, 3)")).alias("copy")
    events = _g(spark, sf_dir).select("*", each)
    events = events.withColumn("GLOBALEVENTID", F.expr("GLOBALEVENTID * 4 + copy")).drop("copy")
    return most_covered(events, TOP_DEFAULT).select("GLOBALEVENTID", "num_articles", "lat", "lon")


def search_actors(spark, sf_dir):
    """Search of both actors with a mention range, over the stored table."""
    root = scratch_path(spark, "tables")
    write_events(_enriched(spark, sf_dir), root)
    return _measures_as_double(search_stored(spark, root, ACTOR_SPEC))


def search_page(spark, sf_dir):
    """A stored search with its totals and its table as displayed: each shown row with the totals."""
    root = scratch_path(spark, "tables")
    write_events(_enriched(spark, sf_dir), root)
    page = country_insights(spark, root, SPEC)
    kpis = page["kpis"].withColumnRenamed("avg_tone", "mean_tone")
    # One row of totals.
    return _measures_as_double(page["display"]).join(kpis)


def search_missing_measures(spark, sf_dir):
    """A search by number ranges over events of which many have no measure; those never pass."""
    gaps = {"num_mentions": 3, "goldstein_scale": 4, "avg_tone": 5}
    events = _enriched(spark, sf_dir).withColumns({
        name: F.expr(f"IF(GLOBALEVENTID % {n} = 0, NULL, {name})") for name, n in gaps.items()
    })
    return search(events, RANGES_SPEC)


def root_and_added(spark, sf_dir):
    """Root flag and day of addition of every raw event; some have no flag, some no real day."""
    raw = adapter.raw_events(_g(spark, sf_dir)).withColumns({
        "IsRootEvent": F.expr("IF(GLOBALEVENTID % 3 = 2, NULL, CAST(GLOBALEVENTID % 3 AS INT))"),
        "DATEADDED": F.expr("IF(GLOBALEVENTID % 7 = 0, 20240230120000, DATEADDED + 123456)"),
    })
    rows = clean(raw, extra=["is_root_event", "date_added"])
    return rows.select("GLOBALEVENTID", "is_root_event", F.col("date_added").cast("timestamp_ntz").alias("date_added"))


def cleared_summaries(spark, sf_dir):
    """Rows of each stored table before and after the summaries are emptied."""
    root = scratch_path(spark, "analysis")
    write_events(_enriched(spark, sf_dir), root)
    run_analysis(spark, root, BASELINE_DAYS * 24, TOP_EVENTS, MIN_BASELINE)
    names = ["events", "top_events", "events_per_country", "events_by_time_and_country"]

    def counted(state):
        rows = [
            read_table(spark, root, name).agg(
                F.lit(name).alias("table_name"), F.lit(state).alias("state"), F.count("*").alias("n_rows")
            )
            for name in names
        ]
        path = scratch_path(spark, "counted")
        reduce(DataFrame.unionByName, rows).write.parquet(path)
        return spark.read.parquet(path)

    before = counted("before")
    clear(spark, root, events_too=False)
    return before.unionByName(counted("after"))


def search_literal(spark, sf_dir):
    return search(_enriched(spark, sf_dir), LITERAL_SPEC)


def stored_impact(spark, sf_dir):
    """The stored impact ranking of the story analysis."""
    root = scratch_path(spark, "stories")
    write_events(_enriched(spark, sf_dir), root)
    run_story_analysis(spark, root)
    ranked = read_table(spark, root, "top_impact_events")
    return ranked.select(*STORY_KEYS, "avg_goldstein_scale", "total_articles", "impact_score")


def _stored_summaries(spark, root):
    """Every row of the tables that the analysis stores, as (table_name, name, day, n, value)."""
    text, whole, value = (lambda c, kind=kind: F.expr(f"CAST({c} AS {kind})") for kind in ("STRING", "BIGINT", "DOUBLE"))
    shapes = {
        "top_events": ("GLOBALEVENTID", "event_date", "num_articles", "lat + 1000 * lon"),
        "events_per_country": ("Country_Name", "NULL", "Total_Events", "NULL"),
        "tone_by_country": ("Country_Name", "NULL", "NULL", "Average_Tone"),
        "country_event_spike": ("ActionGeo_CountryCode", "NULL", "spike_events + baseline_events", "spike_score"),
        "events_by_time_and_country": ("ActionGeo_CountryCode", "event_date", "total_events", "NULL"),
    }
    rows = [
        read_table(spark, root, table).select(
            F.lit(table).alias("table_name"), text(name).alias("name"),
            F.date_format(F.expr(f"CAST({day} AS DATE)"), "yyyy-MM-dd").alias("day"), whole(n).alias("n"), value(x).alias("value"),
        )
        for table, (name, day, n, x) in shapes.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def analysis_job(spark, sf_dir):
    """Every row of the summaries that the analysis stores."""
    root = scratch_path(spark, "analysis")
    write_events(_enriched(spark, sf_dir), root)
    run_analysis(spark, root, BASELINE_DAYS * 24, TOP_EVENTS, MIN_BASELINE)
    return _stored_summaries(spark, root)


def analysis_incremental(spark, sf_dir):
    """The summaries after a second feed that adds, changes and moves events, and a second analysis."""
    root = _updated_tables(
        spark, sf_dir, lambda root: run_analysis(spark, root, BASELINE_DAYS * 24, TOP_EVENTS, MIN_BASELINE)
    )
    return _stored_summaries(spark, root)


QUERIES = [
    country_event_spike, spike_all_countries, spike_report, spike_top20, spike_kpis,
    flagged_spikes, day_ranks, events_by_day_country, events_per_country, country_totals_top15,
    tone_by_country, tone_extremes, mode_place, top_events, map_points, available_dates,
    search_events, search_kpis, search_export, spike_export, story_groups, story_sample_urls,
    impact_ranking, clean_events, enrich_events, scan_events_tsv, scan_zipped_events,
    scan_gkg_tsv, load_event_codes, select_feed_files, events_table_rerun,
    analysis_job, events_table_update, ingest_zipped_window, top_events_default, search_actors,
    search_literal, stored_impact, analysis_incremental, search_page,
    scan_gkg_window, search_missing_measures, root_and_added, cleared_summaries, stream_events, quarantined_rows, events_table_damaged, feed_check, ingest_checked,
]


def entry(spark: SparkSession) -> DataFrame:
    """Spike detection at the smallest scale, where country-days hold only a few events."""
    events = _g(spark, "/root/testdata/sf0.001")
    return detect_spikes(events, min_baseline=0.0, **SPIKES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: _published(query) for query in QUERIES} | CORPUS_QUERIES


# ------------------------------------------------------------------------------ oracle SQL

_G = """
base AS (
  SELECT e.event_id, e.event_type, e.user_id,
         CAST(CAST(e.ts AS DATE) AS TIMESTAMP) AS event_date,
         CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INT) AS k
  FROM events e),
g AS (
  SELECT b.event_id AS GLOBALEVENTID,
    b.event_date AS event_date,
    CAST(year(b.event_date) * 100 + month(b.event_date) AS VARCHAR) AS year_month,
    CASE WHEN b.event_id % 19 = 0 THEN NULL ELSE upper(b.event_type) END AS Actor1Name,
    CASE WHEN b.event_id % 19 = 0 THEN NULL ELSE substring(r.r_name, 1, 3) END AS Actor1CountryCode,
    CASE WHEN b.event_id % 2 = 0 THEN 'GOV' ELSE NULL END AS Actor1Type1Code,
    CASE WHEN b.event_id % 23 = 0 THEN NULL ELSE r.r_name END AS Actor2Name,
    CASE WHEN b.event_id % 23 = 0 THEN NULL ELSE substring(r.r_name, 1, 3) END AS Actor2CountryCode,
    CASE b.event_type WHEN 'click' THEN '010' WHEN 'view' THEN '020' WHEN 'signup' THEN '0311'
         WHEN 'purchase' THEN '057' ELSE '190' END AS EventCode,
    CASE b.event_type WHEN 'click' THEN '010' WHEN 'view' THEN '020' WHEN 'signup' THEN '031'
         WHEN 'purchase' THEN '057' ELSE '190' END AS EventBaseCode,
    CASE b.event_type WHEN 'click' THEN '01' WHEN 'view' THEN '02' WHEN 'signup' THEN '03'
         WHEN 'purchase' THEN '05' ELSE '19' END AS EventRootCode,
    CASE b.event_type WHEN 'click' THEN 1 WHEN 'view' THEN 1 WHEN 'signup' THEN 2
         WHEN 'purchase' THEN 2 ELSE 4 END AS QuadClass,
    CAST((b.k % 41 - 20) AS DOUBLE) / 2 AS goldstein_scale,
    CAST(((b.event_id * 7 + b.k) % 161 - 80) AS DOUBLE) / 8 AS avg_tone,
    b.k AS num_mentions,
    CAST((b.event_id * 13 + b.k) % 101 AS INT) AS num_articles,
    CAST(b.k % 10 + 1 AS INT) AS num_sources,
    CASE WHEN b.event_id % 17 = 0 THEN NULL
         ELSE concat('City', CAST(b.event_id % 3 AS VARCHAR), ', ', n.n_name) END
      AS ActionGeo_FullName,
    CASE WHEN b.event_id % 29 = 0 THEN NULL ELSE n.n_name END AS ActionGeo_CountryCode,
    CASE WHEN b.event_id % 11 = 0 THEN NULL ELSE CAST(b.event_id % 360 - 180 AS DOUBLE) END AS lon,
    CASE WHEN b.event_id % 13 = 0 THEN NULL ELSE CAST(b.event_id % 180 - 90 AS DOUBLE) END AS lat,
    concat('http://news.example/', CAST(b.event_id AS VARCHAR)) AS SOURCEURL
  FROM base b
  JOIN nation n ON n.n_nationkey = b.user_id % 25
  JOIN region r ON r.r_regionkey = n.n_regionkey)"""

_EN = (
    "codes AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{code}', '{text}')" for code, text in adapter.EVENT_CODES.items())
    + ") AS t(EventCode, EventDescription)),\n"
    "en AS (SELECT g.*, c.EventDescription FROM g JOIN codes c ON g.EventCode = c.EventCode)"
)

# The same names over the enriched rows, as the stored events table holds them.
_STORED = (
    _G.replace("\ng AS (", "\nclean AS (")
    + ",\n"
    + _EN.replace("en AS (SELECT g.*", "g AS (SELECT g.*").replace("FROM g JOIN", "FROM clean g JOIN")
)

_COUNTS = """
counts AS (
  SELECT ActionGeo_CountryCode, event_date, count(*) AS total_events FROM g
  WHERE ActionGeo_CountryCode IS NOT NULL AND event_date IS NOT NULL GROUP BY 1, 2),
ranks AS (
  SELECT event_date, dense_rank() OVER (ORDER BY event_date DESC) AS day_rank
  FROM (SELECT DISTINCT event_date FROM counts) d)"""


def _spikes(min_baseline):
    return f"""{_COUNTS},
sums AS (
  SELECT c.ActionGeo_CountryCode,
    CAST(sum(CASE WHEN r.day_rank = 2 THEN c.total_events ELSE 0 END) AS BIGINT) AS spike_events,
    CAST(sum(CASE WHEN r.day_rank BETWEEN 3 AND {2 + BASELINE_DAYS} THEN c.total_events ELSE 0 END)
      AS BIGINT) AS baseline_events,
    CAST(sum(CASE WHEN r.day_rank BETWEEN 3 AND {2 + BASELINE_DAYS} THEN 1 ELSE 0 END)
      AS BIGINT) AS baseline_days_count
  FROM counts c LEFT JOIN ranks r ON c.event_date = r.event_date GROUP BY 1),
averages AS (
  SELECT *, CASE WHEN baseline_days_count > 0
      THEN round(baseline_events / CAST(baseline_days_count AS DOUBLE), 4) ELSE 0.0 END
    AS avg_baseline_per_day FROM sums),
scores AS (
  SELECT *, CASE
      WHEN avg_baseline_per_day > 0
        THEN round((spike_events - avg_baseline_per_day) / avg_baseline_per_day, 4)
      WHEN spike_events > 0 THEN CAST(spike_events AS DOUBLE) ELSE 0.0 END AS spike_score
  FROM averages WHERE avg_baseline_per_day > {min_baseline}),
spikes AS (
  SELECT ActionGeo_CountryCode, spike_events, baseline_events, baseline_days_count,
    avg_baseline_per_day, spike_score, spike_score > 0.5 AS is_spike FROM scores)"""


def _mode(source, keys, value, name):
    """CTE `name` with the modal `value` per key: highest count, then smallest value."""
    cols = ", ".join(keys)
    return f"""{name} AS (
  SELECT {cols}, v FROM (
    SELECT {cols}, {value} AS v,
      row_number() OVER (PARTITION BY {cols} ORDER BY count(*) DESC, {value} ASC) AS rn
    FROM {source} WHERE {value} IS NOT NULL GROUP BY {cols}, {value}) t WHERE rn = 1)"""


_PLACES = (
    _mode("g", ["ActionGeo_CountryCode"], "ActionGeo_FullName", "place")
    + """,
names AS (
  SELECT c.ActionGeo_CountryCode, p.v AS Country_Name, c.n, c.tone FROM (
    SELECT ActionGeo_CountryCode, count(*) AS n, avg(avg_tone) AS tone FROM g GROUP BY 1) c
  LEFT JOIN place p ON c.ActionGeo_CountryCode IS NOT DISTINCT FROM p.ActionGeo_CountryCode),
totals AS (
  SELECT Country_Name, n AS Total_Events FROM names WHERE ActionGeo_CountryCode IS NOT NULL),
tones AS (
  SELECT Country_Name, tone AS Average_Tone FROM names WHERE Country_Name IS NOT NULL)"""
)

_TOP = f"""
top AS (
  SELECT * FROM g WHERE lat IS NOT NULL AND lon IS NOT NULL
  ORDER BY num_articles DESC NULLS LAST, GLOBALEVENTID LIMIT {TOP_EVENTS})"""

_FOUND = f"""
found AS (
  SELECT {", ".join(SEARCH_COLUMNS)} FROM en
  WHERE regexp_matches(ActionGeo_FullName, '{SPEC.country}', 'i')
    AND event_date >= DATE '{SPEC.date_min}' AND event_date <= DATE '{SPEC.date_max}'
    AND goldstein_scale BETWEEN {SPEC.goldstein_min} AND {SPEC.goldstein_max}
    AND avg_tone BETWEEN {SPEC.tone_min} AND {SPEC.tone_max}
    AND num_mentions >= {SPEC.mentions_min}
  ORDER BY num_articles DESC NULLS LAST, GLOBALEVENTID LIMIT {SPEC.limit})"""

_KEYS = ", ".join(STORY_KEYS)
_RANKED = f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {_KEYS}
    ORDER BY num_mentions DESC NULLS LAST, GLOBALEVENTID) AS url_rank
  FROM en WHERE ActionGeo_CountryCode IS NOT NULL)"""


def _stories():
    modes = {
        "top_location": "ActionGeo_FullName", "top_actor_1_name": "Actor1Name",
        "top_actor_2_name": "Actor2Name", "top_lon": "lon", "top_lat": "lat",
        "top_event_description": "EventDescription",
    }
    ctes = [_mode("ranked", STORY_KEYS, value, f"m_{name}") for name, value in modes.items()]
    joins = "\n".join(
        f"  LEFT JOIN m_{name} ON "
        + " AND ".join(f"a.{k} IS NOT DISTINCT FROM m_{name}.{k}" for k in STORY_KEYS)
        for name in modes
    )
    picked = ", ".join(f"m_{name}.v AS {name}" for name in modes)
    ctes = ",\n".join(ctes)
    return f"""{_RANKED},
{ctes},
agg AS (
  SELECT {_KEYS}, count(*) AS total_events,
    CAST(sum(num_mentions) AS BIGINT) AS total_mentions,
    CAST(sum(num_articles) AS BIGINT) AS total_articles,
    CAST(sum(num_sources) AS BIGINT) AS total_sources,
    avg(avg_tone) AS average_tone, avg(goldstein_scale) AS avg_goldstein_scale,
    coalesce(string_agg(CASE WHEN url_rank <= 20 THEN SOURCEURL END, ' ' ORDER BY url_rank), '')
      AS sample_urls
  FROM ranked GROUP BY {_KEYS} HAVING sum(num_sources) > 20),
stories AS (
  SELECT a.{", a.".join(STORY_KEYS)}, a.total_events, a.total_mentions, a.total_articles,
    a.total_sources, a.average_tone, a.avg_goldstein_scale, {picked}, a.sample_urls
  FROM agg a
{joins})"""


def _with(*parts):
    *ctes, body = parts
    return "WITH " + ",\n".join(cte.strip() for cte in ctes) + "\n" + body


# Raw feed columns as SQL over the cleaned events, where they differ from the cleaned column.
_RAW = adapter.FILLERS | {
    "SQLDATE": "strftime(event_date, '%Y%m%d')", "MonthYear": "year_month", "Year": "year(event_date)",
    "IsRootEvent": "1", "GoldsteinScale": "goldstein_scale", "AvgTone": "avg_tone",
    "NumMentions": "num_mentions", "NumArticles": "num_articles", "NumSources": "num_sources",
    "ActionGeo_Long": "lon", "ActionGeo_Lat": "lat",
    "DATEADDED": "concat(strftime(event_date, '%Y%m%d'), '000000')",
}
_GKG = adapter.GKG_FILLERS | {
    "GKGRECORDID": "doc_id", "SOURCECOLLECTIONIDENTIFIER": "1", "SOURCECOMMONNAME": "source",
    "DOCUMENTIDENTIFIER": "concat('http://docs.example/', CAST(doc_id AS VARCHAR))",
    "V2EXTRASXML": "nullif(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g'), '')",
}


def _raw_sql(name, kind):
    kind = {"STRING": "VARCHAR"}.get(kind, kind)
    return f"CAST({_RAW.get(name, name)} AS {kind})"


# Every row of the stored summaries.
_SUMMARIES = """
SELECT 'top_events' AS table_name, CAST(GLOBALEVENTID AS VARCHAR) AS name, strftime(event_date, '%Y-%m-%d') AS day,
  CAST(num_articles AS BIGINT) AS n, CAST(lat + 1000 * lon AS DOUBLE) AS value FROM top
UNION ALL SELECT 'events_per_country', Country_Name, NULL, Total_Events, NULL FROM totals
UNION ALL SELECT 'tone_by_country', Country_Name, NULL, NULL, Average_Tone FROM tones
UNION ALL SELECT 'country_event_spike', ActionGeo_CountryCode, NULL, spike_events + baseline_events, spike_score FROM spikes
UNION ALL SELECT 'events_by_time_and_country', ActionGeo_CountryCode, strftime(event_date, '%Y-%m-%d'), total_events, NULL
FROM counts"""

_UPDATED = """
updated AS (
  SELECT * REPLACE (
    CASE WHEN GLOBALEVENTID % 5 = 0 THEN TIMESTAMP '2024-02-29' ELSE event_date END AS event_date,
    CASE WHEN GLOBALEVENTID % 5 = 0 THEN '202402' ELSE year_month END AS year_month,
    CASE WHEN GLOBALEVENTID % 5 < 2 AND GLOBALEVENTID % 10 < 5 THEN 500 ELSE num_mentions END AS num_mentions)
  FROM en WHERE GLOBALEVENTID % 7 > 0 OR GLOBALEVENTID % 5 < 2)"""


# The damaged feed: rows without a day are gone, cut-off rows keep their first fields.
_CUT = adapter.CUT
_KEPT_OF_CUT = [name for name, _ in fields(RAW_EVENT)][: adapter.CUT_FIELDS] + ["event_date", "year_month"]
_DAMAGED = (
    _G.replace("\ng AS (", "\nsound AS (") + ",\ng AS (\n  SELECT "
    + ", ".join(
        c if c == "GLOBALEVENTID" else
        f"CASE WHEN GLOBALEVENTID % 43 = 0 THEN '\"' || Actor1Name ELSE Actor1Name END AS {c}" if c == "Actor1Name" else
        f"CASE WHEN {_CUT} OR GLOBALEVENTID % 47 = 0 THEN NULL ELSE {c} END AS {c}" if c == "num_mentions" else
        c if c in _KEPT_OF_CUT else f"CASE WHEN NOT ({_CUT}) THEN {c} END AS {c}"
        for c in CLEAN_COLUMNS
    )
    + " FROM sound WHERE GLOBALEVENTID % 31 > 0 AND GLOBALEVENTID % 37 > 0)"
)
_QUARANTINED = f"""
SELECT GLOBALEVENTID, CASE WHEN {_CUT} THEN 'number of fields' WHEN GLOBALEVENTID % 47 = 0 THEN 'unreadable field'
    WHEN GLOBALEVENTID % 37 = 0 THEN 'no day' ELSE 'no calendar day' END AS reason,
  GLOBALEVENTID % 31 = 0 OR GLOBALEVENTID % 37 = 0 AS dropped,
  CAST(CASE WHEN {_CUT} THEN {adapter.CUT_FIELDS} ELSE 61 END AS INT) AS n_fields
FROM g WHERE {_CUT} OR GLOBALEVENTID % 47 = 0 OR GLOBALEVENTID % 37 = 0 OR GLOBALEVENTID % 31 = 0"""


def _search_sql(spec, *texts):
    where = " AND ".join([
        *texts,
        f"goldstein_scale BETWEEN {spec.goldstein_min} AND {spec.goldstein_max}",
        f"avg_tone BETWEEN {spec.tone_min} AND {spec.tone_max}",
        f"num_mentions BETWEEN {spec.mentions_min} AND {spec.mentions_max or 2**31 - 1}",
    ])
    return (
        f"SELECT {', '.join(SEARCH_COLUMNS)} FROM en WHERE {where} "
        f"ORDER BY num_articles DESC NULLS LAST, GLOBALEVENTID LIMIT {spec.limit}"
    )


def oracle_sql() -> dict[str, str]:
    spikes = _spikes(MIN_BASELINE)
    extremes_of = """
SELECT 'most_positive' AS polarity, Country_Name, Average_Tone FROM (
  SELECT * FROM tones ORDER BY Average_Tone DESC NULLS LAST, Country_Name NULLS FIRST LIMIT 10) p
UNION ALL
SELECT 'most_negative' AS polarity, Country_Name, Average_Tone FROM (
  SELECT * FROM tones ORDER BY Average_Tone ASC NULLS FIRST, Country_Name NULLS FIRST LIMIT 10) n"""
    scan = "SELECT " + ", ".join(
        f'{_raw_sql(name, kind)} AS "{name}"' for name, kind in fields(RAW_EVENT)
    ) + " FROM g"
    scan_gkg = "SELECT " + ", ".join(
        f'CAST({_GKG.get(name, "NULL")} AS {"INT" if kind == "INT" else "VARCHAR"}) AS "{name}"'
        for name, kind in fields(RAW_GKG)
    ) + " FROM documents"
    report = "SELECT * FROM spikes ORDER BY spike_score DESC, ActionGeo_CountryCode LIMIT 50"
    shown = ", ".join(
        ["event_date", "ActionGeo_FullName", "Actor1Name", "Actor2Name", "EventDescription",
         "QuadClass", "num_mentions", "num_articles", "goldstein_scale", "avg_tone", "SOURCEURL"]
    )
    return CORPUS_SQL | {
        "country_event_spike": _with(_G, spikes, "SELECT * FROM spikes"),
        "spike_all_countries": _with(_G, _spikes(-1.0), "SELECT * FROM spikes"),
        "spike_report": _with(
            _G, spikes,
            "SELECT * FROM spikes WHERE is_spike "
            "ORDER BY spike_score DESC, ActionGeo_CountryCode LIMIT 50",
        ),
        "spike_top20": _with(
            _G, spikes,
            "SELECT ActionGeo_CountryCode, spike_score FROM spikes "
            "ORDER BY spike_score DESC, ActionGeo_CountryCode LIMIT 20",
        ),
        "spike_kpis": _with(
            _G, spikes,
            "SELECT count(*) AS countries, count(*) FILTER (WHERE is_spike) AS flagged "
            f"FROM ({report}) r",
        ),
        "flagged_spikes": _with(
            _G, spikes,
            "SELECT ActionGeo_CountryCode, spike_events, avg_baseline_per_day, spike_score, "
            f"baseline_events, baseline_days_count FROM ({report}) r WHERE is_spike",
        ),
        "day_ranks": _with(
            _G, _COUNTS, "SELECT event_date, CAST(day_rank AS INT) AS day_rank FROM ranks"
        ),
        "events_by_day_country": _with(
            _G, _COUNTS, "SELECT ActionGeo_CountryCode, event_date, total_events FROM counts"
        ),
        "events_per_country": _with(_G, _PLACES, "SELECT * FROM totals"),
        "country_totals_top15": _with(
            _G, _PLACES,
            "SELECT * FROM totals "
            "ORDER BY Total_Events DESC NULLS LAST, Country_Name NULLS FIRST LIMIT 15",
        ),
        "tone_by_country": _with(_G, _PLACES, "SELECT * FROM tones"),
        "tone_extremes": _with(_G, _PLACES, extremes_of),
        "mode_place": _with(_G, _PLACES, "SELECT ActionGeo_CountryCode, Country_Name FROM names"),
        "top_events": _with(
            _G, _TOP,
            "SELECT GLOBALEVENTID, event_date, ActionGeo_CountryCode, num_articles, lat, lon "
            "FROM top",
        ),
        "map_points": _with(
            _G, _TOP,
            f"SELECT lon, lat FROM top WHERE event_date = DATE '{MAP_DAY}' "
            "ORDER BY num_articles DESC NULLS LAST, GLOBALEVENTID LIMIT 1000",
        ),
        "available_dates": _with(
            _G, _TOP,
            "SELECT DISTINCT event_date, strftime(event_date, '%b %d, %Y') AS label FROM top "
            f"WHERE event_date >= TIMESTAMP '{NOW}' - INTERVAL {DATE_HOURS} HOUR",
        ),
        "search_events": _with(_G, _EN, _FOUND, "SELECT * FROM found"),
        "search_kpis": _with(
            _G, _EN, _FOUND,
            "SELECT count(*) AS n, CAST(sum(num_mentions) AS BIGINT) AS total_mentions, "
            "CAST(sum(num_articles) AS BIGINT) AS total_articles, "
            "avg(goldstein_scale) AS avg_goldstein, avg(avg_tone) AS avg_tone FROM found",
        ),
        "search_export": _with(_G, _EN, _FOUND, f"SELECT {shown} FROM found"),
        "spike_export": _with(_G, spikes, report),
        "story_groups": _with(_G, _EN, _stories(), "SELECT * FROM stories"),
        "story_sample_urls": _with(
            _G, _EN, _RANKED,
            f"SELECT {_KEYS}, CAST(url_rank AS INT) AS url_rank, SOURCEURL FROM ranked "
            f"WHERE url_rank <= {MAX_URLS}",
        ),
        "impact_ranking": _with(
            _G, _EN, _stories(),
            f"SELECT {_KEYS}, avg_goldstein_scale, total_articles, "
            "avg_goldstein_scale * total_articles AS impact_score FROM stories",
        ),
        "clean_events": _with(_G, "SELECT * FROM g"),
        "enrich_events": _with(_G, _EN, "SELECT * FROM en"),
        "scan_events_tsv": _with(_G, scan),
        "scan_zipped_events": _with(_G, scan),
        "scan_gkg_tsv": scan_gkg,
        "scan_gkg_window": f"{scan_gkg} WHERE TIMESTAMP '2024-01-01' + to_hours(doc_id % 720) "
        f"> TIMESTAMP '{NOW}' - INTERVAL {WINDOW_HOURS + 3} HOUR "
        "AND TIMESTAMP '2024-01-01' + to_hours(doc_id % 720) IN (SELECT date_trunc('hour', ts) FROM events)",
        "load_event_codes": "SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS EventCode, "
        "replace(c_name, '#', ' number ') AS EventDescription FROM customer",
        "select_feed_files": "WITH hours AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events) "
        "SELECT concat('http://feed.example/v2/', strftime(h, '%Y%m%d%H%M%S'), '.export.CSV.zip') "
        "AS url, CAST(h AS TIMESTAMP) AS file_time FROM hours "
        f"WHERE h > TIMESTAMP '{NOW}' - INTERVAL {FEED_HOURS + 3} HOUR",
        "events_table_rerun": _with(_G, _EN, "SELECT * FROM en"),
        "events_table_update": _with(_G, _EN, _UPDATED, "SELECT * FROM updated"),
        "ingest_zipped_window": _with(
            _G, _EN,
            "SELECT en.* FROM en JOIN events ON event_id = GLOBALEVENTID "
            f"WHERE date_trunc('hour', ts) > TIMESTAMP '{NOW}' - INTERVAL {WINDOW_HOURS + 3} HOUR",
        ),
        "search_missing_measures": _with(
            _G, _EN.replace("\nen AS (", "\nwhole AS ("),
            "en AS (SELECT * REPLACE (CASE WHEN GLOBALEVENTID % 3 > 0 THEN num_mentions END AS num_mentions, "
            "CASE WHEN GLOBALEVENTID % 4 > 0 THEN goldstein_scale END AS goldstein_scale, "
            "CASE WHEN GLOBALEVENTID % 5 > 0 THEN avg_tone END AS avg_tone) FROM whole)",
            _search_sql(RANGES_SPEC, "true"),
        ),
        "root_and_added": _with(
            _G,
            "SELECT GLOBALEVENTID, CASE GLOBALEVENTID % 3 WHEN 0 THEN false WHEN 1 THEN true END AS is_root_event, "
            "CASE WHEN GLOBALEVENTID % 7 > 0 THEN event_date END AS date_added FROM g",
        ),
        "cleared_summaries": _with(
            _STORED, spikes, _PLACES, _TOP,
            "n AS (SELECT 'events' AS table_name, count(*) AS n, count(*) AS left_over FROM g "
            "UNION ALL SELECT 'top_events', count(*), 0 FROM top UNION ALL SELECT 'events_per_country', count(*), 0 FROM totals "
            "UNION ALL SELECT 'events_by_time_and_country', count(*), 0 FROM counts)",
            "SELECT table_name, 'before' AS state, n AS n_rows FROM n UNION ALL SELECT table_name, 'after', left_over FROM n",
        ),
        "stream_events": _with(_G, _EN, "SELECT * FROM en"),
        "quarantined_rows": _with(_G, _QUARANTINED),
        "events_table_damaged": _with(_DAMAGED, _EN, "SELECT * FROM en"),
        "feed_check": "SELECT strftime(h, '%Y%m%d%H%M%S') || '.export.CSV.zip' AS name, "
        "CASE hour(h) % 7 WHEN 0 THEN 'wrong size' WHEN 1 THEN 'wrong hash' WHEN 2 THEN 'missing' ELSE 'sound' END AS state "
        "FROM (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events) x "
        f"WHERE h > TIMESTAMP '{NOW}' - INTERVAL {WINDOW_HOURS + 3} HOUR",
        "ingest_checked": _with(
            _G, _EN,
            "SELECT en.* FROM en JOIN events ON event_id = GLOBALEVENTID "
            f"WHERE date_trunc('hour', ts) > TIMESTAMP '{NOW}' - INTERVAL {WINDOW_HOURS + 3} HOUR AND hour(ts) % 7 > 2",
        ),
        "top_events_default": _with(
            _G,
            "SELECT GLOBALEVENTID * 4 + copy AS GLOBALEVENTID, num_articles, lat, lon "
            "FROM g, (SELECT unnest(range(4)) AS copy) WHERE lat IS NOT NULL AND lon IS NOT NULL "
            f"ORDER BY num_articles DESC NULLS LAST, 1 LIMIT {TOP_DEFAULT}",
        ),
        "search_actors": _with(
            _G, _EN,
            _search_sql(ACTOR_SPEC, f"regexp_matches(Actor1Name, '{ACTOR_SPEC.actor1}', 'i')",
                        f"regexp_matches(Actor2Name, '{ACTOR_SPEC.actor2}', 'i')"),
        ),
        "search_literal": _with(
            _G, _EN,
            _search_sql(LITERAL_SPEC, f"contains(lower(ActionGeo_FullName), lower('{LITERAL_SPEC.country}'))"),
        ),
        "stored_impact": _with(
            _STORED, _stories().replace("FROM en ", "FROM g ").replace("FROM en\n", "FROM g\n"),
            f"SELECT {_KEYS}, avg_goldstein_scale, total_articles, "
            "avg_goldstein_scale * total_articles AS impact_score FROM stories",
        ),
        "analysis_job": _with(_STORED, spikes, _PLACES, _TOP, _SUMMARIES),
        "analysis_incremental": _with(
            _STORED.replace("\ng AS (", "\nen AS ("), _UPDATED, "g AS (SELECT * FROM updated)", spikes, _PLACES, _TOP,
            _SUMMARIES,
        ),
        "search_page": _with(
            _G, _EN, _FOUND,
            "kpis AS (SELECT count(*) AS n, CAST(sum(num_mentions) AS BIGINT) AS total_mentions, "
            "CAST(sum(num_articles) AS BIGINT) AS total_articles, "
            "avg(goldstein_scale) AS avg_goldstein, avg(avg_tone) AS mean_tone FROM found)",
            f"SELECT {shown}, n, total_mentions, total_articles, avg_goldstein, mean_tone FROM found, kpis",
        ),
    }
