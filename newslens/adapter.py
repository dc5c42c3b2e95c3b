"""Event tables derived from the bundled star schema, and feed files written from them.

The test tables hold no news events. `news_events` reshapes `events`, `nation` and `region` into
cleaned events; the functions below it write those rows in the feed's file formats, so that the
scans can be checked against the rows they came from.
"""

import io
import itertools
import zipfile

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from newslens.schemas import CLEAN_COLUMNS, RAW_EVENT, RAW_GKG, fields

# Lookup of the derived events. 190 is left out so that the inner join loses rows.
EVENT_CODES = {
    "010": "Make statement",
    "020": "Make an appeal",
    "0311": "Express intent to cooperate economically",
    "057": "Sign formal agreement",
}
LINES_PER_ARCHIVE = 100_000
# Lines that a task holds as text.
LINES_AT_ONCE = 1_000


# Schemas of the tables read here; given, so that opening a table needs no job of its own.
EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
    "props STRING"
)
NATION = "n_nationkey INT, n_name STRING, n_regionkey INT"
REGION = "r_regionkey INT, r_name STRING"

# The cleaned event as SQL expressions over the joined tables, in column order. The measures are
# halves and eighths, so that sums and averages are exact.
NEWS_EVENT = {
    "GLOBALEVENTID": "event_id",
    "event_date": "event_date",
    "year_month": "CAST(year(event_date) * 100 + month(event_date) AS STRING)",
    "Actor1Name": "IF(event_id % 19 <> 0, upper(event_type), NULL)",
    "Actor1CountryCode": "IF(event_id % 19 <> 0, left(r_name, 3), NULL)",
    "Actor1Type1Code": "IF(event_id % 2 = 0, 'GOV', NULL)",
    "Actor2Name": "IF(event_id % 23 <> 0, r_name, NULL)",
    "Actor2CountryCode": "IF(event_id % 23 <> 0, left(r_name, 3), NULL)",
    "EventCode": "decode(event_type, 'click', '010', 'view', '020', 'signup', '0311', "
    "'purchase', '057', '190')",
    "EventBaseCode": "decode(event_type, 'click', '010', 'view', '020', 'signup', '031', "
    "'purchase', '057', '190')",
    "EventRootCode": "decode(event_type, 'click', '01', 'view', '02', 'signup', '03', "
    "'purchase', '05', '19')",
    "QuadClass": "decode(event_type, 'click', 1, 'view', 1, 'signup', 2, 'purchase', 2, 4)",
    "goldstein_scale": "CAST(k % 41 - 20 AS DOUBLE) / 2",
    "avg_tone": "CAST((event_id * 7 + k) % 161 - 80 AS DOUBLE) / 8",
    "num_mentions": "k",
    "num_articles": "CAST((event_id * 13 + k) % 101 AS INT)",
    "num_sources": "k % 10 + 1",
    "ActionGeo_FullName": "IF(event_id % 17 <> 0, concat('City', event_id % 3, ', ', n_name), NULL)",
    "ActionGeo_CountryCode": "IF(event_id % 29 <> 0, n_name, NULL)",
    "lon": "IF(event_id % 11 <> 0, CAST(event_id % 360 - 180 AS DOUBLE), NULL)",
    "lat": "IF(event_id % 13 <> 0, CAST(event_id % 180 - 90 AS DOUBLE), NULL)",
    "SOURCEURL": "concat('http://news.example/', event_id)",
}


def news_events(spark, sf_dir):
    """The 22-column cleaned event built from every row of `events`."""
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    nation = spark.read.schema(NATION).parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.schema(REGION).parquet(f"{sf_dir}/region.parquet")
    return (
        events.selectExpr(
            "*",
            "CAST(CAST(ts AS DATE) AS TIMESTAMP) AS event_date",
            "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k",
            "CAST(user_id % 25 AS INT) AS n_nationkey",
        )
        .join(nation, "n_nationkey")
        .join(region, F.expr("n_regionkey = r_regionkey"))
        .selectExpr(*(f"{NEWS_EVENT[name]} AS {name}" for name in CLEAN_COLUMNS))
    )


def event_codes(spark):
    """The code lookup as a local relation, whose size Catalyst knows."""
    rows = ", ".join(f"('{code}', '{text}')" for code, text in EVENT_CODES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(EventCode, EventDescription)")


def _shaped(df, ddl, expressions):
    """Every column of `ddl` as an SQL expression over `df`, NULL where none is given."""
    return df.selectExpr(
        *(f"CAST({expressions.get(name, 'NULL')} AS {kind}) AS `{name}`"
          for name, kind in fields(ddl))
    )


# Raw columns whose value is not simply the cleaned column of the same name.
RAW_FROM_CLEAN = {
    "SQLDATE": "date_format(event_date, 'yyyyMMdd')",
    "MonthYear": "year_month",
    "Year": "year(event_date)",
    "IsRootEvent": "1",
    "GoldsteinScale": "goldstein_scale",
    "AvgTone": "avg_tone",
    "NumMentions": "num_mentions",
    "NumArticles": "num_articles",
    "NumSources": "num_sources",
    "ActionGeo_Long": "lon",
    "ActionGeo_Lat": "lat",
    "DATEADDED": "concat(date_format(event_date, 'yyyyMMdd'), '000000')",
}


def _filler(position, name, kind):
    """A value of its own for a column that the cleaned events do not have."""
    if kind == "STRING":
        return f"concat('{name} ', GLOBALEVENTID % {position + 50})"
    return f"GLOBALEVENTID % {position + 50}"


# SQL that both engines read, for the raw columns that nothing else fills.
FILLERS = {
    name: _filler(position, name, kind)
    for position, (name, kind) in enumerate(fields(RAW_EVENT))
    if name not in CLEAN_COLUMNS and name not in RAW_FROM_CLEAN
}


def raw_events(clean):
    """61-column rows that clean up to `clean` again, every column filled."""
    filled = {name: name for name in CLEAN_COLUMNS} | FILLERS | RAW_FROM_CLEAN
    return _shaped(clean, RAW_EVENT, filled)


GKG_FILLERS = {
    name: f"concat('{name} ', doc_id % {position + 50})"
    for position, (name, kind) in enumerate(fields(RAW_GKG)) if kind == "STRING"
}


def raw_gkg(documents):
    """27-column knowledge-graph rows of the documents, with their whole texts."""
    return _shaped(documents, RAW_GKG, GKG_FILLERS | {
        "GKGRECORDID": "doc_id",
        "SOURCECOLLECTIONIDENTIFIER": "1",
        "SOURCECOMMONNAME": "source",
        "DOCUMENTIDENTIFIER": "concat('http://docs.example/', doc_id)",
        "V2EXTRASXML": "translate(text, '\\t\\r\\n', '   ')",
    })


def tsv_lines(raw):
    """One unquoted tab-separated line per row; NULL is the empty field."""
    values = ", ".join(f"coalesce(CAST(`{name}` AS STRING), '')" for name in raw.columns)
    return raw.selectExpr(f"concat_ws('\\t', {values}) AS value")


def manifest_lines(spark, sf_dir):
    """`size hash url` lines, an event and a knowledge-graph file for each hour with events."""
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    hours = events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    url = F.concat(
        F.lit("http://feed.example/v2/"), F.date_format("hour", "yyyyMMddHHmmss"), F.col("ending")
    )
    endings = F.explode(F.array(F.lit(".export.CSV.zip"), F.lit(".gkg.csv.zip")))
    return hours.select("hour", "n", endings.alias("ending")).select(
        F.concat_ws(" ", F.col("n").cast("string"), F.md5("ending"), url).alias("value")
    )


# Damage done to feed lines: SQL over an event id, and what becomes of the line.
DAMAGE = {
    "GLOBALEVENTID % 31 = 0": {"SQLDATE": "'20240231'"},
    "GLOBALEVENTID % 37 = 0": {"SQLDATE": "''"},
    "GLOBALEVENTID % 43 = 0": {"Actor1Name": "concat('\"', Actor1Name)"},
    "GLOBALEVENTID % 47 = 0": {"NumMentions": "'many'"},
}
CUT = "GLOBALEVENTID % 41 = 0"
CUT_FIELDS = 10


def damaged_lines(raw):
    """`tsv_lines` with impossible and missing days, stray quotes, unreadable numbers, cut-off rows."""
    values = {name: f"coalesce(CAST(`{name}` AS STRING), '')" for name in raw.columns}
    for where, changes in DAMAGE.items():
        for name, value in changes.items():
            values[name] = f"IF({where}, coalesce({value}, ''), {values[name]})"
    whole = f"concat_ws('\t', {', '.join(values.values())})"
    return raw.selectExpr(f"IF({CUT}, substring_index({whole}, '\t', {CUT_FIELDS}), {whole}) AS value")


class _Archive:
    """A zip archive of one member. Lines go in as they come, so it is held compressed only."""

    def __init__(self, name):
        self.name, self.packed, self.n_lines = name, io.BytesIO(), 0
        self.target = zipfile.ZipFile(self.packed, "w", zipfile.ZIP_DEFLATED)
        self.member = self.target.open(name, "w", force_zip64=True)

    def add(self, lines):
        self.member.write("".join(f"{line}\n" for line in lines).encode())
        self.n_lines += len(lines)

    def row(self):
        self.member.close()
        self.target.close()
        return pa.RecordBatch.from_pydict({"path": [f"{self.name}.zip"], "content": [self.packed.getvalue()]})


def _pack(batches):
    """Lines -> zip archives of bounded size, named by task and number."""
    task, number, archive = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        values, at = batch.column("value"), 0
        while at < len(values):
            if archive is None:
                archive = _Archive(f"{task:06d}-{number:06d}.export.CSV")
            lines = values.slice(at, min(LINES_AT_ONCE, LINES_PER_ARCHIVE - archive.n_lines)).to_pylist()
            archive.add(lines)
            at += len(lines)
            if archive.n_lines == LINES_PER_ARCHIVE:
                yield archive.row()
                number, archive = number + 1, None
    if archive is not None:
        yield archive.row()


def archives(lines):
    """(path, content) rows with the lines zipped up, as the feed publishes them."""
    return lines.mapInArrow(_pack, "path string, content binary")


def named_archives(lines):
    """(path, content) rows: the lines of each `name` of (name, line) rows as `name`.zip."""

    def pack(batches):
        archive = None
        for batch in batches:
            for at in range(0, batch.num_rows, LINES_AT_ONCE):
                names, values = (column.to_pylist() for column in batch.slice(at, LINES_AT_ONCE).columns)
                rows = zip(names, values, strict=True)
                for name, group in itertools.groupby(rows, key=lambda row: row[0]):
                    if archive is not None and archive.name != name:
                        yield archive.row()
                        archive = None
                    archive = archive or _Archive(name)
                    archive.add([line for _, line in group])
        if archive is not None:
            yield archive.row()

    ordered = lines.select("name", "line").repartition("name").sortWithinPartitions("name")
    return ordered.mapInArrow(pack, "path string, content binary")


def _line(raw):
    return F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in raw.columns)).alias("line")


def hourly_archives(clean, spark, sf_dir):
    """(path, content) rows, an archive for the events of each hour, named as in the manifest."""
    hours = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("GLOBALEVENTID"), F.date_format("ts", "yyyyMMddHH'0000.export.CSV'").alias("name")
    )
    raw = raw_events(clean)
    return named_archives(raw.join(hours, "GLOBALEVENTID").select("name", _line(raw)))


def hourly_gkg_archives(documents):
    """(path, content) rows of knowledge-graph archives: a document for each hour of January in turn."""
    raw = raw_gkg(documents)
    hour = F.expr("TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, CAST(GKGRECORDID AS INT) % 720)")
    return named_archives(raw.select(F.date_format(hour, "yyyyMMddHH'0000.gkg.csv'").alias("name"), _line(raw)))


def land_archives(packed, folder):
    """Write (path, content) rows as files of a folder, through the file system that it names.

    A file appears under its name only when complete, so a repeated task does no harm.
    """
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    uri = uri.replace("file:/", "file:///", 1) if not uri.startswith("file://") and uri.startswith("file:") else uri

    def write(rows):
        system, place = pyarrow.fs.FileSystem.from_uri(uri)
        system.create_dir(place, recursive=True)
        for row in rows:
            target = f"{place}/{row.path}"
            # Readers skip names that start with a dot or an underscore.
            part = f"{place}/_{row.path}.{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(part) as out:
                out.write(row.content)
            system.move(part, target)

    packed.foreachPartition(write)
