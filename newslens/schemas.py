"""Table schemas as DDL text, and the column lists that results are built from."""

# Names, order and types of the feed's 61 tab-separated event columns.
RAW_EVENT = """
GLOBALEVENTID BIGINT, SQLDATE INT, MonthYear INT, Year INT, FractionDate DOUBLE,
Actor1Code STRING, Actor1Name STRING, Actor1CountryCode STRING, Actor1KnownGroupCode STRING,
Actor1EthnicCode STRING, Actor1Religion1Code STRING, Actor1Religion2Code STRING,
Actor1Type1Code STRING, Actor1Type2Code STRING, Actor1Type3Code STRING,
Actor2Code STRING, Actor2Name STRING, Actor2CountryCode STRING, Actor2KnownGroupCode STRING,
Actor2EthnicCode STRING, Actor2Religion1Code STRING, Actor2Religion2Code STRING,
Actor2Type1Code STRING, Actor2Type2Code STRING, Actor2Type3Code STRING,
IsRootEvent INT, EventCode STRING, EventBaseCode STRING, EventRootCode STRING, QuadClass INT,
GoldsteinScale DOUBLE, NumMentions INT, NumSources INT, NumArticles INT, AvgTone DOUBLE,
Actor1Geo_Type INT, Actor1Geo_FullName STRING, Actor1Geo_CountryCode STRING,
Actor1Geo_ADM1Code STRING, Actor1Geo_ADM2Code STRING, Actor1Geo_Lat DOUBLE,
Actor1Geo_Long DOUBLE, Actor1Geo_FeatureID STRING,
Actor2Geo_Type INT, Actor2Geo_FullName STRING, Actor2Geo_CountryCode STRING,
Actor2Geo_ADM1Code STRING, Actor2Geo_ADM2Code STRING, Actor2Geo_Lat DOUBLE,
Actor2Geo_Long DOUBLE, Actor2Geo_FeatureID STRING,
ActionGeo_Type INT, ActionGeo_FullName STRING, ActionGeo_CountryCode STRING,
ActionGeo_ADM1Code STRING, ActionGeo_ADM2Code STRING, ActionGeo_Lat DOUBLE,
ActionGeo_Long DOUBLE, ActionGeo_FeatureID STRING,
DATEADDED BIGINT, SOURCEURL STRING
"""

# Names, order and types of the feed's 27 tab-separated knowledge-graph columns.
RAW_GKG = """
GKGRECORDID STRING, `DATE` STRING, SOURCECOLLECTIONIDENTIFIER INT, SOURCECOMMONNAME STRING,
DOCUMENTIDENTIFIER STRING, OLDCOUNTS STRING, NEWCOUNTS STRING,
V1THEMES STRING, V2ENHANCEDTHEMES STRING, V1LOCATIONS STRING, V2ENHANCEDLOCATIONS STRING,
V1PERSONS STRING, V2ENHANCEDPERSONS STRING, V1ORGANIZATIONS STRING,
V2ENHANCEDORGANIZATIONS STRING, `V1.5TONE` STRING, `V2.1ENHANCEDDATES` STRING, V2GCAM STRING,
`V2.1SHARINGIMAGE` STRING, `V2.1RELATEDIMAGES` STRING, `V2.1SOCIALIMAGEEMBEDS` STRING,
`V2.1SOCIALVIDEOEMBEDS` STRING, `V2.1QUOTATIONS` STRING, `V2.1ALLNAMES` STRING,
`V2.1AMOUNTS` STRING, `V2.1TRANSLATIONINFO` STRING, V2EXTRASXML STRING
"""

# The 22 columns of a cleaned event, in order.
CLEAN_COLUMNS = [
    "GLOBALEVENTID", "event_date", "year_month",
    "Actor1Name", "Actor1CountryCode", "Actor1Type1Code", "Actor2Name", "Actor2CountryCode",
    "EventCode", "EventBaseCode", "EventRootCode", "QuadClass",
    "goldstein_scale", "avg_tone", "num_mentions", "num_articles", "num_sources",
    "ActionGeo_FullName", "ActionGeo_CountryCode", "lon", "lat", "SOURCEURL",
]

# The stored `events` table. Its partition column is a DATE, so folder names stay readable;
# readers get the UTC-midnight timestamp back (see sources.tables.read_events).
STORED_EVENT = """
GLOBALEVENTID BIGINT, event_date DATE, year_month STRING,
Actor1Name STRING, Actor1CountryCode STRING, Actor1Type1Code STRING,
Actor2Name STRING, Actor2CountryCode STRING,
EventCode STRING, EventBaseCode STRING, EventRootCode STRING, QuadClass INT,
goldstein_scale FLOAT, avg_tone FLOAT, num_mentions INT, num_articles INT, num_sources INT,
ActionGeo_FullName STRING, ActionGeo_CountryCode STRING, lon DOUBLE, lat DOUBLE,
SOURCEURL STRING, EventDescription STRING
"""


def fields(ddl):
    """(name, type) pairs of a DDL text with flat columns."""
    return [tuple(part.replace("`", "").split()) for part in ddl.split(",")]


def require_columns(df, *names):
    """Return `df`, or raise if it lacks one of `names`."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df
