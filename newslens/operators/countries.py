"""Totals, tone and day counts per country."""

from pyspark.sql import functions as F

from newslens.functions.aggregates import modal_value

CODE = "ActionGeo_CountryCode"
PLACE = "ActionGeo_FullName"


def place_counts(events):
    """Events and tone per country and place.

    Every country summary builds on these rows. They are few, and a country that holds a large
    share of the events is spread over its places.
    """
    return events.groupBy(CODE, PLACE).agg(
        F.count("*").alias("n"),
        F.sum("avg_tone").alias("tone_sum"),
        F.count("avg_tone").alias("tone_n"),
    )


def day_place_counts(events):
    """`place_counts` of each day."""
    return events.groupBy(CODE, PLACE, "event_date").agg(
        F.count("*").alias("n"), F.sum("avg_tone").alias("tone_sum"), F.count("avg_tone").alias("tone_n")
    )


def add_day_places(by_day):
    """`place_counts` of all days, from those of each."""
    return by_day.groupBy(CODE, PLACE).agg(
        *(F.sum(c).alias(c) for c in ("n", "tone_sum", "tone_n"))
    )


def country_days(by_day):
    """`events_by_time_and_country` from the place counts of each day."""
    counts = by_day.where(F.col(CODE).isNotNull()).groupBy(CODE, "event_date").agg(F.sum("n").alias("total_events"))
    counts = counts.withColumn("event_ts", F.col("event_date").cast("timestamp")).where(F.col("event_ts").isNotNull())
    return counts.orderBy(F.desc("event_ts"), CODE)


def country_names(places):
    """Modal place per country code, NULL code included."""
    return places.groupBy(CODE).agg(modal_value(F.col(PLACE), F.col("n")).alias("Country_Name"))


def events_per_country(places, keep_code=False):
    """Total events per country, largest first. NULL codes are left out, NULL names are not.

    Two codes may share a name; `keep_code` tells them apart.
    """
    totals = (
        places.where(F.col(CODE).isNotNull())
        .groupBy(CODE)
        .agg(
            modal_value(F.col(PLACE), F.col("n")).alias("Country_Name"),
            F.sum("n").alias("Total_Events"),
        )
        .orderBy(F.desc("Total_Events"), "Country_Name", CODE)
    )
    return totals if keep_code else totals.drop(CODE)


def tone_by_country(places, keep_code=False):
    """Average tone per country, highest first. The NULL code is a group, NULL names drop out."""
    tones = (
        places.groupBy(CODE)
        .agg(
            modal_value(F.col(PLACE), F.col("n")).alias("Country_Name"),
            F.try_divide(F.sum("tone_sum"), F.sum("tone_n")).alias("Average_Tone"),
        )
        .where(F.col("Country_Name").isNotNull())
        .orderBy(F.desc("Average_Tone"), "Country_Name", CODE)
    )
    return tones if keep_code else tones.drop(CODE)


def tone_extremes(tones, limit=10):
    """The `limit` most positive and most negative countries of `tone_by_country`.

    NULL tones sort as the lowest, so a country without any tone counts as most negative.
    """

    def branch(polarity, order):
        return (
            tones.orderBy(order, "Country_Name")
            .limit(limit)
            .select(F.lit(polarity).alias("polarity"), "Country_Name", "Average_Tone")
        )

    return branch("most_positive", F.desc("Average_Tone")).unionByName(
        branch("most_negative", F.asc("Average_Tone"))
    )


def country_day_counts(events, day_col="event_date"):
    """Events per country and day; rows without country or day do not count."""
    return (
        events.where(F.col(CODE).isNotNull())
        .groupBy(CODE, day_col)
        .agg(F.count("*").alias("total_events"))
        .withColumn("event_ts", F.col(day_col).cast("timestamp"))
        .where(F.col("event_ts").isNotNull())
    )


def events_by_time_and_country(events):
    """Events per country and day, newest day first."""
    return country_day_counts(events).orderBy(F.desc("event_ts"), CODE)
