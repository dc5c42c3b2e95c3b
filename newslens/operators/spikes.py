"""Countries whose daily event count jumps above their recent baseline."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from newslens.operators.countries import CODE, country_day_counts

# The columns of a spike report, in order.
SPIKE_COLUMNS = [
    CODE, "spike_events", "baseline_events", "baseline_days_count",
    "avg_baseline_per_day", "spike_score", "is_spike",
]
# The display order of the flagged-countries table.
FLAGGED_COLUMNS = [
    CODE, "spike_events", "avg_baseline_per_day",
    "spike_score", "baseline_events", "baseline_days_count",
]
# Rank 1 is the newest day, still filling up; rank 2 is the last complete one.
SPIKE_RANK = 2


def _days_present(day_counts):
    """Distinct days of the country-day counts.

    Written over the counts (a day with events has a positive sum), so that this branch and the
    join share one scan and one exchange of the events.
    """
    return (
        day_counts.groupBy("event_ts")
        .agg(F.sum("total_events").alias("day_events"))
        .where(F.col("day_events") > 0)
        .select("event_ts")
    )


def _ranked(days):
    # One task, but over distinct days only.
    return days.withColumn("day_rank", F.dense_rank().over(Window.orderBy(F.desc("event_ts"))))


def day_ranks(events, day_col="event_date"):
    """Rank of every day present, newest = 1. Calendar gaps are not filled."""
    return _ranked(_days_present(country_day_counts(events, day_col))).orderBy("day_rank")


def country_event_spike(events, day_col="event_date", **options):
    """`spikes_of_counts` over the events' own country-day counts."""
    return spikes_of_counts(country_day_counts(events, day_col), **options)


def spikes_of_counts(counts, baseline_days=5, spike_threshold=0.5, min_baseline=200.0):
    """Spike score per country: last complete day against the average of the days before it.

    `baseline_days` may be fractional (hours / 24); only whole days count. The average is over
    the baseline days on which the country is present. Countries with an average of at most
    `min_baseline` drop out; a negative value keeps those without any baseline.
    """
    last_rank = SPIKE_RANK + math.floor(baseline_days)
    # Only the newest `last_rank` days matter, which bounds what is ranked and broadcast.
    recent = _ranked(_days_present(counts).orderBy(F.desc("event_ts")).limit(last_rank))
    in_spike = F.col("day_rank") == SPIKE_RANK
    in_baseline = F.col("day_rank").between(SPIKE_RANK + 1, last_rank)
    per_country = (
        counts.join(F.broadcast(recent), "event_ts", "left")
        .groupBy(CODE)
        .agg(
            F.sum(F.when(in_spike, F.col("total_events")).otherwise(0)).alias("spike_events"),
            F.sum(F.when(in_baseline, F.col("total_events")).otherwise(0)).alias("baseline_events"),
            F.count_if(in_baseline).alias("baseline_days_count"),
        )
    )
    average = F.when(
        F.col("baseline_days_count") > 0,
        F.round(F.col("baseline_events") / F.col("baseline_days_count").cast("double"), 4),
    ).otherwise(0.0)
    base = F.col("avg_baseline_per_day")
    score = F.when(base > 0, F.round((F.col("spike_events") - base) / base, 4)).otherwise(
        F.col("spike_events").cast("double")
    )
    return (
        per_country.withColumn("avg_baseline_per_day", average)
        .where(base > min_baseline)
        .withColumn("spike_score", score)
        .withColumn("is_spike", F.col("spike_score") > spike_threshold)
        .select(*SPIKE_COLUMNS)
        .orderBy(F.desc("spike_score"), CODE)
    )


def spike_report(spikes, only_spikes=False, limit=50):
    """Stored spike rows, highest score first."""
    rows = spikes.where("is_spike") if only_spikes else spikes
    return rows.select(*SPIKE_COLUMNS).orderBy(F.desc("spike_score"), CODE).limit(limit)


def spike_top(spikes, n=20):
    """Country and score of the n highest scores, for the chart."""
    return spikes.select(CODE, "spike_score").orderBy(F.desc("spike_score"), CODE).limit(n)


def spike_kpis(report):
    """Countries loaded and countries flagged."""
    return report.agg(
        F.count("*").alias("countries"), F.count_if(F.col("is_spike")).alias("flagged")
    )


def flagged_spikes(report):
    """Flagged rows of a spike report, in display order of the columns."""
    return report.where("is_spike").select(*FLAGGED_COLUMNS).orderBy(F.desc("spike_score"), CODE)
