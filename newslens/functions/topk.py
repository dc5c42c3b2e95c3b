"""Top-k that does not send k rows of every task through one reducer."""

from pyspark.sql import Window
from pyspark.sql import functions as F

# Size of the quantile sketch: about 100 KB a task.
SKETCH_K = 4096
# Four times the rank error, as a share of the rows, that such a sketch keeps to in 99 of 100 cases.
RANK_MARGIN = 4 * 2.296 / SKETCH_K**0.9021
# Shares of the rows for which the sketch is asked where the largest of them begin.
SHARES = [RANK_MARGIN * 2 ** (step / 4) for step in range(31) if RANK_MARGIN * 2 ** (step / 4) < 1]
# Stands for a missing measure, which comes last.
NO_MEASURE = -(2.0**62)
# The smallest integer of each type.
LEAST = {"tinyint": -(2**7), "smallint": -(2**15), "int": -(2**31), "bigint": -(2**63)}


def order_value(measure, ident):
    """A double that never rises from a row to one that comes after it.

    Rows come by falling measure (an integer, NULL last) and rising `ident` (NULL first). The
    measure is the whole part; ids of equal measures are told apart on a logarithmic scale, which
    leaves a difference of about one in 10^7 for measures up to a million.
    """
    ident = F.greatest(F.coalesce(F.col(ident), F.lit(0)).cast("double"), F.lit(0.0))
    return F.coalesce(F.col(measure).cast("double"), F.lit(NO_MEASURE)) + (1 - F.log2(ident + 1) / 64)


def top_cutoff(df, measure, k, ident):
    """One row with a struct `cut` (n, cutoff, low), from one scan of the two columns.

    Each of the first k rows has an `order_value` of `cutoff` or more, and so a measure of `low`
    or more; `low` is the least integer if rows without a measure are among them.
    """
    seen = df.agg(
        F.count("*").alias("n"),
        F.kll_sketch_agg_double(order_value(measure, ident), F.lit(SKETCH_K)).alias("sketch"),
    )
    ranks = F.array(*(F.lit(1 - share) for share in SHARES))
    begins = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", ranks))
    wide = F.transform(begins, lambda q, i: F.struct(F.get(F.array(*map(F.lit, SHARES)), i).alias("share"), q.alias("q")))
    enough = F.filter(wide, lambda x: x["share"] >= F.lit(k) / F.col("n") + RANK_MARGIN)
    cutoff = F.get(enough, F.lit(0))["q"]
    seen = seen.select("n", F.coalesce(cutoff, F.lit(float("-inf"))).alias("cutoff"))
    kind = df.schema[measure].dataType.simpleString()
    low = F.when(F.col("cutoff") > NO_MEASURE / 2, F.ceil(F.col("cutoff") - 1)).otherwise(F.lit(LEAST[kind]))
    low = F.greatest(low, F.lit(LEAST[kind])).cast(kind)
    return seen.select(F.struct("n", "cutoff", low.alias("low"), (F.col("cutoff") <= NO_MEASURE / 2).alias("all")).alias("cut"))


def top_by_measure(df, measure, k, ident, *tiebreak):
    """First k rows by descending measure (NULLs last), ties by ascending `ident`, then `tiebreak`.

    A quantile sketch of both columns gives a cutoff in one narrow scan; the second scan sorts
    what reaches it: k rows and RANK_MARGIN of all, not k of every task. The measure's share of
    the cutoff is compared with the bare column, so it reaches the Parquet scan. Should a sketch
    ever miss its error four times over, the query fails and does not return fewer rows.
    """
    # One scalar subquery, however often it is mentioned.
    cut = top_cutoff(df, measure, k, ident).scalar()
    col = F.col(measure)
    reaching = df.where((col >= cut["low"]) | (col.isNull() & cut["all"])).where(
        order_value(measure, ident) >= cut["cutoff"]
    )
    top = reaching.orderBy(col.desc(), F.asc(ident), *tiebreak).limit(k)
    # At most k rows are counted.
    found = top.withColumn("_found", F.count("*").over(Window.partitionBy()))
    missed = F.col("_found") < F.least(F.lit(k), cut["n"])
    return found.where(
        F.when(missed, F.raise_error(F.lit("quantile sketch missed its error bound; run again")).cast("boolean"))
        .otherwise(F.lit(True))
    ).drop("_found")
