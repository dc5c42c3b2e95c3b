"""Inputs and intermediate tables of the corpus operators."""

from pyspark.sql import functions as F

from newslens.session import scratch_path

# A word of all contracts: a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df, name, **options):
    """The rows of `df` as a written table in the shared folder.

    It ends the lineage: what is read from it later is not computed again, also if executors are
    lost, and its true size is known to the planner.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text):
    """Array of the words of a text column, none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value, use):
    """`use(value)` with `value` computed once, also where `use` mentions it inside a lambda."""
    return F.transform(F.array(value), use)[0]
