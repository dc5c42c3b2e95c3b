"""CSV export of small, already limited results."""


def export_csv(df, path):
    """One CSV file with a header. Only for results behind a limit: one task writes it."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def read_export(spark, path, schema):
    return spark.read.schema(schema).option("header", "true").csv(path)
