"""Runs the SQL of a query in another engine over a folder of tables."""

import glob
import os

import duckdb

from newslens.llm import queries

SF_DIR = "/root/testdata/sf0.01"


def sql_rows(name, folder=SF_DIR):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    return sorted_rows([c[0] for c in cursor.description], cursor.fetchall())


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    rows = [tuple(row[i] for i in order) for row in rows]
    return sorted(columns), sorted(rows, key=repr)


def query_rows(spark, name, folder=SF_DIR):
    frame = queries.QUERIES[name](spark, folder)
    return sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
