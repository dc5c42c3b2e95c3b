"""Every registered query against independent SQL, run by another engine on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("NEWSLENS_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def sorted_rows(rows):
    return sorted(rows, key=lambda row: tuple((v is not None, str(v)) for v in row))


def test_every_query_has_sql():
    own = set(contract.queries()) - set(contract.CORPUS_QUERIES)
    assert own == set(contract.oracle_sql()) - set(contract.CORPUS_SQL)


@pytest.mark.parametrize("name", [q.__name__ for q in contract.QUERIES])
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    cursor = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(row) for row in df.select(*(f"`{c}`" for c in columns)).collect()]
    assert expected
    assert sorted_rows(got) == sorted_rows(expected)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 15
    assert max(row.spike_score for row in rows) == 0.5
    assert not any(row.is_spike for row in rows)
