"""Benchmark decontamination against brute force and SQL."""

import random
import re

import duckdb
from corpus_helpers import query_rows, sql_rows

from newslens.llm import decontamination, queries


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if len(words) < 5:
        return {" ".join(words)} - {""}
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def held_of(item, text):
    """Shingles of an item that a text holds; an item of fewer than five words is sought as a run."""
    s = shingles(item)
    if any(len(x.split()) < 5 for x in s):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        n = len(next(iter(s)).split())
        return s & {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
    return s & shingles(text)


def check(spark, docs, items):
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, n int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_leaks(frame, bench).collect()
    want = set()
    for d, text in docs:
        for i, item in items:
            s = shingles(item)
            if s and 100 * len(held_of(item, text)) >= 80 * len(s):
                want.add((d, i, len(s), len(held_of(item, text))))
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got} == want
    held = {d for d, *_ in want}
    kept = decontamination.remove_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(
        str(d) for d in docs if not any(
            shingles(t) and 100 * len(held_of(t, d[1])) >= 80 * len(shingles(t)) for _, t in items))
    return held


def test_random_edits(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(9)) for _ in range(rng.randrange(5, 60))))
             for i in range(40)]
    docs = []
    for d in range(120):
        words = [f"f{rng.randrange(10**6)}" for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1].upper().split()
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = "edit"
            words += part
        docs.append((d, ", ".join(words)))
    assert check(spark, docs, items)


def test_edge_cases(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (3, "  \n"), (4, "just three words"), (5, "Just three, words!"), (None, item + " x"),
            (6, item), (6, "clean text of this id goes on"), (7, item), (7, item),
            (10, "Here it says: hello, big world; and more of it"), (11, "hello world, big"),
            (8, "w " * 50000 + item), (9, "éa Öb cé dñ eß fü")]
    assert check(spark, docs, [(1, item), (2, None), (3, ""), (4, "just three words"), (5, "ÉA öb Cé dñ eß fü"),
                               (6, "hello big world"), (7, "W")])
    assert not check(spark, docs, [])


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.find_leaks(docs, bench).count() == 0
    assert decontamination.remove_leaks(docs, bench).count() == 0


def test_short_items_against_sql(spark, tmp_path):
    docs = [(1, "it says hello, big world again"), (2, "hello world"), (3, "big"), (4, None), (5, "a b c d e f g")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "Hello big world"), (2, "big"), (3, "b c d e f"), (4, "f g")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name = "op7_benchmark_decontamination"
    frame = queries.QUERIES[name](spark, str(tmp_path))
    got = sorted(tuple(r) for r in frame.select("doc_id", "item_id", "n_shingles", "n_found").collect())
    assert got == [(1, 1, 1, 1), (1, 2, 1, 1), (3, 2, 1, 1), (5, 3, 1, 1), (5, 4, 1, 1)]
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    sql = f"SELECT doc_id, item_id, n_shingles, n_found FROM ({queries.ORACLE_SQL[name]}) x ORDER BY ALL"
    assert con.execute(sql).fetchall() == got


def test_query(spark):
    got = query_rows(spark, "op7_benchmark_decontamination")
    assert got[1]
    assert got == sql_rows("op7_benchmark_decontamination")
