"""Training order: a true permutation, tokens that decode to the texts, resumable shards."""

import os
from collections import defaultdict
from urllib.parse import urlparse

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.llm import queries, training_order
from newslens.session import scratch_path

SCHEMA = "doc_id long, text string, slot string, tokens int"


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 65537])
def test_slots_are_a_permutation(n):
    got = training_order.slots(np.arange(n), n)
    assert sorted(got) == list(range(n))
    if n > 100:
        assert (got != np.arange(n)).mean() > 0.9
        assert (training_order.slots(np.arange(n), n, key=7) != got).mean() > 0.9


def decoded(rows):
    encoding = training_order._encoding(open(training_order.VOCABULARY, "rb").read())
    texts = defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.piece)):
        texts[r.doc_id] += np.frombuffer(bytes(r.tokens), "<u2").tolist()
    assert all(ids.count(training_order.END_OF_TEXT) >= 1 for ids in texts.values())
    return {d: encoding.decode([i for i in ids if i != training_order.END_OF_TEXT]) for d, ids in texts.items()}


def test_edge_cases_and_shards(spark):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "word " * 3000), (None, "é\n\n ü"), (5, "x" * 5000)]
    frame = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    ordered = training_order.training_order(frame, length=16, shard_sequences=50)
    got = ordered.collect()
    assert [r.slot for r in got] == list(range(len(got)))
    assert all(r.shard == r.slot // 50 and len(r.tokens) == 2 * r.n_tokens <= 32 for r in got)
    assert decoded(got) == {d: t or "" for d, t in rows}
    path = scratch_path(spark, "shards")
    training_order.write_shards(ordered, path, length=16)
    for first in (0, 49, 50, 333, len(got) - 1, len(got)):
        back = training_order.read_shards(spark, path, first, length=16, shard_sequences=50).collect()
        assert sorted((r.slot, bytes(r.tokens)) for r in back) == [(r.slot, bytes(r.tokens)) for r in got[first:]]


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "same", "", 0)] * 3, SCHEMA)
    assert sorted(r.slot for r in training_order.training_order(frame).collect()) == [0, 1, 2]
    assert training_order.training_order(frame.limit(0)).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op2_training_order(spark, folder).collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert decoded(rows) == {r.doc_id: r.text for r in docs}
    assert all(r.n_tokens == training_order.LENGTH for r in rows if any(
        o.doc_id == r.doc_id and o.piece == r.piece + 1 for o in rows[:2000]))


def test_query_and_pipeline_read_shard_files(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for found in (queries.op2_training_order(spark, folder), corpus_pipeline.token_output(spark, docs, folder)):
        files = found.inputFiles()
        assert files and all("training-shards" in f and "/part-" in f for f in files)
        size = sum(os.path.getsize(urlparse(f).path) for f in files)
        assert size == found.count() * training_order.stride(origin=True)


def test_shards_keep_the_origin(spark):
    rows = [(1, "word " * 300), (None, "a"), (-5, None)]
    frame = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    options = {"length": 16, "shard_sequences": 7}
    want = training_order.training_order(frame, **options).collect()
    assert training_order.through_shards(frame, **options).collect() == want


def test_rows_that_change_between_the_passes_fail(spark, monkeypatch):
    count = training_order._count
    monkeypatch.setattr(training_order, "_count", lambda source, *a: count(source.withColumn("text", F.lit("other")), *a))
    frame = spark.createDataFrame([(1, "text", "s", 1), (2, "more", "s", 1)], SCHEMA)
    with pytest.raises(Exception, match="differ from those that were counted"):
        training_order.training_order(frame).collect()
