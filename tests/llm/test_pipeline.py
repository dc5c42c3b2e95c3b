"""The pipeline stage by stage on a planted corpus, and whole on the small tables."""

import random

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from test_training_order import decoded  # noqa: E402

from newslens.llm import simhash  # noqa: E402


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(4)
    text = lambda n: " ".join(f"word{rng.randrange(3000)}" for _ in range(n))
    item = text(30)
    base = text(300)
    rows = [(i, text(60), "en", f"s{i % 3}") for i in range(200)]
    rows += [(300, base, "en", "s0"), (301, base, "en", "s1"), (302, base + " end", "en", "s1")]
    rows += [(310, text(40) + " " + item + " " + text(40), "en", "s2"), (320, "too short", "en", "s0")]
    rows += [(330, " ".join(f"#{w}" for w in text(60).split()), "en", "s0"), (331, "a b " * 80, "en", "s0"), (332, None, None, None)]
    rows += [(5, rows[5][1], "en", "s2")]
    folder = f"file://{tmp_path_factory.mktemp('planted')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, base


def test_stages(spark, planted):
    folder, rows, base = planted
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source"]
        seen.append(sorted(r.doc_id for r in docs.collect()))
    clean = list(range(200))
    near = (simhash.fingerprint(base.encode()) ^ simhash.fingerprint((base + " end").encode())).bit_count() <= 2
    assert near
    assert seen[0] == sorted([*clean, 5, 300, 301, 302, 310])
    assert seen[1] == [*clean, 300, 310]
    assert seen[2] == [*clean, 300]
    assert set(seen[3]) == {*clean, 300} and max(map(seen[3].count, clean)) <= 2
    final = corpus_pipeline.run(spark, folder).collect()
    assert [r.slot for r in final] == list(range(len(final)))
    assert {r.doc_id for r in final} == {*clean, 300}


def test_run(spark):
    folder = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, folder).collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    once = {(r.doc_id, r.piece): r for r in rows}.values()
    assert all(text == texts[i] for i, text in decoded(once).items())
    assert corpus_pipeline.ORACLE_SQL is None
