"""Temperature mixing: exponents against a plain bisection, draws against budgets."""

import math
from collections import Counter, defaultdict

import pytest

from newslens.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, epoch int, block string"


def corpus(spark, sizes, words=7):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"doc {i} " + "w " * (words + i % 5), source, 0, ""))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def bisected(value, target):
    low, high = 0.0, 1.0
    if value(low) <= target:
        return 0.0
    if value(high) > target:
        return 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if value(middle) <= target else (middle, high)
    return high


def entropy(p, a):
    s = sum(x**a for x in p)
    return -sum(x**a / s * math.log(x**a / s) for x in p)


def repeats(p, a, drawn):
    s = sum(x**a for x in p)
    return drawn * min(p) ** (a - 1) / s


@pytest.mark.parametrize("target", [{"entropy": 1.2}, {"entropy": 5.0}, {"entropy": 0.01},
                                    {"max_repeat": 2.0, "drawn": 1.0}, {"max_repeat": 1.0, "drawn": 3.0}])
def test_exponent(spark, target):
    counts = {"a": 300, "b": 60, "c": 12, None: 5}
    frame = spark.createDataFrame(
        [(s, n * 1000) for s, n in counts.items()], "source string, n_tokens long")
    p = [n / sum(counts.values()) for n in counts.values()]
    mix = mixing.mixture(frame, **target).collect()
    if "entropy" in target:
        want = bisected(lambda a: entropy(p, a), target["entropy"])
    else:
        want = bisected(lambda a: repeats(p, a, target["drawn"]), target["max_repeat"])
    assert abs(mix[0].exponent - want) < 1e-6
    assert abs(sum(r.weight for r in mix) - 1) < 1e-9


@pytest.mark.parametrize("drawn,block", [(None, 50), (1.0, 50), (2.5, 100000)])
def test_draws(spark, drawn, block):
    frame = corpus(spark, {"big": 120, "mid": 30, None: 9})
    target = dict(max_repeat=3.0, drawn=drawn, block_tokens=block)
    rows = mixing.draws(frame, **target).collect()
    mix = {r.source: r for r in mixing.mixture(
        mixing._narrow(frame, None), **target).collect()}
    tokens = {r.doc_id: len(r.text.split()) for r in frame.collect()}
    by_source, order = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.n_tokens == tokens[r.doc_id]
        by_source[r.source].append(r)
        order[r.source, r.epoch, r.block_place].append(r.place)
    assert all(sorted(places) == list(range(1, len(places) + 1)) for places in order.values())
    for source, m in mix.items():
        total = sum(r.n_tokens for r in by_source[source])
        assert m.budget <= total < m.budget + max(tokens.values())
        for epoch, docs in Counter((r.epoch, r.doc_id) for r in by_source[source]).items():
            assert docs == 1, epoch
        epochs = defaultdict(list)
        for r in sorted(by_source[source], key=lambda r: (r.epoch, r.block_place, r.place)):
            epochs[r.epoch].append(r.doc_id)
        full = [e for e in epochs if len(epochs[e]) == m.n_docs]
        assert len(full) >= m.epochs
        if len(full) > 1 and m.n_docs > 20:
            assert epochs[full[0]] != epochs[full[1]]
    if drawn is None:
        assert {r.doc_id for r in rows} == set(tokens)
        assert max(Counter(r.doc_id for r in rows).values()) <= 3
    again = mixing.draws(frame.repartition(3), **target).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    copies = Counter(r.doc_id for r in mixing.mix_documents(frame, **target).collect())
    assert copies == Counter(r.doc_id for r in rows)


def test_edge_cases(spark):
    rows = [(1, None, "none", 0, ""), (2, "", "none", 0, ""), (3, "a b c", None, 0, ""), (4, None, None, 0, ""),
            (5, "same row here", "x", 0, ""), (5, "same row here", "x", 0, ""), (None, "w " * 50000, "x", 0, "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    drawn = Counter(r.doc_id for r in mixing.draws(frame).collect())
    assert set(drawn) == {3, 4, 5, None} and drawn[5] == 2 and drawn[None] == 1
    mixed = mixing.mix_documents(frame)
    assert mixed.columns == frame.columns
    assert Counter(r.doc_id for r in mixed.collect()) == drawn
    assert mixing.draws(frame.limit(0)).count() == 0
    assert mixing.mix_documents(frame.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    sizes = Counter()
    for r in docs:
        sizes[r.source] += len(r.text.encode().split())
    largest = max(sizes.values())
    a = bisected(lambda a: (min(sizes.values()) / largest) ** (a - 1), mixing.MAX_REPEAT)
    drawn, most = Counter(), max(len(r.text.encode().split()) for r in docs)
    for r in queries.op6_source_mixing(spark, folder).collect():
        drawn[r.source] += r.n_tokens
    for source, n in sizes.items():
        budget = largest * (n / largest) ** a
        assert budget - 2 <= drawn[source] <= budget + most
