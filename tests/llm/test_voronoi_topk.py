"""Exact top-k inner products against brute force and SQL."""

import math

import numpy as np
import pytest
from corpus_helpers import query_rows, sql_rows

from newslens.llm import voronoi_topk

DDL = "vec_id long, embedding array<float>, rank int, cell string"


def usable(rows):
    return [
        (i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]


def brute_force(rows, asks, k):
    rows, result = usable(rows), []
    for q, qv in {(q, tuple(v)) for q, v in rows if asks(q)}:
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q)
        result += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(result)


def check(spark, rows, divisor=5, k=5, **options):
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], DDL)
    vectors = voronoi_topk.whole_vectors(frame)
    got = voronoi_topk.top_k(vectors, vectors.where(f"vec_id % {divisor} = 0"), k, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_force(rows, lambda i: i % divisor == 0, k)


@pytest.mark.parametrize("spread", [0.02, 5.0])
def test_clusters(spark, spread):
    """Tight clusters, where bounds leave most rows out, and loose ones."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * spread).tolist()) for i in range(300)]
    check(spark, rows, n_pivots=12, query_block=7, data_block=40)


def test_bounds_leave_rows_out(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(8) * 4
    data = [(i, (centres[i % 8] + rng.normal(size=8) * 0.01).tolist(), 0, "x") for i in range(400)]
    vectors = voronoi_topk.whole_vectors(spark.createDataFrame(data, DDL))
    pivots = np.array(voronoi_topk._pivots(vectors, 32))
    cells = [tuple(r) for r in voronoi_topk._celled(vectors, pivots).select("vec_id", "cell", "radius").collect()]
    asked = vectors.where("vec_id = 0").selectExpr("vec_id", "vector", "0 AS grp")
    nearest = [c for cell in range(32) for c in sorted((c for c in cells if c[1] == cell), key=lambda c: c[2])[:6]]
    bound = voronoi_topk._bounds(asked, pivots, nearest, 5).first()
    reached = [i for i, cell, r in cells if bound.best[cell] + bound.norm * r >= bound.floor]
    assert 5 < len(reached) < 100
    assert {i for i in reached} >= {row[2] for row in brute_force([d[:2] for d in data], lambda i: i == 0, 5)}


def test_ties_and_copies(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(i, [0.5 * (i % 3), 1.0]) for i in range(40, 60)]
    check(spark, rows, n_pivots=4, query_block=3, data_block=16)
    check(spark, rows + [(60, [9.0, 9.0])] * 3 + [(61, [9.0, 9.0])] * 2, n_pivots=4)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, 0.0]),
        (6, [-0.001, 0.001]), (None, [1.0, 1.0]), (10, [1e30, -1e30]), (15, [3.0]), (20, []), (7, [1e6, 1e6]),
    ]
    small = [r for r in rows if r[0] != 10]
    check(spark, small)
    check(spark, small[:1])
    check(spark, small[:3], k=2)
    check(spark, [])
    vectors = voronoi_topk.whole_vectors(spark.createDataFrame([(*r, 0, "x") for r in rows], DDL))
    top = voronoi_topk.top_k(vectors, vectors.where("vec_id = 10")).collect()
    assert [r.vec_id for r in sorted(top)][:1] == [0] and len(top) == 5


def test_against_sql(spark):
    assert query_rows(spark, "op12_voronoi_topk") == sql_rows("op12_voronoi_topk")
