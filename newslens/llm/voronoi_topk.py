"""Exact top-k inner products: a Voronoi join of queries and data around pivots."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from newslens.llm.tables import keep

# Vectors of the data that the cells are built around.
PIVOTS = 128
# Most queries of a group, and about the most vectors that a task compares with a group at once.
QUERY_BLOCK = 1 << 16
DATA_BLOCK = 1 << 16
# Queries that are multiplied in one step.
STEP = 256
# Integers below it are exact in a double.
EXACT = 2.0**53


def whole_vectors(rows, vec_id="vec_id", vector="embedding", scale=256):
    """(vec_id, vector): each component x as floor(scale * x), in doubles.

    Rows with a NULL id, a NULL vector, or a component that is NULL or not finite (also once
    scaled) are left out.
    """
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # FLOOR gives a BIGINT; doubles beyond it have no fraction.
    floor = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad).select(
        "vec_id", F.transform("vector", floor).alias("vector")
    )


def _matrix(lists, width):
    """A row of doubles per list, filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if (sizes == width).all():
        return values.reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _pivots(vectors, n):
    """Up to n distinct vectors, those with the smallest hashes: a sample of bounded size."""
    hashed = vectors.select(F.xxhash64("vector").alias("h"), "vector")

    def run(batches):
        smallest = {}
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False)
            for i in np.unique(hashes, return_index=True)[1][:n]:
                smallest.setdefault(int(hashes[i]), batch.column(1)[int(i)].as_py())
            smallest = dict(sorted(smallest.items())[:n])
        yield pa.RecordBatch.from_pydict(
            {"h": list(smallest), "vector": list(smallest.values())},
            pa.schema([("h", pa.int64()), ("vector", pa.list_(pa.float64()))]),
        )

    found = hashed.mapInArrow(run, "h long, vector array<double>").dropDuplicates(["h"])
    return [row.vector for row in found.orderBy("h").limit(n).collect()]


def _celled(vectors, pivots):
    """(vec_id, vector, cell, radius): the nearest pivot of each vector, and the distance to it."""
    width = pivots.shape[1]
    squares = (pivots * pivots).sum(axis=1)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width)
            with np.errstate(over="ignore", invalid="ignore"):
                cell = np.argmin(np.nan_to_num(squares - 2 * x @ pivots.T, nan=np.inf), axis=1)
                radius = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius)],
                ["vec_id", "vector", "cell", "radius"],
            )

    return vectors.mapInArrow(run, "vec_id long, vector array<double>, cell int, radius double")


def _packed(sizes, pivots, block):
    """{cell: (first group, number of groups)}: cells next to each other share groups of `block`.

    Cells follow one another by nearness of their pivots. A cell of more queries than `block` is
    split into groups of its own.
    """
    left, order, at = set(sizes), [], None
    while left:
        near = (lambda c: ((pivots[c] - pivots[at]) ** 2).sum()) if order else (lambda c: c)  # noqa: B023
        at = min(left, key=near)
        left.remove(at)
        order.append(at)
    groups, group, filled = {}, 0, 0
    for cell in order:
        if filled and filled + sizes[cell] > block:
            group, filled = group + 1, 0
        parts = math.ceil(sizes[cell] / block)
        groups[cell] = (group, parts)
        if parts > 1:
            group, filled = group + parts, 0
        else:
            filled += sizes[cell]
    return groups


def _bounds(queries, pivots, nearest, k):
    """(vec_id, vector, grp, floor, norm, best): what a query's top k must reach, and can in a cell.

    A vector s at distance r from pivot p scores q.p - |q| r at least and q.p + |q| r at most. The
    k-th largest lower bound of the vectors nearest to their pivots, those with the query's own id
    left out, is a score that k vectors reach: `floor`. `best` is q.p of each pivot.
    """
    width = pivots.shape[1]
    ids, cells, radii = (np.array(x) for x in zip(*nearest, strict=True))

    def run(batches):
        for batch in batches:
            q = _matrix(batch.column(1), width)
            with np.errstate(over="ignore", invalid="ignore"):
                best = q @ pivots.T
                norm = np.sqrt((q * q).sum(axis=1))
                low = best[:, cells] - norm[:, None] * radii
            low[batch.column(0).to_numpy(zero_copy_only=False)[:, None] == ids] = -np.inf
            low = np.nan_to_num(low, nan=-np.inf, posinf=-np.inf, neginf=-np.inf)
            floor = np.full(len(q), -np.inf)
            if low.shape[1] >= k:
                floor = np.partition(low, -k, axis=1)[:, -k]
            rows = pa.array(np.ascontiguousarray(best).ravel())
            offsets = pa.array(np.arange(len(q) + 1, dtype=np.int32) * len(pivots))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(floor), pa.array(norm),
                 pa.ListArray.from_arrays(offsets, rows)],
                ["vec_id", "vector", "grp", "floor", "norm", "best"],
            )

    return queries.mapInArrow(
        run, "vec_id long, vector array<double>, grp int, floor double, norm double, best array<double>"
    )


def _products(q, x):
    """Inner products of rows; exact also where a double is not."""
    most = lambda m: np.abs(m).max(initial=0.0)
    if most(q) * most(x) * max(1, x.shape[1]) < EXACT:
        return q @ x.T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    top = 2**63 - 1
    return np.clip(whole(q) @ whole(x).T, -top - 1, top)


def best_of_block(q_ids, q, ids, x, k):
    """(query number, vec_id, score) of the k best rows of x for each query, smaller ids first of equals."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    out = []
    for start in range(0, len(q), STEP):
        scores = _products(q[start : start + STEP], x)
        asked = q_ids[start : start + STEP]
        own = np.ones(scores.shape, bool)
        left, right = np.searchsorted(ids, asked, "left"), np.searchsorted(ids, asked, "right")
        for row in np.flatnonzero(left < right):
            own[row, left[row] : right[row]] = False
        masked = np.where(own, scores, -np.inf if scores.dtype != object else -(2**64))
        if masked.shape[1] > k:
            lowest = np.partition(masked, -k, axis=1)[:, -k]
            rows, places = np.nonzero(own & (masked >= lowest[:, None]))
        else:
            rows, places = np.nonzero(own)
        found = masked[rows, places]
        # Places follow the ids, so a stable sort by score leaves equals in order of id.
        by_score = np.argsort(-found, kind="stable")
        by_row = by_score[np.argsort(rows[by_score], kind="stable")]
        rows, places, found = rows[by_row], places[by_row], found[by_row]
        first = np.searchsorted(rows, rows, "left")
        kept = np.arange(len(rows)) - first < k
        out.append((start + rows[kept], ids[places[kept]], found[kept].astype(np.int64)))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def top_k(data, queries, k=5, n_pivots=PIVOTS, query_block=QUERY_BLOCK, data_block=DATA_BLOCK):
    """(query_id, rank, vec_id, score): the k rows of `data` with the largest inner products.

    Both frames are (vec_id, vector) as `whole_vectors` gives them. Equal scores go to the
    smaller vec_id. Rows with the query's own vec_id are no candidates. Queries repeated in full
    are asked once; data rows repeated in full count each. Vectors that are shorter than others
    are filled up with zeros. Fewer than k candidates give fewer rows, an empty side none. Scores
    are exact, and clipped to the range of a BIGINT.

    Queries and data go to the cells of their nearest pivots. Summaries of the data's cells give
    each query a score that its top k reach; a group of queries takes from each cell only vectors
    whose distance to the pivot lets them reach the group's lowest such score. A group meets its
    vectors block by block, each block in a task of its own, however many fall into one cell.
    """
    data = keep(data, "topk-data")
    queries = keep(queries.dropDuplicates(["vec_id", "vector"]), "topk-queries")
    found = _pivots(data, n_pivots)
    width = max([x or 0 for f in (data, queries) for x in f.agg(F.max(F.size("vector"))).first()] + [1])
    spark = data.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    if not found:
        return spark.createDataFrame([], result)
    pivots = np.zeros((len(found), width))
    for i, vector in enumerate(found):
        pivots[i, : len(vector)] = vector

    placed = _celled(data, pivots)
    cells = keep(placed.withColumn("row", F.monotonically_increasing_id()), "topk-cells")
    by_radius = Window.partitionBy("cell").orderBy("radius", "vec_id", "row")
    nearest = cells.select("cell", "radius", "vec_id", "row").withColumn(
        "nth", F.row_number().over(by_radius)
    ).where(F.col("nth") <= k + 1).select("vec_id", "cell", "radius").collect()

    asked = keep(_celled(queries, pivots), "topk-asked")
    sizes = {row.cell: row.n for row in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], result)
    groups = _packed(sizes, pivots, query_block)
    first, parts = (
        F.create_map(*(F.lit(x) for cell, g in groups.items() for x in (cell, g[i])))[F.col("cell")]
        for i in range(2)
    )
    group = (first + F.pmod(F.xxhash64("vec_id", "vector"), parts)).cast("int")
    asked = asked.select("vec_id", "vector", group.alias("grp"))
    bounds = keep(_bounds(asked, pivots, [tuple(r) for r in nearest], k), "topk-bounds")
    limits = bounds.select("grp", "floor", "norm", F.posexplode("best").alias("cell", "best")).groupBy(
        "grp", "cell"
    ).agg(F.min("floor").alias("floor"), F.max("norm").alias("norm"), F.max("best").alias("best"))
    limits = keep(limits, "topk-limits")

    # Rounding of the bounds is far below the slack; scores are integers.
    slack = "1 + 1e-9 * (abs(best) + norm * radius)"
    needed = cells.join(limits, "cell").where(f"floor = double('-inf') OR best + norm * radius + {slack} >= floor")
    blocks = max(math.ceil(cells.count() / data_block), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = needed.select("grp", F.pmod("row", F.lit(blocks)).alias("block"), "vec_id", "vector")
    meeting = bounds.select(
        "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "vec_id",
        "vector", F.xxhash64("vector").alias("query_hash"),
    )
    names = ["query_id", "query_hash", "vec_id", "score"]

    def solve(data, queries):
        if not data.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        q_ids = queries["vec_id"].to_numpy()
        rows, ids, scores = best_of_block(
            q_ids, _matrix(queries["vector"], width), data["vec_id"].to_numpy(), _matrix(data["vector"], width), k
        )
        return pa.table([q_ids[rows], queries["query_hash"].to_numpy()[rows], ids, scores], names)

    pieces = dealt.groupBy("grp", "block").cogroup(meeting.groupBy("grp", "block")).applyInArrow(
        solve, "query_id long, query_hash long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    ranked = pieces.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
