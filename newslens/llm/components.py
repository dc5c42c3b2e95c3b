"""Connected components of a graph too large for one task."""

from pyspark.sql import functions as F

from newslens.llm.tables import keep


def _large_star(edges, name):
    """Link each larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("m"))
    # Read from a table, both sides of the join can be split where one node has many links.
    smallest = keep(smallest.select("a", F.least("a", "m").alias("m")), name)
    linked = both.where("b > a").join(smallest, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges, name):
    """Link a node and its smaller neighbours to the smallest of them. Edges have a > b."""
    smallest = keep(edges.groupBy("a").agg(F.min("b").alias("m")), name)
    across = edges.join(smallest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()


def _state(edges):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def connected_components(links, name):
    """(node, root) for each node of `links` (columns a, b): root is the smallest node reachable.

    Alternates large and small stars until every node points at its root, in about log(nodes)
    rounds. A round only joins and aggregates; a node with a great share of all links is
    aggregated in the map tasks and its join partition can be split.
    """
    edges = links.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges = keep(edges, name)
    before = _state(edges)
    while True:
        edges = keep(_large_star(edges, name), name)
        edges = keep(_small_star(edges, name), name)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
