"""Trie of conversations by common beginnings: blocks of turns first, single turns where they part."""

import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from newslens.llm.tables import keep

# Turns of a block.
BLOCK = 8
# Blocks over which one window runs; what lies before them comes as one carried row.
SPAN = 1024
# Ids of a node's ends are joined in pieces of at most 2^PIECE_BITS.
PIECE_BITS = 12
# Rebuilt conversations take up to BRANCH - 1 turns from the first conversation of their family.
BRANCH = 9
FAMILY = 5

NODE = "struct<d: bigint, a: bigint, b: bigint>"


def _running(rows, key, order, sums):
    """Each row's aggregates over the earlier rows of its key; first by spans, then within one.

    `order` counts from 0 in a key. A window holds at most SPAN rows, or one row per span.
    """
    before = Window.partitionBy(key, "span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("span", F.expr(f"{order} div {SPAN}"))
    spans = rows.groupBy(key, "span").agg(*(F.expr(f"bit_xor({c})").alias(c) for c in sums))
    earlier = Window.partitionBy(key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(
        key, "span",
        *(F.coalesce(F.expr(f"bit_xor({c})").over(earlier), F.lit(0)).alias(f"carried_{c}") for c in sums),
    )
    inside = rows.select(
        "*", *(F.coalesce(F.expr(f"bit_xor({c})").over(before), F.lit(0)).alias(f"inside_{c}") for c in sums)
    )
    joined = inside.join(carried, [key, "span"])
    return joined.select(
        *rows.drop("span").columns,
        *(F.expr(f"inside_{c} ^ carried_{c}").alias(f"before_{c}") for c in sums),
    )


def numbered(turns):
    """(conv_id, pos, k1, k2, n_bytes): turns in order, from 1, with a digest of role and text.

    Order: turn (NULL first), then role and text, so that ties come out the same each time. NULL
    role or text is empty; rows without conv_id are of no conversation and are left out. The sort
    is by ranges, so that one conversation with a great share of all turns is dealt over tasks;
    a turn's number is its place in its range and the turns of earlier ranges.
    """
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id",
        F.xxhash64("role", "text").alias("k1"),
        F.xxhash64(F.lit("second"), "text", "role").alias("k2"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("place"),
    )
    ranged = keep(ranged, "trie-ranges")
    parts = ranged.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift")
    )
    return ranged.join(parts, ["conv_id", "part"]).select(
        "conv_id", (F.col("place") + F.col("shift")).alias("pos"), "k1", "k2", "n_bytes"
    )


def branched(turns):
    """(turns, ids) of conversations rebuilt on the first one of their family of five.

    `turns` are numbered. Conversation c begins with the first h turns of conversation c - c % 5,
    as far as there are such, and goes on with its own turns after its first h; h is the CRC-32
    of its decimal id modulo 9. `ids` are all conversations, also those left without turns.
    """
    turns = keep(turns, "trie-turns")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BRANCH
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < BRANCH)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "k1", "k2", "n_bytes"))).alias("head")
    ).select(F.col("conv_id").alias("family"), "head")
    ids = turns.select("conv_id").distinct().withColumn("taken", taken.cast("int"))
    ids = ids.withColumn("family", F.expr(f"conv_id - conv_id % {FAMILY}")).join(heads, "family", "left")
    ids = keep(ids.select(
        "conv_id", "taken", F.slice(F.coalesce("head", F.expr("array()")), F.lit(1), F.col("taken")).alias("head")
    ), "trie-heads")
    begun = ids.select("conv_id", F.inline("head"))
    own = turns.join(ids.select("conv_id", "taken", F.size("head").alias("n_head")), "conv_id").where("pos > taken")
    own = own.select("conv_id", F.expr("pos - taken + n_head").alias("pos"), "k1", "k2", "n_bytes")
    return begun.unionByName(own), ids.select("conv_id")


def _blocks(turns):
    """(conv_id, block, turns, a, b, before_a, before_b): blocks of up to BLOCK turns, with digests.

    The digest of a beginning is the exclusive or of its turns' hashes, each made with the turn's
    number, in 2 x 64 bits: it can be put together from parts, in any order.
    """
    hashed = turns.select(
        "conv_id", "pos", "n_bytes", F.expr(f"(pos - 1) div {BLOCK}").alias("block"),
        F.xxhash64("pos", "k1").alias("a"), F.xxhash64("k2", "pos").alias("b"),
    )
    blocks = hashed.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("pos", "a", "b", "n_bytes"))).alias("turns"),
        F.expr("bit_xor(a)").alias("a"), F.expr("bit_xor(b)").alias("b"),
    )
    return keep(_running(keep(blocks, "trie-parts"), "conv_id", "block", ["a", "b"]), "trie-blocks")


def _nodes(blocks):
    """(node, parent, n_bytes, n_convs, conv_id) for each distinct beginning of one turn or more.

    Conversations are grouped by successive block digests. Where all that go on after a beginning
    share the next block, its turns are nodes as they stand; only where siblings part, their turns
    are compared one by one, a row for each different block and not for each conversation.
    """
    place = ["block", "before_a", "before_b"]
    siblings = blocks.groupBy(*place, "a", "b", F.size("turns").alias("n")).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")
    )
    siblings = keep(siblings, "trie-siblings")
    parents = siblings.groupBy(*place).agg((F.count("*") > 1).alias("part_here"))
    done = F.expr(
        f"aggregate(turns, array(named_struct('d', block * {BLOCK}, 'a', before_a, 'b', before_b, "
        "'n_bytes', 0L)), (done, t) -> array_append(done, named_struct('d', t.pos, "
        "'a', element_at(done, -1).a ^ t.a, 'b', element_at(done, -1).b ^ t.b, 'n_bytes', t.n_bytes)))"
    )
    steps = siblings.join(parents, place).select("part_here", "n_convs", "conv_id", done.alias("done")).select(
        "part_here", "n_convs", "conv_id", "done", F.explode(F.expr("sequence(1, size(done) - 1)")).alias("i")
    )
    at = lambda i: f"named_struct('d', done[{i}].d, 'a', done[{i}].a, 'b', done[{i}].b)"
    steps = keep(steps.select(
        "part_here", F.expr(at("i")).alias("node"), F.expr(at("i - 1")).alias("parent"),
        F.expr("done[i].n_bytes").alias("n_bytes"), "n_convs", "conv_id",
    ), "trie-steps")
    columns = ["node", "parent", "n_bytes", "n_convs", "conv_id"]
    parted = steps.where("part_here").groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("n_bytes").alias("n_bytes"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
    )
    return steps.where("NOT part_here").select(*columns).unionByName(parted.select(*columns))


def _root(ids):
    root = F.expr("named_struct('d', 0L, 'a', 0L, 'b', 0L)")
    return ids.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        root.alias("node"), F.lit(None).cast(NODE).alias("parent"), F.lit(0).cast("long").alias("n_bytes"),
        "n_convs", "conv_id",
    )


def _subtree_sums(nodes):
    """(node, n_leaves, saved_tokens) over each node's subtree, in log2(depth) rounds.

    After round j a node holds the sums of its descendants fewer than 2^j levels below, and knows
    its ancestor 2^j levels above. Nodes with many descendants are summed in the map tasks.
    """
    deepest = nodes.agg(F.max("node.d")).first()[0] or 0
    state = nodes.select(
        "node", F.col("parent").alias("above"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        F.when(F.col("node.d") > 0, (F.col("n_convs") - 1) * F.col("n_bytes")).otherwise(0).alias("saved"),
    )
    reach = 1
    while reach <= deepest:
        given = state.where("above IS NOT NULL").groupBy("above").agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        ).select(F.col("above").alias("node"), "more_leaves", "more_saved")
        summed = keep(state.join(given, "node", "left").select(
            "node", "above", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        ), "trie-sums")
        reach *= 2
        # Only nodes at least so deep have an ancestor twice as far.
        deep, high = F.col("node.d") >= reach, F.col("node.d") < reach
        jump = state.where("above IS NOT NULL").select(F.col("node").alias("above"), F.col("above").alias("far"))
        state = summed.where(high).withColumn("above", F.lit(None).cast(NODE))
        if reach <= deepest:
            farther = summed.where(deep).join(jump, "above").select("node", F.col("far").alias("above"), "leaves", "saved")
            state = keep(state.unionByName(farther), "trie-state")
    return state.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def _ends(blocks, ids):
    """(node, ends_sha256) of the nodes at which conversations end.

    Ids are joined in pieces of a bounded id range; a node's digest then runs over its pieces in
    order, as a stream, so that no task holds the ids of a node. (SHA-256 itself has one order.)
    """
    last = blocks.groupBy("conv_id").agg(
        F.sum(F.size("turns")).alias("d"), F.expr("bit_xor(a)").alias("a"), F.expr("bit_xor(b)").alias("b")
    )
    zero = F.lit(0).cast("long")
    ends = ids.join(last, "conv_id", "left").select(
        F.struct(*(F.coalesce(c, zero).alias(c) for c in ("d", "a", "b"))).alias("node"), "conv_id"
    )
    pieces = ends.groupBy("node", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    ordered = pieces.repartition("node").sortWithinPartitions("node", "piece").select("node.*", "ids")

    def run(batches):
        node, digest, done = None, None, []

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in done], pa.int64()) for i in range(3)]
                + [pa.array([x[3] for x in done], pa.string())], ["d", "a", "b", "ends_sha256"],
            )

        for batch in batches:
            for d, a, b, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node == (d, a, b):
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (d, a, b), hashlib.sha256(ids.encode())
            if done:
                yield rows()
                done = []
        if node is not None:
            done.append((*node, digest.hexdigest()))
            yield rows()

    hashed = ordered.mapInArrow(run, "d long, a long, b long, ends_sha256 string")
    return hashed.select(F.struct("d", "a", "b").alias("node"), "ends_sha256")


def trie(turns, ids):
    """The nodes of the trie of `turns` (as `numbered` gives them) and of all conversations `ids`.

    Per node: conv_id, its smallest member; depth; parent_conv_id, its parent's conv_id (root:
    NULL); n_convs, members; n_children; n_leaves, childless nodes in its subtree, itself
    included; saved_tokens, UTF-8 bytes of last texts in its subtree, each counted once for each
    member but one; ends_sha256, digest of the ids of conversations that end there, ascending and
    joined by commas. A node's turns are the first `depth` ones of its conv_id. Conversations
    without turns are members of the root; without conversations there are no nodes.
    """
    ids = keep(ids, "trie-ids")
    blocks = _blocks(turns)
    nodes = keep(_nodes(blocks).unionByName(_root(ids)), "trie-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    nodes = keep(nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long"))
    ), "trie-families")
    above = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(_subtree_sums(nodes), "node").join(_ends(blocks, ids), "node", "left")
    return found.join(above, "parent", "left").select(
        "conv_id", F.col("node.d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(turns):
    """`trie` of conversations (conv_id, turn, role, text) as they stand.

    NULL role and text are empty, rows without conv_id are left out, rows repeated in full are
    turns of their own, other columns are not looked at. No rows: no nodes.
    """
    rows = keep(numbered(turns), "trie-turns")
    return trie(rows, rows.select("conv_id").distinct())


def branched_trie(turns):
    """`trie` of conversations rebuilt by `branched`."""
    return trie(*branched(numbered(turns)))
