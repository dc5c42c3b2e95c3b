"""Temperature mixing of sources, realised as budgeted block permutations."""

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newslens.llm.tables import keep, words

# No document is drawn more often than this.
MAX_REPEAT = 4.0
# Tokens of a block, about: what one task orders.
BLOCK_TOKENS = 1 << 20
KEY = 20240131
# One pass over the sources tries all exponents that so many bisections could visit.
HALVINGS, PASSES = 6, 5


def source_shares(docs):
    """(source, n_docs, n_tokens, share) of each source that has tokens; share adds up to 1."""
    totals = docs.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
    ).where("n_tokens > 0")
    return totals.withColumn("share", F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy()))


def _sums(shares, exponents):
    """{exponent: (sum of share^a, sum of share^a * ln share, smallest, largest share)}."""
    tried = shares.select("share", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    power = F.exp(F.col("a") * F.ln("share"))
    rows = tried.groupBy("a").agg(
        F.sum(power).alias("s"), F.sum(power * F.ln("share")).alias("t"),
        F.min("share").alias("least"), F.max("share").alias("most"),
    ).collect()
    return {r.a: (r.s, r.t, r.least, r.most) for r in rows}


def entropy_at(a, sums):
    """Entropy in nats of weights share^a / sum."""
    s, t, _, _ = sums
    return math.log(s) - a * t / s


def repeats_at(a, sums, drawn=None):
    """How often the smallest source is drawn if `drawn` times all tokens are drawn.

    Without `drawn` the budget is the least that draws every source once in full.
    """
    s, _, least, most = sums
    if drawn is None:
        return (least / most) ** (a - 1)
    return drawn * least ** (a - 1) / s


def solve_exponent(shares, value, target):
    """Smallest exponent in [0, 1] with value(exponent, sums) <= target, by bisection; else 1.

    Entropy and repetition both fall as the exponent rises. A pass evaluates the whole tree of
    `HALVINGS` bisections at once, as an aggregate over the sources, which stay distributed.
    """
    low, high, steps = 0.0, 1.0, 1 << HALVINGS
    ends = _sums(shares, [low, high])
    if not ends or value(low, ends[low]) <= target:
        return low
    if value(high, ends[high]) > target:
        return high
    for _ in range(PASSES):
        inner = [low + (high - low) * k / steps for k in range(1, steps)]
        sums = _sums(shares, inner)
        above = [a for a in inner if value(a, sums[a]) > target]
        low, high = (max(above, default=low), min((a for a in inner if a not in above), default=high))
    return high


def mixture(docs, max_repeat=None, entropy=None, drawn=None, block_tokens=BLOCK_TOKENS):
    """A row per source: share, weight, budget in tokens, epochs in full, tokens of the rest, blocks.

    Weights are shares raised to the exponent that meets `entropy` (nats) or, by default,
    `max_repeat`. The budget is `drawn` times all tokens; by default the least that draws every
    document at least once.
    """
    shares = keep(source_shares(docs), "mix-shares")
    if entropy is not None:
        a = solve_exponent(shares, entropy_at, entropy)
    else:
        limit = MAX_REPEAT if max_repeat is None else max_repeat
        a = solve_exponent(shares, lambda a, sums: repeats_at(a, sums, drawn), limit)
    every = Window.partitionBy()
    power = F.exp(F.lit(a) * F.ln("share"))
    if drawn is None:
        largest = F.max("n_tokens").over(every)
        ratio = F.col("n_tokens") / largest
        budget = F.greatest(F.round(largest * F.exp(F.lit(a) * F.ln(ratio))).cast("long"), "n_tokens")
    else:
        total = F.sum("n_tokens").over(every)
        budget = F.round(F.lit(drawn) * total * power / F.sum(power).over(every)).cast("long")
    return shares.select(
        "source", "n_docs", "n_tokens", "share", F.lit(a).alias("exponent"),
        (power / F.sum(power).over(every)).alias("weight"), budget.alias("budget"),
    ).withColumns({
        "epochs": F.expr("budget div n_tokens"),
        "rest": F.expr("budget % n_tokens"),
        "blocks": F.expr(f"(n_tokens + {block_tokens - 1}) div {block_tokens}"),
    })


def _narrow(docs, tokens):
    """What decides about a row. Rows repeated in full are one unit, drawn or left together."""
    n_tokens = F.size(words(F.col("text"))) if tokens is None else tokens
    unit = F.xxhash64(F.lit(KEY), F.col("text"), F.col("doc_id"))
    return docs.select("doc_id", "source", unit.alias("unit"), n_tokens.cast("long").alias("n_tokens"))


def _dealt(rows, mix):
    """Rows with the numbers of their source and, by keyed hash, their block."""
    of = mix.select(F.col("source").alias("of_source"), "epochs", "rest", "blocks")
    joined = rows.join(of, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    return joined.withColumn("block", F.pmod(F.xxhash64(F.lit(KEY), "unit"), "blocks"))


def _last_epoch(dealt):
    """(source, block, open_tokens): of the blocks drawn in the part epoch, the tokens to take.

    The epoch's permutation of a source's blocks is walked until its rest is used up. A block is
    about a million tokens, so a source's walk is a short list.
    """
    blocks = dealt.where("rest > 0").groupBy("source", "block", "epochs", "rest").agg(
        F.sum("n_tokens").alias("block_tokens")
    )
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(KEY), "epochs", "block"), "block")
    before = F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = blocks.withColumn("open_tokens", F.col("rest") - F.coalesce(before, F.lit(0)))
    return opened.where("open_tokens > 0").select("source", "block", "open_tokens", "block_tokens")


def _same_block(a, b):
    return a["source"].eqNullSafe(b["source"]) & (a["block"] == b["block"])


def _copies(dealt, narrow_dealt):
    """`dealt` with `copies`: epochs in full, and one if the part epoch draws the row too."""
    last = keep(_last_epoch(narrow_dealt), "mix-last-epoch")
    cut = last.where("open_tokens < block_tokens")
    inside = narrow_dealt.join(cut, _same_block(narrow_dealt, cut), "left_semi")
    units = inside.groupBy("source", "block", "epochs", "unit").agg(F.sum("n_tokens").alias("n_tokens"))
    order = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(KEY), "epochs", "unit"), "unit")
    before = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = units.withColumn("before", before)
    drawn = placed.join(cut, _same_block(placed, cut)).where("before < open_tokens")
    drawn = keep(drawn.select(F.col("unit").alias("drawn_unit")).distinct(), "mix-cut-blocks")
    whole = last.where("open_tokens >= block_tokens").select(
        F.col("source").alias("whole_source"), F.col("block").alias("whole_block")
    )
    whole = keep(whole, "mix-whole-blocks")
    joined = dealt.join(
        whole,
        F.col("source").eqNullSafe(F.col("whole_source")) & (F.col("block") == F.col("whole_block")),
        "left",
    ).join(drawn, F.col("unit") == F.col("drawn_unit"), "left")
    once_more = F.col("whole_block").isNotNull() | F.col("drawn_unit").isNotNull()
    return joined.withColumn("copies", F.col("epochs") + once_more.cast("long"))


def draws(docs, tokens=None, **target):
    """A row per draw: (doc_id, source, n_tokens, epoch, block_place, place).

    A source with weight w gets w times the budget in tokens. Its documents are dealt to blocks by
    a keyed hash; each epoch is a keyed permutation of the blocks and of the documents in them,
    and the last epoch ends at the first document that fills the budget. block_place is the
    block's place in the source's epoch, place the document's in the block. Tokens are words
    unless `tokens` names a column. Rows of sources without any token are not drawn; a NULL source
    is a source. Rows repeated in full stay together. Empty tables give no rows.
    """
    rows = keep(_narrow(docs, tokens), "mix-rows")
    mix = keep(mixture(rows, **target), "mix")
    dealt = _dealt(rows, mix)
    each = _copies(dealt, dealt).where("copies > 0").withColumn(
        "epoch", F.explode(F.expr("sequence(0L, copies - 1)"))
    )
    in_block = Window.partitionBy("source", "epoch", "block").orderBy(
        F.xxhash64(F.lit(KEY), "epoch", "unit"), "unit"
    )
    blocks = mix.select("source", "epochs", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    blocks = blocks.withColumn("epoch", F.explode(F.expr("sequence(0L, epochs)")))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(KEY), "epoch", "block"), "block")
    places = blocks.withColumn("block_place", F.row_number().over(order)).select(
        F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("b"), "block_place"
    )
    placed = each.withColumn("place", F.row_number().over(in_block))
    return placed.join(
        places,
        F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("b")),
    ).select("doc_id", "source", "n_tokens", "epoch", "block_place", "place")


def mix_documents(docs, tokens=None, **target):
    """The rows of `docs` (doc_id, text, source, ...), each as often as it is drawn.

    Texts are not shuffled as long as the decisions, a few rows per block, are small enough for
    the planner to broadcast.
    """
    rows = keep(_narrow(docs, tokens), "mix-rows")
    mix = keep(mixture(rows, **target), "mix")
    unit = F.xxhash64(F.lit(KEY), F.col("text"), F.col("doc_id"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), "source", unit.alias("unit"))
    chosen = _copies(_dealt(whole, mix), _dealt(rows, mix)).where("copies > 0")
    return chosen.select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")
