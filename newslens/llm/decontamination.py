"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Only DataFrame functions. A MinHash sketch of a whole document says little about a short item
inside it, so containment is searched from the item's side. Items are partitioned by size; in a
class of up to u shingles an item's signature is its k smallest shingle hashes, with
k = u - ceil(0.8 * u) + 1. A document that holds 80 % of an item misses
fewer than k of its shingles, so it holds one of the signature: none is missed.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newslens.llm.tables import keep, let

SHINGLE = 5
# Percent of an item's shingles that make a leak.
PERCENT = 80
# Letters and digits of any script count; case, punctuation and spacing do not.
NOT_A_WORD = r"[^\p{L}\p{N}]+"


def _tokens(text):
    return F.array_remove(
        F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD, " "), " "), ""
    )


def _shingles(text, size=SHINGLE, short=()):
    """Array of the shingles of a text. Fewer words than a shingle: all of them, as one.

    `short` are further lengths of word runs that count as shingles too.
    """

    def runs(w, n):
        found = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, found)

    def grams(w):
        whole = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array())
        found = F.coalesce(runs(w, size), whole)
        more = [F.coalesce(runs(w, n), F.array().cast("array<string>")) for n in short]
        return F.concat(found, *more) if more else found

    return let(_tokens(text), grams)


def size_class(n):
    """Upper bound of the size class of n shingles: the next power of two."""
    return F.pow(F.lit(2), F.ceil(F.log2(n.cast("double")))).cast("long")


def signatures(items, percent=PERCENT):
    """(item_id, hash) of each item's smallest hashes, as many as its size class demands.

    `items` has a row per (item_id, shingle, n). A member of a class of up to u shingles may lack
    at most u - ceil(u * percent / 100) of them.
    """
    upper = size_class(F.col("n"))
    lacking = upper - F.ceil(upper * percent / 100).cast("long")
    smallest = Window.partitionBy("item_id").orderBy("hash")
    hashed = items.select("item_id", F.xxhash64("shingle").alias("hash"), lacking.alias("lacking"))
    ranked = hashed.withColumn("place", F.row_number().over(smallest))
    return ranked.where("place <= lacking + 1").select("item_id", "hash")


def find_leaks(docs, benchmark, doc_id="doc_id", text="text", item_id="item_id",
               item_text="text", percent=PERCENT):
    """(doc_id, text_hash, item_id, n_shingles, n_found) for each item that a document holds.

    Shingles are five words, lower-cased, punctuation and spacing ignored; an item is held if the
    document has at least `percent` % of its different shingles. An item of fewer words is one
    shingle, and held by documents with these words in a row. NULL and empty texts hold nothing and are
    held by nothing. Rows that share a doc_id are judged each by its own text, rows repeated in
    full together; a NULL doc_id is a value like others. Items that repeat an item_id count as one
    with all their shingles. Empty tables give no rows.
    """
    # At most the lengths one to four.
    n_words = F.size(_tokens(F.col(item_text)))
    lengths = benchmark.select(n_words.alias("n")).where(F.col("n").between(1, SHINGLE - 1)).distinct()
    short = sorted(row.n for row in lengths.collect())
    items = benchmark.select(
        F.col(item_id).alias("item_id"), F.explode(_shingles(F.col(item_text))).alias("shingle")
    ).distinct()
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n"))
    sizes = sizes.withColumnRenamed("item_id", "of_item")
    items = items.join(sizes, F.col("item_id").eqNullSafe(F.col("of_item"))).drop("of_item")
    items = keep(items, "leak-items")
    # Written, so that the planner knows its size and broadcasts it only if it is small.
    index = keep(signatures(items, percent), "leak-index")
    # A struct compares its fields, NULL with NULL too.
    rows = docs.select(row_key(F.col(doc_id), F.col(text)), F.col(text).alias("text"))
    in_docs = _shingles(F.col("text"), short=short)
    hashes = F.array_distinct(F.transform(in_docs, lambda s: F.xxhash64(s)))
    hashed = rows.select("row", F.explode(hashes).alias("hash"))
    largest = index.agg(F.max("hash")).first()[0]
    if largest is not None:
        hashed = hashed.where(F.col("hash") <= largest)
    candidates = keep(hashed.join(index, "hash").select("row", "item_id").distinct(), "leak-candidates")
    suspects = rows.join(candidates.select("row").distinct(), "row", "left_semi")
    shingles = suspects.select("row", F.explode(F.array_distinct(in_docs)).alias("shingle"))
    shared = shingles.distinct().join(items, "shingle").alias("s")
    of = candidates.alias("c")
    verified = shared.join(
        of,
        (F.col("s.row") == F.col("c.row")) & F.col("s.item_id").eqNullSafe(F.col("c.item_id")),
        "left_semi",
    )
    found = verified.groupBy("row", "item_id", "n").agg(F.count("*").alias("n_found"))
    return found.where(F.col("n_found") * 100 >= F.col("n") * percent).select(
        "row.doc_id", "row.text_hash", "item_id", F.col("n").alias("n_shingles"), "n_found"
    )


def row_key(doc_id, text):
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("text_hash")).alias("row")


def remove_leaks(docs, benchmark, percent=PERCENT):
    """The rows of `docs` (doc_id, text, ...) that hold no benchmark item."""
    leaks = find_leaks(docs, benchmark, percent=percent)
    leaks = keep(leaks.select(F.struct("doc_id", "text_hash").alias("row")).distinct(), "leaks")
    of = row_key(F.col("doc_id"), F.col("text"))
    return docs.join(leaks, of == leaks.row, "left_anti")
