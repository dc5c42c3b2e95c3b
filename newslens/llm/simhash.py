"""SimHash near-duplicates, found with keys from the binary Golay code."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from newslens.llm.components import connected_components
from newslens.llm.tables import keep

SEED = 42
SHINGLE = 3
MAX_BITS = 2
# Fingerprint bits go to three segments, each padded with zeros to the code's 23 bits.
WIDTHS = (22, 21, 21)
STARTS = (0, 22, 43)
CODE_BITS = 23
INDEX_BITS = 12
# Generator polynomial of the (23, 12) code: a fixed value.
GENERATOR = 0b110001110101
# Members of a bucket that are compared pair by pair; fuller buckets are linked by midpoints.
PAIR_BUCKET = 32


def fingerprint(text, shingle=SHINGLE):
    """Signed 64-bit fingerprint of UTF-8 bytes: A-Z lowered, `shingle`-word shingles, XXH64.

    A bit is 1 if it is set in over half of the shingle hashes. No words: 0.
    """
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) < shingle:
        grams = iter([b" ".join(tokens)])
    else:
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(shingle)), strict=False))
    total = max(1, len(tokens) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, total, 1 << 16):
        count = min(1 << 16, total - start)
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(next(grams), SEED) for _ in range(count)), np.uint64, count
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs, doc_id="doc_id", text="text"):
    """(doc_id, fingerprint) for each row. NULL and empty texts have fingerprint 0."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fingerprint"]
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, fingerprint long")


def _syndromes(vectors):
    """Remainders of 23-bit vectors by the generator polynomial."""
    rest = vectors.copy()
    for bit in range(CODE_BITS - 1, CODE_BITS - INDEX_BITS - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - CODE_BITS + INDEX_BITS))
    return rest


def _error_patterns():
    """The only error of weight 0 to 3 for each of the 2,048 syndromes: the code is perfect."""
    one = 1 << np.arange(CODE_BITS, dtype=np.int64)
    pairs = (one[:, None] | one[None, :]).ravel()
    triples = (pairs[:, None] | one[None, :]).ravel()
    errors = np.unique(np.concatenate([[0], one, pairs, triples]))
    table = np.zeros(1 << (CODE_BITS - INDEX_BITS), np.int64)
    table[_syndromes(errors)] = errors
    return table


def nearby_indices(vectors, table):
    """A row of 24 codeword indices per 23-bit vector: its own and those of its one-bit changes.

    Vectors that differ in two bits or fewer have a common vector within one bit of both, and so
    a common index. A row holds one or six different indices.
    """
    near = vectors[:, None] ^ np.concatenate([[0], 1 << np.arange(CODE_BITS, dtype=np.int64)])
    return (near ^ table[_syndromes(near)]) >> (CODE_BITS - INDEX_BITS)


def _bucket_keys(prints):
    """(key, fingerprint): up to 18 keys per fingerprint.

    Two differing bits leave one of three segments without an error (pigeonhole), and put at most
    two into the segment after it. A key is an unchanged segment with a codeword index near the
    next one, so fingerprints that link have a key in common.
    """

    def run(batches):
        table = _error_patterns()
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            unsigned = values.view(np.uint64)
            parts = [
                ((unsigned >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64)
                for start, width in zip(STARTS, WIDTHS, strict=True)
            ]
            for s in range(3):
                near = np.sort(nearby_indices(parts[(s + 1) % 3], table), axis=1)
                first = np.ones(near.shape, bool)
                first[:, 1:] = near[:, 1:] != near[:, :-1]
                rows, _ = np.nonzero(first)
                keys = (s << 36) | (parts[s][rows] << INDEX_BITS) | near[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(values[rows])], ["key", "fingerprint"]
                )

    return prints.mapInArrow(run, "key long, fingerprint long")


def _pair_links(members):
    """Verified pairs of the small buckets, formed inside the row that holds a bucket."""
    buckets = members.groupBy("key").agg(F.collect_list("fingerprint").alias("prints"))
    pairs = F.flatten(
        F.transform(
            "prints",
            lambda a, i: F.transform(
                F.filter(
                    F.slice("prints", i + 2, F.size("prints")),
                    lambda b: F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS,
                ),
                lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")),
            ),
        )
    )
    return buckets.select(F.inline(pairs))


def _midpoint_links(members):
    """Links of the full buckets, without pairs.

    Members of a bucket agree in one segment. Each names the vectors within one bit of it outside
    that segment; fingerprints that name a common vector differ in two bits or fewer, and all that
    differ so do. At most 65 fingerprints lie within one bit of a vector, so linking them to the
    smallest takes few rows, however full the bucket.
    """
    places = members.select(F.shiftright("key", 36).alias("segment"), "fingerprint").distinct()
    flips = F.expr("transform(sequence(0, 63), i -> shiftleft(1L, i))")
    starts, widths = (F.array(*map(F.lit, x)) for x in (STARTS, WIDTHS))
    start = starts[F.col("segment").cast("int")]
    end = start + widths[F.col("segment").cast("int")]
    outside = F.filter(flips, lambda _, i: (i < start) | (i >= end))
    near = places.select(
        "fingerprint",
        F.explode(F.concat(F.array(F.lit(0).cast("long")), outside)).alias("flip"),
    ).select(F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("middle"), "fingerprint")
    around = near.groupBy("middle").agg(F.collect_set("fingerprint").alias("prints"))
    return around.where(F.size("prints") > 1).select(
        F.array_min("prints").alias("a"), F.explode("prints").alias("b")
    ).where("a != b")


def fingerprint_links(prints, pair_bucket=PAIR_BUCKET):
    """Links (a, b) that connect all distinct fingerprints differing in two bits or fewer.

    In buckets of up to `pair_bucket` members every verified pair is a link; in fuller ones the
    links have the same connected components.
    """
    distinct = prints.select("fingerprint").distinct()
    keys = _bucket_keys(distinct)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = keep(keys.join(sizes, "key"), "simhash-buckets")
    small = _pair_links(members.where(F.col("n") <= pair_bucket))
    full = _midpoint_links(members.where(F.col("n") > pair_bucket))
    return small.unionByName(full).distinct()


def near_duplicates(docs, doc_id="doc_id", text="text"):
    """(doc_id, fingerprint, component_id) for each row of `docs`.

    Documents whose fingerprints differ in two bits or fewer are linked; component_id is the
    smallest doc_id that links reach, the row's own included. Texts that are NULL, empty or blank
    have fingerprint 0 and are linked like any others. Repeated rows and ids come back as often
    as they came. A NULL id keeps its row; it is component_id only where no other id is reachable.
    """
    prints = keep(fingerprints(docs, doc_id, text), "simhash-prints")
    smallest = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest"))
    roots = connected_components(fingerprint_links(prints), "simhash-links")
    grouped = smallest.join(roots, smallest.fingerprint == roots.node, "left").select(
        "fingerprint", "smallest", F.coalesce("root", "fingerprint").alias("root")
    )
    grouped = keep(grouped, "simhash-groups")
    ids = grouped.groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_print = grouped.join(ids, "root").select("fingerprint", "component_id")
    return prints.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs):
    """The rows of `docs` (doc_id, text, ...) that come first, by doc_id, in their component.

    Rows repeated in full are one document, of which one row stays; rows that share an id are
    told apart by their texts. Other columns, whatever their names, stay as they are.
    """
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"))
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    first = keep(first, "simhash-first")
    # A name that no column has, in any case.
    name = "_key"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    keyed = docs.withColumn(name, key)
    kept = keyed.join(first, keyed[name] == first["first"], "left_semi")
    return kept.dropDuplicates([name]).drop(name)
