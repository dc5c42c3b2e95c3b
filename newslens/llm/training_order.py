"""Token sequences in training order: a keyed Feistel permutation gives each a global slot."""

import base64
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import functions as F

from newslens.llm.grams import mix
from newslens.session import scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the vocabulary's texts were split into pieces, and its free id: fixed values.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256
LENGTH = 512
SHARD_SEQUENCES = 16384
KEY = 20240131
ROUNDS = 6


def feistel(index, bits, key=KEY):
    """Keyed permutation of the integers of 2 * bits bits (uint64 arrays)."""
    mask, width = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = index >> width, index & mask
    for turn in range(ROUNDS):
        keyed = mix(right, np.full_like(right, (key * ROUNDS + turn) % (1 << 64)))
        left, right = right, left ^ (keyed & mask)
    return (left << width) | right


def slots(index, n, key=KEY):
    """Keyed permutation of 0 .. n-1: those thrown out of the range are permuted on (cycle walking)."""
    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    found = feistel(np.asarray(index, np.uint64), bits, key)
    outside = found >= n
    while outside.any():
        found[outside] = feistel(found[outside], bits, key)
        outside = found >= n
    return found.astype(np.int64)


def _encoding(lines):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _cut(batch, encoding, length, end_of_text):
    """(row, piece, ids as bytes) of each sequence of a batch of (doc_id, text)."""
    for row, text in enumerate(batch.column(1).to_pylist()):
        ids = encoding.encode_to_numpy(text, disallowed_special=())
        ids = np.append(ids, end_of_text).astype("<u2")
        for piece, start in enumerate(range(0, len(ids), length)):
            yield row, piece, ids[start : start + length].tobytes()


def _count(source, lines, length, end_of_text):
    """(writer, n, sum) of each task that has sequences: their number, and a checksum of them in order."""

    def run(batches):
        encoding, n, check = _encoding(lines), 0, 0
        for batch in batches:
            for _, _, tokens in _cut(batch, encoding, length, end_of_text):
                n, check = n + 1, zlib.crc32(tokens, check)
        yield pa.RecordBatch.from_pydict({"writer": [TaskContext.get().partitionId()], "n": [n], "sum": [check]})

    return source.mapInArrow(run, "writer long, n long, sum long").where("n > 0")


def training_order(docs, vocabulary=VOCABULARY, length=LENGTH, shard_sequences=SHARD_SEQUENCES,
                   key=KEY, end_of_text=END_OF_TEXT):
    """(slot, shard, doc_id, piece, n_tokens, tokens) of each sequence, in slot order.

    Texts are cut into runs of up to `length` ids, little-endian, two bytes each (a vocabulary of up
    to 65,536 ids). Each text ends in `end_of_text`. The sequences are numbered 0 .. n-1 by task and
    place within it; slot is that number under a keyed permutation, so training order is random but
    needs no sort key and can be recomputed from the number. A first pass counts the sequences of
    each task, a second makes them again: tokens are never written before their one shuffle.
    `docs` must give its tasks the same rows in the same order each time, as files do: a task that
    finds others fails.

    Partition s holds the slots of shard s, sorted. NULL and empty texts are one sequence of the end
    id. Every row counts, repeated ones too. An empty table gives no rows.
    """
    with open(vocabulary, "rb") as file:
        lines = file.read()
    source = docs.select(
        F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    # A row per task.
    counted = sorted(map(tuple, _count(source, lines, length, end_of_text).collect()))
    known, total = {}, 0
    for writer, n, check in counted:
        known[writer] = (total, n, check)
        total += n
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        encoding, place, check = _encoding(lines), 0, 0
        before, n, stated = shared.value.get(TaskContext.get().partitionId(), (0, 0, 0))
        for batch in batches:
            found = list(_cut(batch, encoding, length, end_of_text))
            if not found:
                continue
            rows, pieces, tokens = zip(*found, strict=True)
            for part in tokens:
                check = zlib.crc32(part, check)
            if place + len(rows) > n:
                break
            slot = slots(np.arange(before + place, before + place + len(rows)), total, key)
            place += len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array((slot // shard_sequences).astype(np.int32)), batch.column(0).take(pa.array(rows, pa.int64())),
                 pa.array(pieces, pa.int32()), pa.array([len(t) // 2 for t in tokens], pa.int32()), pa.array(tokens, pa.binary())],
                ["slot", "shard", "doc_id", "piece", "n_tokens", "tokens"],
            )
        if (place, check) != (n, stated):
            raise ValueError("the rows of a task differ from those that were counted; write them to files first")

    placed = source.mapInArrow(run, f"slot long, shard int, doc_id {kind}, piece int, n_tokens int, tokens binary")
    shards = max(1, -(-total // shard_sequences))
    return placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")


# --------------------------------------------------------------------------------------- files

# Bytes of a record's origin: 1 where doc_id is not NULL, doc_id, and the number of the piece.
ORIGIN = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("piece", "<i4")])


def stride(length=LENGTH, origin=False):
    """Bytes of a record: the number of tokens (two bytes), its origin, `length` ids, and a line break."""
    return 2 + ORIGIN.itemsize * origin + 2 * length + 1


def write_shards(ordered, path, length=LENGTH, origin=False):
    """Write ordered sequences as one file per shard, part-<shard>, with records of fixed stride.

    Slot s is record s % shard_sequences of shard s // shard_sequences. With `origin`, records also
    hold doc_id, an integer, and piece. Spark's own writer ends each record with a line break, and
    reaches any file system.
    """
    if origin and ordered.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("only integers as doc_id have a place in a record")

    def run(batches):
        for batch in batches:
            counts, tokens = batch.column(0).to_numpy().astype("<u2"), batch.column(1).to_pylist()
            heads = [n.tobytes() for n in counts]
            if origin:
                ids, from_ = batch.column(2), np.zeros(len(heads), ORIGIN)
                from_["known"] = ids.is_valid().to_numpy(zero_copy_only=False)
                from_["doc_id"] = ids.fill_null(0).to_numpy()
                from_["piece"] = batch.column(3).to_numpy()
                heads = [n + o.tobytes() for n, o in zip(heads, from_, strict=True)]
            records = [h + t.ljust(2 * length, b"\0") for h, t in zip(heads, tokens, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    of = [F.col("doc_id").cast("long"), "piece"] if origin else []
    records = ordered.select("n_tokens", "tokens", *of).mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\n").text(path)


def read_shards(spark, path, first_slot=0, length=LENGTH, shard_sequences=SHARD_SEQUENCES, origin=False):
    """(slot, tokens) from `first_slot` on, a partition per shard, in order: reading can be resumed anywhere.

    With `origin`, for files written so: (slot, shard, doc_id, piece, n_tokens, tokens).
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    files = files.withColumn("shard", F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int"))
    files = files.withColumn("first", F.col("shard").cast("long") * shard_sequences)
    files = files.withColumn("skip", F.greatest(F.lit(first_slot) - F.col("first"), F.lit(0)))
    step = stride(length, origin)
    files = files.where(F.col("skip") * step < F.col("length"))
    last = files.agg(F.max("shard")).first()[0]
    files = files.repartitionById((last or 0) + 1, F.col("shard"))
    head = 2 + ORIGIN.itemsize * origin
    names = ["slot", "shard", "doc_id", "piece", "n_tokens", "tokens"] if origin else ["slot", "tokens"]

    def run(batches):
        for batch in batches:
            for uri, size, shard, first, skip in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                uri = uri.replace("file:/", "file:///", 1) if not uri.startswith("file://") else uri
                system, place = pyarrow.fs.FileSystem.from_uri(uri)
                with system.open_input_file(place) as file:
                    file.seek(skip * step)
                    for start in range(skip, size // step, 1024):
                        block = file.read(step * min(1024, size // step - start))
                        cut = [block[i : i + step] for i in range(0, len(block), step)]
                        counts = [int.from_bytes(r[:2], "little") for r in cut]
                        columns = {
                            "slot": pa.array(range(first + start, first + start + len(cut)), pa.int64()),
                            "tokens": pa.array([r[head : head + 2 * n] for r, n in zip(cut, counts, strict=True)], pa.binary()),
                        }
                        if origin:
                            of = np.frombuffer(b"".join(r[2:head] for r in cut), ORIGIN)
                            columns |= {
                                "shard": pa.array([shard] * len(cut), pa.int32()),
                                "doc_id": pa.array(of["doc_id"].copy(), mask=of["known"] == 0),
                                "piece": pa.array(of["piece"].copy()), "n_tokens": pa.array(counts, pa.int32()),
                            }
                        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    kinds = {"slot": "long", "shard": "int", "doc_id": "long", "piece": "int", "n_tokens": "int", "tokens": "binary"}
    return files.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def through_shards(docs, length=LENGTH, shard_sequences=SHARD_SEQUENCES, **options):
    """The rows of `training_order`, written as shard files in the shared folder and read back from them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "training-shards")
    ordered = training_order(docs, length=length, shard_sequences=shard_sequences, **options)
    write_shards(ordered, path, length, origin=True)
    return read_shards(spark, path, length=length, shard_sequences=shard_sequences, origin=True)
