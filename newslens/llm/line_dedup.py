"""Near-duplicate lines by an exact set-similarity join, and removal of the later ones."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from newslens.llm.grams import mix, span_hashes, spans, text_bytes
from newslens.llm.tables import keep

# Jaccard similarity of word sets, in percent.
PERCENT = 80
# Token frequencies are counted by hash in so many slots: a table of bounded size.
SLOTS = 1 << 22
SLOT_BLOCK = 1 << 14
# Bits of the table of lines whose words a check needs; a multiple of 2^15.
BITS = 1 << 27
# Bytes of text that a task takes apart at a time.
CHUNK_BYTES = 2 << 20
# Earlier sets that a set is tried against for each prefix word, before it is tried against all.
TRIES = 8
# Prefix words in a partition, about, and sets that a task deals out at a time.
PART_ROWS = 1 << 20
DEAL_SETS = 1 << 16
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(b" \t\n\v\f\r")] = False
_SALT = np.uint64(0x27D4EB2F165667C5)
_STEP = 40503


def _chunks(batches, column):
    """Slices of batches with a few megabytes of text each, whatever rows a batch holds."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES)))
            yield batch.slice(start, end - start)
            start = end


def _slot(hashes):
    return ((hashes >> np.uint64(8)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _line_spans(data, offsets):
    """(row, number, start) of each line of the texts, in order."""
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(before) + 1)
    first = before[:-1] + np.arange(len(offsets) - 1)
    numbers = np.arange(len(rows)) - first[rows]
    starts = np.empty(len(rows), np.int64)
    starts[first] = offsets[:-1]
    starts[numbers > 0] = breaks + 1
    return rows, numbers, starts


def _sorted_words(sizes, hashes, ranks):
    """(line, hash, rank) of the different words of each line, by line, rank and hash.

    Sorting goes by one number that holds the line, the rank and most of the hash, and by the full
    ones where that number is too short.
    """
    at = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    key = (at << np.uint64(48)) | (ranks.astype(np.uint64) << np.uint64(42)) | (hashes >> np.uint64(22))
    order = np.argsort(key)
    key, by_key = key[order], hashes[order]
    if len(sizes) > 1 << 16 or ((key[1:] == key[:-1]) & (by_key[1:] != by_key[:-1])).any():
        order = np.lexsort((hashes, ranks, at))
    at, hashes = at[order].astype(np.int64), hashes[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (hashes[1:] != hashes[:-1])
    return at[fresh], hashes[fresh], ranks[order][fresh]


def token_ranks(source):
    """Rank of the number of occurrences, by slot of the word: half steps of the binary logarithm.

    Words that occur once have rank 0. The table grows with SLOTS only.
    """

    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        for part in _chunks(batches, 0):
            data, offsets = text_bytes(part.column(0))
            np.add.at(counts, _slot(span_hashes(data, *spans(_IN_WORD[data], offsets))), 1)
        for block in np.flatnonzero(counts.reshape(-1, SLOT_BLOCK).any(axis=1)).tolist():
            some = np.minimum(counts[block * SLOT_BLOCK : (block + 1) * SLOT_BLOCK], 2**32 - 1).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([some.tobytes()])], ["block", "n"])

    def add(batches):
        found = {}
        for batch in batches:
            for block, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found[block] = found.get(block, np.int64(0)) + np.frombuffer(some, "<u4")
        for block, some in found.items():
            ranks = np.floor(2 * np.log2(np.maximum(some, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ranks.tobytes()])], ["block", "ranks"])

    counted = source.select("text").mapInArrow(run, "block int, n binary")
    found = counted.repartition("block").mapInArrow(add, "block int, ranks binary").toArrow()
    ranks = np.zeros((SLOTS // SLOT_BLOCK, SLOT_BLOCK), np.uint8)
    for block, some in zip(found["block"].to_pylist(), found["ranks"].to_pylist(), strict=True):
        ranks[block] = np.frombuffer(some, np.uint8)
    return ranks.reshape(-1)


def _overlap(a, b, percent):
    """Common words that sets of a and b words need: ceil(t / (1 + t) * (a + b))."""
    return F.ceil((a + b) * percent / (100 + percent))


def _signed(values):
    return pa.array(values.view(np.int64))


def lines_of(source, ranks, percent=PERCENT):
    """A row per line with a word: its place, its set's key, size, bitmap and prefix.

    Words are ordered from rare to frequent. The prefix is the first n - ceil(t * n) + 1 of them:
    sets that are similar have a word of their prefixes in common. Words that no other line has
    are the first; they are left out of it, and `skipped` counts them. Sets of n words
    with n / (n + 1) under the threshold have no other similar ones and no prefix. A bit of the bitmap (128 bits in
    two numbers) is the parity of the words on it.
    """
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = source.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        for batch in _chunks(batches, 2):
            data, offsets = text_bytes(batch.column(2))
            words = spans(_IN_WORD[data], offsets)
            if not len(words[0]):
                continue
            rows, lines, starts = _line_spans(data, offsets)
            sizes = np.diff(np.append(np.searchsorted(words[0], starts), len(words[0])))
            rows, lines, sizes = (x[sizes > 0] for x in (rows, lines, sizes))
            hashes = span_hashes(data, *words)
            at, hashes, rank = _sorted_words(sizes, hashes, shared.value[_slot(hashes)])
            start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sizes = np.diff(np.append(start, len(at)))
            place = np.arange(len(at)) - start[at]
            # A set's key: sums of mixed hashes, the same in any order.
            keys = [np.add.reduceat(mix(hashes, np.full_like(hashes, salt)), start) for salt in (_SALT, ~_SALT)]
            bit, low = np.uint64(1) << (hashes >> np.uint64(57) & np.uint64(63)), hashes >> np.uint64(63) == 0
            bits = [np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), start) for half in (low, ~low)]
            length = sizes - (sizes * percent + 99) // 100 + 1
            used = (place < length[at]) & (rank > 0) & (sizes[at] * (100 - percent) >= percent)
            ends = np.concatenate([[0], np.cumsum(np.add.reduceat(used.astype(np.int32), start))])
            skipped = np.add.reduceat((rank == 0).astype(np.int32), start).astype(np.int32)
            tokens = (hashes[used] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            take = pa.array(rows)
            # The number of lines of the text, at its last one.
            ends_text = np.append(rows[1:] != rows[:-1], True)
            ordinal = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(lines.astype(np.int32)),
                 pa.array(ordinal.astype(np.int64), mask=~ends_text), _signed(keys[0]), _signed(keys[1]),
                 pa.array(sizes.astype(np.int32)), *map(_signed, bits), pa.array(skipped),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens))],
                ["doc_id", "text_hash", "line", "n_lines", "key1", "key2", "n", "bits1", "bits2", "skipped", "prefix"],
            )

    return source.mapInArrow(
        run,
        f"doc_id {kind}, text_hash long, line int, n_lines long, key1 long, key2 long, n int, bits1 long, bits2 long, skipped int, prefix array<int>",
    )


def _place():
    return F.struct("doc_id", "text_hash", "line")


def _similar_enough(x, y, percent):
    """Length, positional and bitmap filters on two prefix rows; all are exact bounds.

    Of two similar sets the first common word passes the positional one: no earlier word is common.
    """
    need = _overlap(x["n"], y["n"], percent)
    return (
        (x["n"] * 100 >= y["n"] * percent) & (y["n"] * 100 >= x["n"] * percent)
        & (x["n"] - x["pos"] >= need) & (y["n"] - y["pos"] >= need)
        & (sum(F.bit_count(x[b].bitwiseXOR(y[b])) for b in ("bits1", "bits2")) <= x["n"] + y["n"] - 2 * need)
    )


def _numbered(sets):
    """The sets with `id`, which grows with the place of their first line."""
    return sets.orderBy("place.doc_id", "place.text_hash", "place.line").withColumn("id", F.monotonically_increasing_id())


_PREFIX = {"token": "int", "id": "long", "bits1": "long", "bits2": "long", "n": "int", "pos": "int"}


def _prefix_words(batch, table=None):
    """Arrays of the columns _PREFIX: a place per word of each prefix of a batch of `_prefixes`.

    With a table of bits, of the words whose bit it has.
    """
    prefix = batch.column(5)
    sizes, token = np.diff(prefix.offsets.to_numpy()), prefix.flatten().to_numpy()
    of = np.repeat(np.arange(batch.num_rows), sizes)
    pos = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if table is not None:
        wanted = np.flatnonzero(_has_bit(table, token.astype(np.int64) & (BITS - 1)))
        token, of, pos = token[wanted], of[wanted], pos[wanted]
    found = [token, *(batch.column(i).to_numpy()[of] for i in range(4))]
    return [*found, (pos + batch.column(4).to_numpy()[of]).astype(np.int32)]


def _prefixes(sets):
    return sets.select("id", "bits1", "bits2", "n", "skipped", "prefix")


def _prefix_rows(sets, table=None):
    """A row per word of each prefix; with a table of bits, of at least the words whose bit it has."""
    shared = None if table is None else sets.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            found = _prefix_words(batch, None if shared is None else shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], list(_PREFIX))

    return _prefixes(sets).mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in _PREFIX.items()))


def _dealt_words(sets, parts):
    """The words of the prefixes by partition: each task gives a row of arrays per partition and some sets."""

    def deal(batches):
        found = [np.concatenate(c) for c in zip(*map(_prefix_words, batches), strict=True)]
        part = found[0].view(np.uint32) % np.uint32(parts)
        order = np.argsort(part, kind="stable")
        sizes = np.bincount(part, minlength=parts)
        some = np.flatnonzero(sizes)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in found]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *lists], ["part", *_PREFIX])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= DEAL_SETS:
                yield deal(held)
                held, n = [], 0
        if n:
            yield deal(held)

    kinds = ", ".join(f"{c} array<{kind}>" for c, kind in _PREFIX.items())
    return _prefixes(sets).mapInArrow(run, f"part int, {kinds}").repartitionById(parts, F.col("part"))


def _columns(side):
    return {c: F.col(f"{side}.{c}") for c in ("n", "pos", "bits1", "bits2")}


def _pairs(x, y, percent):
    """(later, earlier) sets of x and y with a prefix word in common that pass the filters."""
    rule = (F.col("a.token") == F.col("b.token")) & (F.col("b.id") < F.col("a.id"))
    rule &= _similar_enough(_columns("a"), _columns("b"), percent)
    return x.alias("a").join(y.alias("b"), rule).select(F.col("a.id").alias("later"), F.col("b.id").alias("earlier"))


def _first_partners(token, ids, bits1, bits2, n, pos, percent):
    """(later, earlier, more): for each row, the first TRIES earlier rows of its word that pass the filters.

    `more` says that there may be others. In step k the rows of all words are tried against row k
    of their word; those with enough partners drop out, so near copies leave after a few steps.
    """
    order = np.lexsort((ids, token))
    token, ids, n, pos = (x[order] for x in (token, ids, n.astype(np.int64), pos.astype(np.int64)))
    # Unsigned: of negative numbers numpy counts the bits of the absolute value.
    bits1, bits2 = (x[order].view(np.uint64) for x in (bits1, bits2))
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    first = np.repeat(first, np.diff(np.append(first, len(token))))
    # Differing words that a row's share of the bound allows, a little more for rounding.
    share = (n * (100 - percent) / (100 + percent) + 0.01).astype(np.float32)
    place = np.arange(len(token)) - first
    row = np.argsort(-place, kind="stable")
    tries, found, step = np.zeros(len(token), np.int8), [], 0
    at, bits, own, depth = first[row], bits1[row], share[row], -place[row]
    while True:
        # The rows after `step` in their word.
        end = np.searchsorted(depth, -step)
        if not end:
            break
        other = at[:end] + step
        # What half of the bitmap allows at most; the exact bounds follow for the few that are left.
        near = np.flatnonzero(np.bitwise_count(bits[:end] ^ bits1[other]) <= own[:end] + share[other])
        x, y = row[near], other[near]
        need = -(-(n[x] + n[y]) * percent // (100 + percent))
        good = (n[x] * 100 >= n[y] * percent) & (n[y] * 100 >= n[x] * percent) & (n[x] - pos[x] >= need) & (n[y] - pos[y] >= need)
        apart = np.bitwise_count(bits1[x] ^ bits1[y]).astype(np.int64) + np.bitwise_count(bits2[x] ^ bits2[y])
        good &= (apart <= n[x] + n[y] - 2 * need) & (tries[x] < TRIES)
        x, y = x[good], y[good]
        tries[x] += 1
        found.append((ids[x], ids[y], tries[x] == TRIES))
        step += 1
        if step & (step - 1) == 0:
            left = tries[row] < TRIES
            row, at, bits, own, depth = (c[left] for c in (row, at, bits, own, depth))
    return [np.concatenate(part) for part in zip(*found, strict=True)] if found else [ids[:0], ids[:0], np.zeros(0, bool)]


def _candidates(sets, percent):
    """(later, earlier, more) pairs of sets that may be similar, TRIES at most per set and prefix word.

    A set that has no similar one among them, though there are more, has to be tried against all.
    """
    total = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS))

    def run(batches):
        found = [[c.flatten().to_numpy() for c in batch.columns[1:]] for batch in batches]
        if not found:
            return
        found = _first_partners(*(np.concatenate(c) for c in zip(*found, strict=True)), percent)
        for start in range(0, len(found[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[start : start + (1 << 16)]) for c in found], ["later", "earlier", "more"])

    pairs = _dealt_words(sets, parts).mapInArrow(run, "later long, earlier long, more boolean")
    return pairs.groupBy("later", "earlier").agg(F.max("more").alias("more"))


def _bit(doc_key, line):
    """Bit of a line in the table of wanted lines, for columns and for arrays; that of a text with any is `doc_key`."""
    return (doc_key + (line + 1) * _STEP) % BITS


def _doc_key(doc_id, text_hash):
    return F.xxhash64(doc_id, text_hash).bitwiseAND(F.lit(BITS - 1))


def _bit_table(bits):
    """Table of BITS bits with those that the rows of `bit` name."""
    wanted = bits.select((F.col("bit") + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
    found = wanted.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).toArrow()
    table = np.zeros((BITS >> 15) * 4096, np.uint8).reshape(-1, 4096)
    for bucket, some in zip(found["bucket"].to_pylist(), found["bits"].to_pylist(), strict=True):
        table[bucket - 1] = np.frombuffer(some, np.uint8)
    return table.reshape(-1)


def _has_bit(table, bits):
    return ((table[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1) > 0


def _line_words(source, places):
    """(place, words) of at least the lines at `places`: the hashes of their different words.

    Texts are not shuffled. The lines are found by a table of BITS bits; where others fall on the
    same bits, they come along and no pair asks for them.
    """
    doc_key = _doc_key("place.doc_id", "place.text_hash")
    bits = F.array(doc_key, _bit(doc_key, F.col("place.line").cast("long")))
    shared = source.sparkSession.sparkContext.broadcast(_bit_table(places.select(F.explode(bits).alias("bit"))))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        table = shared.value
        some = (batch.filter(pa.array(_has_bit(table, batch.column(2).to_numpy()))) for batch in batches)
        for batch in _chunks(some, 3):
            data, offsets = text_bytes(batch.column(3))
            rows, lines, starts = _line_spans(data, offsets)
            bits = _bit(batch.column(2).to_numpy()[rows], lines)
            words = spans(_IN_WORD[data], offsets)
            sizes = np.diff(np.append(np.searchsorted(words[0], starts), len(words[0])))
            wanted = _has_bit(table, bits) & (sizes > 0)
            hit = np.flatnonzero(wanted)
            if not len(hit):
                continue
            used = np.repeat(wanted, sizes)
            hashes = span_hashes(data, *(x[used] for x in words))
            at, hashes, _ = _sorted_words(sizes[hit], hashes, np.zeros(len(hashes), np.uint8))
            ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(hit)))]).astype(np.int32)
            take = pa.array(rows[hit])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(lines[hit].astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends), _signed(hashes))],
                ["doc_id", "text_hash", "line", "words"],
            )

    keyed = source.select("doc_id", "text_hash", _doc_key("doc_id", "text_hash").alias("doc_key"), "text")
    sets = keyed.mapInArrow(run, f"doc_id {kind}, text_hash long, line int, words array<long>")
    # Rows repeated in full are one document.
    return sets.groupBy(_place().alias("place")).agg(F.first("words").alias("words"))


def _verified(source, sets, pairs, percent):
    """The later sets of the pairs whose Jaccard similarity is high enough."""
    ids = pairs.select(F.col("later").alias("id")).union(pairs.select("earlier")).distinct()
    places = keep(sets.select("id", "place").join(ids, "id"), "line-places")
    words = places.join(_line_words(source, places), "place")
    words = keep(words.select("id", "words"), "line-words")
    both = pairs.join(words.select(F.col("id").alias("later"), F.col("words").alias("a")), "later")
    both = both.join(words.select(F.col("id").alias("earlier"), F.col("words").alias("b")), "earlier")
    common = F.size(F.array_intersect("a", "b"))
    counted = both.select("later", common.alias("common"), (F.size("a") + F.size("b")).alias("total"))
    return counted.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("later").distinct()


def removed_lines(docs, doc_id="doc_id", text="text", percent=PERCENT):
    """(source, counted, removed): identified texts, (doc_id, text_hash, n_lines) of those with lines, and (doc_id, text_hash, line) of each removed line, perhaps repeated."""
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"),
        F.col(text).cast("binary").alias("text"),
    )
    lines = keep(lines_of(source, token_ranks(source), percent), "lines")
    payload = F.struct(_place().alias("place"), "n", "bits1", "bits2", "skipped", "prefix")
    sets = lines.groupBy("key1", "key2").agg(F.min(payload).alias("first"), F.count("*").alias("lines"))
    sets = keep(_numbered(sets.select("key1", "key2", "lines", "first.*")), "line-sets")
    firsts = sets.where("lines > 1").select("key1", "key2", F.col("place").alias("first"))
    copies = lines.join(firsts, ["key1", "key2"]).where(_place() != F.col("first")).select("doc_id", "text_hash", "line")
    pairs = keep(_candidates(sets, percent), "line-pairs")
    matched = keep(_verified(source, sets, pairs, percent), "line-matches")
    # Sets that were tried in vain, and not against all: against all earlier ones.
    failed = pairs.where("more").select(F.col("later").alias("id")).distinct()
    failed = failed.join(matched, F.col("id") == F.col("later"), "left_anti")
    probes = keep(_prefix_rows(sets.join(failed, "id", "left_semi")), "line-probes")
    if not probes.isEmpty():
        table = _bit_table(probes.select(F.col("token").cast("long").bitwiseAND(F.lit(BITS - 1)).alias("bit")))
        rows = _prefix_rows(sets, table)
        late = keep(_pairs(probes, rows, percent).distinct(), "line-late-pairs")
        matched = matched.union(keep(_verified(source, sets, late, percent), "line-late-matches"))
    found = matched.distinct().withColumnRenamed("later", "id")
    found = sets.select("id", "place").join(found, "id", "left_semi").select("place.*")
    counted = lines.where("n_lines IS NOT NULL").select("doc_id", "text_hash", "n_lines")
    return source, counted, copies.unionByName(found)


def line_decisions(docs, **options):
    """(doc_id, n_lines, n_removed, removed) for each row: numbers of its removed lines.

    Lines are ordered by doc_id, text and number; those without a word are left alone. A line goes
    if an earlier one has the same set of words, or one whose Jaccard similarity is `percent` %
    or more, be that line removed itself or not. Rows repeated in full are one document, and are
    returned as often as they came; NULL ids come first. NULL and empty texts have no lines. An
    empty table gives no rows.
    """
    source, counted, removed = removed_lines(docs, **options)
    known = removed.withColumn("n_lines", F.lit(None).cast("long")).unionByName(counted.withColumn("line", F.lit(None).cast("int")))
    per_text = known.groupBy("doc_id", "text_hash").agg(
        F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("line")).alias("removed")
    )
    narrow = source.select("doc_id", "text_hash")
    joined = narrow.join(
        per_text, narrow.doc_id.eqNullSafe(per_text.doc_id) & (narrow.text_hash == per_text.text_hash), "left"
    )
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    n_lines = F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines")
    return joined.select(narrow.doc_id, n_lines, F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def remove_lines(docs, doc_id="doc_id", text="text", **options):
    """(doc_id, text) of each row without its removed lines."""
    source, _, removed = removed_lines(docs, doc_id, text, **options)
    per_text = removed.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("removed"))
    joined = source.join(
        per_text, source.doc_id.eqNullSafe(per_text.doc_id) & (source.text_hash == per_text.text_hash), "left"
    )
    kept = F.filter(
        F.split(F.col("text").cast("string"), "\n", -1),
        lambda _, n: ~F.array_contains(F.coalesce("removed", F.array().cast("array<int>")), n),
    )
    return joined.select(source.doc_id, F.array_join(kept, "\n").alias("text"))
