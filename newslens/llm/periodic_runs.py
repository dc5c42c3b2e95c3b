"""Runs of words that repeat with a period, by scale: tiles per period octave, stitched by document."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from newslens.llm.grams import run_hashes
from newslens.llm.tables import keep, let, words

# A run has so many periods, and so many words, at least.
MIN_PERIODS = 4
MIN_WORDS = 6
# Words of a tile, without its overlaps; where periods are long, a tile has TILE_PERIODS of them.
TILE = 1024
TILE_PERIODS = 4
# Words of tiles that one task solves.
TASK_WORDS = 1 << 20


def _grid(octave):
    """Distance of the boundaries in an octave of periods p in [2^octave, 2^(octave + 1)).

    The words of a run that equal those p later are 3 p in a row or more, and five or more. So
    they hold a whole stretch between two boundaries.
    """
    return max(3, 1 << octave)


def _seeds(ids, octave):
    """Boundaries from which words up to the next boundary come again a period of the octave later.

    A hash at each boundary is compared with those of all the octave's periods in one step. Every
    run has such boundaries, from the third octave on two in a row; what else is found here is
    sorted out by comparing words.
    """
    grid, low = _grid(octave), 1 << octave
    hashes = run_hashes(ids, grid)
    at = np.arange(0, len(hashes) - low, grid)
    if not len(at):
        return at
    later = np.concatenate([hashes[low:], np.zeros(low + grid, np.uint64)])
    views = np.lib.stride_tricks.sliding_window_view(later, low)
    found = []
    step = max(1, (1 << 20) // low)
    for i in range(0, len(at), step):
        some = at[i : i + step]
        rows, periods = np.nonzero(views[some] == hashes[some, None])
        real = some[rows] + low + periods < len(hashes)
        found.append((i + rows[real]) * low + periods[real])
    found = np.concatenate(found)
    if grid == low:
        found = found[np.isin(found + low, found) | np.isin(found - low, found)]
    return np.unique(found // low) * grid


def tiles(texts):
    """(number of the text, octave, first word, boundaries, words) of the tiles that hold boundaries.

    `texts` are arrays of word numbers; those of one call are searched together, long ones first,
    so that each octave's search takes the texts that are long enough for it. A tile has a core,
    whose boundaries it looks after, one grid step before it, and behind it what words at its last
    boundary are compared with. Boundaries are counted from the tile's first word.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    ends = np.cumsum(sizes)
    # The same word has another number in each text.
    ids = np.concatenate([texts[i] | np.uint64(n << 32) for n, i in enumerate(order)] or [np.zeros(0, np.uint64)])
    octave = 0
    while True:
        n_long = int((sizes >= max(MIN_WORDS, MIN_PERIODS << octave)).sum())
        if not n_long:
            return
        grid = _grid(octave)
        core = max(TILE, TILE_PERIODS << octave)
        at = _seeds(ids[: ends[n_long - 1]], octave)
        text = np.searchsorted(ends, at, "right")
        at = at - (ends - sizes)[text]
        key = text << 32 | at // core
        for start_at, end_at in _stretches(key):
            i, tile = order[text[start_at]], int(at[start_at]) // core
            start = max(0, tile * core - grid)
            words = texts[i][start : (tile + 1) * core + 2 * grid + (2 << octave)].astype(np.int32)
            yield i, octave, start, (at[start_at:end_at] - start).astype(np.int32), words
        octave += 1


def _stretches(key):
    """(from, to) of the stretches of equal neighbours."""
    if not len(key):
        return []
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    return zip([0, *cuts], [*cuts, len(key)], strict=True)


def z_function(words):
    """For each place, how many words from there on equal those at the beginning."""
    n = len(words)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        if i < right and z[i - left] < right - i:
            z[i] = z[i - left]
            continue
        k = max(0, right - i)
        while i + k < n and words[k] == words[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def fragments(octave, boundaries, words):
    """{period: [(from, to), ...]}: where words of a tile equal those a period later.

    At each boundary, a Z-function of the words behind it tells for every period how far they
    repeat to the right, one of the words before it, backwards, how far to the left; each looks
    as far as the next boundary does.
    """
    grid, low = _grid(octave), 1 << octave
    found = {}
    for c in boundaries:
        right = z_function(words[c : c + 2 * grid + 2 * low])
        # Backwards from the boundary: the words before it, a mark, the words before boundary + p.
        behind = words[max(0, c - grid) : c][::-1]
        ahead = words[max(0, c - grid) : c + 2 * low][::-1]
        left = z_function([*behind, None, *ahead])
        for p in range(low, min(2 * low, len(right))):
            if right[p] < grid:
                continue
            more = left[len(behind) + 1 + len(ahead) - (min(c, grid) + p)] if behind else 0
            start, end = c - min(more, len(behind)), c + min(right[p], 2 * grid)
            spans = found.setdefault(p, [])
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(end, spans[-1][1])
            else:
                spans.append([start, end])
    return found


DOC = ["doc_id", "text_hash"]
_INTS = pa.list_(pa.int32())
# What one pass over the texts gives: documents (octave NULL) and tiles (n_words NULL).
_PARTS = [
    ("n_words", pa.int64()), ("tiled", pa.bool_()), ("words_joined", pa.string()), ("octave", pa.int32()),
    ("first", pa.int64()), ("boundaries", _INTS), ("words", _INTS),
]
_BATCH_WORDS = 1 << 20


def _taken_apart(docs, doc_id, text):
    """A row per document with its words joined by one space, and a row per tile."""
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"),
        F.col(text).cast("binary").alias("text"),
    )

    def batch_of(batch, places, parts):
        at = pa.array(places, pa.int32())
        columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*parts, strict=True), _PARTS, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), *columns], DOC + [name for name, _ in _PARTS]
        )

    def searched(batch, places, texts):
        """Batches of the rows of some texts, whose words are counted from `places` on."""
        ids, joined = [], []
        for words in texts:
            numbers = {}
            ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words)))
            joined.append(b" ".join(words).decode("utf-8", "replace"))
        at, parts, held, tiled = [], [], 0, [False] * len(texts)
        for i, octave, first, boundaries, words in tiles(ids):
            tiled[i] = True
            at.append(places[i])
            parts.append((None, None, None, octave, first, boundaries, words))
            held += len(words)
            if held > _BATCH_WORDS:
                yield batch_of(batch, at, parts)
                at, parts, held = [], [], 0
        whole = zip(map(len, texts), tiled, joined, strict=True)
        yield batch_of(batch, at + places, parts + [(*row, None, None, None, None) for row in whole])

    def run(batches):
        for batch in batches:
            places, texts, held = [], [], 0
            for i, body in enumerate(batch.column(2)):
                places.append(i)
                texts.append((body.as_py() or b"").split())
                held += len(texts[-1])
                if held > _BATCH_WORDS:
                    yield from searched(batch, places, texts)
                    places, texts, held = [], [], 0
            if texts:
                yield from searched(batch, places, texts)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"doc_id {kind}, text_hash long, n_words long, tiled boolean, words_joined string, octave int, "
        "first long, boundaries array<int>, words array<int>",
    )


def _solved(found):
    """(doc_id, text_hash, period, start, end) of the fragments of each tile."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, out = [], []
            columns = (batch.column(i).to_pylist() for i in range(2, 6))
            for i, (octave, first, boundaries, words) in enumerate(zip(*columns, strict=True)):
                for period, spans in fragments(octave, boundaries, words).items():
                    rows += [i] * len(spans)
                    out += [(period, first + start, first + end) for start, end in spans]
            at = pa.array(rows, pa.int32())
            numbers = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(numbers[:, c]) for c in range(3))],
                [*DOC, "period", "start", "end"],
            )

    return found.mapInArrow(run, f"doc_id {kind}, text_hash long, period long, start long, end long")


def _stitched(pieces):
    """(doc_id, text_hash, start, length, period) of the runs.

    Fragments of a document and period that overlap or meet are one stretch. A stretch of four
    periods or more has no smaller period, unless that is a divisor with the very same stretch.
    """
    spot = Window.partitionBy(*DOC, "period").orderBy("start", "end")
    earlier = spot.rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col("start") > F.coalesce(F.max("end").over(earlier), F.lit(-1))).cast("long")
    numbered = pieces.withColumn("opens", opens).withColumn(
        "stretch", F.sum("opens").over(spot.rowsBetween(Window.unboundedPreceding, 0))
    )
    stretches = numbered.groupBy(*DOC, "period", "stretch").agg(
        F.min("start").alias("start"), (F.max("end") - F.min("start") + F.col("period")).alias("length")
    )
    long = stretches.where((F.col("length") >= MIN_WORDS) & (F.col("length") >= MIN_PERIODS * F.col("period")))
    return long.groupBy(*DOC, "start", "length").agg(F.min("period").alias("period"))


def _collapsed(joined):
    """Rows with `runs` and the text without what lies in a run after its first period."""
    kind = joined.schema["doc_id"].dataType.simpleString()
    runs_type = joined.schema["runs"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.encode().split()
                change = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    change[r["start"] + r["period"]] += 1
                    change[r["start"] + r["length"]] -= 1
                gone = np.cumsum(change) > 0
                texts.append(b" ".join(w for w, g in zip(words, gone, strict=False) if not g).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed_text"],
            )

    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, runs {runs_type}, collapsed_text string")


def periodic_runs(docs, doc_id="doc_id", text="text"):
    """(doc_id, n_words, runs, collapsed_text) for each row of `docs`.

    A run is a stretch of MIN_WORDS words or more and MIN_PERIODS times its smallest period or
    more, in which words one period apart are the same, and which no neighbouring word extends.
    `runs` are structs (start, period, length), in words from 0, sorted; `collapsed_text` is the
    words that no run holds after its first period, joined by one space. NULL, empty and blank
    texts have no words, no runs and an empty text. Each row comes back once, whatever its id;
    rows repeated in full are solved once.

    Runs are sought per octave of periods. Texts are laid out in overlapping tiles, as long as
    the octave's periods ask for, which are dealt over all tasks and solved alone; what they find
    of a run is stitched per document and period. So a very long text is no task of its own.
    """
    parts = keep(_taken_apart(docs, doc_id, text), "runs-parts", compression="zstd")
    laid = parts.where("octave IS NOT NULL")
    # Tiles are small and much work: as many tasks as their words ask for, whatever their bytes.
    n_words = laid.agg(F.sum(F.size("words"))).first()[0] or 0
    n_tasks = max(docs.sparkSession.sparkContext.defaultParallelism, n_words // TASK_WORDS)
    place = [*DOC, "octave", "first"]
    laid = laid.repartition(n_tasks, *place).dropDuplicates(place)
    pieces = _solved(laid.select(*DOC, "octave", "first", "boundaries", "words"))
    runs = _stitched(pieces).groupBy(*DOC).agg(
        F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs")
    )
    runs = keep(runs, "runs-found")
    whole = parts.where("octave IS NULL").select(*DOC, "n_words", "tiled", "words_joined")
    none = F.expr("CAST(array() AS array<struct<start: bigint, period: bigint, length: bigint>>)")
    plain = whole.where("NOT tiled").select(
        "doc_id", "n_words", none.alias("runs"), F.col("words_joined").alias("collapsed_text")
    )
    tiled = whole.where("tiled")
    same = tiled.doc_id.eqNullSafe(runs.doc_id) & (tiled.text_hash == runs.text_hash)
    joined = tiled.join(runs, same, "left").select(
        tiled.doc_id, "n_words", "words_joined", F.coalesce(runs.runs, none).alias("runs")
    )
    return plain.unionByName(_collapsed(joined))


def with_planted_runs(docs, doc_id="doc_id", text="text"):
    """`docs` with a periodic ending in the texts of about every tenth id.

    h is the CRC-32 of the decimal id, g = h div 10. If h % 10 = 0, each word from word
    a = g % n on is replaced by word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8); words are
    joined by one space. Other texts, and those without words, stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        spot = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(w, lambda _, i: F.get(w, spot(i).cast("int"))), " ")

    changed = let(words(F.col(text)), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.col(text)))
    return docs.withColumn(text, F.when(h % 10 == 0, changed).otherwise(F.col(text)))
