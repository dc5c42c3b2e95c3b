"""Removal of repeated passages: seed with winnowed anchors, extend, keep maximal repeats."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newslens.llm.grams import mix, run_hashes, word_hashes
from newslens.llm.tables import keep

# Words of a window: passages of at least so many words that occur again are repeats.
WINDOW = 35
# Words of a seed. A window holds WINDOW - SEED_WORDS + 1 seeds; the smallest hash is its anchor.
SEED_WORDS = 8


def anchors(words, window=WINDOW, seed_words=SEED_WORDS):
    """(anchor hash, reach hash, first window, number of windows) of each anchor of a text.

    The anchor of a window is its seed with the smallest hash, the first of equals, so equal
    windows have the same anchor at the same offset. Neighbouring windows mostly share one. The
    reach of an anchor is all the words of its windows: as far as it can be extended both ways.
    """
    if len(words) < window:
        return None
    hashes = word_hashes(words)
    seeds = run_hashes(hashes, seed_words)
    windows = run_hashes(hashes, window)
    span = window - seed_words + 1
    views = np.lib.stride_tricks.sliding_window_view(seeds, span)
    at = np.concatenate([
        np.argmin(views[i : i + 65536], axis=1) + np.arange(i, min(i + 65536, len(views)))
        for i in range(0, len(views), 65536)
    ])
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    # The first and the last window together hold every word of the reach.
    place = ((at[first] - first) << 32 | (last - first)).astype(np.uint64)
    reach = mix(mix(windows[first], windows[last]), place)
    return seeds[at[first]].view(np.int64), reach.view(np.int64), first, last - first + 1


def _split(text):
    return (text or b"").split()


def _identified(docs, doc_id, text):
    """(doc_id, text_hash, text): the hash tells rows apart that share an id."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_hash"),
        F.col(text).cast("binary").alias("text"),
    )


def _same_row(a, b):
    return a.doc_id.eqNullSafe(b.doc_id) & (a.text_hash == b.text_hash)


def _seeds(source, window, seed_words):
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [anchors(_split(t), window, seed_words) for t in texts]
            rows = [i for i, f in enumerate(found) if f is not None]
            if not rows:
                continue
            parts = [np.concatenate([found[i][k] for i in rows]) for k in range(4)]
            source_row = pa.array(np.repeat(rows, [len(found[i][0]) for i in rows]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts[0]), pa.array(parts[1]), batch.column(0).take(source_row),
                 batch.column(1).take(source_row), pa.array(parts[2].astype(np.int32)),
                 pa.array(parts[3].astype(np.int32))],
                ["anchor", "reach", "doc_id", "text_hash", "first", "n"],
            )

    return source.mapInArrow(
        run, f"anchor long, reach long, doc_id {kind}, text_hash long, first int, n int"
    )


def _windows(source, picked, window):
    """A row per window of the picked anchors: (anchor, window_hash, doc_id, text_hash, first, alone)."""
    per_text = picked.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("anchor", "first", "n", "alone")).alias("picked")
    )
    joined = source.join(per_text, _same_row(source, per_text)).select(
        source.doc_id, source.text_hash, "text", "picked"
    )
    # Rows repeated in full would repeat their windows.
    joined = joined.dropDuplicates(["doc_id", "text_hash"])
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for row, (text, spots) in enumerate(
                zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ):
                hashes = run_hashes(word_hashes(_split(text)), window).view(np.int64)
                counts = [s["n"] for s in spots]
                starts = np.concatenate([np.arange(s["first"], s["first"] + s["n"]) for s in spots])
                out[0].append(np.repeat([s["anchor"] for s in spots], counts))
                out[1].append(hashes[starts])
                out[2].append(np.full(len(starts), row))
                out[3].append(starts)
                out[4].append(np.repeat([s["alone"] for s in spots], counts))
            if not out[0]:
                continue
            anchor, hashed, rows, starts, alone = map(np.concatenate, out)
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(hashed), batch.column(0).take(rows),
                 batch.column(1).take(rows), pa.array(starts.astype(np.int32)), pa.array(alone)],
                ["anchor", "window_hash", "doc_id", "text_hash", "first", "alone"],
            )

    return joined.mapInArrow(
        run,
        f"anchor long, window_hash long, doc_id {kind}, text_hash long, first int, alone boolean",
    )


def _repeats(source, window, seed_words):
    """(doc_id, text_hash, first, n): runs of windows that occur again, overlapping at most.

    Seeds: anchors that occur twice or more. Extension: occurrences of an anchor with the same
    reach agree in all their windows. Where reaches differ, one occurrence per different reach is
    compared window by window with the others; those agree on a part of the reach. So copies of a
    passage cost a row each, and only their differing edges cost a row per window. No pairs.
    """
    seeds = keep(_seeds(source, window, seed_words), "substring-seeds")
    again = seeds.groupBy("anchor").agg(
        F.count("*").alias("times"), (F.min("reach") != F.max("reach")).alias("mixed")
    ).where("times > 1").select("anchor", "mixed")
    # Read from a table, both sides of the join can be split where one anchor has many rows.
    again = keep(again, "substring-anchors")
    shared = keep(seeds.join(again, "anchor"), "substring-shared")
    place = ["doc_id", "text_hash", "first", "n"]
    alike = shared.where("NOT mixed").select(*place)
    mixed = shared.where("mixed")
    reaches = mixed.groupBy("anchor", "reach").agg(
        F.count("*").alias("times"), F.min(F.struct(*place)).alias("one")
    )
    reaches = keep(reaches, "substring-reaches")
    several = reaches.where("times > 1").select("anchor", "reach")
    alike = alike.unionByName(mixed.join(several, ["anchor", "reach"], "left_semi").select(*place))
    picked = reaches.select("anchor", "one.*", (F.col("times") == 1).alias("alone"))
    windows = keep(_windows(source, picked, window), "substring-windows")
    found = windows.groupBy("anchor", "window_hash").agg(F.count("*").alias("times"))
    found = keep(found.where("times > 1").select("anchor", "window_hash"), "substring-found")
    parts = windows.where("alone").join(found, ["anchor", "window_hash"], "left_semi")
    return alike.unionByName(parts.select("doc_id", "text_hash", "first", F.lit(1).alias("n")))


def _maximal(spots, window, n_words):
    """Sorted disjoint word ranges [start, end) that the windows of the spots cover."""
    change = np.zeros(n_words + 1, np.int64)
    for s in spots:
        change[s["first"]] += 1
        change[s["first"] + s["n"] - 1 + window] -= 1
    covered = np.concatenate([[0], np.cumsum(change[:-1]) > 0, [0]]).astype(np.int8)
    return np.flatnonzero(np.diff(covered) == 1), np.flatnonzero(np.diff(covered) == -1)


def remove_repeats(docs, doc_id="doc_id", text="text", window=WINDOW, seed_words=SEED_WORDS):
    """(doc_id, n_words, n_removed, spans, kept_text) for each row of `docs`.

    A word goes if a window of `window` consecutive words that covers it starts anywhere else too,
    in the same or another row; windows are judged on the input. `spans` are the maximal repeated
    ranges (start, end) in words, `kept_text` the other words joined by one space. All occurrences
    go, the first included. NULL, empty and blank texts have no words and an empty kept text;
    texts shorter than the window keep their words. Each row comes back once, whatever its id;
    rows repeated in full are repeats of each other.
    """
    source = _identified(docs, doc_id, text)
    spots = _repeats(source, window, seed_words).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("first", "n")).alias("spots")
    )
    joined = source.join(spots, _same_row(source, spots), "left").select(
        source.doc_id, "text", "spots"
    )
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            for text, spots in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = _split(text)
                ranges, left, at = [], [], 0
                for start, end in zip(*_maximal(spots or [], window, len(words)), strict=True):
                    ranges.append({"start": int(start), "end": int(end)})
                    left += words[at:start]
                    at = end
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                spans.append(ranges)
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept_text"],
            )

    return joined.mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_removed long, "
        "spans array<struct<start: int, end: int>>, kept_text string",
    )
