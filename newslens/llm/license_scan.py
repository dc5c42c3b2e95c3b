"""Licence notices by a trained paragraph classifier, confirmed by comparison with templates."""

import math
import re
from collections import Counter
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from newslens.llm.grams import run_hashes, word_hashes
from newslens.llm.tables import keep, let

# Wording of licence notices, by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "This project is available under the Apache 2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is distributed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Licensed under the MIT License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the 3-clause BSD License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Released under the GNU GPL v2.",
        "Licensed under the GNU General Public License, version 2.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the GNU LGPL v3.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Content is available under CC-BY 4.0 unless otherwise noted.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Content is available under CC BY-NC 4.0 for non-commercial use.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).",
        "Released under CC0 1.0.",
    ],
}
# Sentences that use the words of licences without being one.
NO_LICENCE = [
    "He lost his driving license and had to walk to work.", "The city issued a license to sell food on the street.",
    "All rights reserved.", "Copyright 2020 by the publisher.", "The warranty covers two years of normal use.",
    "Students at the institute signed a general agreement with the public library.",
    "The company offers software free of charge to schools.", "Version 2.0 of the file was published in May.",
    "The apache helicopter landed near the lake.", "Creative work needs time and common sense.",
    "The foundation gave permission to use the hall.", "This work was released in three parts.",
]
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
# Sequences of one, two and three words are features, hashed to so many buckets for each length.
LENGTHS = (1, 2, 3)
BUCKET_BITS = 13
BUCKETS = 1 << BUCKET_BITS
# Bounds of the labelled sample: paragraphs of the corpus that stand for no licence.
SAMPLE_DOCUMENTS = 400
SAMPLE_ROWS = 3000
# Words of a longer paragraph are read in windows, so that a notice inside is seen.
WINDOW_WORDS = 60
WINDOW_STEP = 30
LEAST_PROBABILITY = 0.5
# Share of the word pairs of the template, or of the paragraph if it has fewer (but no fewer than
# LEAST_PAIRS), that the two must have in common to confirm a family.
LEAST_SIMILARITY = 0.6
LEAST_PAIRS = 8
TEMPERATURES = [0.05 * 1.15**k for k in range(40)]
# Words whose lines are scored together, if no line is longer; windows scored in one step.
CHUNK_WORDS = 1 << 16
CHUNK_WINDOWS = 256
WORD = re.compile(r"[^\W_]+")


class Model(NamedTuple):
    """Weights (bucket, family), a constant per family, and the temperature of the probabilities."""

    weights: np.ndarray
    constants: np.ndarray
    temperature: float


def _tokens(text):
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), "")


def windows(docs, doc_id="doc_id", text="text"):
    """(words) of each window: paragraphs are lines; long ones come in windows."""
    named = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line"))
    words = named.select(_tokens(F.col("line")).alias("all"))
    starts = F.sequence(
        F.lit(0), F.greatest(F.size("all") - (WINDOW_WORDS - WINDOW_STEP), F.lit(0)), F.lit(WINDOW_STEP)
    )
    parts = words.where(F.size("all") > 0).select("all", F.explode(starts).alias("start"))
    return parts.select(F.slice("all", F.col("start") + 1, WINDOW_WORDS).alias("words"))


def _buckets(hashes, length):
    """Bucket of each run of `length` words."""
    return (run_hashes(hashes, length) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)


def features(words):
    """Binary vector of the buckets that the words' sequences fall into."""
    hashes = word_hashes(words)
    held = [np.unique(_buckets(hashes, n)).astype(np.int64) + k * BUCKETS for k, n in enumerate(LENGTHS)]
    held = np.concatenate(held)
    return SparseVector(len(LENGTHS) * BUCKETS, held, np.ones(len(held)))


def _labelled(spark, negatives):
    """Labelled rows: templates whole, by parts, and inside other text; and texts of no licence."""
    rows = []
    fillers = negatives[:40] or [["some", "other", "text"]]
    for label, family in enumerate(FAMILIES):
        for text in TEMPLATES.get(family, NO_LICENCE):
            words = template_tokens(text)
            cuts = [words, words[:-1], words[1:]] + [words[i : i + 14] for i in range(0, max(1, len(words) - 10), 5)]
            for n, cut in enumerate(c for c in cuts if len(c) >= min(4, len(words))):
                around = fillers[(label * 7 + n * 3) % len(fillers)]
                rows += [(label, cut), (label, around[:8] + cut), (label, cut + around[:8]), (label, around[:12] + cut + around[-12:])]
    rows += [(0, words) for words in negatives]
    kind = StructType().add("label", DoubleType()).add("features", VectorUDT()).add("n", LongType())
    return spark.createDataFrame([(float(a), features(b), i) for i, (a, b) in enumerate(rows)], kind)


def template_tokens(text):
    """The words of a template, as `_tokens` takes them."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def train(docs, sample_rows=SAMPLE_ROWS):
    """Model: fitted on templates and `sample_rows` windows of the corpus at most.

    The sample is windows of the documents with the smallest text hashes. Those that hold half of a template's word
    pairs are left out, as they may be licences. A quarter of the labelled rows is kept aside, on
    which the temperature of the class probabilities is fitted: calibration.
    """
    spark = docs.sparkSession
    hashed = docs.withColumn("h", F.xxhash64("text"))
    first = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCUMENTS)
    sample = windows(keep(hashed.join(first, "h", "left_semi").dropDuplicates(["h"]), "license-sample"))
    sample = sample.select("words", F.xxhash64("words").alias("h")).orderBy("h", "words").limit(sample_rows)
    sample = sample.withColumn("similarity", best_template(F.col("words"), None)["similarity"])
    negatives = [r.words for r in sample.where("similarity < 0.5").orderBy("h", "words").collect()]
    rows = keep(_labelled(spark, negatives).coalesce(2), "license-training")
    held_out = F.pmod(F.xxhash64("n"), F.lit(4)) == 0
    fitted = LogisticRegression(family="multinomial", maxIter=30, regParam=1e-4).fit(rows.where(~held_out))
    seen = fitted.transform(rows.where(held_out)).select("label", vector_to_array("rawPrediction").alias("raw")).collect()

    def loss(t):
        return sum(math.log(sum(math.exp(min(700, (x - r.raw[int(r.label)]) / t)) for x in r.raw)) for r in seen)

    return Model(fitted.coefficientMatrix.toArray().T, fitted.interceptVector.toArray(), min(TEMPERATURES, key=loss))


def _pairs(words):
    return F.array_distinct(
        F.when(F.size(words) > 1, F.transform(
            F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i, 2), " ")
        )).otherwise(words)
    )


def best_template(words, family):
    """Struct (similarity, template): the template of the family (of any, if None) that has the
    largest share of word pairs in common with the words."""
    scored = []
    for name, texts in TEMPLATES.items():
        for n, text in enumerate(texts):
            tokens = template_tokens(text)
            pairs = sorted(set(map(" ".join, zip(tokens, tokens[1:], strict=False))))
            scored.append((name, f"{name}/{n}", pairs))

    def of(held):
        options = []
        for name, label, pairs in scored:
            smaller = F.least(F.greatest(F.size(held), F.lit(LEAST_PAIRS)), F.lit(len(pairs)))
            share = F.size(F.array_intersect(held, F.array(*map(F.lit, pairs)))) / smaller
            fits = F.lit(True) if family is None else family == name
            options.append(F.when(fits, F.struct(share.alias("similarity"), F.lit(label).alias("template"))))
        return F.array_max(F.array(*options))

    return let(_pairs(words), of)


def _word_pairs(tokens):
    return list(map(" ".join, zip(tokens, tokens[1:], strict=False))) or list(tokens)


def notices(words, part, more, chances):
    """(family, similarity, template) of the notices in a window; `chances` has a probability by family.

    The likeliest family's best template comes first, then whatever template has the largest share of
    the pairs that are left: each takes its pairs, once, so that a notice is not counted for a similar
    family too. What the window's edge cuts is left to the neighbour that holds all of it.
    """
    templates = [(f, f"{f}/{n}", set(_word_pairs(template_tokens(t)))) for f, texts in TEMPLATES.items() for n, t in enumerate(texts)]
    here = _word_pairs(words)
    left, most = Counter(here), max(len(set(here)), LEAST_PAIRS)
    top, found = max(chances, key=chances.get), {}
    while True:
        scored = [(sum(p in left for p in pairs) / min(most, len(pairs)), chances[f], label, f, pairs) for f, label, pairs in templates]
        good = [x for x in scored if x[0] >= LEAST_SIMILARITY]
        if not good:
            return [(f, *x) for f, x in found.items()]
        similarity, _, label, family, pairs = max([x for x in good if not found and x[3] == top] or good, key=lambda x: x[:3])
        at = [n for n, p in enumerate(here) if p in pairs and left[p]]
        left -= Counter(pairs & set(left))
        cut = more and at[-1] == len(here) - 1 and at[0] >= WINDOW_STEP
        cut |= part > 0 and at[0] == 0 and at[-1] + 1 < WINDOW_WORDS - WINDOW_STEP
        if not cut and similarity > found.get(family, (0,))[0]:
            found[family] = (similarity, label)


def _raw_scores(lines, model):
    """(line, part, score by family) of the windows of lists of words.

    Each word is hashed once. A sequence counts in a window if its bucket does not occur earlier in it.
    """
    sizes = np.array([len(words) for words in lines])
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - (WINDOW_WORDS - WINDOW_STEP), 0) // WINDOW_STEP + 1
    line = np.repeat(np.arange(len(lines)), counts)
    part = np.arange(len(line)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (ends - sizes)[line] + WINDOW_STEP * part
    end = np.minimum(start + WINDOW_WORDS, ends[line])
    hashes = word_hashes(list(chain.from_iterable(lines)))
    scores = np.tile(model.constants, (len(line), 1))
    for k, n in enumerate(LENGTHS):
        bucket = _buckets(hashes, n)
        if not len(bucket):
            continue
        order = np.argsort(bucket, kind="stable")
        before = np.full(len(bucket), -1)
        same = bucket[order[1:]] == bucket[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        # The last row is that of a sequence that does not count.
        weights = np.vstack([model.weights[k * BUCKETS : (k + 1) * BUCKETS], np.zeros(len(FAMILIES))])
        for low in range(0, len(line), CHUNK_WINDOWS):
            first, last = start[low : low + CHUNK_WINDOWS, None], end[low : low + CHUNK_WINDOWS, None]
            at = first + np.arange((last - first).max())
            counted = at + n <= last
            at = np.where(counted, at, 0)
            counted &= before[at] < first
            scores[low : low + CHUNK_WINDOWS] += weights[np.where(counted, bucket[at], BUCKETS)].sum(axis=1)
    return line, part, scores


def likely_windows(lines, model):
    """(line, part, probability by family) of the windows that are more likely a licence than none."""
    line, part, scores = _raw_scores(lines, model)
    scores = np.exp((scores - scores.max(axis=1, keepdims=True)) / model.temperature)
    chances = scores / scores.sum(axis=1, keepdims=True)
    for i in np.nonzero(chances[:, FAMILIES.index(UNKNOWN)] <= 1 - LEAST_PROBABILITY)[0]:
        yield int(line[i]), int(part[i]), chances[i].tolist()


def _chunks(texts):
    """Lists of (row, paragraph, words) for the lines with a word of an Arrow array of texts."""
    chunk, total = [], 0
    for row, text in enumerate(texts):
        for paragraph, line in enumerate((text.as_py() or "").lower().split("\n")):
            words = WORD.findall(line)
            if words:
                chunk.append((row, paragraph, words))
                total += len(words)
            if total >= CHUNK_WORDS:
                yield chunk
                chunk, total = [], 0
    if chunk:
        yield chunk


def scan(docs, doc_id="doc_id", text="text", model=None):
    """(doc_id, paragraph, family, probability, similarity, template) of each licence notice.

    A paragraph is a line; `paragraph` is its number. Windows that are more likely a licence of some
    family than none are compared with the templates of all families. A family is reported, once a
    paragraph, if a window has 60 % of its word pairs, or of the template's if those are fewer, in
    common with one of the family's templates, other notices' pairs left out. `probability` is the
    calibrated one of the family in the window; that of two notices in one window is divided.
    NULL, empty and blank texts have no paragraphs. Rows that share an id are scanned each for
    itself, rows repeated in full give equal results once each. An empty table gives no rows.
    """
    named = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text")
    )
    model = model or train(named)
    kind = named.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for chunk in _chunks(batch.column(2)):
                for line, part, each in likely_windows([words for _, _, words in chunk], model):
                    row, paragraph, words = chunk[line]
                    first, last = part * WINDOW_STEP, part * WINDOW_STEP + WINDOW_WORDS
                    by_family = {f: c for f, c in zip(FAMILIES, each, strict=True) if f != UNKNOWN}
                    for family, similarity, template in notices(words[first:last], part, len(words) > last, by_family):
                        rows.append(row)
                        out.append((paragraph, family, by_family[family], similarity, template))
            take = pa.array(rows, pa.int64())
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).take(take) for n in range(2)] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "text_hash", "paragraph", "family", "probability", "similarity", "template"],
            )

    found = named.mapInArrow(
        run, f"doc_id {kind}, text_hash long, paragraph int, family string, probability double, similarity double, template string"
    )
    best = F.max(F.struct("probability", "similarity", "template")).alias("m")
    return found.groupBy("doc_id", "text_hash", "paragraph", "family").agg(best).select(
        "doc_id", "paragraph", "family", F.round("m.probability", 4).alias("probability"),
        F.round("m.similarity", 4).alias("similarity"), "m.template",
    )
