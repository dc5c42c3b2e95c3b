"""Removal of repeated passages against brute force and SQL."""

import random
from collections import Counter

from corpus_helpers import query_rows, sql_rows

from newslens.llm import substring_dedup


def brute_force(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    result = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        result.append((len(w), len(gone), kept))
    return result


def check(spark, rows, window, seed_words):
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n int, anchor string")
    got = substring_dedup.remove_repeats(frame, window=window, seed_words=seed_words).collect()
    want = brute_force([t for _, t in rows], window)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], key=key) == sorted(
        [(i, *w) for (i, _), w in zip(rows, want, strict=True)], key=key)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_random_passages(spark):
    rng = random.Random(3)
    pool = [[rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(5, 40))] for _ in range(12)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(6)):
            part = list(rng.choice(pool))
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = "edit"
            words += part + [f"u{rng.random()}"] * rng.randrange(3)
        rows.append((i, " ".join(words)))
    check(spark, rows, 10, 4)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 5000}" for i in range(20000))
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "short text"), (5, long), (6, passage + " end"),
        (6, "start\n" + passage), (7, "é " * 90), (None, passage), (8, "solo " * 34), (9, "solo " * 35),
        (10, "rep x " * 36), (11, "same row twice " * 20), (11, "same row twice " * 20),
    ]
    check(spark, rows, 35, 8)
    check(spark, rows[:1], 35, 8)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(frame).collect() == []


def test_query(spark):
    assert query_rows(spark, "op5_substring_dedup") == sql_rows("op5_substring_dedup")
