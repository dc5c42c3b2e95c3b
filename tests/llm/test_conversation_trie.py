"""The conversation trie against brute force and SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from corpus_helpers import query_rows, sql_rows

from newslens.llm import conversation_trie

DDL = "conv_id long, turn long, role string, text string, node string, d int"


def conversations(rows):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute_force(convs):
    members, kids, ends = defaultdict(set), defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    result = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        result.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids[node]),
            sum(not kids[n] for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        ))
    return result


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL)
    order = lambda r: (r[1], r[0], r[3:])
    for build, convs in (
        (conversation_trie.prefix_trie, conversations(rows)),
        (conversation_trie.branched_trie, rebuilt(conversations(rows))),
    ):
        got = [tuple(r) for r in build(frame).collect()]
        assert sorted(got, key=order) == sorted(brute_force(convs), key=order)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(60), 45):
        for turn in range(rng.choice([1, 2, 3, 9, 20])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["é", "bb"]) if turn < 12 else "same"))
    check(spark, rows)


def test_copies_and_deep_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SPAN", 3)
    talk = [f"turn {i} " * (i % 4) for i in range(70)]
    rows = [(c, i, "user", t) for c in (5, 6, 7, 12) for i, t in enumerate(talk)]
    rows += [(20 + c, i, "user", t) for c in range(4) for i, t in enumerate(talk[: 8 * c])]
    rows += [(c, 0, "user", "hello") for c in range(100, 140)]
    check(spark, rows)


def test_edge_cases(spark):
    rows = [
        (1, None, None, None), (1, 0, "", ""), (1, 0, "", ""), (2, 3, "user", None), (2, 3, "user", "b"),
        (2, 3, "user", "a"), (None, 0, "user", "lost"), (3, 0, "user", "long " * 5000), (10, -1, "user", "x"),
        (11, 0, None, "x"), (8192, 0, "user", "far"), (-3, 0, "user", "below zero"),
    ]
    check(spark, [r for r in rows if (r[0] or 0) >= 0])
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL)
    assert conversation_trie.prefix_trie(frame).count() == len(brute_force(conversations(rows)))
    assert conversation_trie.branched_trie(frame.where("false")).collect() == []
    assert conversation_trie.branched_trie(frame.where("conv_id IS NULL")).collect() == []


def test_against_sql(spark):
    assert query_rows(spark, "op13_conversation_trie") == sql_rows("op13_conversation_trie")
