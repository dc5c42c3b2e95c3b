"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from newslens.llm import queries, simhash

SCHEMA = "doc_id long, text string"


def expected_print(text):
    words = bytes(text or "", "utf-8").lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    if 0 < len(words) < 3:
        grams = [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_code_is_perfect_and_indices_meet():
    table = simhash._error_patterns()
    assert len(set(table.tolist())) == 2048
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 400)
    flips = (1 << rng.integers(0, 23, (400, 2))).astype(np.int64)
    y = x ^ flips[:, 0] ^ flips[:, 1]
    for a, b in zip(simhash.nearby_indices(x, table), simhash.nearby_indices(y, table), strict=True):
        assert set(a) & set(b)
        assert len(set(a)) in (1, 6)


@pytest.mark.parametrize("bucket", [0, 2, 32])
def test_links_connect_like_brute_force(spark, bucket):
    rng = random.Random(bucket)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for base in list(prints)[:12]:
        for _ in range(12):
            base ^= 1 << rng.randrange(64)
            base ^= 1 << rng.randrange(64)
            prints.add(base)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    links = simhash.fingerprint_links(frame, pair_bucket=bucket).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in links)
    values = {p: p & (2**64 - 1) for p in sorted(signed)}
    want = expected_components(values)
    got = {p: p for p in signed}
    roots = simhash.connected_components(simhash.fingerprint_links(frame, bucket), "t").collect()
    got.update({r.node: r.root for r in roots})
    assert got == want


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (5, base), (3, base), (9, base.upper()), (7, base + " tail"), (1, "other words entirely here"),
        (2, ""), (4, None), (6, " \n\t"), (8, "one two"), (8, "one two"), (10, "a b c d"),
        (None, base), (11, "x " * 70000), (12, "İAÉ"),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", fingerprint int")
    got = simhash.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    for row in got:
        text = {r[0]: r[1] for r in rows}[row.doc_id]
        assert row.fingerprint & (2**64 - 1) == expected_print(text)
    want = expected_components({i: expected_print(t) for i, t in sorted(
        (r for r in rows if r[0] is not None), key=lambda r: r[0])})
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [want[5]]
    empty = simhash.near_duplicates(frame.limit(0))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"]
    assert empty.count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    prints = {r.doc_id: expected_print(r.text) for r in sorted(docs)}
    want = expected_components(prints)
    got = queries.op10_simhash_near_dup(spark, folder).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (i, f"{prints[i]:016x}", want[i]) for i in prints
    }


def test_columns_of_any_name_stay(spark):
    text = "the same words in both of them"
    frame = spark.createDataFrame(
        [(1, text, 5, 6, 7), (2, text, 5, 6, 7)], "doc_id long, text string, first int, _key int, __KEY int"
    )
    assert [tuple(r) for r in simhash.keep_one(frame).collect()] == [(1, text, 5, 6, 7)]
