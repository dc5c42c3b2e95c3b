"""Near-duplicate lines against brute force."""

import random

import pyarrow as pa
import pytest

from newslens.llm import grams, line_dedup, queries


def brute_force(rows, percent=80):
    """{(doc_id, text): removed line numbers}; candidates share a word."""
    lines = [(d, n, frozenset(line.split())) for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
             for n, line in enumerate((t or "").encode().split(b"\n")) if line.split()]
    by_word, removed = {}, {}
    for place, (d, n, words) in enumerate(lines):
        earlier = {p for w in words for p in by_word.get(w, ())}
        if any(100 * len(words & lines[p][2]) >= percent * len(words | lines[p][2]) for p in earlier):
            removed.setdefault(d, []).append(n)
        for w in words:
            by_word.setdefault(w, []).append(place)
    return removed


def check(spark, rows, percent=80):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, line int, place string")
    want = brute_force(rows, percent)
    got = line_dedup.line_decisions(frame, percent=percent).collect()
    assert sorted((str(r.doc_id), r.removed) for r in got) == sorted((str(d), want.get(d, [])) for d, _ in rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        assert r.n_removed == len(r.removed) and r.n_lines == sum(bool(x.split()) for x in text.encode().split(b"\n"))
    kept = {r.doc_id: r.text for r in line_dedup.remove_lines(frame, percent=percent).collect()}
    for d, text in rows:
        if text is not None:
            assert kept[d] == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want.get(d, []))


def test_random_edits(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 30))] for _ in range(60)]
    rows = []
    for d in range(90):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(500)}"
            rng.shuffle(words)
            lines.append(" ".join(words))
        rows.append((d, "\n".join(lines)))
    check(spark, rows)


@pytest.mark.parametrize("percent", [60, 70, 90])
def test_other_thresholds(spark, percent):
    rng = random.Random(percent)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 9))] for _ in range(25)]
    rows = [(1, "x1 x2 x3\nx1 x2 x3 x4\nalpha beta\nalpha beta gamma")]
    for d in range(2, 60):
        words = list(rng.choice(base))
        if rng.random() < 0.7:
            words[rng.randrange(len(words))] = f"w{rng.randrange(80)}"
        rows.append((d, " ".join(words + ["more"] * rng.randrange(2))))
    check(spark, rows, percent)


def test_edge_cases(spark):
    same = "this line comes again and again in all texts"
    rows = [(5, same), (3, same + " x"), (None, "y " + same), (4, None), (6, ""), (7, " \n\t\n\n"), (8, f"{same}\n{same}\n\nother"),
            (9, "a b c"), (10, "c b a"), (11, "a b d"), (12, "word " * 30000 + "\n" + " ".join(f"w{i}" for i in range(20000))),
            (13, " ".join(f"w{i}" for i in range(19000))), (14, "twice"), (14, "twice"), (15, "é à ü ö"), (16, "ö ü à é ñ")]
    check(spark, rows)
    check(spark, [(1, None)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.line_decisions(empty).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute_force(rows)
    got = {r.doc_id: r.removed for r in queries.op3_line_dedup(spark, folder).collect()}
    assert got == {d: want.get(d, []) for d, _ in rows}


def test_near_copies_behind_other_heads_are_not_all_paired(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join([word] + [f"o{i}x{k}" for k in range(39)] * 2)) for i, word in enumerate(base)]
    for d in range(100, 300):
        words = list(base)
        words[rng.randrange(40)] = f"new{d}"
        rows.append((d, " ".join(words)))
    pairs, keep = {}, line_dedup.keep

    def counted(frame, name, **options):
        found = keep(frame, name, **options)
        pairs[name] = found.count() if "pairs" in name else 0
        return found

    monkeypatch.setattr(line_dedup, "keep", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed for r in line_dedup.line_decisions(frame).collect()}
    assert got == {d: brute_force(rows).get(d, []) for d, _ in rows}
    # All of them would be 19,900.
    assert sum(pairs.values()) < 200 * 40


def test_words_cut_out_of_bytes():
    rng = random.Random(5)
    texts = [b"", None, b" ", b"a", b"\n\n", "é \x1c\x85 x\x00 x\x00\x00".encode(), b"0123456789abcdef01234567", b"0123456789abcdef012345678 " * 2]
    texts += [bytes(rng.choice(b"ab\n \t\r\x0b\x0c\x00\xff") for _ in range(rng.randrange(60))) for _ in range(300)]
    data, offsets = grams.text_bytes(pa.array(texts, pa.binary())[1:])
    starts, ends = grams.spans(line_dedup._IN_WORD[data], offsets)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert words == [w for t in texts[1:] for w in (t or b"").split()]
    of_word = dict(zip(words, grams.span_hashes(data, starts, ends).tolist(), strict=True))
    assert len(set(of_word.values())) == len(of_word)
    rows, numbers, starts = line_dedup._line_spans(data, offsets)
    lines = [(r, n, line) for r, t in enumerate(texts[1:]) for n, line in enumerate((t or b"").split(b"\n"))]
    assert [(r, n) for r, n, _ in lines] == list(zip(rows.tolist(), numbers.tolist(), strict=True))
    assert all(data[s : s + len(line)].tobytes() == line for s, (_, _, line) in zip(starts, lines, strict=True))
