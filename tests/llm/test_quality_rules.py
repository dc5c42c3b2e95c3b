"""Quality rules against SQL and hand-made cases."""

from collections import Counter

import pytest
from corpus_helpers import query_rows, sql_rows

from newslens.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, kept string"


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def repeats(text):
    words = text.split()
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({p for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)})


def test_counts(spark):
    texts = [
        None, "", " \n\t", "a b  c\x0bd\x0ce", "#x *y\n#x *y\n \nz|é", "one two three four five six seven eight",
        "a b c d e f g h " * 3, "w " * 40, "a b c d e f g h x a b c d e f g h y b c d e f g h x", "l\nl\nl\n\n\n",
        " ".join(f"w{i % 700}" for i in range(30000)),
    ]
    frame = spark.createDataFrame([(i, t, None, "s", "x") for i, t in enumerate(texts)], SCHEMA)
    got = by_id(quality_rules.verdicts(frame))
    for i, t in enumerate(texts):
        t, r = t or "", got[i]
        lines = [x for x in t.split("\n") if x.strip()]
        want = (len(t.split()), sum(map(len, t.split())), sum(c in "#*$%&|<>" for c in t),
                len(lines) - len(set(lines)), repeats(t))
        assert tuple(r[c] for c in quality_rules.COUNTS) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


@pytest.mark.parametrize("value", [0, 1, 127, 128, 129, 255, 256, 1000, 123456789, 2**60])
def test_buckets(spark, value):
    row = spark.range(1).select(quality_rules.sketch_bucket(quality_rules.F.lit(value)).alias("b"))
    want = value >> max(0, value.bit_length() - 7) << max(0, value.bit_length() - 7)
    assert row.first().b == want


def test_thresholds_follow_the_source(spark):
    even = " ".join(f"word{i}" for i in range(30))
    marked = " ".join(f"#word{i}" for i in range(30))
    rows = [(i, even, "en", "plain", "") for i in range(120)] + [(200, marked, "en", "plain", "")]
    rows += [(i, marked, "en", "social", "") for i in range(300, 420)]
    rows += [(500, even, "en", "rare", ""), (501, even, None, None, ""), (502, "few words", "en", "x", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = by_id(quality_rules.verdicts(frame))
    assert [got[i].kept for i in (0, 200, 300, 500, 501, 502)] == [True, False, True, True, True, False]
    kept = quality_rules.keep_good(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "good words " + " ".join(map(str, range(20))), "en", "s", "")] * 3 + [(1, "bad", "en", "s", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.kept for r in quality_rules.verdicts(frame).collect()) == [False, True, True, True]
    assert [r.text[:4] for r in quality_rules.keep_good(frame).collect()] == ["good"] * 3
    assert quality_rules.verdicts(frame.limit(0)).count() == 0


def test_query(spark):
    assert query_rows(spark, "op1_quality_rules") == sql_rows("op1_quality_rules")


def test_columns_of_any_name_stay(spark):
    text = "good words of a text that is long enough to pass all of the fixed rules as it has over twenty of them"
    frame = spark.createDataFrame(
        [(1, text, "en", "s", 7, 8, 9), (2, "short", "en", "s", 7, 8, 9)],
        "doc_id long, text string, lang string, source string, good_id int, good_hash int, kept int",
    )
    assert [tuple(r) for r in quality_rules.keep_good(frame).collect()] == [(1, text, "en", "s", 7, 8, 9)]
