"""Surrogates: what is found, that formats stay, that entities stay apart and together."""

import re

from pyspark.sql import functions as F

from newslens.llm import pii, queries

KEY = "a key"
SCHEMA = "doc_id long, text string, row string, kind string"
# Written independently of the operator's patterns.
PLANTED = {
    "email": r"[^\s\"]+@[\w.]+\.com", "ip": r"\b\d+\.\d+\.\d+\.\d+\b", "card": r"\b\d{16}\b",
    "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}", "secret": r"\b(?:[0-9a-f]{40}|[0-9A-F]{40})\b",
}


def replaced(spark, texts):
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    rows = sorted(pii.replace_entities(frame, KEY).collect())
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    return [r.text for r in rows], [r.n_replaced for r in rows]


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v // 10 + v % 10 for v in values) % 10 == 0


def test_formats(spark):
    texts = [
        "mail Jean.Dupont34@mail7.example.com, JEAN.DUPONT34@MAIL7.EXAMPLE.COM!!", "call +1 (017) 555-7713 or +1 017 555 7713.",
        "at 97.51.17.173; not 1.2.3 or 1.2.3.4.5", "4111 1111 1111 1111 4111111111111111 9807915762804490",
        'token = "f6f4b6c25fd9db1a3d0f51bedd389b0833f73c65" 123-45-6789',
        "Mr. John Smith and Mrs Smith met Mary Smith. Mary Jones left. MARY SMITH", "Господин Петров, Иван Петров",
        None, "", "clean text, 2024-01-01 12:30, 1,000,000 and Theory of Mind", "tel иван@mail.example.ru",
    ]
    got, counts = replaced(spark, texts)
    assert counts == [2, 2, 1, 3, 2, 4, 2, 0, 0, 0, 1]
    assert got[7:10] == texts[7:10]
    for before, after in zip(texts, got, strict=True):
        if before and before != after:
            assert not set(re.findall(r"\S*\d{3,}\S*|\S+@\S+", before)) & set(after.split()) - {"1.2.3", "1.2.3.4.5"}
    lower, upper = re.findall(r"\S+@[\w.]+", got[0])
    assert upper == lower.upper() and re.fullmatch(r"[a-z]{4}\.[a-z]{6}\d\d@[a-z]{4}\d\.[a-z]{7}\.example", lower)
    one, two = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4})\.", got[1]).groups()
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two)
    assert got[2].endswith("; not 1.2.3 or 1.2.3.4.5")
    spaced, plain, invalid = re.fullmatch(r"((?:\d{4} ){4})(\d{16}) (\d{16})", got[3]).groups()
    assert spaced.replace(" ", "") == plain and luhn(plain) and not invalid.startswith("98079157")
    assert re.fullmatch(r'token = "[0-9a-f]{40}" \d{3}-\d\d-\d{4}', got[4])
    match = re.fullmatch(r"Mr\. (\w+) (\w+) and Mrs (\w+) met (\w+) (\w+)\. (\w+) (\w+) left\. MARY SMITH", got[5])
    assert match[1] in pii.GIVEN_NAMES[0] and match[4] in pii.GIVEN_NAMES[1] and match[6] == match[4]
    assert match[2] == match[3] == match[5] != match[7]
    match = re.fullmatch(r"Господин (\w+), (\w+) (\w+)", got[6])
    assert match[1] == match[3] and re.fullmatch("[Ѐ-ӿ]+", match[1]) and match[2] in pii.GIVEN_NAMES[2]
    assert re.fullmatch("tel [Ѐ-ӿ]{4}@[a-z]{4}.[a-z]{7}.example", got[10])


def test_collisions_take_later_turns(spark):
    names = [f"n{i}x" for i in range(1500)]
    first = spark.createDataFrame([(n,) for n in names], "entity string")
    made = pii.surrogate_entity(F.lit("name"), F.col("entity"), F.lit(0), KEY)
    taken = first.select(made.alias("m")).first().m
    entities = first.union(spark.createDataFrame([(taken,)], "entity string")).select(F.lit("name").alias("kind"), "entity")
    turns = {r.entity: r.turn for r in pii.later_turns(entities, KEY).collect()}
    assert turns[names[0]] >= 1
    rows = entities.collect()
    frame = spark.createDataFrame([(r.entity, turns.get(r.entity, 0)) for r in rows], "entity string, turn int")
    final = [r.m for r in frame.select(pii.surrogate_entity(F.lit("name"), F.col("entity"), F.col("turn"), KEY).alias("m")).collect()]
    assert len(set(final)) == len(final) and not set(final) & {r.entity for r in rows}


def test_taken_surrogates_in_texts(spark):
    made = spark.range(1).select(pii.surrogate_entity(F.lit("name"), F.lit("smith"), F.lit(0), KEY).alias("m")).first().m
    got, _ = replaced(spark, ["Mr Smith", f"Mr {made.capitalize()}", "Mrs Smith again", "Mrs Smith again"])
    assert got[0][3:] == got[2][4:-6] == got[3][4:-6]
    assert len({got[0], got[1], f"Mr {made.capitalize()}", "Mr Smith"}) == 4


def test_scripts_and_gender(spark):
    texts = [
        "Mr Αλέξανδρος Παπαδόπουλος, Κυρία Παπαδόπουλος", "γιώργος@mail.example.gr", "Frau Anneliese Schmidt und Herr Kaspar Schmidt",
        "MR SMITH met Mr Smith and MRS MARY SMITH", "MS OFFICE, DR NO", "Dr Anneliese Schmidt",
    ]
    got, counts = replaced(spark, texts)
    assert counts == [2, 1, 2, 3, 0, 1] and got[4] == texts[4]
    greek = re.fullmatch("Mr ([Ͱ-Ͽἀ-῿]+) ([Ͱ-Ͽἀ-῿]+), Κυρία ([Ͱ-Ͽἀ-῿]+)", got[0])
    assert greek[1] in pii.GIVEN_NAMES[4] and greek[2] == greek[3] != "Παπαδόπουλος"
    assert re.fullmatch(r"[α-ω]{7}@[a-z]{4}\.[a-z]{7}\.example", got[1])
    woman, one, man, other = re.fullmatch(r"Frau (\w+) (\w+) und Herr (\w+) (\w+)", got[2]).groups()
    assert woman in pii.GIVEN_NAMES[1] and man in pii.GIVEN_NAMES[0] and one == other != "Schmidt"
    upper, lower, mary, again = re.fullmatch(r"MR (\w+) met Mr (\w+) and MRS (\w+) (\w+)", got[3]).groups()
    assert upper == again == lower.upper() != "SMITH" and mary.capitalize() in pii.GIVEN_NAMES[1] and mary != "MARY"
    assert got[5].split()[0] == "Dr" and not set(got[5].split()[1:]) & {"Anneliese", "Schmidt"}


def test_another_key_gives_other_surrogates(spark):
    frame = spark.createDataFrame([(1, "Mr Smith a.b@c.com 4111111111111111", "", "")], SCHEMA)
    one, two = (pii.replace_entities(frame, k).first().text.split() for k in ("a", "b"))
    assert one[0] == two[0] and all(x != y for x, y in zip(one[1:], two[1:], strict=True))


def test_empty_table_and_long_text(spark):
    frame = spark.createDataFrame([(None, "a@b.com " * 20000, "", "")], SCHEMA)
    assert pii.replace_entities(frame, KEY).first().n_replaced == 20000
    assert pii.replace_entities(frame.limit(0), KEY).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op8_pii_surrogates(spark, folder).collect()}
    assert set(got) == set(docs)
    any_of = "|".join(f"(?:{p})" for p in PLANTED.values())
    found, fresh = {}, {}
    for i, text in docs.items():
        before, after = re.findall(any_of, text), re.findall(any_of.replace(r"\.com", r"\.example"), got[i].text)
        assert len(before) == got[i].n_replaced == len(after)
        assert re.split(any_of, text) == re.split(any_of.replace(r"\.com", r"\.example"), got[i].text)
        for b, a in zip(before, after, strict=True):
            assert found.setdefault(b.lower(), a.lower()) == a.lower()
            assert fresh.setdefault(a.lower(), b.lower()) == b.lower()
    assert found and not set(found) & set(fresh)
