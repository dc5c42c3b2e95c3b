"""Licence notices: held-out accuracy on planted lines and on reworded notices."""

import re

import pytest

from newslens.llm import license_scan, queries

FOLDER = "/root/testdata/sf0.01"
NOTICES = {
    "apache": r"Apache License", "mit": r"MIT License", "gpl": r"GNU General Public", "cc-by-nc": r"CC BY-NC",
}
# Wording that is not in the templates.
REWORDED = {
    "The code is licensed under the Apache License, Version 2.0 and may be used freely": "apache",
    "Note: Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "this file: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "Photos and text licensed under CC BY-SA 4.0": "cc-by-sa",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
}


@pytest.fixture(scope="module")
def model(spark):
    return license_scan.train(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text"))


def test_wording(spark, model):
    other = ["My driving license is old", "the the the", "All rights reserved by the author", "x"]
    long = " ".join(f"w{i}" for i in range(5000)) + " Released under the MIT License. " + " ".join(f"v{i}" for i in range(5000))
    rows = [(i, t) for i, t in enumerate([*REWORDED, *other, long, None, "", "\n\n", "Line one\nLicensed under CC BY-NC 4.0.\nEnd"])]
    rows += [(3, "Released under the MIT License."), (None, "Released under CC0 1.0."), (50, "Licensed under CC BY 4.0."), (50, "Licensed under CC BY 4.0.")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, family string, words int")
    got = license_scan.scan(frame, model=model).collect()
    want = [(i, 0, f) for i, f in enumerate(REWORDED.values())]
    want += [(9, 0, "mit"), (13, 1, "cc-by-nc"), (3, 0, "mit"), (None, 0, "public-domain"), (50, 0, "cc-by")]
    print(set(map(str, want)) ^ {str((r.doc_id, r.paragraph, r.family)) for r in got})
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.paragraph, r.family)) for r in got)
    assert all(0.5 <= r.probability <= 1 and r.similarity >= 0.6 for r in got)
    assert license_scan.scan(frame.limit(0), model=model).count() == 0


def test_trains_without_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan(empty).count() == 0


def test_query_finds_planted_notices(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = {
        (r.doc_id, n, family) for r in docs for n, line in enumerate((r.text or "").split("\n"))
        for family, mark in NOTICES.items() if re.search(mark, line)
    }
    got = {(r.doc_id, r.paragraph, r.family) for r in queries.op9_license_scan(spark, FOLDER).collect()}
    assert want and got == want


def test_several_families_in_one_line(spark, model):
    filler = lambda c: " ".join(f"{c}{i}" for i in range(400))
    mit = "Released under the MIT License."
    apache, by_sa = "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-SA 4.0."
    rows = [(1, f"{filler('a')} {mit} {filler('b')} {apache} {filler('c')}"), (2, f"{mit} {apache}"), (3, f"{by_sa} {by_sa}"), (4, mit)]
    rows += [(10 + n, f"{' '.join(f'w{i}' for i in range(n))} {by_sa} {filler('d')}") for n in range(20, 62, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.family) for r in license_scan.scan(frame, model=model).collect()}
    want = {(1, "mit"), (1, "apache"), (2, "mit"), (2, "apache"), (3, "cc-by-sa"), (4, "mit")}
    assert {x for x in got if x[0] < 10} == want
    assert {f for i, f in got if i >= 10} == {"cc-by-sa"}


def reworded(kind, words):
    """The words with each tenth dropped, each eighth replaced, or a word put in behind each sixth."""
    if kind == "dropped":
        return [w for i, w in enumerate(words, 1) if i % 10]
    if kind == "replaced":
        return [w if i % 8 else "whatever" for i, w in enumerate(words, 1)]
    return [x for i, w in enumerate(words, 1) for x in ([w] if i % 6 else [w, "indeed"])]


@pytest.mark.parametrize("kind,least", [("dropped", 0.9), ("replaced", 0.9), ("inserted", 0.9)])
def test_recall_on_reworded_notices(spark, model, kind, least):
    filler = lambda c: [f"{c}{i}" for i in range(50)]
    notices = [(f, t.split()) for f, texts in license_scan.TEMPLATES.items() for t in texts]
    rows = [(n, " ".join([*filler("a"), *reworded(kind, words), *filler("b")])) for n, (_, words) in enumerate(notices)]
    rows += [(1000 + n, " ".join(filler(c))) for n, c in enumerate("abcdefgh")]
    got = {(r.doc_id, r.family) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    found = [(n, f) in got for n, (f, _) in enumerate(notices)]
    assert not any(i >= 1000 for i, _ in got)
    assert sum(found) >= least * len(found)
