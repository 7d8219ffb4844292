import re

import pytest

from panelforge.llm.license_scan import BAND, BASE, LEAST_SCORE, NOTICES, diagonals, known_notices, license_scan, notice_places, spans

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_scan(text):
    """Places of base phrases word by word; notices by sets of agreeing words around every start."""
    w = plain_words(text)
    places = [(i, label) for label, phrase in BASE for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    best = {label: 1.0 for _, label in places}
    for label, notice in BASE + NOTICES:
        t = plain_words(notice)
        hits = {
            (i - j, j + k) for i in range(len(w) - 1) for j in range(len(t) - 1) if w[i] == t[j] and w[i + 1] == t[j + 1] for k in (0, 1)
        }
        for d in {d for d, _ in hits}:
            own = sum(x == d for x, _ in hits)
            if 3 * own < len(t):
                continue
            near = [(x, j) for x, j in hits if abs(x - d) <= BAND]
            at = {x + j for x, j in near}
            agreeing = min(len({j for _, j in near}), len(at))
            score = max(own / len(t), agreeing / max(len(t), max(at) - min(at) + 1))
            if score >= LEAST_SCORE:
                best[label] = max(score, best.get(label, 0))
    starts = [i for i, _ in places]
    return (
        len(w), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({x for _, x in places})), ",".join(sorted(best)), max(best.values(), default=0.0),
    )


TEXTS = [
    "Some prose. Released under the MIT License. More prose.",
    "Distributed under the MIT license",
    "Licensed under the Apache License, Version 2.0 (the thing)",
    "Licensed to you under the Apache Licence, version 2.0",
    "CC BY-NC 4.0 and cc/by and CC BY, cc by-sa; All rights reserved. all rights reserved all  Rights\treserved",
    "GNU General Public License general public license",
    "permission is hereby granted free of charge to any nice person obtaining a copy of this software and the"
    " associated documentation files the software to deal in software without any restriction",
    "this program is free software you can redistribute it and or modify it under the terms of the GNU Lesser"
    " General Public License as published by the Free Software Foundation",
    "of the and of the software of the public and the rights of all",
    "all rights and all reserved rights, a general license for the public",
    "Tous droits réservés ÀB cc by",
    "cc by cc by cc " * 400,
    "unrelated words only",
]


@pytest.fixture(scope="module")
def docs(spark, odd):
    rows = spark.createDataFrame(list(enumerate(TEXTS, 10_000)), "doc_id long, text string")
    return odd.unionByName(rows, allowMissingColumns=True)


def test_same_as_brute_force(spark, docs):
    got = license_scan(docs, known_notices(spark)).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted([(repr(i), *plain_scan(t)) for i, t in texts], key=repr)
    assert sorted([(repr(r[0]), *r[1:]) for r in got], key=repr) == want
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[10_000] == labels[10_001] == "mit" and labels[10_002] == "apache"
    assert labels[10_008] == labels[10_009] == labels[10_012] == ""
    assert labels[10_006] == "mit"


def test_inserted_words_need_neighbouring_diagonals(spark, docs):
    moved = docs.where("doc_id = 10006")
    covers = diagonals(moved, known_notices(spark)).where("label = 'mit' and m > 20")
    assert covers.selectExpr("max(bit_count(cover) / m)").first()[0] < LEAST_SCORE
    span = spans(moved, known_notices(spark)).where("label = 'mit'").orderBy("score").collect()[-1]
    assert span["score"] >= LEAST_SCORE and span["first_word"] == 0


def test_long_notices_are_cut_and_equal_ones_count_once(spark):
    text = " ".join(f"t{i}" for i in range(100))
    rows = [(7, "long", False, text), (3, "long", False, text.upper()), (9, "one", False, "word"), (5, "none", True, None)]
    notices = spark.createDataFrame(rows, "notice int, label string, base boolean, text string")
    places = notice_places(notices)
    assert {tuple(r) for r in places.select("notice.notice", "notice.passage", "m").distinct().collect()} == {
        (3, 0, 33), (3, 1, 33), (3, 2, 34)
    }
    docs = spark.createDataFrame([(1, text[-150:]), (2, "t1 t2 word"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan(docs, notices).collect()} == {1: "long", 2: "", 3: ""}


def test_empty_tables(spark, none, docs):
    assert license_scan(none, known_notices(spark)).count() == 0
    got = license_scan(docs, known_notices(spark).limit(0)).select("n_base", "labels", "score").distinct().collect()
    assert [tuple(r) for r in got] == [(0, "", 0.0)]
