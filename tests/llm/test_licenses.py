"""License scan against plain loops over every block."""

import random
import re

import pytest

from riskweave.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text):
    w = words(text)
    places, base = [], set()
    for phrase, label in L.BASE:
        q = phrase.split()
        at = [i for i in range(len(w) - len(q) + 1) if w[i:i + len(q)] == q]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 1.0 if places else 0.0
    for t, label, marks in L.TEMPLATES:
        q = words(t)
        s, block = set(q), max(2 * len(q) - 3, len(q))
        for first in range(len(w)):
            here = set(w[first:first + block])
            c = len(s & here)
            if 5 * c >= 4 * len(s) and here >= set(words(marks)):
                labels.add(label)
                score = max(score, c / len(s))
    return (len(w), len(places), min(places) if places else None, max(places) if places else None,
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


def texts():
    rng = random.Random(5)
    out = [None, "", "  ", "no license here", "UNDER THE MIT-LICENSE, under the mit license", "été Apache License, Version 2.0!",
           "CC BY-NC 4.0 cc by nc cc by", "rights all reserved", "x " * 5000 + "All Rights\nReserved." + " y" * 5000]
    vocab = sorted({x for t, *_ in L.TEMPLATES for x in words(t)}) + ["foo", "bar", "été"]
    for t, *_ in L.TEMPLATES:
        for _ in range(12):
            q = [x for x in words(t) if rng.random() > 0.15]
            pad = [[rng.choice(vocab) for _ in range(rng.randrange(0, 60))] for _ in range(2)]
            out.append(" ".join(pad[0] + q + pad[1]))
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_scan_matches_loops(spark, parts):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(None, "All rights reserved", "x", "y"), (3, "cc by nc", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, score string").repartition(parts)
    got = L.op8_license_scan(docs).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, got)) == sorted(key((i, *brute(t))) for i, t, *_ in rows)


def test_spans(spark):
    docs = spark.createDataFrame([(1, "a b c All rights reserved d")], "doc_id long, text string")
    got = [(r.label, r.first_word, r.last_word, r.containment) for r in L.scan(docs).collect()]
    assert got == [("all-rights-reserved", 3, 5, 1.0)]


def labels_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in L.op8_license_scan(docs).orderBy("doc_id").collect()]


def test_distinguishing_words(spark):
    none = ["Released under the Apache License", "This tool is released under the GPL license today", "Released under the BSD license.",
            "Licensed under CC BY 4.0", "This work is licensed under the GNU General Public License, version 2",
            "the rights of all reserved seats"]
    assert labels_of(spark, none) == [""] * len(none)
    some = [("Released under an MIT License", "mit"), ("licensed under the apache license v 2.0", "apache-2"),
            ("Licensed under CC BY-NC", "cc-by-nc"), ("all rights reserved.", "all-rights-reserved")]
    assert labels_of(spark, [t for t, _ in some]) == [x for _, x in some]


def test_found_at_every_offset(spark):
    passage = "Released now under our MIT License"
    texts = [" ".join(["word"] * k + [passage] + ["word"] * 9) for k in range(17)]
    assert labels_of(spark, texts) == ["mit"] * 17
    far = " ".join(["word"] * 30_000 + [passage])
    docs = spark.createDataFrame([(1, far + " " + "x " * 40 + passage)], "doc_id long, text string")
    got = [(r.label, r.first_word, r.last_word) for r in L.scan(docs).collect()]
    assert got == [("mit", 30_000, 30_006), ("mit", 30_046, 30_051)]


def test_empty_table(spark):
    assert L.op8_license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
