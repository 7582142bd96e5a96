"""License scans: an exact containment join of text blocks with license templates.

A template is the set of its words, and some of them are its distinguishing
words ("mit", "nc", the number of a version): without all of these a passage
is not that license's, however much it shares.  A block is a run of words of
a text, twice as long as the template less three words, so that words may be
put in, but the three of "all rights reserved" must stand together.  Every
block that holds at least ``num / den`` of a template's words and all its
distinguishing ones is found, wherever it starts; blocks that overlap are one
passage, given as the block that shares most (the first of these):

* words are ordered by their frequency in all texts; if a block holds o of a
  template's n words, it holds one of the template's n - o + 1 rarest (prefix
  filter), so only blocks around those are looked at, and only those that
  start at one of the template's words;
* a block with fewer than o of the template's words, repeats counted, cannot
  qualify (length filter), nor can one whose rarest shared word stands so late
  in the template's order that o are out of reach (positional filter);
* the words shared by what is left are counted exactly.

The templates are a fixed list, so every worker holds them; texts do not move.

Edge cases: a null or empty text has no words and no labels (empty strings);
a null id is carried through; repeated rows are scanned each; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import Words, blocks, utf8

# The phrases of the base labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Notices that the licenses' own texts ask for or use, with their labels and distinguishing words.
TEMPLATES = [
    ("Released under the MIT License", "mit", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files, to deal in the Software without restriction", "mit", ""),
    ("Licensed under the Apache License, Version 2.0", "apache-2", "apache 2"),
    ("Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at", "apache-2", "apache 2"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc", "cc nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc",
     "noncommercial"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3", "gnu 3"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License", "gpl-3", "general 3"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met", "bsd", ""),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2", "mozilla 2"),
    ("All rights reserved", "all-rights-reserved", "all rights reserved"),
]

#: Separators of the words: ASCII except digits and (after lower-casing) letters.
SEPARATOR = np.array([b < 0x80 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A) for b in range(256)])


@dataclass(frozen=True)
class Params:
    num: int = 4               # containment threshold num / den
    den: int = 5


def words_of(raw: np.ndarray, offs: np.ndarray) -> Words:
    return Words(raw, offs, sep=SEPARATOR)


def hashes_of(text: str) -> np.ndarray:
    raw, offs = utf8(pa.array([text]))
    return words_of(raw, offs).hashes()


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[int, int]:
    """How often each word of the templates occurs in all texts (a bounded table)."""
    vocab = np.unique(np.concatenate([hashes_of(t) for t, *_ in templates]))

    def run(batches):
        total = np.zeros(len(vocab), np.int64)
        for rb in batches:
            raw, offs = utf8(rb.column("text"))
            for lo, hi in blocks(offs):
                h = words_of(raw, offs[lo:hi + 1]).hashes()
                at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                total += np.bincount(at[vocab[at] == h], minlength=len(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocab))), pa.array(total)], names=["word", "n"])
    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(w): 0 for w in vocab} | {int(vocab[r.word]): r.n for r in got}


@dataclass
class Template:
    label: str
    block: int                 # words of a block
    words: np.ndarray          # distinct word hashes, rarest first
    need: int                  # words that a block must share
    marks: list[int]           # places of the distinguishing words in ``words``


def ordered(freq: dict[int, int], p: Params, templates=TEMPLATES) -> list[Template]:
    out = []
    for text, label, marks in templates:
        h = hashes_of(text)
        distinct = sorted({int(x) for x in h}, key=lambda x: (freq.get(x, 0), x))
        out.append(Template(label, max(2 * len(h) - 3, len(h)), np.array(distinct, np.uint64),
                            -(-len(distinct) * p.num // p.den), [distinct.index(int(x)) for x in hashes_of(marks)]))
    return out


def matches(w: Words, h: np.ndarray, t: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, shared words) of every passage that meets the template's need."""
    n = len(t.words)
    by = np.argsort(t.words)
    at = np.minimum(np.searchsorted(t.words[by], h), n - 1)
    place = np.where(t.words[by][at] == h, by[at], n).astype(np.int64)   # place in the template's order; n: not in it
    empty = np.zeros(0, np.int64)
    rare = np.flatnonzero(place <= n - t.need)
    if not len(rare):
        return empty, empty, empty
    start = np.flatnonzero(place < n)
    doc = np.searchsorted(w.doc_ptr, start, side="right") - 1
    end = np.minimum(start + t.block, w.doc_ptr[doc + 1])
    near = rare[np.minimum(np.searchsorted(rare, start), len(rare) - 1)]
    keep = (near >= start) & (near < end)                               # a rare word stands in the block
    keep &= np.searchsorted(start, end) - np.arange(len(start)) >= t.need
    doc, start, end = doc[keep], start[keep], end[keep]
    found = ([], [], [])
    for a in range(0, len(doc), 20_000):
        d, f, e = doc[a:a + 20_000], start[a:a + 20_000], end[a:a + 20_000]
        spot = f[:, None] + np.arange(t.block)
        got = np.where(spot < e[:, None], place[np.minimum(spot, len(h) - 1)], n)
        able = n - got.min(axis=1) >= t.need
        d, f, got = d[able], f[able], got[able]
        there = np.stack([(got == i).any(axis=1) for i in range(n)], axis=1)
        shared = there.sum(axis=1)
        ok = (shared >= t.need) & there[:, t.marks].all(axis=1)
        for out, x in zip(found, (d, f, shared)):
            out.append(x[ok])
    doc, start, shared = (np.concatenate(x) if x else empty for x in found)
    if not len(doc):
        return empty, empty, empty
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] >= start[:-1] + t.block))
    passage = np.cumsum(new)
    order = np.lexsort((start, -shared, passage))
    first = order[np.flatnonzero(np.append(True, np.diff(passage[order]) > 0))]
    return doc[first], start[first], shared[first]


def phrase_places(w: Words, h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """First words of all places where the phrase's words stand consecutively in one document."""
    m = len(phrase)
    if len(h) < m:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[:len(h) - m + 1] == phrase[0])
    for i in range(1, m):
        at = at[h[at + i] == phrase[i]]
    doc = np.searchsorted(w.doc_ptr, at, side="right") - 1
    return at[at + m <= w.doc_ptr[doc + 1]]


def scan(docs: DataFrame, params: Params | None = None, templates=TEMPLATES) -> DataFrame:
    """doc_id, label, first_word, last_word (of the block), containment: every passage found."""
    p = params or Params()
    known = ordered(frequencies(docs, templates), p, templates)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("label", T.StringType()),
                           T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
                           T.StructField("containment", T.DoubleType())])

    def run(batches):
        for rb in batches:
            raw, offs = utf8(rb.column("text"))
            for lo, hi in blocks(offs):
                w = words_of(raw, offs[lo:hi + 1])
                h = w.hashes()
                for t in known:
                    d, f, s = matches(w, h, t)
                    last = np.minimum(f + t.block, w.doc_ptr[d + 1]) - 1
                    yield pa.RecordBatch.from_arrays(
                        [rb.column("doc_id").take(pa.array(lo + d)), pa.array([t.label] * len(d), pa.string()),
                         pa.array(f - w.doc_ptr[d]), pa.array(last - w.doc_ptr[d]), pa.array(s / len(t.words))],
                        names=schema.names)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op8_license_scan(docs: DataFrame, params: Params | None = None, templates=TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest containment of a template in a block that was found; 1
    where a base phrase stands; else 0.
    """
    p = params or Params()
    known = ordered(frequencies(docs, templates), p, templates)
    phrases = [(hashes_of(t), label) for t, label in BASE]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")],
                           T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches):
        for rb in batches:
            raw, offs = utf8(rb.column("text"))
            for lo, hi in blocks(offs):
                w = words_of(raw, offs[lo:hi + 1])
                h = w.hashes()
                n = w.n_docs
                count, score = np.zeros(n, np.int64), np.zeros(n)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
                base: list[set] = [set() for _ in range(n)]
                for phrase, label in phrases:
                    at = phrase_places(w, h, phrase)
                    d = np.searchsorted(w.doc_ptr, at, side="right") - 1
                    np.add.at(count, d, 1)
                    np.minimum.at(first, d, at - w.doc_ptr[d])
                    np.maximum.at(last, d, at - w.doc_ptr[d])
                    for i in np.unique(d).tolist():
                        base[i].add(label)
                both = [set(b) for b in base]
                score[count > 0] = 1.0
                for t in known:
                    d, _, shared = matches(w, h, t)
                    np.maximum.at(score, d, shared / len(t.words))
                    for i in np.unique(d).tolist():
                        both[i].add(t.label)
                yield pa.RecordBatch.from_arrays(
                    [rb.column("doc_id").slice(lo, n), pa.array(w.counts().astype(np.int64)), pa.array(count),
                     pa.array(first, mask=count == 0), pa.array(last, mask=count == 0),
                     pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(sorted(b)) for b in both]),
                     pa.array(score)], names=schema.names)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
