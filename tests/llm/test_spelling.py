"""Spelling variants against a plain version, prefixes, long words, chains of forms, edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from riskweave.llm import spelling


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(docs):
    out = Counter()
    for i, text in docs:
        for w in spelling.WORD.findall((text or "").translate(spelling.FOLD)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def plain(counts):
    near = defaultdict(list)
    for a in counts:
        for b in counts:
            if is_near(a, b):
                near[a].append(b)
    form = {}
    for w, bs in near.items():
        best = min(bs, key=lambda b: (-counts[b], b))
        if counts[best] >= 5 * counts[w]:
            form[w] = best
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, n, len(near[w]), form.get(w), counts.get(form.get(w)), root))
    return sorted(rows)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcàéÉx") for _ in range(rng.randint(5, 9))) for _ in range(30)] + ["aaaaaa", "aaaaaaa", "ababab"]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base[:1 + i % len(base)])
            k = rng.random()
            at = rng.randrange(len(w))
            if k < 0.2:
                w = w[:at] + rng.choice("abcé") + w[at + (k < 0.1):]
            elif k < 0.25:
                w = w[:at] + w[at + 1:]
            words.append(w.upper() if k > 0.9 else w)
        docs.append((i, rng.choice([" ", "-", "7", "\n"]).join(words)))
    return docs


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_version(spark, seed):
    docs = corpus(seed) + [(None, "plainword " * 6), (500, None), (501, ""), (502, "×÷×÷×÷ " * 5), (3, "plainwork " * 40)]
    docs += [docs[7]] * 2
    df = spark.createDataFrame([(*d, "?", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(5)
    want = plain(plain_counts(docs))
    assert any(r[3] for r in want) and max(r[2] for r in want) > 1
    assert rows(spelling.variants(df)) == want


def test_all_words_are_counted_when_tasks_send_early(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH_WORDS", 10)
    docs = corpus(3, 60)
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_counts(docs)


@pytest.mark.parametrize("spelled", [64, 0])
def test_prefixes_meet_only_for_near_words(monkeypatch, spelled):
    """Spelled and hashed prefixes: as many meetings as near words, each pair once when first."""
    monkeypatch.setattr(spelling, "SPELLED", spelled)
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(3, 8))) for _ in range(150)})
    groups = defaultdict(list)
    for w in words:
        for prefix, skipped, first in spelling.prefixes(w):
            groups[prefix].append((w, skipped, first))
    met = Counter()
    for members in groups.values():
        assert len(members) <= 3           # two letters and the shorter word
        for a, a_cut, a_first in members:
            for b, b_cut, b_first in members:
                if a != b and (a_cut and b_cut or a_cut and a_first or b_cut and b_first):
                    met[a, b] += 1
    assert set(met.values()) == {1}
    assert set(met) == {(a, b) for a in words for b in words if is_near(a, b)}


def test_long_words(spark):
    """Around the length from which prefixes are hashed, and very long words."""
    w = "abcdefghij" * 7
    long = "lorem" * 4000
    groups = [(w[:63], 40), (w[:64], 200), (w[:65], 6), (w[:66], 1100), ("z" + w[1:64], 5), (w[:30] + "q" + w[31:65], 7),
              (long, 30), (long[:-1] + "x", 5), ("x" + long, 6), (long[:9] + long[10:], 5)]
    docs = [(i, " ".join([word] * n)) for i, (word, n) in enumerate(groups)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(spelling.variants(df)) == plain(plain_counts(docs))


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(27)] + [("a", "w26")], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w27"}


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_invalid_bytes_do_not_stop_the_job(spark):
    df = spark.sql("SELECT 1L AS doc_id, concat(repeat('strange ', 6), cast(X'FF' AS string)) AS text")
    assert rows(spelling.variants(df)) == plain(plain_counts([(1, "strange " * 6)]))
