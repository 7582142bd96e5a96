"""Near-duplicate operators and the graph helpers against brute force."""

import random
import re

import numpy as np
import pytest

from riskweave.llm import graph, jaccard, lines
from riskweave.llm.store import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("shape", ["path", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {"path": [(i, i + 1) for i in range(200)], "star": [(7, i) for i in range(150)],
             "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(260)], "none": [(1, 1)]}[shape]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: u.find(n) for e in edges if e[0] != e[1] for n in e}


@pytest.mark.parametrize("seed", [0])
def test_linked_finds_what_all_pairs_would(spark, seed):
    """Links that are not transitive: values in one bucket link when they differ by at most 2."""
    rng = random.Random(seed)
    rows = [(s, n) for s in range(6) for n in rng.sample(range(120), 30)]
    u = Union()
    for s, a in rows:
        for t, b in rows:
            if s == t and abs(a - b) <= 2:
                u.join(a, b)
    shared = graph.shared_buckets(spark.createDataFrame(rows, "sig long, node long"))
    label = graph.linked(shared, lambda p: p.where("abs(a - b) <= 2"))
    got = {r.node: r.component for r in label.collect()}
    want = {n: u.find(n) for _, n in rows}
    assert {n: got.get(n, n) for n in want} == want


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    u = Union()
    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    for k, (i, s) in enumerate(sets):
        u.find(i)
        for j, r in sets[:k]:
            if s and r and 100 * len(s & r) >= 90 * len(s | r):
                u.join(i, j)
    return u


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choice(vocab) for _ in range(60))
    texts = [None, "", "  ", "one", "One", "two words", "Two  WORDS", "a b c", "a b c d"]
    for k in range(n):
        size = rng.choice([3, 10, 30, 80, 200])
        t = [rng.choice(vocab) for _ in range(size)]
        texts.append(" ".join(t) + (" " + common if k % 3 == 0 else ""))
        for _ in range(rng.choice([0, 0, 1, 3])):
            e = list(t)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                e[rng.randrange(len(e))] = rng.choice(vocab)
            texts.append(" ".join(e) + (" " + common if k % 3 == 0 else ""))
    base = [rng.choice(vocab) for _ in range(150)]                  # a large group of near copies
    for _ in range(60):
        e = list(base)
        for _ in range(rng.randrange(8)):
            e[rng.randrange(len(e))] = rng.choice(vocab)
        texts.append(" ".join(e))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,params", [(1, jaccard.Params()), (2, jaccard.Params(cell_bits=6, per_class=4, frequent=0.5))])
def test_jaccard_join_is_exact(spark, seed, params):
    rows = [(i * 3 - 40, t, 1, 2) for i, t in enumerate(corpus(seed))]
    rows += [rows[5], rows[20], (None, rows[30][1], 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int, n_shingles int").repartition(5)
    got = jaccard.join(docs, params).collect()
    u = brute_components(rows)
    assert len(got) == len(rows)
    size = {i: len(shingles(t)) for i, t, *_ in rows}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (size[r.doc_id], u.find(r.doc_id))
    kept = jaccard.one_per_component(docs, params)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i if i is None else u.find(i) for i, *_ in rows}


@pytest.mark.parametrize("params", [jaccard.Params(), jaccard.Params(num=80), jaccard.Params(per_class=4, pairs_from=3, num=60)])
def test_linked_sets_share_a_key_of_the_smaller_ones_prefix(params):
    """Sets of every size at the threshold; frequencies from all rare to all frequent elements."""
    rng = np.random.default_rng(5)
    for k in range(400):
        n = int(rng.choice([1, 2, 3, 5, 8, 12, 30, 90, 300, 1500])) + int(rng.integers(0, 3))
        a = rng.integers(0, 2**64, n, np.uint64)
        gone = int(rng.integers(0, n - -(-n * params.num // params.den) + 1))
        new = int(rng.integers(0, (n - gone) * params.den // params.num - n + 1)) if k % 2 else 0
        b = np.concatenate([a[gone:], rng.integers(0, 2**64, max(new, 0), np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if not jaccard.meets(both, len(a), len(b), params):
            continue
        freq = np.where(rng.random(1 << params.cell_bits) < rng.choice([0, 0.5, 0.9, 1]), 100, 1)
        low, high = sorted((a, b), key=len)
        less, _ = jaccard.signatures(low, freq, 1.0, params)
        assert np.isin(less, np.concatenate(jaccard.signatures(high, freq, 1.0, params))).any()


def test_keys_grow_in_proportion_to_very_long_texts():
    p = jaccard.Params()
    freq = np.full(1 << p.cell_bits, 100)
    for n in (10_000, 100_000, 400_000):                            # all elements frequent: the most keys
        elem = np.sort(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
        assert sum(map(len, jaccard.signatures(elem, freq, 1.0, p))) < n


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "p q r s"), (3, "p q r s"), (4, "x")]
    got = {(r.doc_id, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_repeated_rows_keep_every_bucket(spark):
    rows = [(1, n) for n in "aabb"] + [(2, n) for n in "ccdd"] + [(3, n) for n in "aax"] + [(4, n) for n in "bbx"] + [(5, n) for n in "ee"]
    got = {}
    for r in graph.shared_buckets(spark.createDataFrame(rows, "sig long, node string")).collect():
        got.setdefault(r.sig, []).append(r.node)
    assert {s: sorted(n) for s, n in got.items()} == {1: ["a", "b"], 2: ["c", "d"], 3: ["a", "x"], 4: ["b", "x"]}


def test_jaccard_join_of_a_table_that_repeats_every_row(spark):
    rng = random.Random(8)
    rows = []
    for k in range(30):                                             # pairs of near copies, each row twice
        t = [f"v{rng.randrange(3000)}" for _ in range(100)]
        rows += [(2 * k, " ".join(t)), (2 * k + 1, " ".join([*t[:-1], "x"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.join(docs.union(docs)).collect()}
    u = brute_components(rows)
    assert got == {(i, u.find(i)) for i, _ in rows} and sum(i != c for i, c in got) == 30


def windows(norm, k=8):
    return frozenset(norm[i:i + k] for i in range(len(norm) - k + 1))


def brute_lines(rows):
    places = {}
    for i, t, *_ in rows:
        for pos, line in enumerate((t or "").split("\n")):
            norm = line.strip(" ").lower()
            if i is not None and len(norm) >= 8:
                places.setdefault(norm, set()).add((i, pos))
    u = Union()
    names = sorted(places)
    sets = {n: windows(n) for n in names}
    for k, a in enumerate(names):
        u.find(a)
        for b in names[:k]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                u.join(a, b)
    groups = {}
    for n in names:
        groups.setdefault(u.find(n), set()).update(places[n])
    return {p for g in groups.values() for p in g if p != min(g)}


def test_line_dedup(spark):
    rng = random.Random(4)
    vocab = [f"wort{i}" for i in range(300)]
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.choice([5, 12, 40]))) for _ in range(80)]
    rows = [(0, None, 1, "x"), (1, "", 1, "x"), (2, "short", 1, "x"), (3, "short\nshort", 1, "x"), (None, pool[0], 1, "x")]
    for i in range(4, 90):
        part = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(pool)
            if rng.random() < 0.4:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyz") + line[at + 1:]
            part.append(rng.choice(["", " "]) + (line.upper() if rng.random() < 0.1 else line))
        rows.append((i, "\n".join(part), 1, "x"))
    rows.append(rows[10])
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos int, norm string").repartition(4)
    want = brute_lines(rows)
    got = {(r.doc_id, p) for r in lines.report(docs).collect() for p in (r.dropped or [])}
    assert len(want) > 100 and got <= want and len(got) >= 0.97 * len(want)
    out = lines.dedup(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        if r.doc_id is None:
            assert r.text == pool[0]
    text = {i: t for i, t, *_ in rows}
    for r in out.collect():
        if r.doc_id is not None and text[r.doc_id] is not None:
            keep = [x for k, x in enumerate(text[r.doc_id].split("\n")) if (r.doc_id, k) not in got]
            assert r.text == "\n".join(keep)
    left = {r.doc_id for r in out.collect()}
    for i, t in text.items():
        all_gone = i is not None and t is not None and all((i, k) in got for k in range(len(t.split("\n"))))
        assert (i in left) != all_gone


def test_rows_of_one_id_with_other_texts_are_several_documents(spark):
    a, b = "the first line is long enough", "another line that nothing repeats"
    docs = spark.createDataFrame([(0, a), (1, a), (1, b), (2, f"{b}\n{a}\nown words of this row"), (2, f"{b}\n{a}\nown words of this row")],
                                 "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in lines.dedup(docs).collect())
    assert got == [(0, a), (1, b), (2, "own words of this row"), (2, "own words of this row")]


def test_short_lines_and_clashing_columns(spark):
    rows = [(i, "copied ln\n}\n\nend if", 5, 6, 7, "d") for i in range(4)] + [(9, "copied 1n\nseventh", 5, 6, 7, "d")]
    names = "doc_id long, text string, __rest long, gone long, rest long, body string"
    docs = spark.createDataFrame(rows, names)
    out = sorted(tuple(r) for r in lines.dedup(docs).collect())
    # one character of nine changes both windows; lines below eight characters stay
    assert out == [(0, "copied ln\n}\n\nend if", 5, 6, 7, "d"), *[(i, "}\n\nend if", 5, 6, 7, "d") for i in range(1, 4)],
                   (9, "copied 1n\nseventh", 5, 6, 7, "d")]
    assert lines.dedup(docs.select("rest", "text", "doc_id")).columns == ["rest", "text", "doc_id"]


def alike(rng, kind):
    """A line and a copy with one to three changes whose windows have a similarity of 0.8 or more."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def token(lo, hi):
        return "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))
    while True:
        a = {"5 words": lambda: " ".join(token(3, 8) for _ in range(5)),
             "6-8 words": lambda: " ".join(token(3, 8) for _ in range(rng.randint(6, 8))),
             "9-12 words": lambda: " ".join(token(3, 8) for _ in range(rng.randint(9, 12))),
             "13-20 words": lambda: " ".join(token(3, 8) for _ in range(rng.randint(13, 20))),
             "3-6 long tokens": lambda: " ".join(token(12, 25) for _ in range(rng.randint(3, 6))),
             "no blanks": lambda: "https://" + "/".join(token(3, 12) for _ in range(rng.randint(4, 9))),
             "few windows": lambda: token(2, 9) * 12}[kind]()
        b = list(a)
        for _ in range(rng.randint(1, 3)):
            b[rng.choice([0, 1, 2, len(b) - 1, rng.randrange(len(b))])] = rng.choice(letters)
        b = "".join(b)
        if kind == "few windows":
            b = a + rng.choice(letters)
        if a != b and len(a) >= 24 and 5 * len(windows(a) & windows(b)) >= 4 * len(windows(a) | windows(b)):
            return a, b


def test_bands_meet_for_lines_of_every_length(spark):
    rng = random.Random(6)
    kinds = ["5 words", "6-8 words", "9-12 words", "13-20 words", "3-6 long tokens", "no blanks", "few windows"]
    rows = [(k, i, t) for k in kinds for i in range(300) for t in alike(rng, k)]
    rows += [("listed", 0, f"{i}. terms and conditions of this service apply") for i in (1, 2)]
    keys = {}
    for r in lines.keyed(spark.createDataFrame(rows, "kind string, pair int, norm string"), lines.Params()).collect():
        assert r.size == len(windows(r.norm))
        keys.setdefault((r.kind, r.pair), []).append(set(r.sigs))
    share = {k: [bool(a & b) for (kind, _), (a, b) in keys.items() if kind == k] for k in [*kinds, "listed"]}
    share = {k: sum(x) / len(x) for k, x in share.items()}
    assert all(x >= 0.96 for x in share.values()), share


def test_line_dedup_uses_no_python(spark):
    docs = spark.createDataFrame([(1, "a line that is long enough to count\nb"), (2, "a line that is long enough to count")],
                                 "doc_id long, text string")
    plan = lines.report(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert {r.doc_id: r.dropped for r in lines.report(docs).collect()} == {1: None, 2: [0]}


def test_texts_of_lines_without_a_like_one_are_not_written(spark, monkeypatch):
    rows = [(i, f"{i} {'abcdefgh'[i % 8] * 12} a line of its own {i * i} that no other one is like\nthe line that all have") for i in range(40)]
    rows += [(99, "a line that has a like one, long enough for many windows"), (98, "a line that has a like one, long enough for many windowz")]
    tables = {}

    def kept(df, name):
        tables[name] = written(df, name)
        return tables[name]
    monkeypatch.setattr(lines, "written", kept)
    docs = spark.createDataFrame([*rows, rows[-1], rows[-2]], "doc_id long, text string")
    got = {(r.doc_id, p) for r in lines.report(docs).collect() for p in (r.dropped or [])}
    assert got == brute_lines(rows)
    assert "norm" not in tables["lines"].columns
    assert {"a line that has a like one, long enough for many window" + c for c in "sz"} <= {r.norm for r in tables["texts"].collect()}
    assert tables["texts"].count() == tables["nodes"].count() < tables["lines"].count()


def test_bands_come_from_one_order_of_the_windows(spark):
    """All keys from one sort, without the marks of the places: lines that lie between two marks share no key for that."""
    p = lines.Params()
    rng = random.Random(7)
    rows = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([8, 9, 10, 15, 40, 90, 300]))) for _ in range(300)]
    df = lines.keyed(spark.createDataFrame([(t,) for t in rows], "norm string"), p)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 2
    keys = {}
    for r in df.collect():
        for s in set(r.sigs):
            keys.setdefault(s, set()).add(r.norm)
    assert all(len(x) == 1 for x in keys.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(none).count() == 0 and lines.report(none).count() == 0 and lines.dedup(none).count() == 0
    assert written(none, "none").count() == 0
