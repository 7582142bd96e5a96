"""Spelling variant grouping by permuterm rotations.

Words are counted per document in Spark's tasks and added up.  Every frequent
word is marked with an end sign and rotated to each of its positions.  Two
words that differ by one replaced character share a rotation up to its last
character; a word that lacks one character of another is, rotated, exactly
that prefix.  So all near words meet under the prefix that skips the edited
character: rows (prefix, word) are dealt by the prefix and sorted, and a scan
of each group gives every member its number of near words and its most
frequent one.  A group holds one word per character of the alphabet and the
shorter word, whatever the corpus, and no pairs are made: a member's best
partner is the group's first or, for the first itself, the second.  A run of
equal characters gives the same shorter word several times; only the first of
them is counted.

Prefixes are spelled out for words of up to ``SPELLED`` characters and are two
61-bit polynomial hashes of the rotation beyond, so a word of any length takes
memory in proportion to it, and not to its square.

Forms lead from a word to a more frequent near word, so a chain of them ends;
roots are found by doubling: each round joins the table of pointers with
itself, and the number of rounds is the logarithm of the longest chain.

Edge cases: a null or empty text has no words; a null id counts as an empty
text in the rule that deletes characters; ties go to the smaller word; repeated
rows count each; an empty table gives no rows.  Only ``doc_id`` and ``text``
are read, whatever the other columns.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

WORD = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = {c: c + 32 for c in range(65, 91)}
DELETE_EACH, MIN_CHARS, MIN_COUNT, RATIO = 199, 6, 5, 5
END = "\n"              # the end sign: no word holds it
SPELLED = 64
FLUSH_WORDS = 200_000   # distinct words that a task adds up before it sends them on
MOD, BASES = (1 << 61) - 1, (0x1B873593A5A5A5, 0x2545F4914F6CDD)


def mistyped(doc_id: str, word: str) -> str:
    """The word as the rule has it: for one in ``DELETE_EACH`` ids and words, without one character."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % DELETE_EACH else word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the words with enough characters and occurrences."""
    def send(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches):
        total: Counter = Counter()
        for rb in batches:
            for doc_id, text in zip(rb.column("doc_id").to_pylist(), rb.column("text")):
                own: Counter = Counter()
                for run_ in WORD.findall((text.as_py() or b"").decode("utf-8", "replace").translate(FOLD)):
                    own[run_] += 1
                for w, n in own.items():
                    if len(w) >= min_chars:
                        w = mistyped(doc_id, w)
                        if len(w) >= min_chars:
                            total[w] += n
                if len(total) > FLUSH_WORDS:
                    yield send(total)
                    total.clear()
        yield send(total)
    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
                        F.col("text").cast("string").cast("binary").alias("text"))
    return (given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


# ---------------------------------------------------------------- rotations
def prefixes(word: str):
    """(prefix, skipped, first) for all rotations of the marked word.

    ``skipped``: the prefix leaves out the character that stands last in its
    rotation; else it is the whole rotation.  ``first``: the skipped character
    is not the same as the one before it.
    """
    n = len(word)
    # a prefix is written in the way of the shorter word, which it is a rotation of
    if n > SPELLED:
        hashed = hashed_prefixes(word)
        yield from hashed if n - 1 > SPELLED else (p for p in hashed if not p[1])
    for i in range(n):
        if n <= SPELLED:
            yield word[i:] + END + word[:i], False, True
        if n - 1 <= SPELLED:
            yield word[i + 1:] + END + word[:i], True, i == 0 or word[i] != word[i - 1]
    if n <= SPELLED:
        yield END + word, False, True


def hashed_prefixes(word: str):
    """As ``prefixes``, each as (characters, two polynomial hashes), in time linear in the word."""
    codes, n = [ord(c) + 1 for c in word], len(word)
    powers, heads = [], []
    for base in BASES:
        p, h = [1], [0]
        for c in codes:
            p.append(p[-1] * base % MOD)
            h.append((h[-1] * base + c) % MOD)
        p.append(p[-1] * base % MOD)
        powers.append(p)
        heads.append(h)

    def rotation(i: int, j: int) -> list[int]:
        """Hashes of word[j:] + END + word[:i]."""
        out = []
        for p, h in zip(powers, heads):
            tail = (h[n] - h[j] * p[n - j]) % MOD
            out.append(((tail * p[1] + ord(END) + 1) * p[i] + h[i]) % MOD)
        return out
    for i in range(n + 1):
        yield "{} {:x} {:x}".format(n + 1, *rotation(i, i)), False, True
        if i < n:
            yield "{} {:x} {:x}".format(n, *rotation(i, i + 1)), True, i == 0 or word[i] != word[i - 1]


def rotations(words: DataFrame) -> DataFrame:
    """prefix, skipped, first, word, n for every rotation of every word."""
    def run(batches):
        for rb in batches:
            rows, size = [], 0
            for word, n in zip(rb.column("word").to_pylist(), rb.column("n").to_pylist()):
                for prefix, skipped, first in prefixes(word):
                    rows.append((prefix, skipped, first, word, n))
                    size += len(prefix) + len(word)
                    if size > 1 << 22:
                        yield batch(rows)
                        rows, size = [], 0
            yield batch(rows)

    def batch(rows):
        cols = list(zip(*rows)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            cols, (pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.int64()))],
            names=["prefix", "skipped", "first", "word", "n"])
    return words.select("word", "n").mapInArrow(run, "prefix string, skipped boolean, first boolean, word string, n long")


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, near (struct of -n and word of the best near word) of the words that have near words."""
    rows = rotations(words)
    group = W.partitionBy("prefix")
    ranked = group.orderBy(F.col("n").desc(), "word")
    whole = ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    member = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("word"))
    skipped, first = F.col("skipped").cast("long"), (F.col("skipped") & F.col("first")).cast("long")
    seen = (rows.withColumn("place", F.row_number().over(ranked))
            .withColumn("one", F.first(member).over(whole)).withColumn("two", F.nth_value(member, 2).over(whole))
            .withColumn("edits", F.sum(skipped).over(whole)).withColumn("firsts", F.sum(first).over(whole))
            .withColumn("shorter", F.sum(1 - skipped).over(whole)))
    near = F.when(F.col("skipped"), F.col("edits") - 1 + F.when(F.col("first"), F.col("shorter")).otherwise(0)) \
        .otherwise(F.col("firsts"))
    return (seen.where(F.col("two").isNotNull())
            .select("word", near.alias("near"), F.when(F.col("place") == 1, F.col("two")).otherwise(F.col("one")).alias("best"))
            .groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from (word, form): forms are followed to their ends, twice as far each round."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                     F.col("next").isNotNull().alias("moved"))
        ahead = written(ahead, "spelling-roots")
        if ahead.where("moved").isEmpty():
            return at
        at = ahead.drop("moved")


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every frequent word."""
    words = written(word_counts(docs, min_chars, min_count), "spelling-words")
    form_n = -F.col("best.minus")
    real = form_n >= ratio * F.col("n")
    out = words.join(neighbours(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(real, F.col("best.word")).alias("form"), F.when(real, form_n).alias("form_n"))
    out = written(out, "spelling-near")
    ends = roots(out.where(F.col("form").isNotNull()))
    return out.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


_UP, _LOW = (bytes(range(a, a + 26)).decode() for a in (65, 97))


def oracle_sql() -> str:
    """DuckDB: near words by deleting each character, pairs checked by position."""
    from .resampling import CRC_TABLE, crc_sql
    return f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT *, row_number() OVER () AS nr FROM documents),
r AS (SELECT nr, w, count(*) AS n FROM (SELECT nr, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'),
      '[A-Za-zÀ-ÿ]+')) AS w FROM d) WHERE length(w) >= 6 GROUP BY ALL),
h AS (SELECT w, n, {crc_sql("g")} AS h FROM (SELECT w, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS g
      FROM r JOIN d USING (nr)), crc_table),
t AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2)
      ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM t WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, v.word, v.n FROM x a JOIN v ON a.cut = v.word
      UNION SELECT v.word, a.word, a.n FROM x a JOIN v ON a.cut = v.word),
g AS (SELECT word, count(*) AS n_near, max(n) AS top FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN top END AS form_n FROM v LEFT JOIN g USING (word)),
o AS (SELECT f.*, (SELECT min(near) FROM p WHERE p.word = f.word AND p.n = f.form_n) AS form FROM f),
c AS (SELECT word, word AS at, 0 AS step FROM o
      UNION ALL SELECT c.word, o.form, step + 1 FROM c JOIN o ON o.word = c.at WHERE o.form IS NOT NULL)
SELECT o.word, o.n, o.n_near, o.form, o.form_n, arg_max(c.at, c.step) AS root FROM o JOIN c USING (word) GROUP BY ALL
"""


def op12_spelling_variants(docs: DataFrame) -> DataFrame:
    return variants(docs)
