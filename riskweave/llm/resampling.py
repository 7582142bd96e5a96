"""Target-distribution importance resampling by hashed n-grams found with an overlapped regular expression.

A text is lower-cased (A-Z), its separators collapse to single spaces, and one
pattern is matched with ``overlapped=True``: look-arounds hold its ends to
word boundaries, and its groups end after 1, 2 .. n words, so every match
gives the spans of all n-grams that begin at a word.  The span's bytes are
hashed by crc32 into buckets.  Bucket counts of the raw and of the target
texts give each bucket's gain, a document's weight is the mean gain of its
features, and Gumbel noise from a hash of the id turns a ranking into a draw
without replacement.

Passes: the buckets of every document are written once (two bytes a feature);
counts are added up per task before the shuffle (at most ``buckets`` rows a
task); gains are a table of ``buckets`` numbers, the only thing collected.
Ranks come from one range shuffle of slim rows: every partition numbers its
sorted rows and the partitions' counts are added up, so no task sees all rows.

Edge cases: a null, empty or separator-only text has no features and weight 0;
a null id counts as an empty text in the noise and sorts after other ids;
repeated rows are ranked once each; empty tables give no rows (no target texts:
T = 0).  Only ``doc_id`` and ``text`` are read, whatever the other columns.
Words are runs of bytes, so texts of any length take memory in proportion to
one text.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written
from .text import mix

N, BUCKETS, SEED, PERCENT, MIN_WORDS = 2, 10_000, 7, 25, 20
#: Separators become blanks, A-Z becomes a-z; other ASCII letters and digits and all bytes of other characters stay.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
BLANKS = regex.compile(rb" +")


def grams(n: int) -> regex.Pattern:
    """One word and up to n - 1 following words; group k ends after k words."""
    tail = rb""
    for _ in range(n - 1):
        tail = rb"(?:( [^ ]+)" + tail + rb")?+"
    return regex.compile(rb"(?<![^ ])([^ ]++)" + tail + rb"(?![^ ])")


def normal(text: bytes) -> bytes:
    return BLANKS.sub(b" ", text.translate(FOLD)).strip(b" ")


def spans(text: bytes, pattern: regex.Pattern):
    """A slice for every n-gram of a normalised text."""
    for m in pattern.finditer(text, overlapped=True):
        ends = m.regs
        start = ends[0][0]
        for _, end in ends[1:]:
            if end < 0:
                break
            yield slice(start, end)


def hashed(text: bytes, pattern: regex.Pattern, buckets: int) -> tuple[int, np.ndarray]:
    """(words, bucket of every n-gram) of a text."""
    text = normal(text)
    if not text:
        return 0, np.zeros(0, np.uint32)
    out = np.fromiter(map(zlib.crc32, map(text.__getitem__, spans(text, pattern))), np.uint32)
    return text.count(b" ") + 1, out % np.uint32(buckets)


def features(texts: DataFrame, n: int = N, buckets: int = BUCKETS, key: str | None = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, found (the buckets, two or four bytes each), tie (a random number a row)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        pattern, task, nth = grams(n), TaskContext.get().partitionId(), 0
        for rb in batches:
            rows = []
            for doc_id, text in zip(rb.column(0), rb.column(1)):
                words, found = hashed(text.as_py() or b"", pattern, buckets)
                rows.append((doc_id.as_py(), words, len(found), found.astype(kind).tobytes()))
            cols = list(zip(*rows)) if rows else [()] * 4
            tie = mix(np.arange(nth, nth + len(rows), dtype=np.uint64) + np.uint64((task + 1) << 36)).view(np.int64)
            nth += len(rows)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))), pa.array(tie)],
                names=["doc_id", "n_words", "n_features", "found", "tie"])
    given = texts.select((F.col(key).cast("long") if key else F.lit(None).cast("long")).alias("doc_id"),
                         F.col("text").cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_words long, n_features long, found binary, tie long")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often each bucket occurs; a task sends one row a bucket."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for rb in batches:
            for f in rb.column(0):
                total += np.bincount(np.frombuffer(f.as_py(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    return found.select("found").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) for every bucket."""
    both = [np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)]
    for out, counts in zip(both, (raw, target)):
        for r in counts.collect():                    # at most ``buckets`` rows
            out[r.bucket] = r.n
    s, t = both
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * all_s / (float(a + 1) * all_t)))
                     for a, b in zip(s.tolist(), t.tolist())], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * a Gumbel number) from a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighed(found: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, tie."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches):
        for rb in batches:
            sums = [int(gain[np.frombuffer(f.as_py(), kind)].sum()) for f in rb.column("found")]
            weight = [s // max(n, 1) for s, n in zip(sums, rb.column("n_features").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in names), pa.array(weight, pa.int64())],
                                             names=[*names, "weight"])
    names = ["doc_id", "n_words", "n_features", "tie"]
    out = found.mapInArrow(run, "doc_id long, n_words long, n_features long, tie long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with rank: 1, 2 .. over the drawn rows by falling score, ties to the smaller id; else null.

    Rows are dealt by ranges of (enough words, score, id) and sorted; a row's
    rank is its number in its partition after the rows of earlier partitions.
    """
    spark = scored.sparkSession
    scored = scored.withColumn("enough", (F.col("n_words") >= min_words).cast("int"))
    order = [F.col("enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    # the count is named, so that partitions stay as dealt
    dealt = scored.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)

    def number(batches):
        part, nth = TaskContext.get().partitionId(), 0
        for rb in batches:
            yield pa.RecordBatch.from_arrays(
                [*rb.columns, pa.array(np.full(rb.num_rows, part, np.int64)), pa.array(np.arange(nth, nth + rb.num_rows))],
                names=[*rb.schema.names, "part", "nth"])
            nth += rb.num_rows
    schema = "doc_id long, n_features long, weight long, score long, enough int, part long, nth long"
    rows = written(dealt.sortWithinPartitions(*order).select("doc_id", "n_features", "weight", "score", "enough")
                   .mapInArrow(number, schema), "resampling-order")
    counts = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("enough").alias("able"))
    # one row a partition: at most spark.sql.shuffle.partitions rows
    before = counts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0))
                                    - F.col("n")).alias("before"))
    total = counts.agg(F.sum("able").alias("able")).first().able or 0
    rank = F.col("before") + F.col("nth") + 1
    return (rows.join(F.broadcast(before), "part")
            .withColumn("rank", F.when((rank <= total * percent // 100) & (F.col("enough") == 1), rank))
            .drop("part", "nth", "before", "enough"))


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = SEED,
             percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document."""
    found = written(features(docs, n, buckets), "resampling-features")
    aim = features(target, n, buckets, key=None)
    gain = gains(bucket_counts(found, buckets), bucket_counts(aim, buckets), buckets)
    return ranked(weighed(found, gain, seed), percent, min_words)


#: The letters that lower-casing changes, for SQL.
_UP, _LOW = (bytes(range(a, a + 26)).decode() for a in (65, 97))
#: crc32 of a text in SQL: the byte table, then one step a byte.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a text; needs ``crc_table`` (column t) in scope."""
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), "
            f"lambda i: CAST(('0x' || substr(hex(encode({text})), 2 * i + 1, 2)) AS BIGINT))), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))")


def _features_sql(table: str, key: str) -> str:
    return f"""SELECT {key} AS k, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"""


ORACLE_SQL = f"""
WITH {CRC_TABLE},
d AS ({_features_sql("(SELECT *, row_number() OVER () AS nr FROM documents)", "nr")}),
b AS ({_features_sql("benchmark", "0")}),
texts AS (SELECT 0 AS side, * FROM d UNION ALL SELECT 1, * FROM b),
f AS (SELECT side, k, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM texts),
v AS (SELECT g, CAST({crc_sql("g")} % 10000 AS INT) AS bucket FROM (SELECT DISTINCT g FROM f), crc_table),
c AS (SELECT side, k, bucket, count(*) AS n FROM f JOIN v USING (g) GROUP BY ALL),
s AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM c GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM s) + 10000)))) AS gain FROM s),
wt AS (SELECT k, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
    FROM c JOIN gain USING (bucket) WHERE side = 0 GROUP BY k),
x AS (SELECT doc_id, len(d.w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)
      AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM (SELECT *, row_number() OVER () AS nr FROM documents) o JOIN d ON o.nr = d.k LEFT JOIN wt ON wt.k = d.k),
r AS (SELECT *, words >= 20 AS able, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS p,
    count(*) FILTER (words >= 20) OVER () AS total FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND p <= total * 25 // 100 THEN p END AS rank FROM r
"""


def op11_importance_resampling(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target)
