"""Account check digit and BVN checks (reference unit tests, ported)."""

import pytest
from pyspark.sql import functions as F

from riskweave.functions import identity as I


def test_nuban(spark):
    rows = [("0110000001", "058", True), ("0110000002", "058", False),
            ("011000000a", "058", False), ("011000000", "058", False),
            (None, "058", False), ("0110000001", "58", False)]
    df = spark.createDataFrame(rows, "acc string, bank string, want boolean")
    got = df.select(I.nuban_valid(F.col("acc"), F.col("bank")).alias("ok"), "want").collect()
    assert [g.ok for g in got] == [g.want for g in got]


def test_bvn(spark):
    df = spark.createDataFrame([("12345678901",), ("12345",), ("abcdefghijk",), (None,)], "b string")
    got = df.select(I.bvn_valid(F.col("b")).alias("v"), I.bvn_hash(F.col("b")).alias("h")).collect()
    assert [g.v for g in got] == [True, False, False, False]
    assert len(got[0].h) == 64 and all(c in "0123456789abcdef" for c in got[0].h)
    assert got[1].h is None


def test_bvn_strict_raises(spark):
    df = spark.createDataFrame([("12345",)], "b string")
    with pytest.raises(Exception):
        df.select(I.bvn_hash(F.col("b"), strict=True)).collect()


def test_column_kinds_and_alignment(spark):
    from riskweave import config as C
    from riskweave.operators.quality import align_features, column_kinds
    df = spark.createDataFrame([("t1", 0.5, 1, "WEB")], "transaction_id string, amount double, is_fraud int, channel string")
    assert column_kinds(df) == (["amount"], ["transaction_id", "channel"])
    a = align_features(df, keep=["transaction_id"])
    assert a.columns == ["transaction_id", *C.FEATURES]
    r = a.first()
    assert r["amount"] == 0.5 and r["channel_TRANSFER"] == 0.0
