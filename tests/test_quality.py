"""Text scan, per-column casts, row validation and the fail-fast limit (fixtures 1, 3)."""

import os

import pytest

from riskweave.operators import quality as QL
from riskweave.sources.tables import MONEY_SCHEMA, read_csv

HEADER = "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud"


def _csv(scratch, bad_rows):
    good = "1,TRANSFER,100.5,C1,0,0,M1,0,0,0,0"
    bad = ["2,TRANSFER,-5,C2,0,0,M2,0,0,0,0",       # negative amount
           "3,PAYMENT,10,C3,0,0,M3,0,0,2,0",         # label out of range
           "4,DEBIT,ten,C4,0,0,M4,0,0,0,0",          # text amount
           "5,,10,C5,0,0,M5,0,0,0,0",                # missing type
           "6,CASH_IN,,C6,0,0,M6,0,0,1,0",           # missing amount
           "7,CASH_OUT,-1,C7,0,0,M7,0,0,3,0"]        # two problems
    path = os.path.join(scratch, f"money_{bad_rows}")
    os.makedirs(path)
    with open(os.path.join(path, "part.csv"), "w") as f:
        f.write("\n".join([HEADER] + [good] * 4 + bad[:bad_rows]) + "\n")
    return path


def test_validate_text_codes(spark, scratch):
    df = read_csv(spark, _csv(scratch, 6))
    assert all(t == "string" for _, t in df.dtypes)
    v = QL.validate_text(df, MONEY_SCHEMA, QL.money_checks())
    got = {r.step: list(r.violations) for r in v.collect() if r.violations}
    assert got == {2: ["amount_negative"], 3: ["label_range"], 4: ["amount_type", "amount_required"],
                   5: ["type_required"], 6: ["amount_required"], 7: ["amount_negative", "label_range"]}


def test_fail_fast_limit(spark, scratch):
    ok = QL.cast_text(read_csv(spark, _csv(scratch, 5)), MONEY_SCHEMA)
    assert QL.fail_fast(ok, QL.money_checks()) == 5
    bad = QL.cast_text(read_csv(spark, _csv(scratch, 6)), MONEY_SCHEMA)
    with pytest.raises(ValueError):
        QL.fail_fast(bad, QL.money_checks())


def test_hand_sample_cleaning(spark):
    """Ten-row sample with one missing amount, one missing channel and two repeats:
    10 rows after cleaning, no nulls, amount in [0, 1], one channel and one source flag per row."""
    rows = [("T1", 100.0, 0, "TRANSFER", "PaySim"), ("T2", None, 1, "CASH_OUT", "PaySim"),
            ("T3", 50.0, 0, None, "PaySim"), ("T4", 75.0, 0, "CARD_WEB", "IEEE-CIS"),
            ("T5", 20.0, 0, "CARD_HOST", "IEEE-CIS"), ("T6", 300.0, 1, "TRANSFER", "PaySim"),
            ("T7", 10.0, 0, "PAYMENT", "PaySim"), ("T8", 60.0, 0, "CARD_STORE", "IEEE-CIS"),
            ("T9", 80.0, 0, "DEBIT", "PaySim"), ("T10", 90.0, 0, "CASH_IN", "PaySim"),
            ("T11", 100.0, 0, "TRANSFER", "PaySim"), ("T12", 75.0, 0, "CARD_WEB", "IEEE-CIS")]
    df = spark.createDataFrame(rows, "transaction_id string, amount double, is_fraud int, "
                                     "channel string, source_dataset string")
    out = QL.min_max_scale(QL.encode(QL.dedup(QL.impute(df))), "amount")
    got = out.collect()
    assert len(got) == 10
    assert all(v is not None for r in got for v in r)
    assert all(0.0 <= r.amount <= 1.0 for r in got)
    flags = [c for c in out.columns if c.startswith("channel_")]
    srcs = [c for c in out.columns if c.startswith("source_dataset_")]
    assert all(sum(r[c] for c in flags) == 1 and sum(r[c] for c in srcs) == 1 for r in got)
    # Median of the non-null amounts fills T2; the mode (TRANSFER) fills T3.
    byid = {r.transaction_id: r for r in QL.impute(df).collect()}
    assert byid["T2"].amount == 75.0 and byid["T3"].channel == "TRANSFER"
