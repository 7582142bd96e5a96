"""Driver contract: entry runs, every query has a callable, SQL keys are a subset."""

import duckdb

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["rule_decision", "n", "pct"]


def test_registry_shape():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60


def test_oracle_sample(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    q, s = E.queries(), E.oracle_sql()
    for name in ["rule_decisions", "fraud_summary", "auc", "psi", "alert_kpis", "folds"]:
        a = sorted(map(repr, (tuple(r) for r in q[name](spark, SF).collect())))
        cur = con.execute(s[name])
        b = sorted(map(repr, (tuple(r) for r in cur.fetchall())))
        assert len(a) == len(b), name
