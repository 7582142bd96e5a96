"""SQL text for the canonical views, written independently of the Spark code.

Used as the oracle side of every registered query (DuckDB dialect, ANSI
where possible).  The fixed lists come from ``config``; the logic here is a
second, hand-written statement of each view.
"""

from __future__ import annotations

from .. import config as C


def q(s) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def case(expr: str, pairs, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k) if isinstance(k, str) else k} THEN "
                     f"{q(v) if isinstance(v, str) else v}" for k, v in pairs)
    return f"(CASE {expr} {whens} ELSE {default} END)"


def nuban_digit_sql(bank: str, serial: str) -> str:
    s = " + ".join(f"CAST(substr({bank} || {serial}, {i + 1}, 1) AS INTEGER) * {w}"
                   for i, w in enumerate(C.NUBAN_WEIGHTS))
    return f"((10 - (({s}) % 10)) % 10)"


_HOME1 = case("user_id % 7", list(enumerate(C.CITIES)))
_HOME2 = case("(user_id + 1) % 7", list(enumerate(C.CITIES)))
_BANK = case("user_id % 7", list(enumerate(C.USER_BANKS)))
_SERIAL = "lpad(CAST(event_id % 1000000000 AS VARCHAR), 9, '0')"

TX_BASE = f"""
SELECT 'TXN' || CAST(event_id AS VARCHAR) AS transaction_id,
       event_id,
       user_id AS sender,
       CAST(round(value * 100) * 50 AS DOUBLE) AS amount,
       {case('event_type', C.EVENT_CHANNEL)} AS channel,
       CASE WHEN event_id % 29 = 0 THEN {q(C.FOREIGN_CITY)} ELSE {_HOME1} END AS location,
       [{_HOME1}, {_HOME2}] AS historical_locations,
       (event_id % 41 = 0) AS device_is_new,
       (event_id % 53 <> 0) AS bvn_matched,
       ts,
       {_BANK} AS bank_code,
       {_SERIAL} || CAST(({nuban_digit_sql(_BANK, _SERIAL)} + event_id % 2) % 10 AS VARCHAR) AS account,
       CASE WHEN event_id % 37 = 0 THEN 'BVN' || CAST(user_id AS VARCHAR)
            ELSE lpad(CAST(user_id % 100000000000 AS VARCHAR), 11, '2') END AS bvn,
       (event_id * 7919) % 200 AS beneficiary,
       CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS is_fraud,
       TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS scoring_latency_ms
FROM events
"""

TX_VELOCITY = f"""
SELECT *, CAST(count(*) OVER (PARTITION BY sender ORDER BY ts
              RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) - 1 AS INTEGER)
          AS tx_count_last_hour
FROM ({TX_BASE}) b
"""

RAW_MONEY = f"""
SELECT o_orderkey AS order_key,
       CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 24 AS step,
       CASE WHEN o_orderkey % 89 = 0 THEN NULL
            ELSE {case('o_orderpriority', C.PRIORITY_TYPE)} END AS type,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice END AS amount,
       'C' || CAST(o_custkey AS VARCHAR) AS nameOrig,
       o_totalprice AS oldbalanceOrg,
       0.0::DOUBLE AS newbalanceOrig,
       'M' || CAST((o_orderkey * 31) % 10007 AS VARCHAR) AS nameDest,
       0.0::DOUBLE AS oldbalanceDest,
       o_totalprice AS newbalanceDest,
       CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END AS isFraud,
       0 AS isFlaggedFraud
FROM orders
"""

RAW_CARD = f"""
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR),
                 CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                 CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR),
                 CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS TransactionID,
       CASE WHEN l_partkey % 20 = 0 THEN 1 ELSE 0 END AS isFraud,
       CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 86400 AS TransactionDT,
       l_extendedprice AS TransactionAmt,
       {case('l_returnflag || l_linestatus', C.FLAG_PRODUCT, q(C.UNMAPPED_PRODUCT))} AS ProductCD,
       CAST(l_partkey AS DOUBLE) AS card1,
       CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE CAST(l_suppkey AS DOUBLE) END AS card2,
       CAST(l_orderkey % 500 AS DOUBLE) AS addr1,
       CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'mail.example' END AS P_emaildomain
FROM lineitem
"""

COMMON = f"""
SELECT 'PAYSIM_' || CAST(step AS VARCHAR) || '_' || CAST(order_key AS VARCHAR) AS transaction_id,
       amount, isFraud AS is_fraud, type AS channel, 'PaySim' AS source_dataset
FROM ({RAW_MONEY}) m
UNION ALL
SELECT 'IEEE_' || TransactionID AS transaction_id, TransactionAmt AS amount, isFraud AS is_fraud,
       {case('ProductCD', C.PRODUCT_CHANNEL, q(C.CARD_OTHER))} AS channel,
       'IEEE-CIS' AS source_dataset
FROM ({RAW_CARD}) c
"""


def rules_sql(src: str, velocity_threshold: int) -> str:
    """Rule flags, triggered list, score and decision over a transaction relation."""
    amt = "coalesce(amount, 0.0)"
    ch = f"upper(coalesce(channel, {q(C.DEFAULT_CHANNEL)}))"
    loc = f"coalesce(location, {q(C.DEFAULT_LOCATION)})"
    hist = f"coalesce(historical_locations, [{q(C.DEFAULT_LOCATION)}])"
    flags = [
        "NOT coalesce(bvn_matched, true)",
        f"({ch} = 'USSD' AND {amt} > {C.USSD_SINGLE_LIMIT})",
        f"(coalesce(hour(ts) >= {C.NIGHT_WINDOW_START} OR hour(ts) < {C.NIGHT_WINDOW_END}, false)"
        f" AND {amt} >= {C.NIGHT_LARGE_AMOUNT})",
        f"(coalesce(tx_count_last_hour, 0) >= {velocity_threshold})",
        f"NOT coalesce(list_contains({hist}, {loc}), false)",
        f"(coalesce(device_is_new, false) AND {amt} >= {C.NEW_DEVICE_AMOUNT})",
    ]
    names = [n for n, _ in C.RULES]
    weights = [w for _, w in C.RULES]
    cols = ", ".join(f"{f} AS f{i}" for i, f in enumerate(flags))
    trig = "list_concat(" + ", ".join(
        f"CASE WHEN f{i} THEN [{q(n)}] ELSE []::VARCHAR[] END" for i, n in enumerate(names)) + ")"
    score = "CAST(round(greatest(0.0, " + ", ".join(
        f"CASE WHEN f{i} THEN {w} ELSE 0.0 END" for i, w in enumerate(weights)) + "), 2) AS DOUBLE)"
    return f"""
SELECT *, {trig} AS triggered_rules, {score} AS rule_risk_score,
       CASE WHEN {score} >= {C.BLOCK_AT} THEN 'BLOCKED'
            WHEN {score} >= {C.OTP_AT} THEN 'PENDING_OTP' ELSE 'APPROVED' END AS rule_decision
FROM (SELECT *, {cols} FROM ({src}) s0) s1
"""


def key_uniform_sql(*parts: str) -> str:
    text = "concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"(CAST(('0x' || substr(sha256({text}), 1, 8)) AS BIGINT) / 4294967296.0)"
