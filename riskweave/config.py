"""Fixed values the results depend on, plus tunables.

Everything here is a plain literal.  Values that must equal the reference
application's behaviour are grouped under the ``FIXED VALUES`` banner below;
values we chose ourselves (the projections of the driver's tables into the
fraud domain) are grouped under ``PROJECTION CHOICES``.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference behaviour)
# ---------------------------------------------------------------------------

# Limits in Naira.
USSD_SINGLE_LIMIT = 20000.0
USSD_DAILY_LIMIT = 100000.0
MOBILE_APP_SINGLE_LIMIT = 100000.0
NIGHT_LARGE_AMOUNT = 500000.0
NEW_DEVICE_AMOUNT = 100000.0

# Velocity.
MAX_TX_PER_HOUR = 5
MAX_SAME_BENEFICIARY_PER_HOUR = 3

# Night window: hour >= 23 or hour < 4.
NIGHT_WINDOW_START = 23
NIGHT_WINDOW_END = 4

# Rule names and weights, in rule order.
RULES = [
    ("BVN_DETAILS_MISMATCH", 0.90),
    ("USSD_SINGLE_LIMIT_EXCEEDED", 0.85),
    ("NIGHT_WINDOW_LARGE_TRANSFER", 0.65),
    ("HIGH_TRANSACTION_VELOCITY", 0.70),
    ("LOCATION_ANOMALY", 0.75),
    ("NEW_DEVICE_HIGH_VALUE_TX", 0.50),
]
RULE_WEIGHT = dict(RULES)

# Decision tiers.
BLOCK_AT = 0.8
OTP_AT = 0.5
ALERT_BLOCK_AT = 0.80
HIGH_RISK_AT = 0.85
NOTIFY_AT = 0.85
DEFAULT_CUTOFF = 0.5

# Decision and status labels.
BLOCKED = "BLOCKED"
PENDING_OTP = "PENDING_OTP"
APPROVED = "APPROVED"
UNKNOWN_CHANNEL = "UNKNOWN"
INCREASES = "INCREASES"
DECREASES = "DECREASES"

# Text formats (printf style) and fixed messages.
MODEL_REASON_FORMAT = "Model Probability: %.1f%%"
F1_REASON_FORMAT = "F1-score (%.4f) below threshold (%s)"
DRIFT_REASON_PREFIX = "Data drift detected: "
DRIFT_REASON_MIDDLE = " of features drifted (threshold={threshold:.0%}). Drifted: "
FORCED_REASON = "Manual force retrain requested by operator"
NO_RETRAIN_REASON = "No drift or performance degradation detected"
REASON_SEPARATOR = " | "
FEATURE_RENAMES = [("channel_", "Channel: "), ("source_dataset_", "Pipeline: ")]
MESSAGE_HEADER = "[{brand}] FRAUD ALERT"
MESSAGE_FACTORS = "Top Risk Factors:"
MESSAGE_FOOTER = "-- Auto-blocked by {brand} --"

# Event defaults when a field is missing.
DEFAULT_CHANNEL = "MobileApp"
DEFAULT_LOCATION = "Lagos"

# Account check-digit weights.
NUBAN_WEIGHTS = [3, 7, 3, 3, 7, 3, 3, 7, 3, 3, 7, 3]

# Bank codes and names.
BANKS = [
    ("011", "First Bank of Nigeria"),
    ("032", "Union Bank of Nigeria"),
    ("033", "United Bank for Africa (UBA)"),
    ("035", "Wema Bank"),
    ("044", "Access Bank"),
    ("050", "Ecobank Nigeria"),
    ("057", "Zenith Bank"),
    ("058", "Guaranty Trust Bank (GTBank)"),
    ("070", "Fidelity Bank"),
    ("214", "First City Monument Bank (FCMB)"),
    ("215", "Unity Bank"),
    ("221", "Heritage Bank"),
    ("232", "Sterling Bank"),
    ("301", "Jaiz Bank"),
    ("076", "Polaris Bank"),
    ("101", "Providus Bank"),
]
UNKNOWN_BANK = "Unknown Bank"

# Card product code -> channel; anything else is CARD_OTHER.
PRODUCT_CHANNEL = [
    ("W", "CARD_WEB"),
    ("H", "CARD_HOST"),
    ("C", "CARD_PHONE"),
    ("S", "CARD_STORE"),
    ("R", "CARD_RECURRING"),
]
CARD_OTHER = "CARD_OTHER"

# Pinned one-hot categories, in feature order.
CHANNELS = [
    "CARD_HOST", "CARD_PHONE", "CARD_RECURRING", "CARD_STORE", "CARD_WEB",
    "CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER",
]
SOURCES = ["IEEE-CIS", "PaySim"]
FEATURES = (["amount"] + [f"channel_{c}" for c in CHANNELS]
            + [f"source_dataset_{s}" for s in SOURCES])
LABEL = "is_fraud"

# Serving-time amount scale and event channel -> model channel.
SERVE_AMOUNT_SCALE = 2500000.0
EVENT_CHANNEL_TO_MODEL = [
    ("USSD", "TRANSFER"),
    ("MOBILEAPP", "TRANSFER"),
    ("WEB", "CARD_WEB"),
    ("POS", "CASH_OUT"),
    ("ATM", "CASH_OUT"),
]
EVENT_CHANNEL_DEFAULT_MODEL = "TRANSFER"

# Anomaly-feature codes and defaults.
ANOMALY_CHANNEL_CODE = [("USSD", 0), ("WEB", 1), ("MOBILEAPP", 2), ("POS", 3), ("ATM", 4)]
ANOMALY_CHANNEL_DEFAULT = 2
ANOMALY_LOCATION_CODE = [("LAGOS", 0), ("ABUJA", 1), ("PORT HARCOURT", 2), ("KANO", 3)]
ANOMALY_LOCATION_DEFAULT = 4
ANOMALY_HOUR_DEFAULT = 12

# Z-score fallback scorer.
ZSCORE_HIGH = 3.0
ZSCORE_MID = 2.0
ZSCORE_SCORES = (0.85, 0.60, 0.15)
UNTRAINED_SCORE = 0.10

# Additive log-odds scorer: base, amount slope, then per-flag (if set, if not set).
LOGODDS_BASE = -1.25
LOGODDS_AMOUNT = 2.11
LOGODDS_FLAGS = [
    ("channel_CARD_WEB", 0.45, -0.25),
    ("channel_CASH_OUT", 0.50, -0.20),
    ("channel_DEBIT", -0.50, 0.20),
    ("channel_TRANSFER", 0.75, -0.30),
    ("source_dataset_PaySim", 0.40, -0.10),
]

# Drift.
PSI_BINS = 10
PSI_EPS = 1e-6
PSI_THRESHOLD = 0.20
DRIFT_SHARE_THRESHOLD = 0.30
F1_THRESHOLD = 0.85
MAX_BACKUPS = 10

# Validation fail-fast limit.
MAX_INVALID_ROWS = 5

# Latency target in milliseconds.
LATENCY_TARGET_MS = 200.0

# Geo dimension: state, latitude, longitude.
GEO = [
    ("Lagos", 6.5244, 3.3792),
    ("Abuja (FCT)", 9.0765, 7.3986),
    ("Port Harcourt (Rivers)", 4.8156, 7.0498),
    ("Kano", 12.0022, 8.5919),
    ("Ibadan (Oyo)", 7.3775, 3.9470),
    ("Kaduna", 10.5105, 7.4165),
    ("Benin City (Edo)", 6.3350, 5.6263),
    ("Abeokuta (Ogun)", 7.1599, 3.3486),
    ("Enugu", 6.4584, 7.5083),
    ("Warri (Delta)", 5.5174, 5.7508),
    ("Jos (Plateau)", 9.8965, 8.8583),
    ("Maiduguri (Borno)", 11.8311, 13.1509),
]

# Tuned boosted-tree parameters saved by the reference's search, per library.
TUNED_PARAMS = {
    "first": {
        "n_estimators": 267,
        "max_depth": 9,
        "learning_rate": 0.13766134492174428,
        "subsample": 0.7468977981821954,
        "colsample_bytree": 0.7613664146909971,
        "min_child_weight": 10,
        "scale_pos_weight": 1.4829634081378087,
    },
    "second": {
        "n_estimators": 152,
        "max_depth": 8,
        "num_leaves": 159,
        "learning_rate": 0.045374723380929426,
        "subsample": 0.9764707554239438,
        "colsample_bytree": 0.5081385552186585,
        "min_child_samples": 7,
        "scale_pos_weight": 1.0950503970248604,
    },
}

# ---------------------------------------------------------------------------
# PROJECTION CHOICES (how the driver's tables become fraud-domain tables)
# ---------------------------------------------------------------------------

# Event type -> payment channel.
EVENT_CHANNEL = [
    ("view", "WEB"),
    ("click", "MOBILEAPP"),
    ("purchase", "POS"),
    ("signup", "ATM"),
    ("error", "USSD"),
]
# Home cities, indexed by user_id % 7 (first) and (user_id + 1) % 7 (second).
CITIES = ["Lagos", "Abuja", "Port Harcourt", "Kano", "Ibadan", "Kaduna", "Enugu"]
FOREIGN_CITY = "London"
# Bank codes indexed by user_id % 7.
USER_BANKS = ["011", "032", "033", "044", "057", "058", "070"]
# Order priority -> mobile-money transaction type.
PRIORITY_TYPE = [
    ("1-URGENT", "TRANSFER"),
    ("2-HIGH", "CASH_OUT"),
    ("3-MEDIUM", "PAYMENT"),
    ("4-NOT SPECIFIED", "DEBIT"),
    ("5-LOW", "CASH_IN"),
]
# (returnflag || linestatus) -> card product code; "RO" is deliberately unmapped.
FLAG_PRODUCT = [("AF", "W"), ("AO", "H"), ("NF", "C"), ("NO", "S"), ("RF", "R")]
UNMAPPED_PRODUCT = "U"
# Day that splits reference and current windows for drift.
DRIFT_SPLIT_DAY = "2024-01-16"
DRIFT_SHIFT = 1.6


@dataclass(frozen=True)
class Tunables:
    """Knobs that change plans, not results."""

    # Groups of at most this many rows are collected by exact quantile search.
    quantile_collect_limit: int = 100_000
    quantile_buckets: int = 1024
    # Rows per equal-depth bucket of prefix sums.
    rank_rows: int = 1_000_000
    # Consecutive points of a cell whose neighbours are found in one window.
    neighbour_block: int = 100_000
    # Blocks of equal rows that a tree learner draws from.
    tree_blocks: int = 500_000
    # Synthetic rows per task.
    synthetic_rows: int = 1_000_000
    # Hour buckets used to bound velocity-window partitions.
    velocity_bucket_seconds: int = 3600


TUNABLES = Tunables()


# Labels of alerts that a model alone raised.
MODEL_HIGH_AT = 0.85
MODEL_HIGH = "MODEL_HIGH_FRAUD_RISK"
MODEL_SUSPICIOUS = "MODEL_SUSPICIOUS_RISK"

# Further required fields of the two sources, by column name.
MONEY_REQUIRED = ["nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest", "oldbalanceDest", "newbalanceDest",
                  "isFlaggedFraud"]
CARD_REQUIRED = ["TransactionDT"]
