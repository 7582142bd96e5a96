"""Source alignment, validation, profiling, imputation, de-duplication and
encoding (P1-P11, A1-A6, U1, U4, U6, W1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.core import lookup, nan_to_null, rnd
from ..functions.scoring import one_hot
from .stats import exact_median, min_max_scale, mode_value


def align_money(raw: DataFrame) -> DataFrame:
    """Mobile-money rows -> common schema; id from step and the natural key."""
    return raw.select(
        F.concat(F.lit("PAYSIM_"), F.col("step").cast("string"), F.lit("_"),
                 F.col("order_key").cast("string")).alias("transaction_id"),
        nan_to_null(F.col("amount").cast("double")).alias("amount"),
        F.col("isFraud").cast("int").alias("is_fraud"),
        F.col("type").alias("channel"),
        F.lit("PaySim").alias("source_dataset"))


def align_card(raw: DataFrame) -> DataFrame:
    """Card rows -> common schema with product-code recode and default."""
    return raw.select(
        F.concat(F.lit("IEEE_"), F.col("TransactionID").cast("string")).alias("transaction_id"),
        nan_to_null(F.col("TransactionAmt").cast("double")).alias("amount"),
        F.col("isFraud").cast("int").alias("is_fraud"),
        lookup(F.col("ProductCD"), C.PRODUCT_CHANNEL, C.CARD_OTHER).alias("channel"),
        F.lit("IEEE-CIS").alias("source_dataset"))


def merge_sources(money: DataFrame, card: DataFrame) -> DataFrame:
    """Union of the two aligned sources (U1); no shuffle."""
    return align_money(money).unionByName(align_card(card))


# --- validation -----------------------------------------------------------

def _required(columns, fields) -> list[tuple[str, Column]]:
    """Missing-value checks of the other required fields that the table has."""
    return [(f"{f}_required", F.col(f"`{f}`").isNull()) for f in fields if columns is not None and f in columns]


def money_checks(columns: list[str] | None = None) -> list[tuple[str, Column]]:
    """Checks of the mobile-money source; ``columns``: those of the table, for the fields not all tables carry."""
    amt = nan_to_null(F.col("amount").cast("double"))
    return _required(columns, C.MONEY_REQUIRED) + [
        ("step_required", F.col("step").isNull()),
        ("type_required", F.col("type").isNull()),
        ("amount_required", amt.isNull()),
        ("amount_negative", amt < 0),
        ("label_range", ~F.coalesce(F.col("isFraud").isin(0, 1), F.lit(False))),
    ]


def card_checks(columns: list[str] | None = None) -> list[tuple[str, Column]]:
    """Checks of the card source; ``columns`` as for the mobile-money source."""
    amt = nan_to_null(F.col("TransactionAmt").cast("double"))
    return _required(columns, C.CARD_REQUIRED) + [
        ("id_required", F.col("TransactionID").isNull()),
        ("amount_required", amt.isNull()),
        ("amount_negative", amt < 0),
        ("label_range", ~F.coalesce(F.col("isFraud").isin(0, 1), F.lit(False))),
        ("product_required", F.col("ProductCD").isNull()),
    ]


def violations(checks: list[tuple[str, Column]]) -> Column:
    """Array of failed check codes, in check order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code))
                                     for code, c in checks]))


def validate(df: DataFrame, checks) -> DataFrame:
    return df.withColumn("violations", violations(checks))


def fail_fast(df: DataFrame, checks, limit: int = C.MAX_INVALID_ROWS) -> int:
    """Count invalid rows in one aggregate; raise when above ``limit`` (P5)."""
    n = df.agg(F.count_if(F.size(violations(checks)) > 0)).first()[0]
    if n > limit:
        raise ValueError(f"{n} invalid rows exceed the limit of {limit}")
    return n


# --- profile and summaries -------------------------------------------------

def null_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null and null counts, from one aggregate."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count(F.col(f"`{c}`")).alias(f"nn_{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    dtypes = dict(df.dtypes)
    stack = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(dtypes[c]).alias("dtype"),
                 F.col(f"nn_{i}").alias("non_null"),
                 (F.col("__rows") - F.col(f"nn_{i}")).alias("nulls"))
        for i, c in enumerate(df.columns)]))
    return one.select(stack)


def fraud_summary(df: DataFrame) -> DataFrame:
    """Per source: legit, fraud, total, fraud rate % (A1); conditional counts, no pivot."""
    g = df.groupBy("source_dataset").agg(
        F.count_if(F.col("is_fraud") == 0).alias("legitimate"),
        F.count_if(F.col("is_fraud") == 1).alias("fraudulent"))
    total = F.col("legitimate") + F.col("fraudulent")
    return g.select("source_dataset", "legitimate", "fraudulent", total.alias("total"),
                    rnd(F.col("fraudulent") * 100.0 / total, 2).alias("fraud_rate_pct"))


def class_counts(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Overall class counts (A2)."""
    return df.agg(F.count_if(F.col(label) == 0).alias("legitimate"),
                  F.count_if(F.col(label) == 1).alias("fraudulent"),
                  F.count(F.lit(1)).alias("total"))


# --- cleaning --------------------------------------------------------------

def impute(df: DataFrame, numeric: list[str] = ("amount",),
           categorical: list[str] = ("channel",)) -> DataFrame:
    """Median fill for numeric, mode fill (smallest on ties) for categorical (A3-A5).

    Only the listed columns are filled; identifiers are never imputed.
    """
    out = df
    for c in numeric:
        med = exact_median(df, c)
        if med is not None:
            out = out.withColumn(c, F.coalesce(nan_to_null(F.col(c)), F.lit(med)))
    for c in categorical:
        out = out.withColumn(c, F.coalesce(F.col(c), mode_value(df, c)))
    return out


def dedup(df: DataFrame, id_col: str = "transaction_id",
          keys: list[str] | None = None) -> DataFrame:
    """Keep the first (smallest id) row per content fingerprint.

    Written as a group-by with ``min(id)``: partial aggregation collapses
    repeats before the shuffle, so a fingerprint repeated a billion times
    sends one row per partition, not a billion, to a single task.  NULLs
    compare equal, as in the fingerprint of their printed form.
    """
    keys = keys or [c for c in df.columns if c != id_col]
    return df.groupBy(*keys).agg(F.min(id_col).alias(id_col)).select(id_col, *keys)


def encode(df: DataFrame) -> DataFrame:
    """Pinned one-hot flags for channel and source (P10)."""
    rest = [c for c in df.columns if c not in ("channel", "source_dataset")]
    return df.select(*rest, *one_hot(F.col("channel"), F.col("source_dataset")))


def feature_table(money: DataFrame, card: DataFrame) -> DataFrame:
    """merge -> impute -> dedup -> one-hot -> min-max: the 13-feature table."""
    filled = impute(merge_sources(money, card))
    # The range is taken before the de-duplication: the same values without a second shuffle of all rows.
    return min_max_scale(encode(dedup(filled)), "amount", over=filled)


def distinct_categories(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values (U4)."""
    return df.select(col).distinct().orderBy(col)


def column_kinds(df: DataFrame, label: str = "is_fraud") -> tuple[list[str], list[str]]:
    """Numeric and categorical columns from the schema, label excluded."""
    from pyspark.sql.types import NumericType
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != label]
    cat = [f.name for f in df.schema.fields
           if not isinstance(f.dataType, NumericType) and f.name != label]
    return num, cat


def align_features(df: DataFrame, features=C.FEATURES, keep: list[str] = ()) -> DataFrame:
    """Keep ``keep`` plus the feature columns; absent features become 0.0."""
    have = set(df.columns)
    cols = [F.col(f"`{k}`") for k in keep]
    cols += [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f) if f in have
             else F.lit(0.0).alias(f) for f in features]
    return df.select(*cols)


def cast_text(df: DataFrame, schema) -> DataFrame:
    """Per-column ``try_cast`` of an all-string scan (S2) to ``schema``; a value
    that is present but does not parse is recorded in ``type_errors``."""
    typed, errors = [], []
    for f in schema.fields:
        raw = F.col(f"`{f.name}`")
        cast = raw.try_cast(f.dataType)
        typed.append(cast.alias(f.name))
        errors.append(F.when(raw.isNotNull() & cast.isNull(), F.lit(f"{f.name}_type")))
    return df.select(*typed, F.array_compact(F.array(*errors)).alias("type_errors"))


def validate_text(df: DataFrame, schema, checks) -> DataFrame:
    """Typed rows with all violation codes: parse errors first, then the checks."""
    t = cast_text(df, schema)
    return t.withColumn("violations", F.concat(F.col("type_errors"), violations(checks))) \
            .drop("type_errors")
