"""Small generic column helpers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(c: Column, pairs, default=None) -> Column:
    """Map ``c`` through a fixed list of (key, value) pairs; folded to a literal map."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])
    out = m[c]
    return out if default is None else F.coalesce(out, F.lit(default))


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, ``default`` when the denominator is 0 or NULL (ANSI safe)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(default))


def to_ts(c: Column) -> Column:
    """Timestamp from a timestamp or an ISO-8601 string; NULL when unparsable."""
    return F.coalesce(c.try_cast("timestamp_ntz"),
                      F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz"))


def key_uniform(*parts: Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of SHA-256 over ``parts``.

    Deterministic across engines, partitionings and task retries (the same
    value is reproducible in plain SQL), so sampled splits and synthetic rows
    never change between runs.
    """
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") / 4294967296.0


def rnd(c, d: int = 0) -> Column:
    """Round half away from zero at ``d`` decimals, on the binary value:
    round(x * 10^d) / 10^d.

    ``F.round`` rounds the shortest decimal form of a double, so 0.39035
    (stored as 0.390349999...) would go up; this form decides on the stored
    value, the same way the oracle SQL engine does.
    """
    c = F.col(c) if isinstance(c, str) else c
    if d == 0:
        return F.round(c, 0)
    m = float(10 ** d)
    return F.round(c * m, 0) / m


def nan_to_null(c: Column) -> Column:
    """NaN counts as missing, as in a CSV read."""
    return F.when(~F.isnan(c), c)
