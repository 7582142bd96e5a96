"""Account (NUBAN) and BVN checks V1-V3 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def _weighted_digit_sum(digits12: Column) -> Column:
    terms = [F.substring(digits12, i + 1, 1).try_cast("int") * w
             for i, w in enumerate(C.NUBAN_WEIGHTS)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def nuban_check_digit(bank_code: Column, serial9: Column) -> Column:
    """Check digit for a 3-digit bank code and a 9-digit serial."""
    s = _weighted_digit_sum(F.concat(bank_code, serial9))
    return F.pmod(F.lit(10) - F.pmod(s, F.lit(10)), F.lit(10))


def nuban_valid(account: Column, bank_code: Column) -> Column:
    """True when the 10-digit account carries the right check digit for the bank.

    Malformed accounts or bank codes (wrong length, non-ASCII-digit) are False.
    """
    well_formed = (F.coalesce(account.rlike("^[0-9]{10}$"), F.lit(False))
                   & F.coalesce(bank_code.rlike("^[0-9]{3}$"), F.lit(False)))
    expected = nuban_check_digit(bank_code, F.substring(account, 1, 9))
    return F.when(well_formed, expected == F.substring(account, 10, 1).try_cast("int")) \
            .otherwise(F.lit(False))


def bvn_valid(bvn: Column) -> Column:
    """Exactly 11 ASCII digits."""
    return F.coalesce(bvn.rlike("^[0-9]{11}$"), F.lit(False))


def bvn_hash(bvn: Column, strict: bool = False) -> Column:
    """SHA-256 hex of a valid BVN; invalid input is NULL, or an error when strict."""
    ok = bvn_valid(bvn)
    invalid = (F.raise_error(F.lit("Invalid BVN format. Cannot hash.")).cast("string")
               if strict else F.lit(None).cast("string"))
    return F.when(ok, F.sha2(bvn, 256)).otherwise(invalid)
