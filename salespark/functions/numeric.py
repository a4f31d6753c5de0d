"""Sums and ratios with the null rules of the sales tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# money is added in ten-thousandths: integer addition gives the same total in any order
MONEY_STEPS = 10_000


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def exact_sum(value: Column | str) -> Column:
    """Sum of money as a double; 0.0 without any non-null value.

    Whole units and ten-thousandths are added apart as BIGINT, so the result does not depend on partitioning, equal
    totals compare equal (ties in rankings and quintiles), and totals up to 9.2e18 fit. The two meet as a decimal.
    Under ANSI mode an overflow raises.
    """
    amount = _col(value).cast("double")
    whole = F.floor(amount)
    parts = F.rint((amount - whole) * MONEY_STEPS).cast("bigint")
    steps = F.sum(whole).cast("decimal(20,0)") * F.lit(MONEY_STEPS).cast("decimal(5,0)") + F.sum(parts).cast("decimal(20,0)")
    return F.coalesce(steps.cast("double"), F.lit(0.0)) / float(MONEY_STEPS)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, null where the denominator is zero."""
    return _col(numerator) / F.nullif(_col(denominator).cast("double"), F.lit(0.0))


def share_pct(value: Column | str, total: Column | str) -> Column:
    """Value as % of the total, with a zero total counted as 1."""
    total = _col(total).cast("double")
    return _col(value) / F.when(total == 0, 1.0).otherwise(total) * 100


def change_pct(now: Column | str, before: Column | str) -> Column:
    """Variation in %, null without a positive earlier value."""
    before = _col(before)
    return F.when(before > 0, (_col(now) - before) / before * 100)
