"""Numeric column expressions with the panel's rule for missing values: NULL, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_nan(c: Column) -> Column:
    """NaN becomes NULL, so counts, means and comparisons skip it."""
    return F.when(~F.isnan(c), c)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL where the divisor is 0 or either side is missing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent_of(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def relative_change(start: Column, end: Column) -> Column:
    """(end - start) / start."""
    return ratio(end - start, start)


def per_billion(amount: Column, base: Column) -> Column:
    """Intensity: amount per 1e9 units of the base."""
    return ratio(amount, base / F.lit(1e9))


def scaled_intensity(amount: Column, base: Column) -> Column:
    """Intensity with the amount scaled up instead; the same number wherever base is not 0."""
    return ratio(amount * F.lit(1e9), base)


def clip_low(c: Column, low: float) -> Column:
    """Lower bound that keeps NULL (``greatest`` alone would turn it into the bound)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(low))))


def remaining_gap(current: Column, target: Column | float) -> Column:
    """How much is left to the target, not below 0."""
    return clip_low((target if isinstance(target, Column) else F.lit(float(target))) - current, 0)


def affine(c: Column, base: float, per_unit: float) -> Column:
    return F.lit(float(base)) + c * F.lit(float(per_unit))


def stock_millions(per_thousand: Column, population: Column) -> Column:
    """Stock in millions from a rate per 1000 heads."""
    return per_thousand * population / F.lit(1000.0) / F.lit(1e6)


def shift_log(c: Column, factor: float) -> Column:
    """A log-scale feature after its level is multiplied by ``factor``."""
    return c + F.log(F.lit(float(factor)))


def compound_growth(rate_pct: Column) -> Column:
    """Aggregate: product of (1 + rate/100) - 1 over the non-missing rates.

    Rounded to 12 digits, so that a product that is 1 up to float noise counts as no growth.
    """
    return F.round(F.product(F.lit(1.0) + rate_pct / F.lit(100.0)) - F.lit(1.0), 12)


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded for reports; adding 0 turns -0.0 into 0.0."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)
