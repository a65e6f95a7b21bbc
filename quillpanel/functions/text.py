"""Names and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_period(c: Column, prefix: str = "YR") -> Column:
    """'YR1990' -> 1990; NULL for what is no whole number then."""
    return F.regexp_replace(c.cast("string"), prefix, "").try_cast("int")


def metric_name(c: Column, prefix: str = "co2_", suffix: str = "_mt") -> Column:
    """Metric column name without its prefix and suffix."""
    return F.regexp_replace(F.regexp_replace(c, f"^{prefix}", ""), f"{suffix}$", "")


def title(c: Column) -> Column:
    return F.initcap(F.regexp_replace(c, "_", " "))


def upper_title(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "_", " "))


def display(c: Column, digits: int, prefix: str = "", suffix: str = "", sign: bool = False, missing: str = "N/A") -> Column:
    """Number with thousands commas and fixed digits, halves to even; or the word for missing."""
    number = F.format_string(f"%{'+' if sign else ''},.{digits}f", F.bround(c.cast("double"), digits))
    return F.when(c.isNull(), F.lit(missing)).otherwise(F.concat(F.lit(prefix), number, F.lit(suffix)))


def signed_percent(share: Column) -> Column:
    """0.123 -> '+12.3%'."""
    return display(share * 100, 1, suffix="%", sign=True)


def dollars(c: Column) -> Column:
    """1234.6 -> '$1,235'."""
    return display(c, 0, prefix="$")
