"""Long-run outcome per entity and the feature matrix of its base period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel import fixed_values as V
from quillpanel.functions.classes import outcome_type
from quillpanel.functions.numeric import compound_growth, relative_change
from quillpanel.spec import existing


def cumulative_growth(
    df: DataFrame,
    entity: str,
    period: str,
    rate: str,
    first: int,
    last: int,
    evidence: float = V.EVIDENCE_SHARE,
    include_base_year: bool = True,
) -> DataFrame:
    """Compound growth per entity over the closed window, NULL below the evidence share.

    The window holds last - first + 1 rates; ``include_base_year=False`` leaves out the
    first one, so that the product spans exactly last - first steps.
    """
    inside = df.where(F.col(period).between(first if include_base_year else first + 1, last))
    return inside.groupBy(entity).agg(
        F.count(rate).alias("n_rates"),
        F.when(F.count(rate) >= evidence * (last - first), compound_growth(F.col(rate))).alias("growth"),
    )


def outcomes(
    df: DataFrame,
    entity: str,
    period: str,
    target: str,
    rate: str,
    last: int,
    years: int = V.HORIZON_YEARS,
    threshold: float = V.REDUCTION_THRESHOLD,
    evidence: float = V.EVIDENCE_SHARE,
    include_base_year: bool = True,
) -> DataFrame:
    """Start and end value, change, base growth, outcome type and 0/1 flag: one shuffle by entity.

    Entities without a value at either end, or with a start of 0 or less, are left out.
    Without a growth column every outcome is insufficient_data.
    """
    first = last - years
    at = lambda p: F.max(F.when(F.col(period) == p, F.col(target)))
    if rate in df.columns:
        counted = F.col(period) > first if not include_base_year else F.lit(True)
        used = F.when(counted, F.col(rate))
        growth = F.when(F.count(used) >= evidence * years, compound_growth(used))
    else:
        growth = F.lit(None).cast("double")
    change = relative_change(F.col("start_value"), F.col("end_value"))
    return (
        df.where(F.col(period).between(first, last))
        .groupBy(entity)
        .agg(at(first).alias("start_value"), at(last).alias("end_value"), growth.alias("growth"))
        .where(F.col("end_value").isNotNull() & (F.col("start_value") > 0))
        .withColumn("change", change)
        .withColumn("outcome", outcome_type(F.col("change"), F.col("growth"), threshold))
        .withColumn("success", (F.col("outcome") == "decoupling").cast("int"))
    )


def feature_matrix(
    df: DataFrame,
    outcome: DataFrame,
    entity: str,
    period: str,
    base: int,
    features: list[str],
    log_features: list[str],
) -> DataFrame:
    """Features of the base period (those that exist), their logs, and the entity's outcome."""
    logs = {f"log_{c}": F.log1p(F.col(c).cast("double")) for c in existing(df, log_features)}
    rows = df.where(F.col(period) == base).select(entity, *existing(df, features)).withColumns(logs)
    return rows.join(outcome.select(entity, "success", "change", "growth", "outcome"), entity)
