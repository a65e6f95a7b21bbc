"""Row selection: members, snapshots, splits, complete cases and the audit of what they drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_LIST = 1000


def exclude_members(df: DataFrame, column: str, members: list | DataFrame) -> DataFrame:
    """Rows whose key is not a listed member.

    A short list becomes a filter inside the scan; a table of members an anti join, which
    Spark broadcasts or shuffles by the size it measures.  A missing key is kept either
    way, as it equals no member.
    """
    if isinstance(members, DataFrame):
        return df.join(members.select(column).distinct(), column, "left_anti")
    if len(members) > SMALL_LIST:
        raise ValueError("pass long member lists as a DataFrame")
    return df.where(F.col(column).isNull() | ~F.col(column).isin(members))


def drop_entities(df: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """Anti join against a computed set of entities; nothing is collected."""
    return df.join(entities.select(entity), entity, "left_anti")


def keep_entities(df: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """All rows of the entities in a computed set."""
    return df.join(entities.select(entity).distinct(), entity, "left_semi")


def latest_period(df: DataFrame, period: str, offset: int = 0) -> Column:
    """Scalar subquery: the last period minus ``offset``."""
    return df.agg((F.max(period) - F.lit(offset)).cast("int").alias("p")).scalar()


def snapshot(df: DataFrame, period: str, offset: int = 0) -> DataFrame:
    """Rows of the last period (or ``offset`` before it).

    Two passes over ``df``: give it a stored panel, not a plan that joins raw tables.
    """
    return df.where(F.col(period) == latest_period(df, period, offset))


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def positive(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with every column above 0, for log scales."""
    for c in columns:
        df = df.where(F.col(c) > 0)
    return df


def temporal_split(
    df: DataFrame, period: str, last_train: int, target: str, features: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Train up to and including ``last_train``, test after it; complete cases only."""
    usable = complete_cases(df, [target, *features])
    return usable.where(F.col(period) <= last_train), usable.where(F.col(period) > last_train)


def row_loss(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows before and after each filter applied in turn, counted in one pass.

    ``steps`` are (name, condition to stay); a condition that is NULL drops the row.
    """
    kept, rows_in = F.lit(True), F.count(F.lit(1))
    parts = []
    for i, (name, stays) in enumerate(steps, start=1):
        kept = kept & F.coalesce(stays, F.lit(False))
        rows_out = F.count(F.when(kept, 1))
        parts.append(
            F.struct(
                F.lit(i).alias("step_no"), F.lit(name).alias("step"), rows_in.alias("rows_in"), rows_out.alias("rows_out")
            )
        )
        rows_in = rows_out
    return df.agg(F.array(*parts).alias("steps")).select(F.inline("steps"))
