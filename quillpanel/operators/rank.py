"""Top-k, cumulative share, last rows per entity and the weighted rank score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillpanel.functions.numeric import percent_of, relative_change
from quillpanel.operators.ordered import percent_rank_average


def top_k(df: DataFrame, column: str, k: int, key: str, largest: bool = True) -> DataFrame:
    """The k largest (or smallest) rows, missing values last, ties by key: each task keeps k rows."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if largest else c.asc_nulls_last(), F.col(key).asc()).limit(k)


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int, rank: str = "rank_no") -> DataFrame:
    """First k rows of each group; tasks drop the rest before the shuffle, so a hot group stays small."""
    w = W.partitionBy(group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def enumerate_top(df: DataFrame, order: list[Column], rank: str = "rank_no") -> DataFrame:
    """Numbers the rows of a result already limited to a few."""
    return df.withColumn(rank, F.row_number().over(W.orderBy(*order)))


def union_top(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two top lists under each other, each key once."""
    return a.unionByName(b).dropDuplicates([key])


def cumulative_share(df: DataFrame, column: str, k: int, key: str) -> DataFrame:
    """Top k with the share of the total of all rows and the running share in descending order."""
    total = df.agg(F.sum(column).alias("t")).scalar()
    top = top_k(df, column, k, key).withColumn("share_pct", percent_of(F.col(column), total))
    order = [F.col(column).desc_nulls_last(), F.col(key).asc()]
    running = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)  # k rows only
    return enumerate_top(top.withColumn("cumulative_share_pct", F.sum("share_pct").over(running)), order)


def last_rows(df: DataFrame, entity: str, period: str, n: int) -> DataFrame:
    """The last n rows of each entity by period: rows, not calendar periods."""
    return top_per_group(df, entity, [F.col(period).desc()], n, "_back")


def endpoint_change(
    df: DataFrame, entity: str, period: str, column: str, rows: int = 5, min_values: int = 3, name: str = "endpoint_change"
) -> DataFrame:
    """(last - first) / first of the non-missing values among the last ``rows`` rows of each entity.

    Needs that many rows and ``min_values`` values; entities short of either are left out.
    """
    value = F.when(F.col(column).isNotNull(), F.col(period))
    return (
        last_rows(df, entity, period, rows)
        .groupBy(entity)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count(column).alias("_values"),
            F.min_by(column, value).alias("_first"),
            F.max_by(column, value).alias("_last"),
        )
        .where((F.col("_rows") >= rows) & (F.col("_values") >= min_values))
        .select(entity, relative_change(F.col("_first"), F.col("_last")).alias(name))
    )


def trend_slope(df: DataFrame, entity: str, period: str, column: str, rows: int = 5) -> DataFrame:
    """Least-squares slope per period over the last ``rows`` rows, as the alternative to the endpoint change."""
    return last_rows(df, entity, period, rows).groupBy(entity).agg(F.regr_slope(column, period).alias("trend_slope"))


def weighted_rank_score(
    df: DataFrame, key: str, weights: dict[str, float], ascending: dict[str, bool], name: str = "score"
) -> DataFrame:
    """Sum of weight x percentile rank per row key; NULL as soon as one component is missing."""
    ranks = percent_rank_average(df, ascending, [key])
    score = sum(F.col(f"{c}_rank") * F.lit(float(w)) for c, w in weights.items())
    return ranks.select(key, score.alias(name))
