"""Exact order statistics without putting a whole column into one task.

Ranks, quantiles, ROC points and exact splits all need "how many values are smaller".
Rows are first counted per distinct value, so a value that holds a third of all rows is
one row afterwards.  The distinct values are then cut into ranges at boundaries taken
from the values themselves: those whose hash lies in the share of all hashes that holds
about as many values as ranges are wanted.  That takes the number of distinct values,
which tasks count and add up, and a filter; no task sees more than its own values and
the boundaries, and as these depend on the data only, a recomputed task sees the same
ranges.  Each range is ordered on its own and starts at the total of the ranges below it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_RANGES, MAX_RANGES = 32, 1024


def range_count(df: DataFrame) -> int:
    """As many ranges as the session shuffles into, within bounds that keep the boundary list small."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_RANGES, max(MIN_RANGES, wanted))


def ordered_totals(
    df: DataFrame,
    value: str,
    by: str | None = None,
    measures: dict[str, Column] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """One row per distinct non-missing ``value`` (inside each ``by`` group).

    For each measure ``m`` (counts; by default ``n``, the rows): ``m`` at this value,
    ``m_before`` over all smaller values and ``m_all`` over the whole group.  ``by`` must
    have few groups (metrics, classes); the values may be as many as they like.
    """
    measures = measures or {"n": F.count(F.lit(1))}
    names = list(measures)
    group = by or "_group"
    rows = df.where(F.col(value).isNotNull())
    if not by:  # one group for all, written so that it stays a join key
        rows = rows.withColumn(group, F.when(F.col(value).isNotNull(), 0))
    counted = rows.groupBy(group, value).agg(*[m.alias(k) for k, m in measures.items()])
    ranges = ranges or range_count(df)
    # one row per group with its boundaries, so the broadcast side cannot grow with the data
    edges = F.broadcast(_edges(counted, value, group, names, ranges))
    ranged = counted.join(edges, counted[group] == edges["_of"], "left").select(group, value, *names, _range_of(F.col(value), ranges).alias("_range"))

    below = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        ranged.groupBy(group, "_range")
        .agg(*[F.sum(m).alias(f"_sum_{m}") for m in names])
        .select(
            group,
            "_range",
            *[F.coalesce(F.sum(f"_sum_{m}").over(below), F.lit(0)).alias(f"_below_{m}") for m in names],
            *[F.sum(f"_sum_{m}").over(W.partitionBy(group)).alias(f"{m}_all") for m in names],
        )
    )
    inside = W.partitionBy(group, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    positioned = ranged.withColumns({f"_inside_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in names})
    # at most (ranges + 1) rows per group, so the broadcast side cannot grow with the data
    return positioned.join(F.broadcast(totals), [group, "_range"]).select(
        *([by] if by else []),
        value,
        *names,
        *[(F.col(f"_below_{m}") + F.col(f"_inside_{m}")).alias(f"{m}_before") for m in names],
        *[f"{m}_all" for m in names],
    )


def _edges(counted: DataFrame, value: str, group: str, names: list[str], ranges: int) -> DataFrame:
    """The sorted lower ends of each group's ranges but the first, as (_of, _edges); about ``ranges`` of them."""
    # the tests on the measures keep this branch's columns equal to the others', so one shuffle serves all
    rows = counted.where(reduce(lambda a, b: a & b, [F.col(m) >= 0 for m in names]))
    sizes = rows.groupBy(F.col(group).alias("_of")).agg(F.count(F.lit(1)).alias("_values"))
    place = F.shiftrightunsigned(F.xxhash64(value), 11) / F.lit(float(1 << 53))  # from 0 to below 1, by value
    chosen = rows.join(F.broadcast(sizes), F.col(group) == F.col("_of")).where(place * F.col("_values") < ranges)
    return chosen.groupBy("_of").agg(F.sort_array(F.collect_list(value)).alias("_edges"))


def _range_of(value: Column, ranges: int) -> Column:
    """How many of the ascending ``_edges`` are not above ``value``, by halving steps.

    Edges number ``ranges`` on average; twice as many, and a few, are never reached.
    """
    steps = [1 << i for i in reversed(range((2 * ranges + 64).bit_length()))]
    onwards = lambda at, step: F.when(F.get("_edges", at + step - 1) <= value, at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), onwards)


def average_rank(ascending: bool = True) -> Column:
    """Rank from 1 with ties averaged, over the columns of :func:`ordered_totals`."""
    smaller = F.col("n_before") if ascending else F.col("n_all") - F.col("n_before") - F.col("n")
    return smaller + (F.col("n") + 1) / 2


def attach_by_value(df: DataFrame, lookup: DataFrame, keys: list[str], payload: list[str], hot_share: float = 0.001) -> DataFrame:
    """Left join of rows to a one-row-per-value lookup that stands hot and missing values.

    ``lookup`` comes from :func:`ordered_totals`.  Values that hold at least ``hot_share``
    of their group number at most 1/hot_share per group, so they go out by broadcast;
    their rows, and rows without a value, are spread over the shuffle of the rest.
    """
    value = keys[-1]
    is_hot = F.col("n") >= F.lit(hot_share) * F.col("n_all")
    hot = lookup.where(is_hot).select(*keys, F.struct(*payload).alias("_hot"))
    cold = lookup.where(~is_hot).select(*keys, F.lit(0).alias("_spread"), F.struct(*payload).alias("_cold"))
    spread = F.when(
        F.col("_hot").isNotNull() | F.col(value).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(1024)).cast("int") + 1
    ).otherwise(0)
    joined = (
        df.join(F.broadcast(hot), keys, "left")
        .withColumn("_spread", spread)
        .join(cold, [*keys, "_spread"], "left")
    )
    found = F.coalesce("_hot", "_cold")
    return joined.select(*df.columns, *[found[p].alias(p) for p in payload])


def percent_rank_average(
    df: DataFrame, columns: dict[str, bool], keys: list[str], suffix: str = "_rank", ranges: int | None = None
) -> DataFrame:
    """Percentile rank of each column (True = ascending), ties averaged, NULL where the value is missing.

    Returns ``keys`` and one ``<column>_rank`` per column.  All columns are ranked in one
    pass over their long form.
    """
    names = list(columns)
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(keys, names, "_metric", "_value")
    ranks = ordered_totals(long, "_value", "_metric", ranges=ranges)
    directed = F.when(F.col("_metric").isin([c for c in names if columns[c]]), average_rank(True)).otherwise(average_rank(False))
    ranks = ranks.withColumn("_pct", directed / F.col("n_all"))
    ranked = attach_by_value(long, ranks, ["_metric", "_value"], ["_pct"])
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("_metric") == c, F.col("_pct"))).alias(c + suffix) for c in names])


def percent_rank_window(df: DataFrame, column: str, ascending: bool = True) -> Column:
    """The same rank as a plain window expression.

    The whole frame is ordered in one task: only for frames already cut to a known size.
    """
    c = F.col(column)
    order = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    peers = F.count(F.lit(1)).over(W.partitionBy(c))
    rank = F.rank().over(W.orderBy(order)) + (peers - 1) / 2
    return F.when(c.isNotNull(), rank / F.count(c).over(W.partitionBy()))


def quantiles(df: DataFrame, value: str, probabilities: dict[str, float], by: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group."""
    ranked = ordered_totals(df, value, by)
    columns = []
    for name, p in probabilities.items():
        position = (F.col("n_all") - 1) * F.lit(float(p))
        low, high = _value_at(value, F.floor(position)), _value_at(value, F.ceil(position))
        weight = F.max(position - F.floor(position))
        columns.append((low + (high - low) * weight).alias(name))
    return ranked.groupBy(*([by] if by else [])).agg(*columns)


def values_at(df: DataFrame, value: str, positions: dict[str, Column], by: str | None = None) -> DataFrame:
    """The values at given positions (from 0, may use ``n_all``) of the ascending order, one row per group."""
    ranked = ordered_totals(df, value, by)
    return ranked.groupBy(*([by] if by else [])).agg(
        *[_value_at(value, p).alias(name) for name, p in positions.items()], F.max("n_all").alias("n_all")
    )


def _value_at(value: str, position: Column) -> Column:
    here = (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))
    return F.max(F.when(here, F.col(value)))
