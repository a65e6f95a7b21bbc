"""Gap filling along an entity's periods, and mean or median filling of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillpanel import fixed_values as V
from quillpanel.operators.ordered import quantiles


def gap_fill(
    df: DataFrame,
    entity: str,
    period: str,
    columns: list[str],
    interpolate: int = V.INTERPOLATE_LIMIT,
    forward: int = V.FORWARD_LIMIT,
    backward: int = V.BACKWARD_LIMIT,
    block: int | None = None,
) -> DataFrame:
    """Linear interpolation, then forward, then backward fill, each with a limit.

    Positions are row numbers inside the entity, not period distances.  For a missing
    cell with the last value p at distance d and the next value q at distance e:

    * between two values: d <= interpolate + forward gives p + (q-p) * min(d, interpolate)
      / gap; otherwise q where e <= backward;
    * after the last value: p where d <= interpolate + forward;
    * before the first value: q where e <= backward.

    All columns share one shuffle by entity.  ``block`` (in periods) is for entities with
    very long series: each block is then ordered in a task of its own, and what lies
    before and after it comes from a summary with one row per block.
    """
    names = {c: i for i, c in enumerate(columns)}
    keys = [entity]
    rows = df
    if block:
        rows = rows.withColumn("_block", F.floor(F.col(period) / F.lit(block)))
        keys = [entity, "_block"]
    ahead = W.partitionBy(*keys).orderBy(F.col(period).asc())
    back = W.partitionBy(*keys).orderBy(F.col(period).desc())
    up_to_here = (W.unboundedPreceding, 0)

    rows = rows.withColumn("_row", F.row_number().over(ahead))
    if block:
        summary = _block_summary(rows, entity, names)
        rows = rows.join(summary, keys).withColumn("_row", F.col("_row") + F.col("_rows_before"))

    def seen(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_row").alias("at"), F.col(c).cast("double").alias("value")))

    rows = rows.withColumns(
        {f"_p{i}": F.last(seen(c), ignorenulls=True).over(ahead.rowsBetween(*up_to_here)) for c, i in names.items()}
    )
    # descending order instead of an unbounded following frame, which would rescan the rest for each row
    rows = rows.withColumns(
        {f"_q{i}": F.last(seen(c), ignorenulls=True).over(back.rowsBetween(*up_to_here)) for c, i in names.items()}
    )
    filled = {}
    for c, i in names.items():
        p, q = F.col(f"_p{i}"), F.col(f"_q{i}")
        if block:
            p, q = F.coalesce(p, f"_before{i}"), F.coalesce(q, f"_after{i}")
        filled[c] = _fill(F.col(c), F.col("_row"), p, q, interpolate, forward, backward)
    return rows.withColumns(filled).select(*df.columns)


def _fill(value: Column, row: Column, p: Column, q: Column, interpolate: int, forward: int, backward: int) -> Column:
    since, until = row - p["at"], q["at"] - row
    carried = since <= interpolate + forward
    line = p["value"] + (q["value"] - p["value"]) * F.least(since, F.lit(interpolate)) / (q["at"] - p["at"])
    return (
        F.when(value.isNotNull(), value.cast("double"))
        .when(q.isNull(), F.when(carried, p["value"]))
        .when(carried, line)
        .when(until <= backward, q["value"])
    )


def _block_summary(rows: DataFrame, entity: str, names: dict[str, int]) -> DataFrame:
    """Per block: rows before it, the last value before it and the first value after it."""

    def edge(pick, c: str) -> Column:
        at = F.when(F.col(c).isNotNull(), F.col("_row"))
        return F.struct(pick(at).alias("at"), (F.max_by if pick is F.max else F.min_by)(F.col(c).cast("double"), at).alias("value"))

    blocks = rows.groupBy(entity, "_block").agg(
        F.count(F.lit(1)).alias("_n"),
        *[edge(F.min, c).alias(f"_f{i}") for c, i in names.items()],
        *[edge(F.max, c).alias(f"_l{i}") for c, i in names.items()],
    )
    order = W.partitionBy(entity).orderBy("_block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(entity).orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_rows_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))

    def shifted(c: str) -> Column:
        s = F.col(c)
        return F.when(
            s["at"].isNotNull(), F.struct((s["at"] + F.col("_rows_before")).alias("at"), s["value"].alias("value"))
        )

    blocks = blocks.withColumns({f"_{e}{i}": shifted(f"_{e}{i}") for e in "fl" for i in names.values()})
    return blocks.select(
        entity,
        "_block",
        "_rows_before",
        *[F.last(f"_l{i}", ignorenulls=True).over(before).alias(f"_before{i}") for i in names.values()],
        *[F.last(f"_f{i}", ignorenulls=True).over(after).alias(f"_after{i}") for i in names.values()],
    )


def fill_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values take the mean of the column over all rows."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), means[c]) for c in columns})


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact medians as (metric, median)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "metric", "value")
    return quantiles(long, "value", {"median": 0.5}, by="metric")


def fill_median(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Missing values take the column's exact median over ``fit_on`` (all rows by default).

    Fit on the training rows only to keep the test rows out of the medians.
    """
    found = medians(df if fit_on is None else fit_on, columns)
    lookup = found.agg(F.map_from_entries(F.collect_list(F.struct("metric", "median"))).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.element_at(lookup, F.lit(c))) for c in columns})
