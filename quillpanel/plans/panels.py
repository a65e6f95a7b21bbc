"""Compositions over a whole panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel import fixed_values as V
from quillpanel.functions.numeric import per_billion
from quillpanel.functions.units import resolved
from quillpanel.operators.impute import gap_fill
from quillpanel.operators.rank import top_k, union_top
from quillpanel.operators.select import complete_cases, drop_entities, exclude_members, keep_entities, positive, snapshot
from quillpanel.operators.stats import too_sparse, without_target
from quillpanel.session import stage
from quillpanel.spec import keep_existing, numeric_columns

TARGET_CANDIDATES = ["co2_emissions_mt", "co2_emissions_kt", "co2_total"]


def derived_features(df: DataFrame, gdp: str, population: str, target: str) -> DataFrame:
    """log_gdp, log_population, log_co2 and co2_intensity, each where its inputs exist."""
    logs = {"log_gdp": gdp, "log_population": population, "log_co2": target}
    added = {name: F.log1p(F.col(c).cast("double")) for name, c in logs.items() if c in df.columns}
    if gdp in df.columns and target in df.columns:
        added["co2_intensity"] = per_billion(F.col(target), F.col(gdp))
    return df.withColumns(added)


def clean_panel(
    df: DataFrame,
    entity: str = "country_code",
    period: str = "year",
    target: str | None = None,
    members: list | DataFrame = tuple(V.AGGREGATE_MEMBERS),
    max_missing: float = V.MAX_MISSING_SHARE,
    gdp: str = "gdp_current_usd",
    population: str = "population",
) -> DataFrame:
    """Cleaning in order: aggregate members, entities and rows without target, sparse entities, gaps, derived columns.

    Every shuffle is keyed by entity and nothing is collected.  Dropping the target-less
    rows removes their entities too, so both steps are one filter.  Without a given ``target``
    the first known emission column is taken, converted to megatonnes where it is in another unit.
    """
    if target is None:
        df, target = resolved(df, TARGET_CANDIDATES, TARGET_CANDIDATES[0]), TARGET_CANDIDATES[0]
    members = list(members) if isinstance(members, tuple) else members
    rows = exclude_members(df, entity, members).where(F.col(target).isNotNull())
    metrics = numeric_columns(rows, exclude=(entity, period))
    rows = drop_entities(rows, too_sparse(rows, entity, metrics, max_missing), entity)
    return derived_features(gap_fill(rows, entity, period, metrics), gdp, population, target)


def clean_with_audit(
    df: DataFrame,
    entity: str,
    period: str,
    target: str,
    members: list,
    max_missing: float = V.MAX_MISSING_SHARE,
    gdp: str = "gdp_current_usd",
    population: str = "population",
) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`clean_panel`, and step_no, step, rows_in, rows_out of the same run.

    Every row is stored once with the step that drops it, if one does; the cleaned panel and the counts are
    both read from that table, so they can't differ, and a task that runs again counts nothing twice.  A
    step judges only rows that the steps before have kept.
    """
    steps = ["members", "has_target", "not_sparse"]
    member = F.coalesce(F.col(entity).isin(members), F.lit(False))
    rows = df.withColumn("_left", F.when(member, 1).when(F.col(target).isNull(), 2))
    metrics = numeric_columns(rows, exclude=(entity, period, "_left"))
    sparse = too_sparse(rows.where("_left is null"), entity, metrics, max_missing).select(entity, F.lit(3).alias("_sparse"))
    rows = rows.join(sparse, entity, "left").withColumn("_left", F.coalesce("_left", "_sparse")).drop("_sparse")
    rows = stage(rows, "marked")
    kept = gap_fill(rows.where("_left is null").drop("_left"), entity, period, metrics)
    after = lambda k: F.count_if(F.col("_left").isNull() | (F.col("_left") > k))
    counts = [
        F.struct(F.lit(k).alias("step_no"), F.lit(name).alias("step"), after(k - 1).alias("rows_in"), after(k).alias("rows_out"))
        for k, name in enumerate(steps, start=1)
    ]
    audit = rows.agg(F.array(*counts).alias("steps")).select(F.inline("steps"))
    return derived_features(kept, gdp, population, target), audit


def dropped_entities(df: DataFrame, entity: str, target: str) -> DataFrame:
    """Entities the cleaning drops for having no target at all."""
    return without_target(df, entity, target).select(entity)


def top_entity_series(df: DataFrame, entity: str, period: str, target: str, k: int = 5) -> DataFrame:
    """Whole series of the k entities with the largest last-period target."""
    top = top_k(snapshot(df, period), target, k, entity)
    return keep_entities(df, top, entity).orderBy(entity, period)


def labelled_points(df: DataFrame, entity: str, period: str, x: str, y: str, k: int = 5) -> DataFrame:
    """Last-period entities positive in both columns, flagged where they lead in either one."""
    points = positive(complete_cases(snapshot(df, period), [x, y]), [x, y])
    leaders = union_top(top_k(points, x, k, entity), top_k(points, y, k, entity), entity)
    flag = F.broadcast(leaders.select(entity, F.lit(True).alias("labelled")))  # at most 2k rows
    return points.join(flag, entity, "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


def project(df: DataFrame, wanted: list[str]) -> DataFrame:
    return keep_existing(df, wanted)
