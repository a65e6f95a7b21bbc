"""Prioritisation lists, sector analysis, archetypes and the actions that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel import fixed_values as V
from quillpanel.functions.classes import archetype
from quillpanel.functions.numeric import percent_of, scaled_intensity
from quillpanel.operators.rank import cumulative_share, endpoint_change, top_k, top_per_group, weighted_rank_score
from quillpanel.operators.select import snapshot

REFERENCE_ORDER = {"fossil": True, "renewable": False, "intensity": False, "size": False}


def latest_profile(df: DataFrame, entity: str, period: str, target: str, base: str, trend_rows: int = 5) -> DataFrame:
    """Last-period rows with intensity and the endpoint change of the last rows; reads ``df`` twice."""
    rows = snapshot(df, period).withColumn("intensity", scaled_intensity(F.col(target), F.col(base)))
    change = endpoint_change(df, entity, period, target, trend_rows)
    return rows.join(change, entity, "left")


def high_impact(df: DataFrame, entity: str, target: str, k: int = V.TOP_K) -> DataFrame:
    """Largest entities with their share and cumulative share of the total."""
    return cumulative_share(df, target, k, entity)


def potential(
    df: DataFrame,
    entity: str,
    columns: dict[str, str],
    weights: dict[str, float] | None = None,
    min_size: float = V.POTENTIAL_MIN_SIZE,
    k: int = V.TOP_K,
    mode: str = "reference",
) -> DataFrame:
    """Top k of the entities above ``min_size`` by the weighted percentile-rank score.

    ``columns`` maps fossil, renewable, intensity and size to panel columns; those that
    are absent are not scored.  ``mode="reference"`` ranks fossil upwards and the others
    downwards; ``"corrected"`` turns all four round, so that a low fossil share and high
    values of the others score high.
    """
    if mode not in ("reference", "corrected"):
        raise ValueError(f"unknown mode {mode!r}")
    weights = weights or V.POTENTIAL_WEIGHTS
    used = {role: c for role, c in columns.items() if c in df.columns}
    flip = mode == "corrected"
    rows = df.where(F.col(columns["size"]) > min_size)
    score = weighted_rank_score(
        rows,
        entity,
        {c: weights[role] for role, c in used.items()},
        {c: REFERENCE_ORDER[role] != flip for role, c in used.items()},
        "potential_score",
    )
    return top_k(rows.join(score, entity), "potential_score", k, entity)


def quick_wins(
    df: DataFrame,
    entity: str,
    target: str,
    change: str = "endpoint_change",
    below: float = V.QUICK_WIN_CHANGE,
    min_size: float = V.QUICK_WIN_MIN_SIZE,
    k: int = V.TOP_K,
) -> DataFrame:
    """Entities already falling, steepest first."""
    return top_k(df.where((F.col(change) < below) & (F.col(target) > min_size)), change, k, entity, largest=False)


def sector_shares(df: DataFrame, keys: list[str], total: str, sectors: list[str]) -> DataFrame:
    """Long (keys, sector, amount, share_pct) of each row's parts."""
    long = df.select(*keys, total, *[F.col(s).cast("double").alias(s) for s in sectors]).unpivot(
        [*keys, total], sectors, "sector", "amount"
    )
    return long.withColumn("share_pct", percent_of(F.col("amount"), F.col(total)))


def sector_split(df: DataFrame, total: str, sectors: list[str]) -> DataFrame:
    """Total per sector and share of the grand total, one pass."""
    amount = lambda s: F.coalesce(F.sum(s), F.lit(0.0))
    rows = [
        F.struct(F.lit(s).alias("sector"), amount(s).alias("amount"), percent_of(amount(s), F.sum(total)).alias("share_pct"))
        for s in sectors
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r")).orderBy(F.col("amount").desc(), "sector")


def dominant_entities(shares: DataFrame, entity: str, above: float = V.DOMINANT_SHARE_PCT, k: int = V.DOMINANT_TOP) -> DataFrame:
    """Per sector the largest entities in which it makes up more than ``above`` percent."""
    order = [F.col("amount").desc_nulls_last(), F.col(entity).asc()]
    return top_per_group(shares.where(F.col("share_pct") > above), "sector", order, k)


def with_archetype(df: DataFrame, columns: dict[str, str], cuts: dict[str, float] | None = None) -> DataFrame:
    """Adds ``archetype``.  Absent columns count as income, per head and renewable 0 and fossil 100."""
    defaults = {"income": 0.0, "per_head": 0.0, "renewable": 0.0, "fossil": 100.0}

    def role(name: str) -> Column:
        c = columns.get(name)
        return F.col(c) if c in df.columns else F.lit(defaults[name])

    return df.withColumn("archetype", archetype(*[role(r) for r in defaults], cuts))


def archetype_totals(df: DataFrame, target: str) -> DataFrame:
    """Entities and total per archetype, largest total first."""
    return (
        df.groupBy("archetype")
        .agg(F.count(F.lit(1)).alias("n_entities"), F.coalesce(F.sum(target), F.lit(0.0)).alias("total"))
        .orderBy(F.col("total").desc(), "archetype")
    )


def archetype_examples(df: DataFrame, entity: str, k: int = 5) -> DataFrame:
    """First k members of each archetype by key, as one list per archetype."""
    first = top_per_group(df, "archetype", [F.col(entity).asc()], k)
    return first.groupBy("archetype").agg(F.array_sort(F.collect_list(entity)).alias("members"))


def actions_table(spark, actions: dict[str, list[str]], key: str) -> DataFrame:
    """Dimension of a class and its ordered action list."""
    return spark.createDataFrame([(k, v) for k, v in actions.items()], f"{key} string, actions array<string>")


def with_actions(df: DataFrame, actions: dict[str, list[str]], key: str) -> DataFrame:
    """One row per action of the row's class, numbered from 1; classes without actions drop out."""
    table = F.broadcast(actions_table(df.sparkSession, actions, key))  # one row per class
    return df.join(table, key).select(*df.columns, F.posexplode("actions").alias("_i", "action")).select(
        *df.columns, (F.col("_i") + 1).alias("priority"), "action"
    )
