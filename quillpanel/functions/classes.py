"""Bins, step functions and class lookups as generated expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillpanel import fixed_values as V


def bin_ordinal(c: Column, edges: list[float], include_lowest: bool = False) -> Column:
    """Number (from 1) of the right-closed interval holding the value.

    NULL outside the edges; the lowest edge itself belongs to the first bin only with
    ``include_lowest``.
    """
    arms = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:]), start=1):
        above = c >= F.lit(lo) if include_lowest and i == 1 else c > F.lit(lo)
        below = c <= F.lit(hi) if hi != float("inf") else c.isNotNull()
        arms.append((above & below, F.lit(i)))
    return _chain(arms)


def bin_label(c: Column, edges: list[float], labels: list[str], include_lowest: bool = False) -> Column:
    """Label of the right-closed interval; sort by the ordinal, not by the label."""
    ordinal = bin_ordinal(c, edges, include_lowest)
    return F.element_at(F.array(*[F.lit(x) for x in labels]), ordinal)


def step_value(c: Column, thresholds: list[float], values: list[float], default: float | None = None) -> Column:
    """Value of the first step whose threshold exceeds ``c``; the last value above all of them."""
    arms = [(c < F.lit(t), F.lit(v)) for t, v in zip(thresholds, values)]
    missing = [(c.isNull(), F.lit(default))]
    return _chain(missing + arms, F.lit(values[-1]))


def sign_word(beta: Column) -> Column:
    """Elastic or inelastic, by whether the elasticity reaches 1 in size."""
    return F.when(F.abs(beta) < 1, "inelastic").otherwise("elastic")


def archetype(
    income: Column, per_head: Column, renewable: Column, fossil: Column, cuts: dict[str, float] | None = None
) -> Column:
    """Segment of an entity.  A missing share fails its test, as a missing value fails any comparison."""
    cuts = cuts or V.ARCHETYPE_CUTS
    rich = F.when(per_head > cuts["high_per_head"], "High-Income High-Emitter").otherwise("High-Income Low-Emitter")
    middle = F.when(fossil > cuts["fossil"], "Middle-Income Fossil-Dependent").otherwise("Middle-Income Transitioning")
    return (
        F.when(income.isNull() | per_head.isNull(), "Insufficient Data")
        .when(renewable > cuts["renewable"], "Clean Energy Leader")
        .when(income > cuts["high_income"], rich)
        .when(income > cuts["middle_income"], middle)
        .otherwise("Low-Income")
    )


def outcome_type(change: Column, growth: Column, threshold: float) -> Column:
    """Outcome of one entity from its relative change and its base growth (NULL = too little evidence)."""
    fell = change < F.lit(-threshold)
    return (
        F.when(growth.isNull(), "insufficient_data")
        .when(fell & (growth > 0), "decoupling")
        .when(fell, "economic_contraction")
        .otherwise("no_reduction")
    )


def _chain(arms: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    (test, value), *rest = arms
    chain = reduce(lambda acc, arm: acc.when(*arm), rest, F.when(test, value))
    return chain if default is None else chain.otherwise(default)
