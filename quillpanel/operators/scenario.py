"""What-if grids: enrichment, the impact formula, one-at-a-time sensitivity and corner cases."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel import fixed_values as V
from quillpanel.functions.classes import bin_label, bin_ordinal, step_value
from quillpanel.functions.numeric import affine, clip_low, percent_of, ratio, remaining_gap, stock_millions
from quillpanel.operators.impute import fill_mean
from quillpanel.operators.select import complete_cases

PARAMETERS = ["share", "adoption", "ref_per_km", "use_per_km"]


@dataclass(frozen=True)
class Scenario:
    """One row of the grid: its label and the four parameter values."""

    scenario: str
    parameter: str
    level: str
    share: float
    adoption: float
    ref_per_km: float
    use_per_km: float
    flat_target: bool = False


def scenario_rows(assumptions: dict[str, dict[str, float]] | None = None) -> list[Scenario]:
    """Base, every parameter at low/base/high with the others at base, and the two corners.

    A lower use per km is the favourable end, so the corners invert it.
    """
    a = assumptions or V.ASSUMPTIONS
    base = {p: a[p]["base"] for p in PARAMETERS}
    corner = lambda good, bad: {p: a[p][bad if p == "use_per_km" else good] for p in PARAMETERS}
    rows = [Scenario("base", "all", "base", **base)]
    rows += [
        Scenario(f"{p}_{level}", p, level, **{**base, p: a[p][level]}) for p in PARAMETERS for level in ("low", "base", "high")
    ]
    return [*rows, Scenario("best_case", "all", "best", **corner("high", "low")), Scenario("worst_case", "all", "worst", **corner("low", "high"))]


@dataclass(frozen=True)
class ImpactColumns:
    """Which panel columns the formula reads."""

    component: str = "co2_transport_mt"
    total: str = "co2_emissions_mt"
    intensity: str = "grid_intensity"
    current: str = "current_rate"
    ownership: str = "ownership"


def membership_rates(
    df: DataFrame, code: str, classes: dict[str, list], rates: dict[str, float], default: str = "low"
) -> DataFrame:
    """Class and rate of each entity from a short member table; the default class where it is not listed."""
    rows = [(m, c, float(rates[c])) for c, members in classes.items() for m in members]
    key_type = df.schema[code].dataType.simpleString()
    table = df.sparkSession.createDataFrame(rows, f"{code} {key_type}, _class string, _rate double")
    return df.join(F.broadcast(table), code, "left").select(
        *df.columns,
        F.coalesce("_class", F.lit(default)).alias("rate_class"),
        F.coalesce("_rate", F.lit(float(rates[default]))).alias("current_rate"),
    )


def enrich(
    df: DataFrame,
    entity: str,
    component: str,
    fossil: str,
    income: str,
    population: str,
    classes: dict[str, list] | None = None,
    rates: dict[str, float] | None = None,
) -> DataFrame:
    """Entities of one period made ready for the scenario formula.

    Rows without the component are dropped, a missing fossil share takes the mean, and
    intensity, ownership, stock, current rate and the gap to the target are added.
    """
    usable = fill_mean(complete_cases(df, [component]), [fossil])
    usable = membership_rates(usable, entity, classes or V.ADOPTION_CLASSES, rates or V.ADOPTION_RATES)
    ownership = step_value(F.col(income), V.OWNERSHIP_THRESHOLDS, V.OWNERSHIP_VALUES, V.OWNERSHIP_DEFAULT)
    return (
        usable.withColumn("grid_intensity", affine(F.col(fossil), V.INTENSITY_BASE, V.INTENSITY_PER_PCT))
        .withColumn("ownership", ownership)
        .withColumn("stock_millions", stock_millions(F.col("ownership"), F.col(population)))
        .withColumn("remaining_gap", remaining_gap(F.col("current_rate"), V.ADOPTION_TARGET))
    )


def impact(columns: ImpactColumns, p: dict[str, Column]) -> dict[str, Column]:
    """The formula's output columns, with the parameters as literals or as columns of a scenario frame.

    component part = component x share; effective rate = gap to the target, or the target
    itself where ``flat_target``; factor = 1 - use x intensity / reference; impact is
    their product.
    """
    part = F.col(columns.component) * p["share"]
    gap = clip_low(p["adoption"] - F.col(columns.current), 0)
    effective = F.when(p.get("flat_target", F.lit(False)), p["adoption"]).otherwise(gap)
    unit = p["use_per_km"] * F.col(columns.intensity)
    factor = F.lit(1.0) - ratio(unit, p["ref_per_km"])
    reduction = part * effective * factor
    return {
        "component_part": part,
        "effective_rate": effective,
        "unit_per_km": unit,
        "factor": factor,
        "reduction": reduction,
        "reduction_pct": percent_of(reduction, F.col(columns.total)),
        "component_reduction_pct": percent_of(reduction, F.col(columns.component)),
    }


def literals(s: Scenario) -> dict[str, Column]:
    return {**{p: F.lit(float(getattr(s, p))) for p in PARAMETERS}, "flat_target": F.lit(s.flat_target)}


def apply_scenario(
    df: DataFrame, s: Scenario, columns: ImpactColumns, scale_by_ownership: bool = False
) -> DataFrame:
    """Entity rows with the impact of one scenario, optionally scaled by ownership."""
    out = df.withColumns(impact(columns, literals(s)))
    if scale_by_ownership:
        factor = F.col(columns.ownership) / F.lit(float(V.OWNERSHIP_REFERENCE))
        out = out.withColumns({"ownership_factor": factor, "reduction_scaled": F.col("reduction") * factor})
    return out


def entity_grid(df: DataFrame, scenarios: list[Scenario], columns: ImpactColumns) -> DataFrame:
    """Every entity under every scenario: each row carries the short scenario list and unfolds it."""
    fields = list(asdict(scenarios[0]))
    listed = F.array(*[F.struct(*[F.lit(getattr(s, f)).alias(f) for f in fields]) for s in scenarios])
    unfolded = df.select(*df.columns, F.inline(listed))
    return unfolded.withColumns(impact(columns, {p: F.col(p) for p in [*PARAMETERS, "flat_target"]}))


def scenario_totals(df: DataFrame, scenarios: list[Scenario], columns: ImpactColumns) -> DataFrame:
    """Total impact per scenario and its difference to base.

    All scenarios are sums of one pass over the entities, so rows are neither multiplied
    nor shuffled; what moves is one row of partial sums per task.
    """
    names = {s.scenario: f"_t{i}" for i, s in enumerate(scenarios)}
    sums = df.agg(*[F.sum(impact(columns, literals(s))["reduction"]).alias(names[s.scenario]) for s in scenarios])
    totals = sums.na.fill(0.0)
    base = F.col(names["base"])
    rows = []
    for s in scenarios:
        total = F.col(names[s.scenario])
        labels = [F.lit(v).alias(k) for k, v in asdict(s).items() if k != "flat_target"]
        vs_base = F.coalesce(percent_of(total - base, base), F.lit(0.0))
        rows.append(F.struct(*labels, total.alias("total"), vs_base.alias("vs_base_pct")))
    return totals.select(F.inline(F.array(*rows)))


def base_summary(df: DataFrame, columns: ImpactColumns, scenario: Scenario | None = None) -> DataFrame:
    """Totals of one scenario, their percentages, and the mean current and effective rates."""
    result = apply_scenario(df, scenario or scenario_rows()[0], columns)
    s = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return result.agg(
        F.count(F.lit(1)).alias("n_entities"),
        s(columns.component).alias("component_total"),
        s("component_part").alias("component_part_total"),
        s(columns.total).alias("grand_total"),
        s("reduction").alias("reduction_total"),
        percent_of(s("reduction"), s(columns.component)).alias("pct_of_component"),
        percent_of(s("reduction"), s(columns.total)).alias("pct_of_total"),
        s("stock_millions").alias("stock_millions"),
        (F.avg(columns.current) * 100).alias("mean_current_pct"),
        (F.avg("effective_rate") * 100).alias("mean_effective_pct"),
    )


def adverse(df: DataFrame) -> DataFrame:
    """Rows of an applied scenario whose factor is below 0."""
    return df.where(F.col("factor") < 0)


def tornado(totals: DataFrame) -> DataFrame:
    """Low, high and width per parameter, widest first.

    A higher use per km is the unfavourable end; ``low`` and ``high`` follow the level
    names, the width is their distance either way.
    """
    at = lambda level: F.max(F.when(F.col("level") == level, F.col("total")))
    return (
        totals.where(F.col("parameter") != "all")
        .groupBy("parameter")
        .agg(at("low").alias("low_total"), at("high").alias("high_total"))
        .withColumn("width", F.abs(F.col("high_total") - F.col("low_total")))
        .orderBy(F.col("width").desc(), "parameter")
    )


def most_sensitive(ranges: DataFrame) -> DataFrame:
    """The parameter with the widest range."""
    return ranges.agg(F.max_by("parameter", "width").alias("parameter"), F.max("width").alias("width"))


def by_bin(
    df: DataFrame,
    column: str,
    component: str,
    edges: list[float] | None = None,
    labels: list[str] | None = None,
    include_lowest: bool = False,
) -> DataFrame:
    """Applied scenario by bin of a column: totals, mean factor, entities and percentage of the component.

    Only bins that occur; rows outside every bin are left out.
    """
    edges, labels = edges or V.GRID_EDGES, labels or V.GRID_LABELS
    c = F.col(column)
    return (
        df.withColumn("bin_no", bin_ordinal(c, edges, include_lowest))
        .where(F.col("bin_no").isNotNull())
        .groupBy("bin_no", bin_label(c, edges, labels, include_lowest).alias("bin"))
        .agg(
            F.coalesce(F.sum("reduction"), F.lit(0.0)).alias("reduction_total"),
            F.coalesce(F.sum(component), F.lit(0.0)).alias("component_total"),
            F.avg("factor").alias("mean_factor"),
            F.count(F.lit(1)).alias("n_entities"),
        )
        .withColumn("reduction_pct", percent_of(F.col("reduction_total"), F.col("component_total")))
        .orderBy("bin_no")
    )


def clean_dirty(bins: DataFrame, clean: list[str] | None = None, dirty: list[str] | None = None) -> DataFrame:
    """Total of the clean and of the dirty bins."""
    in_set = lambda names: F.coalesce(F.sum(F.when(F.col("bin").isin(names), F.col("reduction_total"))), F.lit(0.0))
    return bins.agg(in_set(clean or V.CLEAN_LABELS).alias("clean_total"), in_set(dirty or V.DIRTY_LABELS).alias("dirty_total"))
