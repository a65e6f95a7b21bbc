"""Registered queries: each reads the given tables whole and returns one result frame.

Queries that pass over a panel more than once store it first (``stage``); the others
stay one lazy plan.  Thresholds that the defaults tie to national statistics are given
as parameters fitting the order tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpanel import fixed_values as V
from quillpanel.functions import classes, numeric, text
from quillpanel.functions.numeric import tidy
from quillpanel.models import linear, logistic, metrics, splits, trees
from quillpanel.operators import assembly, correlation, impute, ordered, outcome, rank, scenario, segment, select, stats
from quillpanel.plans import panels
from quillpanel.session import new_path, stage
from quillpanel.sources import files
from quillpanel.sources.tables import (
    LAST_FULL_PERIOD,
    SECTORS,
    customer_panel,
    long_metrics,
    nation_panel,
    table,
)
from quillpanel.spec import FeatureSpec, PanelSpec, numeric_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEYS = ["entity", "period"]
METRICS = ["target", "base", "population", "fossil_pct", "renewable_pct", "growth_pct"]
NATION_METRICS = METRICS[:5]
HORIZON, BASE_PERIOD, FEATURE_PERIOD, LAST_TRAIN = 5, 1995, 1996, 1999
EXCLUDED = [20, 21, 22, 23, 24]
CLASSES = {"high": list(range(0, 7)), "medium": list(range(7, 20))}
CUTS = {"renewable": 60, "high_income": 200, "high_per_head": 0.45, "middle_income": 100, "fossil": 30}
ROLES = {"income": "base", "per_head": "target", "renewable": "renewable_pct", "fossil": "fossil_pct"}
POTENTIAL = {"fossil": "fossil_pct", "renewable": "renewable_pct", "intensity": "intensity", "size": "target"}
FEATURES = ["target", "base", "population", "fossil_pct", "renewable_pct", "growth_pct"]
SHOCKS = [1.05, 1.10, 1.20]
SECTOR_ROLE = {"s_urgent": "transport", "s_high": "power_industry", "s_medium": "buildings", "s_low": "industrial"}
RULES = [
    ("base", 1, "Higher base", "%.1f vs %.1f"),
    ("population", 1, "More orders", "%.2f vs %.2f"),
    ("renewable_pct", 1, "Higher open share", "%.1f%% vs %.1f%%"),
    ("fossil_pct", -1, "Lower returned share", "%.1f%% vs %.1f%%"),
]
IMPACT = scenario.ImpactColumns("s_urgent", "target")
MODEL_FEATURES = ["log_base", "population", "fossil_pct", "renewable_pct"]
CLASS_FEATURES = ["log_target", "log_base", "population", "fossil_pct", "renewable_pct", "growth_pct"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


LOG = "log"


def out(df: DataFrame, **columns: int | str | None) -> DataFrame:
    """Result columns: a number of digits rounds, None leaves as is, LOG gives log1p to 8 digits.

    LOG is for ratios of whole numbers over many magnitudes, whose short decimals would
    otherwise lie on rounding edges.
    """

    def shown(c: str, d: int | str | None):
        if d is None:
            return F.col(c)
        return tidy(F.log1p(c), 8).alias(f"log_{c}") if d == LOG else tidy(F.col(c), d).alias(c)

    return df.select(*[shown(c, d) for c, d in columns.items()])


def metric_digits(names: list[str]) -> dict[str, int]:
    """8 digits for amounts, which are whole cents in millions, 6 for the rest."""
    return {n: 8 if n in ("target", *SECTORS) else 6 for n in names}


def nations(spark: SparkSession, d: str) -> DataFrame:
    return stage(nation_panel(spark, d), "nation")


def customers(spark: SparkSession, d: str) -> DataFrame:
    return stage(customer_panel(spark, d), "customer")


def at_last_full(df: DataFrame) -> DataFrame:
    return df.where(F.col("period") == LAST_FULL_PERIOD)


def outcome_frame(panel: DataFrame) -> DataFrame:
    return outcome.outcomes(panel, "entity", "period", "target", "growth_pct", LAST_FULL_PERIOD, HORIZON)


# ---------------------------------------------------------------- sources and selection


@query
def topk_cumulative_share(spark, d):
    latest = select.snapshot(nations(spark, d), "period")
    return out(
        segment.high_impact(latest, "entity", "target"),
        rank_no=None, entity=None, target=8, share_pct=6, cumulative_share_pct=6,
    )


@query
def panel_profile(spark, d):
    spec = PanelSpec("entity", "period", "target", ("base",), ("growth_pct",))
    panel = customer_panel(spark, d)
    spec.validate(panel)
    return spec.profile(panel)


@query
def latest_snapshot(spark, d):
    return out(select.snapshot(nations(spark, d), "period"), entity=None, period=None, **metric_digits(METRICS))


@query
def base_snapshot(spark, d):
    rows = select.snapshot(nations(spark, d), "period", offset=HORIZON)
    return out(rows, entity=None, period=None, **metric_digits(METRICS))


@query
def exclude_members_anti(spark, d):
    rows = select.exclude_members(nation_panel(spark, d), "entity", EXCLUDED)
    return out(rows, entity=None, period=None, **metric_digits(NATION_METRICS))


@query
def keep_existing_columns(spark, d):
    return out(panels.project(nation_panel(spark, d), ["entity", "period", "absent", "base"]), entity=None, period=None, base=6)


@query
def temporal_split_counts(spark, d):
    train, test = select.temporal_split(customers(spark, d), "period", LAST_TRAIN, "target", ["base", "fossil_pct", "growth_pct"])
    count = lambda df, part: df.agg(
        F.lit(part).alias("part"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
    )
    return count(train, "train").unionByName(count(test, "test"))


@query
def row_loss_audit(spark, d):
    steps = [
        ("members", ~F.col("entity").isin(EXCLUDED)),
        ("has_target", F.col("target").isNotNull()),
        ("has_growth", F.col("growth_pct").isNotNull()),
        ("positive_fossil", F.col("fossil_pct") > 0),
    ]
    return select.row_loss(customer_panel(spark, d), steps)


@query
def catalog_search(spark, d):
    found = assembly.search_catalogue(table(spark, d, "part"), "p_partkey", "p_name", ["small", "ring"])
    return out(found, term=None, n_matches=None, rank_no=None, p_partkey=None, p_name=None)


@query
def period_parse(spark, d):
    raw = long_metrics(nation_panel(spark, d), ["target", "base"])
    raw = raw.select("entity", F.concat(F.lit("YR"), F.col("period")).alias("time"), "indicator", "value")
    named = assembly.rename(raw, {"entity": "country_code", "time": "year", "absent": "x"})
    parsed = named.withColumn("year", text.parse_period(F.col("year")))
    return out(parsed, country_code=None, year=None, indicator=None, value=8)


@query
def indicator_ingest(spark, d):
    return out(_ingest(spark, d)[0], country_code=None, year=None, target=8, base=6, growth_pct=6, fossil_pct=6)


@query
def ingest_status(spark, d):
    return out(_ingest(spark, d)[1], indicator=None, status=None, rows=None, bad_rows=None, error=None)


def _landed(spark, d, names):
    """Each metric as a CSV file of its own with text periods; one with columns in another order, one damaged."""
    panel = nations(spark, d)
    folder = new_path(spark, "landing")
    for name in names:
        rows = panel.where(F.col(name).isNotNull())
        rows = rows.select(F.col("entity").alias("country_code"), F.concat(F.lit("YR"), "period").alias("year"), F.col(name).cast("string").alias(name))
        if name == "base":
            rows = rows.select(name, F.lit("x,y").alias("note"), "year", "country_code")
        if name == "fossil_pct":  # a number and a period that can't be read, for two entities
            rows = rows.withColumn(name, F.when(F.col("country_code") == 3, "n/a?").otherwise(F.col(name)))
            rows = rows.withColumn("year", F.when(F.col("country_code") == 4, "unknown").otherwise(F.col("year")))
        files.write_panel(rows, f"{folder}/{name}", "csv")
    files.write_panel(panel.select("entity").limit(0), f"{folder}/no_rows", "csv")
    return {n: f"{folder}/{n}" for n in [*names, "no_rows", "not_there"]}


def _ingest(spark, d):
    """Lands metrics as files, then loads them with one source damaged, one without lines and one missing."""
    panel, status = files.load_indicators(spark, _landed(spark, d, ["target", "base", "growth_pct", "fossil_pct"]), 1996, 2001)
    return panel, status.withColumn("error", F.when(F.col("error").contains("PATH_NOT_FOUND"), "not found").otherwise(F.col("error")))


@query
def long_ingest(spark, d):
    """The same from one file of all metrics."""
    names = ["target", "base", "growth_pct"]
    path = new_path(spark, "landing")
    long = nations(spark, d).select(F.col("entity").alias("country_code"), "period", *names).unpivot(["country_code", "period"], names, "indicator", "value")
    files.write_panel(long.select("indicator", F.concat(F.lit("YR"), "period").alias("year"), "value", "country_code"), path, "csv")
    panel, _ = files.load_long(spark, path, ["target", "growth_pct"], 1996, 2001)
    return out(panel, country_code=None, year=None, target=8, growth_pct=6)


@query
def csv_round_trip(spark, d):
    panel = nation_panel(spark, d).select("entity", "period", *NATION_METRICS)
    path = new_path(spark, "panel-csv")
    files.write_panel(panel, path, "csv")
    return out(files.read_csv(spark, path, panel.schema), entity=None, period=None, **metric_digits(NATION_METRICS))


@query
def partitioned_round_trip(spark, d):
    """Panel laid out by period; the period filter then prunes folders."""
    path = new_path(spark, "panel-by-period")
    files.write_panel(nation_panel(spark, d), path, period="period")
    rows = spark.read.parquet(path).where(F.col("period").between(1997, 1999))
    return out(rows, entity=None, period=None, **metric_digits(NATION_METRICS))


@query
def published_periods(spark, d):
    """A panel published whole, then two of its periods again with other amounts."""
    panel = stage(nation_panel(spark, d).select(*KEYS, "target", "base"), "nation")
    path = new_path(spark, "published")
    files.publish_periods(panel, path, "period", "entity")
    files.publish_periods(panel.where("period in (1997, 1999)").withColumn("base", F.col("base") * 2), path, "period", "entity")
    return out(spark.read.parquet(path), entity=None, period=None, target=8, base=6)


@query
def matrix_round_trip(spark, d):
    columns = ["target", "base", "population"]
    long = stats.correlation_matrix(nation_panel(spark, d), columns, lower_only=False)
    path = new_path(spark, "matrix")
    files.write_matrix(long, path, columns)
    wide = files.read_csv(spark, path, "x string, target double, base double, population double")
    return out(wide, x=None, target=6, base=6, population=6)


# ---------------------------------------------------------------- assembly and gaps


def _present(spark, d, names):
    return long_metrics(nation_panel(spark, d), names).where(F.col("value").isNotNull())


@query
def panel_pivot(spark, d):
    names = ["target", "base", "fossil_pct", "growth_pct"]
    wide = assembly.pivot_panel(_present(spark, d, names), KEYS, names)
    return out(wide, entity=None, period=None, **metric_digits(names))


@query
def panel_outer_merge(spark, d):
    names = ["growth_pct", "target", "base", "fossil_pct"]
    panel = nations(spark, d)
    frames = [panel.where(F.col(n).isNotNull()).select(*KEYS, n) for n in names]
    # the name comes from the first frame only: rows first seen later have none
    frames[0] = frames[0].withColumn("name", F.concat(F.lit("N"), F.col("entity")))
    merged = assembly.outer_merge(frames, KEYS)
    return out(merged, entity=None, period=None, name=None, **metric_digits(names))


@query
def entity_coverage(spark, d):
    return out(stats.entity_coverage(customer_panel(spark, d), "entity", "target"), entity=None, coverage=6)


@query
def column_null_pct(spark, d):
    return out(stats.column_nulls(customer_panel(spark, d), METRICS), metric=None, n_missing=None, missing_pct=6)


@query
def missing_cells(spark, d):
    return stats.missing_cells(customer_panel(spark, d), METRICS)


@query
def entity_missingness(spark, d):
    sparse = stats.too_sparse(customer_panel(spark, d), "entity", METRICS, V.MAX_MISSING_SHARE)
    return out(sparse, entity=None, missing_share=6)


@query
def entities_without_target(spark, d):
    return panels.dropped_entities(customer_panel(spark, d), "entity", "target")


@query
def gap_fill(spark, d):
    names = ["target", "base", "fossil_pct"]
    filled = impute.gap_fill(customer_panel(spark, d), "entity", "period", names)
    return out(filled, entity=None, period=None, target=10, base=6, fossil_pct=6)


@query
def gap_fill_blocks(spark, d):
    """The same result with every entity's series cut into blocks of three periods."""
    names = ["target", "base", "fossil_pct"]
    filled = impute.gap_fill(customers(spark, d), "entity", "period", names, block=3)
    return out(filled, entity=None, period=None, target=10, base=6, fossil_pct=6)


@query
def derived_features(spark, d):
    rows = panels.derived_features(nation_panel(spark, d), "base", "population", "target")
    rows = rows.withColumn("scaled_intensity", numeric.scaled_intensity(F.col("target"), F.col("base")))
    return out(rows, entity=None, period=None, log_gdp=6, log_population=6, log_co2=6, co2_intensity=LOG, scaled_intensity=LOG)


def _cleaned(panel):
    return panels.clean_panel(
        panel.select(*KEYS, *METRICS), "entity", "period", "target", EXCLUDED, gdp="base", population="population"
    )


@query
def clean_panel(spark, d):
    return out(
        _cleaned(customers(spark, d)),
        entity=None, period=None, **metric_digits(NATION_METRICS), growth_pct=6,
        log_gdp=6, log_population=6, log_co2=6, co2_intensity=LOG,
    )


def _audited(spark, d):
    panel = customer_panel(spark, d).select(*KEYS, *METRICS)
    return panels.clean_with_audit(panel, "entity", "period", "target", EXCLUDED, gdp="base", population="population")


@query
def clean_panel_audit(spark, d):
    """Rows before and after each step of the cleaning, from the run that made the cleaned panel."""
    return _audited(spark, d)[1]


@query
def clean_panel_audited(spark, d):
    """The panel that the audited cleaning made."""
    return out(
        _audited(spark, d)[0], entity=None, period=None, **metric_digits(NATION_METRICS), growth_pct=6,
        log_gdp=6, log_population=6, log_co2=6, co2_intensity=LOG,
    )


@query
def clean_panel_kilotons(spark, d):
    """The cleaning of a panel whose amounts come in kilotons, which it recognises and converts."""
    panel = customers(spark, d).select(*KEYS, *METRICS).withColumn("co2_emissions_kt", F.col("target") * 1000).drop("target")
    cleaned = panels.clean_panel(panel, "entity", "period", members=EXCLUDED, gdp="base", population="population")
    return out(cleaned, entity=None, period=None, co2_emissions_mt=8, base=6, growth_pct=6, log_co2=6)


# ---------------------------------------------------------------- statistics


@query
def describe_numeric(spark, d):
    found = stats.describe(customers(spark, d), METRICS)
    return out(found, metric=None, n=None, mean=6, std=6, min=6, q25=6, q50=6, q75=6, max=6)


@query
def corr_with_target(spark, d):
    return out(stats.correlation_with(nation_panel(spark, d), "target", METRICS), metric=None, corr=6)


@query
def corr_matrix(spark, d):
    return out(stats.correlation_matrix(customer_panel(spark, d), METRICS), x=None, y=None, corr=6)


@query
def corr_products(spark, d):
    """Correlations of all numeric columns by products of column sets."""
    found = correlation.correlation_products(customer_panel(spark, d), [*METRICS, *SECTORS])
    return out(found, x=None, y=None, corr=6, n=None)


@query
def resolved_features(spark, d):
    """Correlation with the target of the features left by exclusion, sector columns out but for one."""
    panel = nation_panel(spark, d)
    spec = FeatureSpec(exclude=(*KEYS, "target"), exclude_prefix="s_", extra=("s_urgent", "absent"))
    features = [c for c in spec.resolve(panel) if c in numeric_columns(panel, exclude=tuple(KEYS))]
    return out(stats.correlation_with(panel, "target", features, top=None), metric=None, corr=6)


@query
def period_totals(spark, d):
    return out(stats.period_totals(customer_panel(spark, d), "period", "target"), period=None, total=8)


@query
def global_ratio(spark, d):
    return out(stats.ratio_of_totals(nation_panel(spark, d), "s_urgent", "target"), part_total=8, whole_total=8, part_pct=6)


@query
def value_counts(spark, d):
    return stats.frequency(table(spark, d, "orders"), "o_orderpriority")


def _features(panel):
    """Feature period's columns with the outcome of each entity."""
    return outcome.feature_matrix(
        panel, outcome_frame(panel), "entity", "period", FEATURE_PERIOD, FEATURES, ["target", "base"]
    )


@query
def class_mean_diff(spark, d):
    compared = stats.class_means(_features(customers(spark, d)), "success", FEATURES)
    return out(compared, feature=None, success_mean=6, other_mean=6, difference=6)


@query
def insight_rules(spark, d):
    compared = stats.class_means(_features(customers(spark, d)), "success", FEATURES)
    return stats.insights(compared, RULES)


# ---------------------------------------------------------------- ranking


def _shares(panel):
    return segment.sector_shares(panel, KEYS, "target", list(SECTORS))


@query
def topk_per_sector(spark, d):
    shares = _shares(customer_panel(spark, d))
    dominant = segment.dominant_entities(shares.withColumn("entity_period", F.concat_ws("-", *KEYS)), "entity_period")
    return out(dominant, sector=None, rank_no=None, entity=None, period=None, amount=8, share_pct=6)


@query
def sector_shares(spark, d):
    return out(_shares(nation_panel(spark, d)), entity=None, period=None, sector=None, amount=8, share_pct=6)


@query
def pct_rank_avg(spark, d):
    ranked = ordered.percent_rank_average(customers(spark, d), {"target": True, "fossil_pct": False, "base": True}, KEYS)
    return out(ranked, entity=None, period=None, target_rank=8, fossil_pct_rank=8, base_rank=8)


def _potential(spark, d, mode):
    rows = at_last_full(nation_panel(spark, d))
    rows = stage(rows.withColumn("intensity", numeric.scaled_intensity(F.col("target"), F.col("base"))), "potential")
    top = segment.potential(rows, "entity", POTENTIAL, min_size=1, mode=mode)
    return out(top, entity=None, target=8, fossil_pct=6, renewable_pct=6, potential_score=6)


@query
def potential_score(spark, d):
    return _potential(spark, d, "reference")


@query
def potential_score_corrected(spark, d):
    return _potential(spark, d, "corrected")


def _full_periods(df):
    return df.where(F.col("period") <= LAST_FULL_PERIOD)


@query
def endpoint_change(spark, d):
    change = rank.endpoint_change(_full_periods(customer_panel(spark, d)), "entity", "period", "target")
    return out(change, entity=None, endpoint_change=6)


@query
def trend_slope(spark, d):
    slopes = rank.trend_slope(_full_periods(customer_panel(spark, d)), "entity", "period", "target")
    return out(slopes, entity=None, trend_slope=10)


@query
def latest_profile(spark, d):
    panel = _full_periods(customers(spark, d))
    rows = segment.latest_profile(panel, "entity", "period", "target", "base")
    return out(rows, entity=None, period=None, target=8, intensity=LOG, endpoint_change=6)


@query
def quick_wins(spark, d):
    panel = _full_periods(customers(spark, d))
    rows = segment.latest_profile(panel, "entity", "period", "target", "base")
    return out(segment.quick_wins(rows, "entity", "target", min_size=0.1), entity=None, target=8, endpoint_change=6)


@query
def topk_union(spark, d):
    latest = select.snapshot(nations(spark, d), "period")
    both = rank.union_top(rank.top_k(latest, "target", 5, "entity"), rank.top_k(latest, "population", 5, "entity"), "entity")
    return out(both, entity=None, target=8, population=None)


@query
def labelled_points(spark, d):
    points = panels.labelled_points(nations(spark, d), "entity", "period", "target", "base")
    return out(points, entity=None, target=8, base=6, labelled=None)


@query
def top_entity_series(spark, d):
    series = panels.top_entity_series(nations(spark, d), "entity", "period", "target")
    return out(series, entity=None, period=None, target=8)


# ---------------------------------------------------------------- outcome and segments


@query
def cumulative_growth(spark, d):
    grown = outcome.cumulative_growth(customer_panel(spark, d), "entity", "period", "growth_pct", BASE_PERIOD, LAST_FULL_PERIOD)
    return out(grown, entity=None, n_rates=None, growth=LOG)


@query
def cumulative_growth_corrected(spark, d):
    grown = outcome.cumulative_growth(
        customer_panel(spark, d), "entity", "period", "growth_pct", FEATURE_PERIOD, LAST_FULL_PERIOD, include_base_year=False
    )
    return out(grown, entity=None, n_rates=None, growth=LOG)


@query
def outcome_labels(spark, d):
    return out(
        outcome_frame(customer_panel(spark, d)),
        entity=None, start_value=8, end_value=8, change=6, growth=LOG, outcome=None, success=None,
    )


@query
def outcome_counts(spark, d):
    return stats.frequency(outcome_frame(customer_panel(spark, d)), "outcome")


@query
def outcome_share(spark, d):
    shares = stats.class_share(outcome_frame(customer_panel(spark, d)), "success")
    return out(shares, n_total=None, n_success=None, success_pct=6, n_other=None, other_pct=6)


@query
def success_members(spark, d):
    rows = outcome_frame(customer_panel(spark, d)).where("success = 1").orderBy("change", "entity")
    return rows.select(
        "entity", text.signed_percent(F.col("change")).alias("change"), text.signed_percent(F.col("growth")).alias("growth")
    )


@query
def outcome_extremes(spark, d):
    rows = stage(outcome_frame(customer_panel(spark, d)), "outcome")
    falling = rank.top_k(rows.where("outcome = 'decoupling'"), "change", 10, "entity", largest=False)
    rising = rank.top_k(rows.where("outcome = 'no_reduction'"), "change", 5, "entity")
    return out(falling.unionByName(rising), entity=None, outcome=None, change=6)


@query
def feature_matrix(spark, d):
    rows = stage(_features(customers(spark, d)), "features")
    names = [*FEATURES, "log_target", "log_base"]
    return out(
        impute.fill_median(rows, names),
        entity=None, target=9, **{n: 6 for n in names[1:]}, success=None, change=6, growth=LOG, outcome=None,
    )


def _segmented(spark, d):
    return segment.with_archetype(at_last_full(customer_panel(spark, d)), ROLES, CUTS)


@query
def archetypes(spark, d):
    return out(_segmented(spark, d), entity=None, archetype=None, target=8, base=6, renewable_pct=6)


@query
def archetype_totals(spark, d):
    return out(segment.archetype_totals(_segmented(spark, d), "target"), archetype=None, n_entities=None, total=8)


@query
def archetype_examples(spark, d):
    examples = segment.archetype_examples(_segmented(spark, d), "entity")
    return examples.select("archetype", F.array_join("members", ",").alias("members"))


@query
def archetype_actions(spark, d):
    rows = _segmented(spark, d).select("entity", "archetype")
    return segment.with_actions(rows, V.ARCHETYPE_ACTIONS, "archetype")


@query
def sector_split(spark, d):
    return out(segment.sector_split(nation_panel(spark, d), "target", list(SECTORS)), sector=None, amount=8, share_pct=6)


@query
def sector_actions(spark, d):
    split = segment.sector_split(nation_panel(spark, d), "target", list(SECTORS))
    role = F.create_map(*[F.lit(x) for pair in SECTOR_ROLE.items() for x in pair])
    named = split.withColumn("sector", role[F.col("sector")])
    return out(segment.with_actions(named, V.SECTOR_ACTIONS, "sector"), sector=None, amount=8, priority=None, action=None)


@query
def sector_report(spark, d):
    split = segment.sector_split(nation_panel(spark, d), "target", list(SECTORS))
    name = text.metric_name(F.concat(F.col("sector"), F.lit("_mt")), "s_", "_mt")
    return split.select(
        name.alias("sector"),
        text.title(name).alias("title"),
        text.upper_title(name).alias("heading"),
        text.display(F.col("amount"), 2).alias("amount"),
        text.display(F.col("share_pct"), 1, suffix="%").alias("share"),
    )


# ---------------------------------------------------------------- scenario


@query
def step_lookup(spark, d):
    rows = customer_panel(spark, d).withColumn("income", F.col("base") * 100)
    step = classes.step_value(F.col("income"), V.OWNERSHIP_THRESHOLDS, V.OWNERSHIP_VALUES, V.OWNERSHIP_DEFAULT)
    rows = rows.withColumn("ownership", step.cast("int"))
    rows = rows.withColumn("stock", numeric.stock_millions(F.col("ownership"), F.col("population") * 1e6))
    return out(rows, entity=None, period=None, income=6, ownership=None, stock=6)


@query
def membership_lookup(spark, d):
    rows = scenario.membership_rates(nation_panel(spark, d), "entity", CLASSES, V.ADOPTION_RATES)
    gap = numeric.remaining_gap(F.col("current_rate"), V.ADOPTION_TARGET)
    return out(rows.withColumn("gap", gap), entity=None, period=None, rate_class=None, current_rate=6, gap=6)


def _bin_counts(spark, d, include_lowest):
    c = F.col("fossil_pct")
    rows = customer_panel(spark, d).select(
        classes.bin_ordinal(c, V.GRID_EDGES, include_lowest).alias("bin_no"),
        classes.bin_label(c, V.GRID_EDGES, V.GRID_LABELS, include_lowest).alias("bin"),
    )
    return rows.where("bin_no IS NOT NULL").groupBy("bin_no", "bin").agg(F.count(F.lit(1)).alias("n")).orderBy("bin_no")


@query
def bin_counts(spark, d):
    return _bin_counts(spark, d, False)


@query
def bin_counts_corrected(spark, d):
    return _bin_counts(spark, d, True)


@query
def income_groups(spark, d):
    rows = at_last_full(customer_panel(spark, d)).withColumn("income", F.col("base") * 25)
    c = F.col("income")
    return (
        rows.select(
            classes.bin_ordinal(c, V.INCOME_EDGES).alias("group_no"),
            classes.bin_label(c, V.INCOME_EDGES, V.INCOME_LABELS).alias("income_group"),
        )
        .where("group_no IS NOT NULL")
        .groupBy("group_no", "income_group")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("group_no")
    )


def _enriched(spark, d):
    """Customers of the last full period, ready for the scenario formula."""
    rows = at_last_full(customer_panel(spark, d)).withColumn("income", F.col("base") * 100)
    rows = stage(rows, "scenario")
    return scenario.enrich(rows, "entity", "s_urgent", "fossil_pct", "income", "population", CLASSES, V.ADOPTION_RATES)


BASE_SCENARIO = scenario.scenario_rows()[0]


@query
def scenario_entities(spark, d):
    rows = scenario.apply_scenario(_enriched(spark, d), BASE_SCENARIO, IMPACT, scale_by_ownership=True)
    return out(
        rows,
        entity=None, grid_intensity=6, ownership=None, stock_millions=9, rate_class=None, remaining_gap=6,
        component_part=6, effective_rate=6, unit_per_km=6, factor=6, reduction=6, reduction_pct=6,
        component_reduction_pct=6, reduction_scaled=6,
    )


SUMMARY = {
    "n_entities": None, "component_total": 8, "component_part_total": 6, "grand_total": 8, "reduction_total": 6,
    "pct_of_component": 6, "pct_of_total": 6, "stock_millions": 8, "mean_current_pct": 6, "mean_effective_pct": 6,
}


@query
def scenario_base(spark, d):
    return out(scenario.base_summary(_enriched(spark, d), IMPACT), **SUMMARY)


@query
def scenario_flat(spark, d):
    flat = scenario.Scenario("flat", "all", "base", **{p: V.ASSUMPTIONS[p]["base"] for p in scenario.PARAMETERS}, flat_target=True)
    return out(scenario.base_summary(_enriched(spark, d), IMPACT, flat), **SUMMARY)


@query
def adverse_entities(spark, d):
    rows = scenario.adverse(scenario.apply_scenario(_enriched(spark, d), BASE_SCENARIO, IMPACT))
    return out(rows, entity=None, grid_intensity=6, unit_per_km=6, factor=6)


@query
def top_reductions(spark, d):
    rows = scenario.apply_scenario(_enriched(spark, d), BASE_SCENARIO, IMPACT)
    order = [F.col("reduction").desc_nulls_last(), F.col("entity").asc()]
    top = rank.enumerate_top(rank.top_k(rows, "reduction", 10, "entity"), order)
    return out(top, rank_no=None, entity=None, reduction=6, factor=6, grid_intensity=6)


@query
def scenario_grid(spark, d):
    totals = scenario.scenario_totals(_enriched(spark, d), scenario.scenario_rows(), IMPACT)
    return out(totals, scenario=None, parameter=None, level=None, share=6, adoption=6, ref_per_km=6, use_per_km=6, total=6)


@query
def scenario_vs_base(spark, d):
    totals = scenario.scenario_totals(_enriched(spark, d), scenario.scenario_rows(), IMPACT)
    return out(totals, scenario=None, total=6, vs_base_pct=6)


@query
def scenario_entity_grid(spark, d):
    rows = scenario.entity_grid(_enriched(spark, d), scenario.scenario_rows(), IMPACT)
    return out(rows, entity=None, scenario=None, effective_rate=6, factor=6, reduction=6)


def _tornado(spark, d):
    return scenario.tornado(scenario.scenario_totals(_enriched(spark, d), scenario.scenario_rows(), IMPACT))


@query
def tornado_ranges(spark, d):
    return out(_tornado(spark, d), parameter=None, low_total=6, high_total=6, width=6)


@query
def most_sensitive(spark, d):
    return out(scenario.most_sensitive(_tornado(spark, d)), parameter=None, width=6)


def _by_bin(spark, d, include_lowest):
    rows = scenario.apply_scenario(_enriched(spark, d), BASE_SCENARIO, IMPACT)
    return scenario.by_bin(rows, "fossil_pct", "s_urgent", include_lowest=include_lowest)


BIN_COLUMNS = {
    "bin_no": None, "bin": None, "reduction_total": 6, "component_total": 8, "mean_factor": 6, "n_entities": None,
    "reduction_pct": 6,
}


@query
def scenario_by_bin(spark, d):
    return out(_by_bin(spark, d, False), **BIN_COLUMNS)


@query
def scenario_by_bin_corrected(spark, d):
    return out(_by_bin(spark, d, True), **BIN_COLUMNS)


@query
def clean_dirty_totals(spark, d):
    return out(scenario.clean_dirty(_by_bin(spark, d, False)), clean_total=6, dirty_total=6)


# ---------------------------------------------------------------- models


@query
def elasticity_univariate(spark, d):
    slope = linear.log_slope(customer_panel(spark, d), "target", "base")
    return out(slope, n=None, slope=6, intercept=6, coef_standardised=6)


@query
def ridge_two_feature(spark, d):
    lines = table(spark, d, "lineitem")
    fit = linear.ridge_two(lines, F.log1p("l_quantity"), F.col("l_discount"), F.log1p("l_extendedprice"), alpha=10)
    return out(fit, n=None, coef1_standardised=6, coef2_standardised=6, coef1=6, coef2=6, intercept=6)


@query
def shock_table(spark, d):
    """Closed-form response of every nation's own elasticity to each shock."""
    slopes = linear.log_slope(nation_panel(spark, d), "target", "base", by="entity")
    rows = slopes.select("entity", "slope", F.explode(F.array(*[F.lit(s) for s in SHOCKS])).alias("factor"))
    rows = rows.withColumns(linear.shock_response(F.col("slope"), F.col("factor")))
    return out(rows, entity=None, factor=2, slope=6, multiplier=6, change_pct=6, linear_pct=6, linear_error=6, response=None)


def _line(panel):
    """Least-squares line of log target on log base, and the panel's rows with both logs."""
    model = linear.line_model(linear.log_slope(panel, "target", "base"), "log_base")
    rows = panel.select(*KEYS, F.log1p("target").alias("label"), F.log1p("base").alias("log_base"))
    return model, rows.where("label IS NOT NULL")


def _line_changes(spark, d):
    model, rows = _line(customers(spark, d))
    return linear.counterfactual(at_last_full(rows), model, "log_base", V.SHOCK)


@query
def counterfactual_linear(spark, d):
    return out(_line_changes(spark, d), entity=None, baseline=6, changed=6, change_pct=6)


@query
def counterfactual_distribution(spark, d):
    found = stats.change_distribution(_line_changes(spark, d), "change_pct")
    return out(found, n=None, mean=6, median=6, std=6, min=6, max=6, band_low=6, band_high=6)


@query
def counterfactual_extremes(spark, d):
    rows = stage(_line_changes(spark, d), "changes")
    top = rank.top_k(rows, "change_pct", 5, "entity").withColumn("side", F.lit("largest"))
    low = rank.top_k(rows, "change_pct", 5, "entity", largest=False).withColumn("side", F.lit("smallest"))
    return out(top.unionByName(low), side=None, entity=None, baseline=6, change_pct=6)


@query
def standardise(spark, d):
    rows = select.complete_cases(customers(spark, d), ["base", "fossil_pct"])
    return out(linear.standardise(rows, ["base", "fossil_pct"]), entity=None, period=None, base=6, fossil_pct=6)


@query
def median_impute(spark, d):
    filled = impute.fill_median(customers(spark, d), ["target", "growth_pct"])
    return out(filled, entity=None, period=None, target=9, growth_pct=6)


@query
def mean_impute(spark, d):
    filled = impute.fill_mean(customers(spark, d), ["target", "fossil_pct"])
    return out(filled, entity=None, period=None, target=8, fossil_pct=6)


@query
def balanced_weights(spark, d):
    rows = stage(outcome_frame(customer_panel(spark, d)), "outcome")
    return out(splits.balanced_weights(rows, "success"), entity=None, success=None, weight=6)


def _line_predictions(spark, d):
    model, rows = _line(customers(spark, d))
    return rows.withColumn("prediction", model.predict())


@query
def regression_metrics(spark, d):
    found = metrics.regression_metrics(_line_predictions(spark, d))
    return out(found, n=None, r2=6, rmse=6, mae=6, mape=6, rmse_original=6, mae_original=6)


@query
def residuals(spark, d):
    rows = metrics.residuals(_line_predictions(spark, d))
    return out(rows, entity=None, period=None, label=6, prediction=6, residual=6, actual=8, predicted=6)


def _scored(spark, d):
    """Outcome labels with a fixed score: how little of the feature period's lines came back."""
    rows = _features(customers(spark, d)).where("fossil_pct IS NOT NULL")
    score = F.round(1 - F.col("fossil_pct") / 100, 6)
    return rows.select("entity", F.col("success").alias("label"), score.alias("score")).withColumn(
        "prediction", (F.col("score") >= 0.7).cast("int")
    )


@query
def confusion_matrix(spark, d):
    return metrics.confusion(_scored(spark, d))


@query
def binary_metrics(spark, d):
    found = metrics.binary_metrics(_scored(spark, d))
    return out(found, tp=None, fp=None, fn=None, tn=None, accuracy=6, precision=6, recall=6, f1=6)


@query
def auc_rank(spark, d):
    return out(metrics.auc(stage(_scored(spark, d), "scores")), auc=6)


@query
def roc_points(spark, d):
    return out(metrics.roc_points(stage(_scored(spark, d), "scores")), threshold=6, fpr=6, tpr=6)


# ---------------------------------------------------------------- fitted models, checked by their rows and in tests


def _model_rows(spark, d):
    rows = customer_panel(spark, d).where("target IS NOT NULL")
    rows = rows.withColumns({"label": F.log1p("target"), "log_base": F.log1p("base")})
    train, test = select.temporal_split(stage(rows, "model"), "period", LAST_TRAIN, "label", MODEL_FEATURES)
    return stage(splits.contiguous_folds(train, KEYS, V.RIDGE_FOLDS), "train"), test


@query
def ridge_cv(spark, d):
    """Coefficients of the ridge with the cross-validated penalty, with a reading and a category each."""
    train, _ = _model_rows(spark, d)
    best = linear.best_ridge(*linear.ridge_path(train, MODEL_FEATURES, "label", "fold"))
    table_ = linear.interpret(best.withColumnRenamed("coef", "elasticity"), {"log_base": "base"})
    categories = {"Economic": ["log_base", "population"], "Energy": ["fossil_pct", "renewable_pct"]}
    return out(
        linear.with_category(table_, categories),
        feature=None, coef_standardised=6, elasticity=6, reading=None, category=None, alpha=None, intercept=6,
    )


@query
def ridge_cv_scores(spark, d):
    train, _ = _model_rows(spark, d)
    return out(linear.ridge_path(train, MODEL_FEATURES, "label", "fold")[1], alpha=None, mean_r2=6)


@query
def ridge_test_metrics(spark, d):
    train, test = _model_rows(spark, d)
    model = linear.ridge_cv(train, MODEL_FEATURES, "label", "fold")
    found = metrics.regression_metrics(test.withColumn("prediction", model.predict()))
    return out(found, n=None, r2=6, rmse=6, mae=6, mape=6, rmse_original=6, mae_original=6)


@query
def counterfactual_ridge(spark, d):
    """Every entity of the last full period rescored by all features with its base multiplied."""
    train, test = _model_rows(spark, d)
    model = linear.ridge_cv(train, MODEL_FEATURES, "label", "fold")
    rows = linear.counterfactual(at_last_full(test), model, "log_base", V.SHOCK)
    return out(rows, entity=None, baseline=6, changed=6, change_pct=6)


@query
def forest_regression(spark, d):
    train, test = _model_rows(spark, d)
    model = trees.fit_forest_regression(train, MODEL_FEATURES, "label")
    return metrics.regression_metrics(model.transform(test))


def _class_rows(spark, d):
    """Weighted, imputed feature rows split by class; medians and scales come from the training rows.

    The test rows are left to be stored by the queries that read them.
    """
    rows = stage(_features(customers(spark, d)), "class-rows")
    train, test = splits.stratified_split(rows, "entity", "success")
    train = stage(train, "split")
    train, test = (impute.fill_median(part, CLASS_FEATURES, fit_on=train) for part in (train, test))
    train = stage(train, "filled")
    train, test = (linear.standardise(part, CLASS_FEATURES, train, "_z") for part in (train, test))
    return stage(splits.balanced_weights(train, "success"), "train"), test.withColumn("weight", F.lit(1.0))


def _names(model):
    return [f"{c}_z" for c in CLASS_FEATURES] if model == "Logistic Regression" else CLASS_FEATURES


def _pipeline(name, n_rows):
    return trees.classifier(name, _names(name), "success", "weight", n_rows)


def _fit(name, train):
    return _pipeline(name, train.count()).fit(trees.spread(train))


def _evaluated(spark, d, names):
    train, test = _class_rows(spark, d)
    test = stage(test, "test")
    frames = [
        trees.evaluate(_fit(n, train), train, test, "success").select(F.lit(i).alias("model_no"), F.lit(n).alias("model"), "*")
        for i, n in enumerate(names)
    ]
    return trees.union_rows(frames)


@query
def forest_classifier(spark, d):
    return _evaluated(spark, d, ["Random Forest"])


@query
def gbt_classifier(spark, d):
    return _evaluated(spark, d, ["Gradient Boosting"])


@query
def stratified_split_rows(spark, d):
    """Train or test, by exact quotas of each class in the order of a portable hash."""
    rows = stage(_features(customers(spark, d)), "class-rows")
    train, test = splits.stratified_split(rows, "entity", "success")
    parts = [p.select("entity", "success", F.lit(n).alias("part")) for p, n in ((train, "train"), (test, "test"))]
    return parts[0].union(parts[1])


@query
def stratified_fold_rows(spark, d):
    rows = stage(_features(customers(spark, d)), "class-rows")
    return splits.stratified_folds(rows, "entity", "success", 5).select("entity", "success", "fold")


def _logistic(train):
    return logistic.fit_logistic(train, _names("Logistic Regression"), "success", "weight", trees.LOGISTIC_C)


@query
def logistic_classifier(spark, d):
    """Logistic regression by reweighted least squares on the training part, judged on both."""
    train, test = _class_rows(spark, d)
    test = stage(test, "test")
    model = _logistic(train)
    found = trees.judged(model.score(train, "success"), model.score(test, "success"))
    named = found.select(F.lit(0).alias("model_no"), F.lit("Logistic Regression").alias("model"), "*")
    return out(
        named, model_no=None, model=None, train_accuracy=6, tp=None, fp=None, fn=None, tn=None,
        accuracy=6, precision=6, recall=6, f1=6, auc=6,
    )


@query
def logistic_importance(spark, d):
    """Sizes and signs of the logistic coefficients of the standardised features."""
    train, _ = _class_rows(spark, d)
    return out(_logistic(train).importance(spark, CLASS_FEATURES), feature=None, importance=6, sign=None)


@query
def logistic_cv_f1(spark, d):
    """F1 of class 1 over the five stratified folds of the training part."""
    train, _ = _class_rows(spark, d)
    folded = stage(splits.stratified_folds(train, "entity", "success", 5), "folds")
    found = []
    for k in range(5):  # a fit per fold
        model = _logistic(folded.where(F.col("fold") != k))
        found.append(metrics.binary_metrics(model.score(folded.where(F.col("fold") == k), "success")).select(F.lit(k).alias("fold"), "f1"))
    return out(trees.union_rows(found), fold=None, f1=6)


@query
def best_model(spark, d):
    return metrics.best_model(_evaluated(spark, d, trees.CLASSIFIERS))


@query
def feature_importance(spark, d):
    train, _ = _class_rows(spark, d)
    frames = [trees.importance(_fit(n, train), CLASS_FEATURES).withColumn("model", F.lit(n)) for n in trees.CLASSIFIERS]
    return trees.union_rows(frames)


def _cross_validated(spark, d, names):
    train, _ = _class_rows(spark, d)
    folded = stage(splits.stratified_folds(train, "entity", "success", 5), "folds")
    n = folded.count()
    rows = [
        (m, *trees.cross_validated_f1(_pipeline(m, n), folded, "success", "fold", 5, parallelism=5)) for m in names
    ]
    return spark.createDataFrame(rows, "model string, cv_f1_mean double, cv_f1_std double")


@query
def cv_f1(spark, d):
    return _cross_validated(spark, d, ["Random Forest", "Logistic Regression"])


@query
def cv_f1_boosted(spark, d):
    """Boosted trees on their own: five times a hundred rounds, one after the other."""
    return _cross_validated(spark, d, ["Gradient Boosting"])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Customer panel, cleaned; each entity's outcome and its archetype in the last full period."""
    cleaned = stage(_cleaned(customers(spark, d)), "cleaned")
    segments = segment.with_archetype(at_last_full(cleaned), ROLES, CUTS).select("entity", "archetype")
    found = outcome_frame(cleaned).join(segments, "entity")
    return out(found, entity=None, archetype=None, start_value=8, end_value=8, change=6, growth=LOG, outcome=None, success=None)


QUERIES["flagship"] = flagship


