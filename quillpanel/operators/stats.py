"""Panel statistics: coverage, missing values, summaries, correlations, totals and class comparisons."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel.functions.numeric import not_nan, percent_of, ratio
from quillpanel.operators.ordered import quantiles


def _missing(columns: list[str]) -> Column:
    """Number of missing cells of a row among the columns."""
    return sum(F.col(c).isNull().cast("int") for c in columns)


def entity_coverage(df: DataFrame, entity: str, column: str) -> DataFrame:
    """Share of an entity's rows that have a value."""
    return df.groupBy(entity).agg(ratio(F.count(column), F.count(F.lit(1))).alias("coverage"))


def entity_missingness(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """Mean share of missing cells per entity over the columns, from whole counts so that limits compare exactly."""
    cells = F.count(F.lit(1)) * len(columns)
    return df.groupBy(entity).agg(ratio(F.sum(_missing(columns)), cells).alias("missing_share"))


def without_target(df: DataFrame, entity: str, target: str) -> DataFrame:
    """Entities that never have a target value."""
    return entity_coverage(df, entity, target).where(F.col("coverage") == 0)


def too_sparse(df: DataFrame, entity: str, columns: list[str], max_missing: float) -> DataFrame:
    """Entities whose mean missing share is above the limit."""
    return entity_missingness(df, entity, columns).where(F.col("missing_share") > max_missing)


def column_nulls(df: DataFrame, columns: list[str], only_missing: bool = True) -> DataFrame:
    """Missing cells and percentage per column, one pass, highest first."""
    rows = [
        F.struct(
            F.lit(c).alias("metric"),
            F.count_if(F.col(c).isNull()).alias("n_missing"),
            percent_of(F.count_if(F.col(c).isNull()), F.count(F.lit(1))).alias("missing_pct"),
        )
        for c in columns
    ]
    found = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    if only_missing:
        found = found.where(F.col("n_missing") > 0)
    return found.orderBy(F.col("missing_pct").desc(), "metric")


def missing_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.coalesce(F.sum(_missing(columns)), F.lit(0)).alias("n_missing"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "metric", "value")
    moments = long.groupBy("metric").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by="metric")
    return moments.join(F.broadcast(quartiles), "metric", "left")  # one row per column


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns, NULL where one is constant on the common rows (Spark's own ``corr`` then fails)."""
    there, back = F.regr_slope(y, x), F.regr_slope(x, y)
    r = not_nan(F.signum(there) * F.sqrt(there * back))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def correlation_matrix(df: DataFrame, columns: list[str], lower_only: bool = True) -> DataFrame:
    """Pairwise-complete Pearson correlations as (x, y, corr) in one pass.

    ``lower_only`` keeps i >= j, the diagonal included.  One aggregate per pair: meant
    for up to about a hundred columns.
    """
    order = {c: i for i, c in enumerate(columns)}
    pairs = [*combinations(columns, 2), *[(c, c) for c in columns]]
    entries = []
    for b, a in pairs:
        r = pearson(a, b)
        entries.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r.alias("corr")))
        if a != b and not lower_only:
            entries.append(F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), r.alias("corr")))
    assert all(order[a] >= order[b] for b, a in pairs)
    return df.agg(F.array(*entries).alias("r")).select(F.inline("r"))


def correlation_with(df: DataFrame, target: str, columns: list[str], top: int | None = 10) -> DataFrame:
    """Correlation of each column with the target, highest first, the target left out."""
    rows = [
        F.struct(F.lit(c).alias("metric"), pearson(target, c).alias("corr")) for c in columns if c != target
    ]
    found = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    found = found.orderBy(F.col("corr").desc_nulls_last(), "metric")
    return found.limit(top) if top else found


def period_totals(df: DataFrame, period: str, column: str) -> DataFrame:
    """Total per period; 0 where all values are missing."""
    return df.groupBy(period).agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("total"))


def ratio_of_totals(df: DataFrame, part: str, whole: str) -> DataFrame:
    return df.agg(
        F.coalesce(F.sum(part), F.lit(0.0)).alias("part_total"),
        F.coalesce(F.sum(whole), F.lit(0.0)).alias("whole_total"),
        percent_of(F.sum(part), F.sum(whole)).alias("part_pct"),
    )


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; missing values are not counted."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), column)
    )


def class_share(df: DataFrame, flag: str) -> DataFrame:
    """Number and share of the rows with flag 1, and the complement."""
    n, total = F.coalesce(F.sum(flag), F.lit(0)), F.count(F.lit(1))
    return df.agg(
        total.alias("n_total"),
        n.alias("n_success"),
        percent_of(n, total).alias("success_pct"),
        (total - n).alias("n_other"),
        percent_of(total - n, total).alias("other_pct"),
    )


def class_means(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Mean of each feature in the two classes and the difference, in one pass over the rows.

    Features without a value in either class are left out.
    """
    mean = lambda c, k: F.avg(F.when(F.col(label) == k, F.col(c)))
    rows = [
        F.struct(F.lit(c).alias("feature"), mean(c, 1).alias("success_mean"), mean(c, 0).alias("other_mean"))
        for c in features
    ]
    return (
        df.agg(F.array(*rows).alias("r"))
        .select(F.inline("r"))
        .where(F.col("success_mean").isNotNull() & F.col("other_mean").isNotNull())
        .withColumn("difference", F.col("success_mean") - F.col("other_mean"))
    )


def insights(comparison: DataFrame, rules: list[tuple[str, int, str, str]]) -> DataFrame:
    """Rules whose feature differs between the classes in the expected direction, as readable lines.

    A rule is (feature, expected sign, text, format of the two means).
    """
    spark = comparison.sparkSession
    rows = [(feature, sign, text) for feature, sign, text, _ in rules]
    table = spark.createDataFrame(rows, "feature string, expected_sign int, text string")
    line = F.lit(None).cast("string")
    for feature, _, _, pattern in rules:
        shown = F.format_string(pattern, F.col("success_mean"), F.col("other_mean"))
        line = F.when(F.col("feature") == feature, shown).otherwise(line)
    return (
        comparison.join(F.broadcast(table), "feature")
        .where(F.signum("difference") == F.col("expected_sign"))
        .select("feature", F.concat("text", F.lit(" ("), line, F.lit(")")).alias("insight"))
    )


def change_distribution(df: DataFrame, column: str) -> DataFrame:
    """mean, exact median, population deviation, min, max and the mean +- 2 deviations band."""
    c = F.col(column)
    moments = df.agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")
    )
    median = quantiles(df, column, {"median": 0.5}).scalar()
    return moments.select(
        "n",
        "mean",
        median.alias("median"),
        "std",
        "min",
        "max",
        (F.col("mean") - 2 * F.col("std")).alias("band_low"),
        (F.col("mean") + 2 * F.col("std")).alias("band_high"),
    )
