"""Exact, repeatable splits and folds that do not depend on how rows are partitioned.

The cut points between parts are values at given positions of an ordering, found with
:func:`quillpanel.operators.ordered.values_at`.  They are a handful of values, so placing
a row afterwards is a comparison, not a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel import fixed_values as V
from quillpanel.operators.ordered import values_at


def _fold_starts(k: int) -> dict[str, Column]:
    """First position of folds 1..k-1: sizes differ by one at most, larger ones first."""
    n = F.col("n_all")
    size = F.floor(n / F.lit(k))
    extra = n - size * k
    return {f"f{j}": size * j + F.least(F.lit(j), extra) for j in range(1, k)}


def _fold_no(cuts: Column, key: Column, k: int) -> Column:
    return sum(F.coalesce(key >= cuts[f"f{j}"], F.lit(False)).cast("int") for j in range(1, k))


def contiguous_folds(df: DataFrame, keys: list[str], k: int, name: str = "fold") -> DataFrame:
    """k unshuffled folds of the rows in key order (entity, then period, for a panel)."""
    key = F.struct(*keys)
    starts = values_at(df.select(key.alias("_key")), "_key", _fold_starts(k))
    cuts = starts.agg(F.first(F.struct(*[f"f{j}" for j in range(1, k)]))).scalar()
    return df.withColumn("_cuts", cuts).withColumn(name, _fold_no(F.col("_cuts"), key, k)).drop("_cuts")


def portable_hash(key: Column, seed: int) -> Column:
    """A whole number below 16**15 from the MD5 of ``seed:key``, which any engine can compute alike."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _hashed(key: str, seed: int) -> Column:
    return F.struct(portable_hash(F.col(key), seed).alias("h"), F.col(key).alias("k"))


def _cuts_by_label(df: DataFrame, key: str, label: str, seed: int, positions: dict[str, Column]) -> Column:
    found = values_at(df.select(label, _hashed(key, seed).alias("_key")), "_key", positions, by=label)
    entry = F.struct(F.col(label), F.struct(*positions).alias("cuts"))
    return found.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int = V.SEED, name: str = "fold") -> DataFrame:
    """k folds in hash order inside each class, so each fold has each class's share of rows."""
    cuts = F.element_at(_cuts_by_label(df, key, label, seed, _fold_starts(k)), F.col(label))
    return df.withColumn("_cuts", cuts).withColumn(name, _fold_no(F.col("_cuts"), _hashed(key, seed), k)).drop("_cuts")


def test_quotas(counts: dict[int, int], share: float) -> dict[int, int]:
    """Test rows per class: ceil(n x share) in all, by class size, remainders to the largest fractions."""
    total = sum(counts.values())
    wanted = -int(-total * share // 1)
    exact = {c: n * wanted / total for c, n in counts.items()}
    quota = {c: int(x) for c, x in exact.items()}
    for c in sorted(exact, key=lambda c: (quota[c] - exact[c], c))[: wanted - sum(quota.values())]:
        quota[c] += 1
    return quota


def stratified_split(
    df: DataFrame, key: str, label: str, share: float = V.TEST_SHARE, seed: int = V.SEED
) -> tuple[DataFrame, DataFrame]:
    """Train and test with exact class quotas; the test rows are the first of each class in hash order."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # one row per class
    quota = test_quotas(counts, share)
    at = F.lit(-1)
    for c, q in quota.items():
        at = F.when(F.col(label) == c, F.lit(q - 1)).otherwise(at)
    cuts = F.element_at(_cuts_by_label(df, key, label, seed, {"last": at}), F.col(label))
    marked = df.withColumn("_cuts", cuts).withColumn(
        "_test", F.coalesce(_hashed(key, seed) <= F.col("_cuts.last"), F.lit(False))
    )
    clean = lambda d: d.drop("_cuts", "_test")
    return clean(marked.where(~F.col("_test"))), clean(marked.where("_test"))


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Row weight n / (classes x rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n") / F.count(F.lit(1))
    entries = F.map_from_entries(F.collect_list(F.struct(label, "_n")))
    found = counts.agg(F.struct(total.alias("per_class"), entries.alias("n")).alias("w")).scalar()
    return df.withColumn("_w", found).withColumn(name, F.col("_w.per_class") / F.element_at("_w.n", F.col(label))).drop("_w")
