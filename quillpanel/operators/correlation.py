"""Correlations of very many columns: products of whole column sets instead of an aggregate per pair."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
#: A variance below this share of the mean square about the column's overall mean is rounding: the values are equal.
ROUNDING = 1e-13
ROWS_AT_ONCE = 1024


def correlation_products(df: DataFrame, columns: list[str], lower_only: bool = True) -> DataFrame:
    """Pairwise-complete Pearson correlations as (x, y, corr, n), for thousands of columns.

    Each task multiplies the matrix of its rows and that of their presence, in slices of 1024 rows, and
    keeps four matrices of columns by columns (32 MB at 1000 columns, 128 MB at 2000); a pair's six sums
    leave it once and add up in one exchange by pair.  Values are taken from their columns' means, which a
    first pass finds, so that sums of squares don't lose digits.  NULL and NaN are missing; a pair with
    fewer than two common rows, or with a column that is constant on them, has no correlation (NULL).
    ``lower_only`` keeps pairs whose x does not stand before y in ``columns``, the diagonal included.
    """
    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(columns)])
    means = values.agg(*[F.avg(c) for c in values.columns]).first()  # a number per column
    shift = [0.0 if m is None else float(m) for m in means]

    def products(batches: Iterable) -> Iterator:  # needs nothing of this package on the executors
        import numpy as np
        import pyarrow as pa

        size = len(shift)
        n, first, square, cross = (np.zeros((size, size)) for _ in range(4))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns])
                there = ~np.isnan(x)
                x = np.where(there, x - np.array(shift), 0.0)
                there = there.astype(np.float64)
                n += there.T @ there
                first += x.T @ there
                square += (x * x).T @ there
                cross += x.T @ x
        for a in range(size):
            own = slice(0, a + 1)
            sums = [n[a, own], first[a, own], first[own, a], square[a, own], square[own, a], cross[a, own]]
            b = np.arange(a + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(a + 1, a, np.int32)), pa.array(b), *map(pa.array, sums)], ["a", "b", *SUMS])

    parts = values.mapInArrow(products, "a int, b int, " + ", ".join(f"{s} double" for s in SUMS))
    found = parts.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])
    n, sx, sy, sxx, syy, sxy = (F.col(s) for s in SUMS)
    spread = lambda s, ss: F.when(n > 1, ss - F.try_divide(s * s, n))
    vx, vy = spread(sx, sxx), spread(sy, syy)
    varies = (vx > ROUNDING * sxx) & (vy > ROUNDING * syy)
    r = F.when(varies, (sxy - F.try_divide(sx * sy, n)) / (F.sqrt(vx) * F.sqrt(vy)))
    r = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    names = F.array(*[F.lit(c) for c in columns])
    named = lambda c: F.element_at(names, F.col(c) + 1)
    lower = found.select(named("a").alias("x"), named("b").alias("y"), r.alias("corr"), n.cast("long").alias("n"))
    if lower_only:
        return lower
    return lower.union(lower.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "corr", "n"))
