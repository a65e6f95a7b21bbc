"""Small linear systems solved inside a plan, one per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def solved(matrix: Column, size: int) -> Column:
    """x of A x = b as an array, for rows of [A | b] as an array of ``size`` arrays of ``size`` + 1 numbers.

    Gauss-Jordan elimination without exchanges, so A must be symmetric and positive definite, as penalised
    moments are; a pivot of 0 gives NULL.  The work is the cube of ``size`` in each row.
    """

    def cleared(m: Column, k: Column) -> Column:
        pivot = F.get(m, k)
        scaled = F.transform(pivot, lambda x: F.try_divide(x, F.get(pivot, k)))
        # bound once by the outer array of one element
        return F.get(F.transform(F.array(scaled), lambda p: F.transform(m, lambda row, i: F.when(i == k, p).otherwise(_less(row, p, k)))), F.lit(0))

    def _less(row: Column, pivot: Column, k: Column) -> Column:
        return F.zip_with(row, pivot, lambda x, y: x - F.get(row, k) * y)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, cleared)
    return F.transform(done, lambda row: F.get(row, F.lit(size)))


def gathered(cells: DataFrame, by: list[str], row: str, column: str, value: str, name: str = "matrix") -> DataFrame:
    """Cells (``by``, row, column, value) of small matrices as one array of arrays per group, both in order."""
    in_order = lambda place, x: F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), F.col(x).alias("x")))), lambda s: s["x"])
    rows = cells.groupBy(*by, row).agg(in_order(column, value).alias("_cells"))
    return rows.groupBy(*by).agg(in_order(row, "_cells").alias(name))
