"""Units of amounts: known from a column's metadata or its name, converted where a panel comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tonnes in each unit.
TONNES = {"t": 1.0, "kt": 1e3, "mt": 1e6, "gt": 1e9}
UNIT = "unit"


def with_unit(df: DataFrame, column: str, unit: str) -> DataFrame:
    """``df`` with the unit noted in the column's metadata, which later steps and Parquet files keep."""
    if unit.lower() not in TONNES:
        raise ValueError(f"unknown unit {unit!r}")
    return df.withMetadata(column, {**df.schema[column].metadata, UNIT: unit.lower()})


def unit_of(df: DataFrame, column: str) -> str | None:
    """The unit in the metadata, or else the last part of a name like ``emissions_kt``; None where neither tells."""
    noted = df.schema[column].metadata.get(UNIT)
    suffix = column.lower().rpartition("_")[2]
    return noted or (suffix if suffix in TONNES and suffix != column.lower() else None)


def converted(c: Column, unit: str, to: str) -> Column:
    """An amount in ``unit`` as one in ``to``; NULL stays."""
    have, want = TONNES[unit.lower()], TONNES[to.lower()]
    return c if have == want else c / F.lit(want / have) if want > have else c * F.lit(have / want)


def resolved(df: DataFrame, candidates: list[str], name: str, unit: str = "mt") -> DataFrame:
    """``df`` with ``name`` in ``unit``, made from the first of ``candidates`` that it has.

    The candidate's own column goes where it isn't ``name``.  A column without a known unit is taken to be
    in ``unit``.  Raises where no candidate is there.
    """
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {candidates} in {df.columns}")
    amount = converted(F.col(found).cast("double"), unit_of(df, found) or unit, unit)
    out = df.withColumn(name, amount)
    return with_unit(out if found == name else out.drop(found), name, unit)
