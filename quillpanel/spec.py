"""Panel and feature descriptions, resolved on the driver from the schema alone."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


class MissingColumns(ValueError):
    """A required column is not in the schema."""


def existing(df: DataFrame, names: list[str]) -> list[str]:
    """The names that are columns of ``df``, in the order asked for."""
    present = set(df.columns)
    return [n for n in names if n in present]


def first_existing(df: DataFrame, names: list[str]) -> str | None:
    """First candidate that is a column of ``df``."""
    return next(iter(existing(df, names)), None)


def keep_existing(df: DataFrame, names: list[str]) -> DataFrame:
    """Project to the wanted columns that exist, in the wanted order."""
    return df.select(*existing(df, names))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ("year", "period")) -> list[str]:
    """Numeric columns except the excluded ones (the period by default)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


@dataclass(frozen=True)
class PanelSpec:
    """Names of the key columns, the target and the columns a panel must or may have."""

    entity: str = "country_code"
    period: str = "year"
    target: str = "co2_emissions_mt"
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    def validate(self, df: DataFrame) -> DataFrame:
        """Raise on a missing required column, otherwise report each optional one."""
        needed = [self.entity, self.period, self.target, *self.required]
        missing = [c for c in needed if c not in df.columns]
        if missing:
            raise MissingColumns(f"missing columns: {missing}")
        rows = [(c, True, True) for c in needed] + [(c, False, c in df.columns) for c in self.optional]
        return df.sparkSession.createDataFrame(rows, "column string, required boolean, present boolean")

    def profile(self, df: DataFrame) -> DataFrame:
        """Rows, entities and period range in one pass."""
        return df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(self.entity).alias("n_entities"),
            F.min(self.period).alias("first_period"),
            F.max(self.period).alias("last_period"),
            F.count(self.target).alias("n_target"),
        )


@dataclass(frozen=True)
class FeatureSpec:
    """Feature list: candidates minus named and prefixed columns, each once, plus forced extras."""

    exclude: tuple[str, ...] = ()
    exclude_prefix: str | None = None
    extra: tuple[str, ...] = field(default=())

    def resolve(self, df: DataFrame) -> list[str]:
        kept = [
            c
            for c in df.columns
            if c not in self.exclude and not (self.exclude_prefix and c.startswith(self.exclude_prefix))
        ]
        return list(dict.fromkeys([*kept, *existing(df, list(self.extra))]))
