"""Indicator frames to one panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_long(frames: list[DataFrame]) -> DataFrame:
    """Long frames (entity, period, indicator, value) under each other."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def pivot_panel(long: DataFrame, keys: list[str], indicators: list[str]) -> DataFrame:
    """Wide panel in one shuffle, however many indicators there are.

    The indicator list is given, so no extra job looks for it, and each key keeps its
    first non-missing value per indicator.  Rows are combined before the shuffle.
    """
    return long.groupBy(*keys).pivot("indicator", indicators).agg(F.first("value", ignorenulls=True))


def outer_merge(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge of frames that are each one row per key, in one exchange however many they are.

    The frames go under each other, each with the columns that no earlier frame has, and are grouped by
    key, which combines rows before they move.  So descriptive columns of later frames that an earlier
    one has already are dropped, and a row first seen in a later frame has no name.  Keys that are null
    are one key.  Of rows that repeat a key in a frame the first value that isn't missing stays.
    """
    kinds = {f.name: f.dataType for f in frames[0].schema}
    owned = [[c for c in frames[0].columns if c not in keys]]
    for frame in frames[1:]:
        owned.append([c for c in frame.columns if c not in kinds])
        kinds |= {c: frame.schema[c].dataType for c in owned[-1]}
    columns = [c for own in owned for c in own]
    parts = [
        frame.select(*keys, *[F.col(c) if c in own else F.lit(None).cast(kinds[c]).alias(c) for c in columns])
        for frame, own in zip(frames, owned, strict=True)
    ]
    merged = reduce(DataFrame.union, parts).groupBy(*keys)
    if not columns:
        return merged.agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    return merged.agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Source names to panel names; names that are absent are ignored."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def search_catalogue(catalogue: DataFrame, key: str, text: str, terms: list[str], first: int = 10) -> DataFrame:
    """Per search term: number of matching entries and the first few by key.

    Each row is tested once against the short term list, counts combine before the
    shuffle, and the first entries are cut per task before they move.
    """
    from quillpanel.operators.rank import top_per_group

    hits = catalogue.select(
        key,
        text,
        F.explode(
            F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(F.col(text)), F.lower(t)))
        ).alias("term"),
    )
    counts = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_matches"))
    return top_per_group(hits, "term", [F.col(key).asc()], first).join(F.broadcast(counts), "term")
