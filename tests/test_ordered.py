"""Ranks, quantiles and positions against pandas and NumPy, with ties and a hot value."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillpanel.operators import ordered
from quillpanel.operators.ordered import (
    ordered_totals,
    percent_rank_average,
    percent_rank_window,
    quantiles,
    values_at,
)
from quillpanel.operators.rank import cumulative_share, endpoint_change, top_k, top_per_group, union_top


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows share one value, a tenth have none, the rest tie now and then."""
    rng = random.Random(3)
    pick = lambda: 7.0 if rng.random() < 0.34 else None if rng.random() < 0.1 else round(rng.expovariate(0.01), 1)
    return pd.DataFrame({"k": range(4000), "a": [pick() for _ in range(4000)], "b": [pick() for _ in range(4000)]})


@pytest.fixture(scope="module")
def frame(spark, skewed):
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in skewed.itertuples(index=False)]
    return spark.createDataFrame(rows, "k long, a double, b double").repartition(8)


def test_small_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, None, 3.0, 2.0])], "k long, v double")
    up = percent_rank_average(df, {"v": True}, ["k"]).orderBy("k").collect()
    down = percent_rank_average(df, {"v": False}, ["k"]).orderBy("k").collect()
    assert [r["v_rank"] for r in up] == [0.875, 0.25, None, 0.875, 0.5]
    assert [r["v_rank"] for r in down] == [0.375, 1.0, None, 0.375, 0.75]


@pytest.mark.parametrize("ranges", [1, 4, None, 300, 1024, 2000])
def test_percent_rank_matches_pandas(frame, skewed, ranges):
    got = percent_rank_average(frame, {"a": True, "b": False}, ["k"], ranges=ranges).toPandas().sort_values("k")
    np.testing.assert_allclose(got["a_rank"].to_numpy(), skewed["a"].rank(pct=True).to_numpy(), atol=1e-12)
    np.testing.assert_allclose(got["b_rank"].to_numpy(), skewed["b"].rank(pct=True, ascending=False).to_numpy(), atol=1e-12)


@pytest.mark.parametrize("partitions", [32, 999, 1000, 2000])
def test_no_task_orders_all_values(spark, frame, partitions):
    """At any parallelism the values are ordered by range only; what else is ordered is a row per range."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        long = frame.select("a", "b").unpivot([], ["a", "b"], "m", "v")
        plan = ordered_totals(long, "v", "m")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    windows = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window ")]
    by_value = [line for line in windows if re.search(r"v#\d+ ASC", line)]
    assert by_value and all("_range" in line for line in by_value)
    assert "row_number" not in plan and "Sort " not in plan


def test_boundaries_are_few(spark):
    """About as many values as ranges are taken as boundaries, all where there are fewer; repeated runs agree."""
    df = spark.range(50_000).select((F.col("id") % 20_000).cast("double").alias("v"))
    for ranges, low, high in ((32, 10, 70), (1000, 850, 1150), (30_000, 20_000, 20_000)):
        found = [
            ordered._edges(d.groupBy(F.lit(0).alias("g"), "v").agg(F.count(F.lit(1)).alias("n")), "v", "g", ["n"], ranges).first()["_edges"]
            for d in (df, df.repartition(13))
        ]
        assert low <= len(found[0]) <= high and found[0] == found[1] == sorted(found[0])


def test_window_form_is_equal(frame):
    both = percent_rank_average(frame, {"a": True}, ["k"]).join(
        frame.select("k", percent_rank_window(frame, "a").alias("w")), "k"
    )
    assert both.where(~F.col("a_rank").eqNullSafe(F.col("w"))).count() == 0


def test_quantiles_match_numpy(frame, skewed):
    probabilities = {f"p{p}": p / 100 for p in (0, 1, 25, 50, 75, 99, 100)}
    row = quantiles(frame, "a", probabilities).first().asDict()
    for name, p in probabilities.items():
        assert row[name] == pytest.approx(np.quantile(skewed["a"].dropna(), p), abs=1e-9)
    long = frame.select("a", "b").unpivot([], ["a", "b"], "m", "v")
    found = {r["m"]: r["q"] for r in quantiles(long, "v", {"q": 0.5}, by="m").collect()}
    assert found == {c: pytest.approx(np.median(skewed[c].dropna())) for c in ("a", "b")}


def test_totals_of_several_measures(frame, skewed):
    measures = {"n": F.count(F.lit(1)), "even": F.count_if(F.col("k") % 2 == 0)}
    got = ordered_totals(frame, "a", measures=measures).toPandas().sort_values("a").reset_index(drop=True)
    known = skewed.dropna(subset=["a"])
    even = known[known["k"] % 2 == 0].groupby("a").size().reindex(got["a"], fill_value=0)
    assert got["even_before"].tolist() == (even.cumsum() - even).tolist()
    assert set(got["n_all"]) == {len(known)} and got["n"].sum() == len(known)


def test_values_at_positions(frame, skewed):
    ordered = sorted(skewed["a"].dropna())
    row = values_at(frame, "a", {"first": F.lit(0), "last": F.col("n_all") - 1, "tenth": F.lit(9)}).first()
    assert (row["first"], row["last"], row["tenth"]) == (ordered[0], ordered[-1], ordered[9])


def test_empty_input_gives_no_rows(frame):
    assert percent_rank_average(frame.where("k < 0"), {"a": True}, ["k"]).count() == 0


def test_top_k_orders_missing_last_and_ties_by_key(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0), (4, 1.0)], "k long, v double")
    assert [r["k"] for r in top_k(df, "v", 3, "k").collect()] == [1, 3, 4]
    assert [r["k"] for r in top_k(df, "v", 4, "k", largest=False).collect()] == [4, 1, 3, 2]
    assert union_top(top_k(df, "v", 2, "k"), top_k(df, "v", 2, "k", largest=False), "k").count() == 3


def test_cumulative_share(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([10, 40, 30, 20])], "k long, v double")
    got = [(r["rank_no"], r["k"], r["cumulative_share_pct"]) for r in cumulative_share(df, "v", 3, "k").collect()]
    assert got == [(1, 1, 40.0), (2, 2, 70.0), (3, 3, 90.0)]


def test_endpoint_change_needs_rows_and_values(spark):
    rows = [("ok", t, v) for t, v in enumerate([9.0, None, 2.0, None, 3.0, 5.0])]
    rows += [("short", t, 1.0) for t in range(4)] + [("sparse", t, 1.0 if t < 2 else None) for t in range(5)]
    rows += [("zero", t, float(t)) for t in range(5)]
    df = spark.createDataFrame(rows, "e string, t int, v double")
    got = {r["e"]: r["endpoint_change"] for r in endpoint_change(df, "e", "t", "v").collect()}
    assert got == {"ok": 1.5, "zero": None}


def test_top_per_group_cuts_before_the_shuffle(frame):
    top = top_per_group(frame, "a", [F.col("k").asc()], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
