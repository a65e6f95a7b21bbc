"""Gap filling against hand-made series and pandas."""

import random

import pandas as pd
import pytest

from quillpanel.operators.impute import fill_mean, fill_median, gap_fill

SCHEMA = "e long, t int, v double"


def filled(spark, series, **kw):
    rows = [(0, i, v) for i, v in enumerate(series)]
    out = gap_fill(spark.createDataFrame(rows, SCHEMA), "e", "t", ["v"], **kw).orderBy("t").collect()
    return [r["v"] for r in out]


def test_leading_interior_and_trailing_gaps(spark):
    series = [None] * 3 + [1.0, 2.0] + [None] * 7 + [10.0, 11.0, 12.0] + [None] * 6
    got = filled(spark, series)
    assert got[:3] == [None, 2.0 - 1.0, 1.0]  # two steps back, the third stays missing
    assert got[5:8] == [3.0, 4.0, 5.0] and got[8:10] == [5.0, 5.0]  # line for 3, then carried for 2
    assert got[10:12] == [10.0, 10.0]  # next value back for 2
    assert got[15:20] == [12.0] * 5 and got[20] is None


def test_entity_without_values_stays_missing(spark):
    assert filled(spark, [None] * 5) == [None] * 5


@pytest.mark.parametrize("block", [None, 1, 3, 100])
@pytest.mark.parametrize("limits", [(3, 2, 2), (1, 0, 4)])
def test_random_series_match_pandas(spark, block, limits):
    rng = random.Random(7)
    rows, t0 = [], 0
    for e in range(60):
        share = rng.random()
        periods = sorted(rng.sample(range(40), rng.randint(1, 30)))  # uneven spacing: positions count, not years
        rows += [(e, t0 + t, None if rng.random() < share else round(rng.uniform(-5, 5), 3)) for t in periods]
    rng.shuffle(rows)
    pdf = pd.DataFrame(rows, columns=["e", "t", "v"]).astype({"v": float}).sort_values(["e", "t"])
    i, f, b = limits
    expected = pdf.copy()
    expected["v"] = pdf.groupby("e")["v"].transform(
        lambda s: (lambda x: x.ffill(limit=f) if f else x)(s.interpolate(method="linear", limit=i)).bfill(limit=b)
    )
    df = spark.createDataFrame([(e, t, v) for e, t, v in rows], SCHEMA)
    got = gap_fill(df, "e", "t", ["v"], i, f, b, block=block).toPandas().sort_values(["e", "t"])
    pd.testing.assert_frame_equal(got.reset_index(drop=True), expected.reset_index(drop=True), check_dtype=False)


def test_mean_and_median_fill(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 9.0), (0, 3, None)], SCHEMA)
    assert {r["v"] for r in fill_mean(df, ["v"]).where("t = 3").collect()} == {4.0}
    assert {r["v"] for r in fill_median(df, ["v"]).where("t = 3").collect()} == {2.0}
    train = df.where("t < 2")
    assert {r["v"] for r in fill_median(df, ["v"], fit_on=train).where("t = 3").collect()} == {1.5}
