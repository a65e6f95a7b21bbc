"""Scenario formula and sensitivity against published figures and hand calculation."""

import pytest
from pyspark.sql import functions as F

from quillpanel.operators import scenario as S

COLUMNS = S.ImpactColumns()


@pytest.fixture(scope="module")
def enriched(spark):
    rows = [
        ("NOR", 10.0, 40.0, 0.0, 80000.0, 5e6),
        ("DEU", 150.0, 700.0, 45.0, 48000.0, 8e7),
        ("IND", 300.0, 2500.0, 75.0, 2000.0, 1.4e9),
        ("XXX", 20.0, 90.0, None, None, 1e6),
        ("YYY", None, 90.0, 10.0, 500.0, 1e6),
    ]
    df = spark.createDataFrame(
        rows, "country_code string, co2_transport_mt double, co2_emissions_mt double, fossil double, income double, population double"
    )
    return S.enrich(df, "country_code", "co2_transport_mt", "fossil", "income", "population")


def test_enrichment(enriched):
    got = {r["country_code"]: r for r in enriched.collect()}
    assert set(got) == {"NOR", "DEU", "IND", "XXX"}
    assert got["XXX"]["fossil"] == pytest.approx(40.0) and got["XXX"]["ownership"] == 100
    assert (got["NOR"]["current_rate"], got["DEU"]["current_rate"], got["IND"]["current_rate"]) == (0.20, 0.08, 0.02)
    assert got["NOR"]["grid_intensity"] == 50.0 and got["DEU"]["ownership"] == 600
    assert got["IND"]["stock_millions"] == pytest.approx(50 * 1.4e9 / 1000 / 1e6)


@pytest.mark.parametrize(
    "intensity, unit, factor",
    [(50, 10, 0.92), (400, 80, 0.33), (800, 160, -0.33), (524, 105, 0.13), (120, 24, 0.80), (207, 41, 0.65), (109, 22, 0.82), (565, 113, 0.06)],
)
def test_factor_goldens(spark, intensity, unit, factor):
    df = spark.createDataFrame([(1.0, 1.0, float(intensity), 0.0, 1.0)], "co2_transport_mt double, co2_emissions_mt double, grid_intensity double, current_rate double, ownership double")
    row = S.apply_scenario(df, S.scenario_rows()[0], COLUMNS).first()
    assert row["unit_per_km"] == pytest.approx(unit, abs=0.5) and row["factor"] == pytest.approx(factor, abs=0.01)


def test_grid_has_fifteen_rows_and_corners_use_the_right_ends():
    rows = {s.scenario: s for s in S.scenario_rows()}
    assert len(rows) == 15
    best, worst = rows["best_case"], rows["worst_case"]
    assert (best.share, best.adoption, best.ref_per_km, best.use_per_km) == (0.50, 0.70, 150.0, 0.15)
    assert (worst.share, worst.adoption, worst.ref_per_km, worst.use_per_km) == (0.40, 0.30, 100.0, 0.25)


def test_totals_equal_the_unfolded_grid(enriched):
    one_pass = {r["scenario"]: r["total"] for r in S.scenario_totals(enriched, S.scenario_rows(), COLUMNS).collect()}
    grid = S.entity_grid(enriched, S.scenario_rows(), COLUMNS).groupBy("scenario").agg(F.sum("reduction").alias("t"))
    assert one_pass == {r["scenario"]: pytest.approx(r["t"]) for r in grid.collect()}
    assert one_pass["share_low"] / one_pass["base"] == pytest.approx(0.40 / 0.45)
    assert one_pass["best_case"] > one_pass["base"] > one_pass["worst_case"]
    assert one_pass["share_base"] == one_pass["base"]


def test_tornado_and_most_sensitive(enriched):
    ranges = S.tornado(S.scenario_totals(enriched, S.scenario_rows(), COLUMNS))
    rows = {r["parameter"]: r for r in ranges.collect()}
    assert set(rows) == set(S.PARAMETERS) and rows["use_per_km"]["low_total"] > rows["use_per_km"]["high_total"]
    assert S.most_sensitive(ranges).first()["parameter"] == max(rows.values(), key=lambda r: r["width"])["parameter"]


def test_flat_target_ignores_the_current_rate(enriched):
    flat = S.Scenario("flat", "all", "base", 0.45, 0.50, 120.0, 0.20, flat_target=True)
    assert {r["effective_rate"] for r in S.apply_scenario(enriched, flat, COLUMNS).collect()} == {0.5}
    scaled = S.apply_scenario(enriched, flat, COLUMNS, scale_by_ownership=True).first()
    assert scaled["reduction_scaled"] == pytest.approx(scaled["reduction"] * scaled["ownership"] / 200)


def test_bins_leave_out_zero_unless_asked(enriched):
    rows = S.apply_scenario(enriched, S.scenario_rows()[0], COLUMNS)
    plain = S.by_bin(rows, "fossil", "co2_transport_mt").collect()
    full = S.by_bin(rows, "fossil", "co2_transport_mt", include_lowest=True).collect()
    assert sum(r["n_entities"] for r in plain) == 3 and sum(r["n_entities"] for r in full) == 4
    assert S.adverse(rows).select("country_code").collect()[0][0] == "IND"


def test_base_of_zero_reports_no_difference(enriched):
    none = enriched.withColumn("co2_transport_mt", F.lit(0.0))
    assert {r["vs_base_pct"] for r in S.scenario_totals(none, S.scenario_rows(), COLUMNS).collect()} == {0.0}
