"""Bins, steps, outcomes, archetypes, members, audit and statistics on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from quillpanel import fixed_values as V
from quillpanel.functions import classes, numeric, text
from quillpanel.operators import assembly, outcome, segment, select, stats
from quillpanel.plans import panels
from quillpanel.spec import FeatureSpec, MissingColumns, PanelSpec, first_existing, numeric_columns


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_right_closed_bins(spark):
    rows = [(x,) for x in (0.0, 0.1, 20.0, 20.1, 100.0, 101.0, None)]
    c = F.col("x")
    got = one(spark, rows, "x double", classes.bin_ordinal(c, V.GRID_EDGES), classes.bin_ordinal(c, V.GRID_EDGES, True))
    assert got == [(None, 1), (1, 1), (1, 1), (2, 2), (5, 5), (None, None), (None, None)]
    income = one(spark, [(0.5,), (12000.0,), (9e9,)], "x double", classes.bin_label(c, V.INCOME_EDGES, V.INCOME_LABELS))
    assert income == [("Low",), ("Upper-Middle",), ("High",)]


def test_step_lookup(spark):
    rows = [(x,) for x in (999.0, 1000.0, 14999.0, 15000.0, 30000.0, 49999.0, 50000.0, None)]
    step = classes.step_value(F.col("x"), V.OWNERSHIP_THRESHOLDS, V.OWNERSHIP_VALUES, V.OWNERSHIP_DEFAULT)
    assert [r[0] for r in one(spark, rows, "x double", step)] == [20, 50, 200, 400, 600, 600, 800, 100]


def test_archetype_leaves(spark):
    rows = [
        (40000.0, 12.0, 10.0, 50.0, "High-Income High-Emitter"),
        (40000.0, 10.0, 10.0, 50.0, "High-Income Low-Emitter"),
        (40000.0, 12.0, 51.0, 50.0, "Clean Energy Leader"),
        (30000.0, 12.0, 50.0, 71.0, "Middle-Income Fossil-Dependent"),
        (30000.0, 12.0, None, None, "Middle-Income Transitioning"),
        (5000.0, 1.0, 1.0, 99.0, "Low-Income"),
        (None, 1.0, 90.0, 99.0, "Insufficient Data"),
        (1.0, None, 90.0, 99.0, "Insufficient Data"),
    ]
    df = spark.createDataFrame(rows, "i double, p double, r double, f double, expected string")
    got = segment.with_archetype(df, {"income": "i", "per_head": "p", "renewable": "r", "fossil": "f"})
    assert got.where("archetype <> expected").count() == 0
    # absent columns: no income and no renewables, all fossil
    assert {r["archetype"] for r in segment.with_archetype(df.select("p"), {"per_head": "p"}).collect()} == {
        "Low-Income",
        "Insufficient Data",
    }


def test_zero_divisors_give_null(spark):
    got = one(
        spark, [(5.0, 0.0)], "a double, b double",
        numeric.ratio(F.col("a"), F.col("b")), numeric.per_billion(F.col("a"), F.col("b")),
        numeric.scaled_intensity(F.col("a"), F.col("b")), numeric.relative_change(F.col("b"), F.col("a")),
        numeric.clip_low(F.lit(None).cast("double"), 0), numeric.clip_low(F.lit(-2.0), 0),
    )
    assert got == [(None, None, None, None, None, 0.0)]


def test_compound_growth_golden(spark):
    rows = [(r,) for r in (3.0, 2.0, -1.0, 4.0, None)]
    df = spark.createDataFrame(rows, "g double").agg(numeric.compound_growth(F.col("g")).alias("x"))
    assert df.first()["x"] == pytest.approx(0.0817, abs=5e-5)


def outcome_panel(spark):
    """One entity per outcome over 2000..2010, one exactly at the threshold, and ones that drop out."""
    cases = {
        "decoupling": (100.0, 80.0, 2.0),
        "contraction": (100.0, 80.0, -2.0),
        "edge": (100.0, 90.0, 2.0),
        "rising": (100.0, 120.0, 2.0),
        "no_growth_data": (100.0, 50.0, None),
        "zero_start": (0.0, 50.0, 2.0),
        "no_end": (100.0, None, 2.0),
    }
    rows = []
    for e, (a, b, g) in cases.items():
        rows += [(e, y, a if y == 2000 else b if y == 2010 else 1.0, g) for y in range(2000, 2011)]
    return spark.createDataFrame(rows, "e string, t int, v double, g double")


def test_outcome_types(spark):
    got = outcome.outcomes(outcome_panel(spark), "e", "t", "v", "g", 2010)
    found = {r["e"]: (r["outcome"], r["success"]) for r in got.collect()}
    assert found == {
        "decoupling": ("decoupling", 1),
        "contraction": ("economic_contraction", 0),
        "edge": ("no_reduction", 0),
        "rising": ("no_reduction", 0),
        "no_growth_data": ("insufficient_data", 0),
    }
    assert {r["outcome"] for r in outcome.outcomes(outcome_panel(spark).drop("g"), "e", "t", "v", "g", 2010).collect()} == {
        "insufficient_data"
    }


def test_growth_window_modes(spark):
    df = outcome_panel(spark).where("e = 'rising'")
    eleven = outcome.cumulative_growth(df, "e", "t", "g", 2000, 2010).first()
    ten = outcome.cumulative_growth(df, "e", "t", "g", 2000, 2010, include_base_year=False).first()
    assert (eleven["n_rates"], ten["n_rates"]) == (11, 10)
    assert eleven["growth"] == pytest.approx(1.02**11 - 1) and ten["growth"] == pytest.approx(1.02**10 - 1)
    sparse = df.withColumn("g", F.when(F.col("t") < 2006, F.col("g")))
    assert outcome.cumulative_growth(sparse, "e", "t", "g", 2000, 2010).first()["growth"] is None


def test_members_by_list_and_by_table_agree(spark):
    df = spark.createDataFrame([("WLD", 1), ("FRA", 2), (None, 3)], "c string, x int")
    table = spark.createDataFrame([("WLD",), ("EUU",)], "c string")
    by_list = select.exclude_members(df, "c", V.AGGREGATE_MEMBERS)
    assert {r["x"] for r in by_list.collect()} == {r["x"] for r in select.exclude_members(df, "c", table).collect()} == {2, 3}
    assert len(V.AGGREGATE_MEMBERS) == 50 and len(V.INDICATORS) == 21


def test_row_loss(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, -1.0)], "k int, v double")
    got = [tuple(r) for r in select.row_loss(df, [("known", F.col("v").isNotNull()), ("positive", F.col("v") > 0)]).collect()]
    assert got == [(1, "known", 3, 2), (2, "positive", 2, 1)]


def test_outer_merge_equals_pivot_and_names_come_from_the_left(spark):
    a = spark.createDataFrame([("x", 1, "X", 1.0)], "e string, t int, name string, a double")
    b = spark.createDataFrame([("x", 1, "X", 2.0), ("y", 1, "Y", 3.0)], "e string, t int, name string, b double")
    got = {r["e"]: tuple(r) for r in assembly.outer_merge([a, b], ["e", "t"]).collect()}
    assert got == {"x": ("x", 1, "X", 1.0, 2.0), "y": ("y", 1, None, None, 3.0)}


def test_outer_merge_moves_rows_once(spark):
    """One exchange for any number of frames, and the rows of a chain of full outer joins."""
    frames = [spark.range(i, 40 + 3 * i).select("id", (F.col("id") % 3).alias("t"), (F.col("id") * i).alias(f"v{i}")) for i in range(21)]
    merged = assembly.outer_merge(frames, ["id", "t"])
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    chained = frames[0]
    for f in frames[1:]:
        chained = chained.join(f, ["id", "t"], "full_outer")
    assert merged.columns == chained.columns
    assert sorted(map(str, merged.collect())) == sorted(map(str, chained.collect()))


def test_clean_panel_reference_columns(spark):
    rows = [
        ("AAA", 2000 + i, 10.0 if i != 1 else None, 1e9 if i != 2 else None, 1000.0) for i in range(4)
    ] + [("WLD", 2000, 1.0, 1.0, 1.0), ("EMP", 2000, None, 5.0, 5.0), ("THN", 2000, 1.0, None, None)]
    df = spark.createDataFrame(rows, "country_code string, year int, co2_emissions_mt double, gdp_current_usd double, population double")
    got = panels.clean_panel(df).orderBy("country_code", "year").collect()
    assert [(r["country_code"], r["year"]) for r in got] == [("AAA", 2000), ("AAA", 2002), ("AAA", 2003)]
    assert got[1]["gdp_current_usd"] == 1e9 and got[0]["co2_intensity"] == 10.0
    assert {"log_gdp", "log_population", "log_co2", "co2_intensity"} <= set(got[0].asDict())


def test_correlations_are_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.5, 0.0), (4.0, None, 5.0)], "a double, b double, c double")
    full = {(r["x"], r["y"]): r["corr"] for r in stats.correlation_matrix(df, ["a", "b", "c"], lower_only=False).collect()}
    assert len(full) == 9 and all(full[(x, y)] == full[(y, x)] for x, y in full)
    pdf = df.toPandas().corr()
    for (x, y), v in full.items():
        assert v == pytest.approx(pdf.loc[x, y], abs=1e-12)


def test_potential_modes_are_opposite(spark):
    df = spark.createDataFrame([(i, float(i), float(i), float(i), 11.0 + i) for i in range(5)], "e long, f double, r double, i double, s double")
    columns = {"fossil": "f", "renewable": "r", "intensity": "i", "size": "s"}
    ref = {r["e"]: r["potential_score"] for r in segment.potential(df, "e", columns, mode="reference").collect()}
    cor = {r["e"]: r["potential_score"] for r in segment.potential(df, "e", columns, mode="corrected").collect()}
    # both directions of a rank without ties add up to 1 + 1/n
    assert all(ref[e] + cor[e] == pytest.approx(100 * 1.2) for e in ref)
    with pytest.raises(ValueError):
        segment.potential(df, "e", columns, mode="x")


def test_actions_unfold_in_order(spark):
    df = spark.createDataFrame([(1, "Low-Income"), (2, "Insufficient Data")], "e int, archetype string")
    got = segment.with_actions(df, V.ARCHETYPE_ACTIONS, "archetype").orderBy("priority").collect()
    assert [r["action"] for r in got] == V.ARCHETYPE_ACTIONS["Low-Income"]


def test_spec_and_feature_lists(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0, 3.0)], "country_code string, year int, co2_x double, gdp double, log_co2 double")
    with pytest.raises(MissingColumns):
        PanelSpec(required=("absent",), target="gdp").validate(df)
    status = PanelSpec(target="gdp", optional=("absent", "co2_x")).validate(df)
    assert {r["column"]: r["present"] for r in status.where("NOT required").collect()} == {"absent": False, "co2_x": True}
    assert first_existing(df, ["nope", "gdp"]) == "gdp" and numeric_columns(df) == ["co2_x", "gdp", "log_co2"]
    assert FeatureSpec(("country_code", "year"), "co2_", ("log_co2", "gdp")).resolve(df) == ["gdp", "log_co2"]


def test_text(spark):
    got = one(
        spark, [("co2_power_industry_mt", 0.123, None, 1234.5, "YR1990")], "m string, s double, n double, d double, y string",
        text.title(text.metric_name(F.col("m"))), text.upper_title(text.metric_name(F.col("m"))), text.signed_percent(F.col("s")),
        text.signed_percent(F.col("n")), text.dollars(F.col("d")), text.parse_period(F.col("y")),
    )
    assert got == [("Power Industry", "POWER INDUSTRY", "+12.3%", "N/A", "$1,234", 1990)]
