"""Indicator loading, sinks and staging."""

import math
import os

import pytest

from quillpanel.functions import units
from quillpanel.session import new_path, shared_folder, stage
from quillpanel.sources import files


def land(spark, folder, name, rows):
    df = spark.createDataFrame(rows, f"country_code string, year string, {name} double")
    files.write_panel(df, f"{folder}/{name}", "csv")
    return f"{folder}/{name}"


def test_broken_sources_are_reported_and_the_rest_loads(spark):
    folder = new_path(spark, "land")
    paths = {
        "gdp": land(spark, folder, "gdp", [("A", "YR1990", 1.0), ("A", "YR1991", float("nan")), ("B", "YR1989", 5.0)]),
        "pop": land(spark, folder, "pop", [("A", "YR1990", 7.0), ("C", "YR1992", 9.0)]),
        "old": land(spark, folder, "old", [("A", "YR1950", 7.0)]),
        "gone": f"{folder}/nowhere",
    }
    panel, status = files.load_indicators(spark, paths, 1990, 2024)
    rows = {(r["country_code"], r["year"]): r for r in panel.collect()}
    assert set(rows) == {("A", 1990), ("A", 1991), ("C", 1992)}
    assert rows[("A", 1991)]["gdp"] is None and rows[("A", 1990)]["pop"] == 7.0 and rows[("C", 1992)]["gdp"] is None
    found = {r["indicator"]: (r["status"], r["rows"]) for r in status.collect()}
    assert found == {"gdp": ("loaded", 2), "pop": ("loaded", 2), "old": ("empty", 0), "gone": ("failed", 0)}


def test_nothing_readable_is_an_error(spark):
    with pytest.raises(ValueError):
        files.load_indicators(spark, {"x": new_path(spark, "none")}, 1990, 2000)


def test_stage_keeps_schema_and_rows(spark):
    df = spark.createDataFrame([(1, 2.5, "x"), (2, None, None)], "a int, b double, c string")
    kept = stage(df)
    assert kept.dtypes == df.dtypes and sorted(map(tuple, kept.collect()), key=lambda r: r[0]) == [(1, 2.5, "x"), (2, None, None)]
    assert all(p.startswith("file:") and shared_folder(spark).split(":")[-1] in p for p in kept.inputFiles())


def test_nan_never_enters_a_panel(spark):
    folder = new_path(spark, "nan")
    path = land(spark, folder, "v", [("A", "YR2000", float("nan")), ("A", "YR2001", 1.0)])
    panel, _ = files.load_indicators(spark, {"v": path}, 2000, 2001)
    assert not any(r["v"] is not None and math.isnan(r["v"]) for r in panel.collect())


def write(folder, name, text):
    """A landed file of its own folder, as text."""
    path = os.path.join(folder, name)
    os.makedirs(path)
    with open(os.path.join(path, "part.csv"), "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_landed_files_of_every_kind(spark, tmp_path):
    """Damaged, empty, headless, reordered and missing sources each have their status; what can be read is read."""
    paths = {
        "good": write(tmp_path, "good", "country_code,year,good\nA,YR2000,1.5\nB,2001,\n"),
        "mixed": write(tmp_path, "mixed", 'note,mixed,year,country_code\n"x, ""y""",2.5,YR2000,A\n,3,YR2001,"C"\n'),
        "bad": write(tmp_path, "bad", "country_code,year,bad\nA,YR2000,oops\nB,someday,1\n,YR2000,4\nA,YR2001,7\nD,YR2001\n"),
        "nothing": write(tmp_path, "nothing", ""),
        "headless": write(tmp_path, "headless", "A,YR2000,1\nB,YR2000,2\n"),
        "other": write(tmp_path, "other", "country_code,year,value\nA,YR2000,1\n"),
        "old": write(tmp_path, "old", "country_code,year,old\nA,YR1900,1\n"),
        "gone": str(tmp_path / "gone"),
    }
    panel, status = files.load_indicators(spark, paths, 2000, 2010)
    found = {r["indicator"]: (r["status"], r["rows"], r["bad_rows"]) for r in status.collect()}
    assert found == {
        "good": ("loaded", 2, 0), "mixed": ("loaded", 2, 0), "bad": ("loaded", 2, 3), "nothing": ("empty", 0, 0),
        "headless": ("failed", 0, 2), "other": ("failed", 0, 2), "old": ("empty", 0, 0), "gone": ("failed", 0, 0),
    }
    errors = {r["indicator"]: r["error"] for r in status.collect()}
    assert errors["good"] is errors["old"] is None and errors["bad"] == "3 rows could not be read"
    assert "header" in errors["headless"] and "PATH_NOT_FOUND" in errors["gone"] and errors["nothing"] == "no line"
    rows = {(r["country_code"], r["year"]): r for r in panel.collect()}
    assert set(rows) == {("A", 2000), ("B", 2001), ("C", 2001), ("A", 2001), ("D", 2001)}
    assert rows["A", 2000]["mixed"] == 2.5 and rows["C", 2001]["mixed"] == 3.0 and rows["A", 2001]["bad"] == 7.0
    assert rows["B", 2001]["good"] is None and rows["A", 2000]["bad"] is None
    plan = panel._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 1  # the lines of all sources; the headers come from a small table


def test_one_long_file(spark, tmp_path):
    path = write(tmp_path, "long", "value,year,indicator,country_code\n1,YR2000,a,X\n2,YR2000,b,X\nhm,YR2000,a,Y\n5,YR2000,c,X\n")
    panel, status = files.load_long(spark, path, ["a", "b", "z"], 2000, 2001)
    assert [tuple(r) for r in panel.collect()] == [("X", 2000, 1.0, 2.0, None)]
    assert {r["indicator"]: (r["status"], r["rows"], r["bad_rows"]) for r in status.collect()} == {
        "a": ("loaded", 1, 1), "b": ("loaded", 1, 0), "z": ("empty", 0, 0),
    }


def test_units(spark):
    df = spark.createDataFrame([("A", 2000.0), ("B", None)], "e string, co2_emissions_kt double")
    got = units.resolved(df, ["co2_emissions_mt", "co2_emissions_kt"], "co2_emissions_mt")
    assert [tuple(r) for r in got.orderBy("e").collect()] == [("A", 2.0), ("B", None)] and units.unit_of(got, "co2_emissions_mt") == "mt"
    noted = units.with_unit(df.withColumnRenamed("co2_emissions_kt", "co2"), "co2", "Gt")
    assert units.resolved(stage(noted), ["x", "co2"], "t", "mt").where("e = 'A'").first()["t"] == 2e6  # files keep the unit
    assert units.unit_of(df.withColumnRenamed("co2_emissions_kt", "t"), "t") is None
    with pytest.raises(ValueError):
        units.resolved(df, ["nope"], "x")
    with pytest.raises(ValueError):
        units.with_unit(df, "co2_emissions_kt", "lb")
