"""Products of column sets, publishing by period, and the audited cleaning."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillpanel.operators.correlation import correlation_products
from quillpanel.operators.stats import correlation_matrix
from quillpanel.plans.panels import clean_panel, clean_with_audit
from quillpanel.sources.files import publish_periods


def test_products_are_pairwise_complete(spark):
    r = random.Random(1)
    cell = lambda k: None if r.random() < 0.3 else float("nan") if r.random() < 0.05 else 7.5 if k == 3 else r.gauss(1e6 * k, 1 + k)
    columns = [f"my col{k}" for k in range(6)] + ["only", "nothing"]
    rows = [tuple([cell(k) for k in range(6)] + [4.0 if i == 5 else None, None]) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in columns)).repartition(5)
    clean = df.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in columns])
    expected = {(x.x, x.y): x.corr for x in correlation_matrix(clean, columns, lower_only=False).collect()}
    got = correlation_products(df, columns, lower_only=False).collect()
    assert len(got) == len(expected) == 64
    for x in got:
        want = expected[x.x, x.y]
        assert x.corr is None if want is None else x.corr == pytest.approx(want, abs=1e-9), (x, want)
        assert x.n == clean.where(F.col(x.x).isNotNull() & F.col(x.y).isNotNull()).count() if x.x < "my col2" else True
    empty = correlation_products(df.limit(0), columns).collect()
    assert all(x.corr is None for x in empty)


def files_of(path, period):
    folder = f"{path}/period={period}"
    return sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))


def test_publishing_leaves_other_periods(spark, tmp_path):
    path = str(tmp_path / "panel")
    df = spark.range(300).select((F.col("id") % 60).alias("entity"), (2000 + F.col("id") % 5).cast("int").alias("period"), F.col("id").alias("v"))
    publish_periods(df, path, "period", "entity")
    before = {p: files_of(path, p) for p in range(2000, 2005)}
    publish_periods(df.where("period = 2003 and v > 100").withColumn("v", -F.col("v")), path, "period", "entity")
    after = {p: files_of(path, p) for p in range(2000, 2005)}
    assert {p for p in before if before[p] != after[p]} == {2003}
    got = sorted((r.entity, r.period, r.v) for r in spark.read.parquet(path).collect())
    want = [(r.entity, r.period, -r.v if r.period == 2003 else r.v) for r in df.collect() if r.period != 2003 or r.v > 100]
    assert got == sorted(want)


def test_audit_counts_what_the_cleaning_drops(spark):
    rows = [(e, y, None if e == 2 or (e, y) == (3, 2001) else 1.0 * e, None if e == 4 else 2.0, None if e == 4 else 3.0) for e in (1, 2, 3, 4, 9) for y in (2000, 2001)]
    rows.append((None, 2000, 5.0, 6.0, 7.0))
    df = spark.createDataFrame(rows, "entity int, period int, target double, base double, population double")
    kept, audit = clean_with_audit(df, "entity", "period", "target", [9], gdp="base", population="population")
    plain = clean_panel(df, "entity", "period", "target", [9], gdp="base", population="population")
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))
    counts = [(r.step, r.rows_in, r.rows_out) for r in sorted(audit.collect())]
    assert counts[0] == ("members", 11, 9) and counts[1] == ("has_target", 9, 6) and counts[2][:2] == ("not_sparse", 6)
    assert counts[2][2] == kept.count()
