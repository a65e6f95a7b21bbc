"""What cross validation stores and keeps."""

from quillpanel.models import trees
from quillpanel.plans import queries


def test_queries_that_read_no_test_rows_store_none(spark, sf_dir, monkeypatch):
    stored, stage = [], queries.stage
    monkeypatch.setattr(queries, "stage", lambda df, name="stage": stored.append(name) or stage(df, name))
    train, test = queries._class_rows(spark, sf_dir)
    assert stored == ["customer", "class-rows", "split", "filled", "train"]
    assert train.columns == test.columns and train.count() > test.count() > 0
    assert train.select("entity").intersect(test.select("entity")).count() == 0


def test_validator_keeps_the_columns_it_reads(spark, monkeypatch):
    rows = spark.range(120).selectExpr("id", "id % 7 / 7.0 x", "cast(id % 5 < 2 as int) y", "1.0 w", "cast(id % 3 as int) fold", "repeat('z', 99) other")
    kept, persist = [], type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda df, *level: kept.append(set(df.columns)) or persist(df, *level))
    pipeline = trees.classifier("Logistic Regression", ["x"], "y", "w", 120, maxIter=5)
    trees.cross_validated_f1(pipeline, rows, "y", "fold", 3)
    assert kept and all(c <= {"x", "y", "w", "fold"} for c in kept)
