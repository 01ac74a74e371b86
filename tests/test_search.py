"""Automatic search: drawn settings compete with the plain algorithms, and time ends it."""

from pyspark.sql import functions as F

from brindle.ml import training


def test_search_is_never_behind_the_plain_algorithms(spark):
    df = spark.range(600).select((F.col("id") % 37).cast("double").alias("a"), (F.col("id") * 7 % 11).cast("double").alias("b")).withColumn("Label", F.when(F.col("a") > 20, F.col("b") * 3).otherwise(-F.col("a")))
    rows, best = training.auto_ml(df, "Label", "Regression", 600, trials=4, parallel=2)
    plain = len(training.CANDIDATES["Regression"])
    assert [r["rank"] for r in rows] == list(range(1, plain + 2)) and all(r["parameters"] for r in rows)
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True) and best.spec.parameters == rows[0]["parameters"]
    ran = {str((r["algorithm"], r["parameters"])) for r in rows}
    assert len(ran) == plain + 1
    none, _ = training.auto_ml(df, "Label", "Regression", 600, trials=0)
    assert {r["algorithm"] for r in none} == set(training.CANDIDATES["Regression"]) and rows[0]["score"] >= none[0]["score"] - 1e-9


def test_importance_of_a_classifier_measures_its_headline_alone(spark, monkeypatch):
    rows = spark.range(400).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") > 200).cast("int").alias("Label"))
    t = training.train(training.spec("algo.bin.logistic", maximumNumberOfIterations=5), rows, "Label")

    def refuse(*_):
        raise AssertionError("a pass for figures that nobody reads")

    monkeypatch.setattr(training.E, "binary_metrics", refuse)
    found = training.feature_importance(t, rows, 1)
    assert found[0]["feature"] == "a" and found[0]["importance"] > 0.2
