"""M1's boosted trees, fitted on one row for each combination of bins, predict as MLlib's on all rows."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from vistaspark.ml import models as MD


def table(spark, n):
    rows = spark.range(n, numPartitions=3).select("id", (F.col("id") * 37 % 101 / 7.0).alias("x"), (F.col("id") * 53 % 11).alias("z"))
    return rows.withColumn("label", F.col("x") * F.col("z") + F.sin(F.col("id").cast("double")))


@pytest.mark.parametrize("n", [12, 900, 25_000])  # fewer rows than bins; all rows give thresholds; a drawn part does
def test_predictions_equal_those_of_trees_on_rows(spark, n):
    train = MD.written(table(spark, n))
    rows = Pipeline(stages=MD._features(["x", "z"]) + [GBTRegressor(maxIter=4, maxDepth=3, seed=42, labelCol="label")]).fit(train)
    cells = MD.fit_boosted(train, ["x", "z"], 4, 3, 42)
    both = cells.transform(train).select("id", F.col("prediction").alias("a")).join(rows.transform(train).select("id", F.col("prediction").alias("b")), "id")
    assert both.where(F.abs(F.col("a") - F.col("b")) > 1e-7).count() == 0 and both.count() == n


def test_the_rounds_read_bounded_rows(spark, monkeypatch):
    read = []
    fit = GBTRegressor._fit
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, data: (read.append(data.count()), fit(self, data))[1])
    _, models = MD.fit_regressors(table(spark, 25_000), ["x", "z"], "label", "id", trees=2, depth=2, iters=2)
    assert len(read) == 1 and read[0] <= MD.TREE_BINS * 11
    out = models["gbt"].transform(table(spark, 50).union(spark.createDataFrame([(99, None, 1, 0.0)], "id long, x double, z long, label double")))
    assert out.count() == 50


def test_cut_points():
    assert MD.cut_points([3.0, 1.0, 1.0, 2.0], 4, 32) == [1.5, 2.5]
    assert MD.cut_points([0.0, 1.0, 0.0], 3, 32) == [0.5]
    assert MD.cut_points([2.0] * 9, 9, 32) == []
    assert MD.cut_points([float(i) for i in range(1, 101)], 100, 4) == [25.5, 50.5, 75.5]
