"""Exact quantiles by selection against numpy, with small limits so that cells are divided."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from datasets import SF_MID
from vistaspark.operators import aggregates as A
from vistaspark.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.999, 1.0]
DRAW = np.random.default_rng(7)
SHAPES = {
    "even": DRAW.uniform(-5, 5, 4000), "long tail": np.exp(DRAW.normal(0, 9, 4000)), "third equal": np.r_[np.full(1500, 2.5), DRAW.normal(2.5, 1, 2500)],
    "two values": DRAW.integers(0, 2, 4000).astype(float), "one value": np.full(4000, -1.0), "outlier": np.r_[DRAW.uniform(0, 1e-9, 3999), 1e300],
}


def test_several_columns_and_divisions(spark):
    names = list(SHAPES)
    rows = [tuple(map(float, r)) for r in zip(*SHAPES.values(), strict=True)]
    df = spark.createDataFrame([*rows, (None,) * len(names)], ", ".join(f"`c{i}` double" for i in range(len(names)))).repartition(5)
    for limit in (100_000, 20):
        got = exact_quantiles(df, {f"c{i}": PROBS for i in range(len(names))}, limit=limit).first()
        for i, name in enumerate(names):
            assert got[f"c{i}"] == pytest.approx(list(np.quantile(SHAPES[name], PROBS)), rel=1e-12, abs=0), (name, limit)
            assert got[f"c{i}__n"] == 4000


def test_groups_with_nulls_and_a_hot_group(spark):
    rows = [("hot", float(x)) for x in SHAPES["long tail"]] + [(None, 1.0), (None, 3.0), ("", 2.0), ("void", None), ("two", 5.0), ("two", 7.0), ("two", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r.g: (r.x, r.x__n) for r in exact_quantiles(df, {"x": PROBS}, by=["g"], limit=30).collect()}
    assert got.keys() == {"hot", None, "", "void", "two"} and got["void"] == (None, 0) and got["two"][1] == 2
    for g, values in (("hot", SHAPES["long tail"]), (None, [1.0, 3.0]), ("", [2.0]), ("two", [5.0, 7.0])):
        assert got[g][0] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12)


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, x double")
    r = exact_quantiles(df, {"x": [0.5]}).first()
    assert r.x is None and r.x__n == 0 and exact_quantiles(df, {"x": [0.5]}, by=["g"]).collect() == []


def test_no_exchange_carries_the_column(spark):
    """What is shuffled: histograms and counts, one row a task, and the values of the last cells."""
    from vistaspark.plans.bind import Tables

    cargos = Tables(spark, SF_MID).cargos
    plan = A.iqr_summary(cargos, "subtotal", method="rank")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan
    n = cargos.count()
    q = exact_quantiles(cargos, {"subtotal": [0.25, 0.5, 0.75]}, limit=1000)
    again = cargos.select(F.percentile("subtotal", [0.25, 0.5, 0.75])).first()[0]
    assert q.first().subtotal == pytest.approx(again, rel=1e-12) and n > 50_000
