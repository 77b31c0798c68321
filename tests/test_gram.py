"""Models solved from one Gram aggregate against MLlib, numpy and optimality conditions."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from vistaspark.ml import gram as G
from vistaspark.ml import models as MD

DRAW = np.random.default_rng(11)
N = 400
X = np.c_[DRAW.normal(1e6, 3, N), DRAW.exponential(2, N), DRAW.integers(0, 4, N), np.full(N, 7.0)]  # large mean; last column constant
Y = 2.5 * X[:, 0] - 40 * X[:, 1] + 0.02 * X[:, 2] + DRAW.normal(0, 5, N)
COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(*map(float, x), float(y), i) for i, (x, y) in enumerate(zip(X, Y, strict=True))]
    return spark.createDataFrame([*data, (None, 1.0, 1.0, 7.0, 1.0, N), (1.0, 1.0, 1.0, 7.0, None, N + 1)],
                                 "a double, b double, c double, d double, y double, id long").repartition(5)


@pytest.fixture(scope="module")
def g(rows):
    return G.gram(rows, [*COLUMNS, "y"])


def test_moments(g):
    assert g.n == N and g.mean == pytest.approx(np.c_[X, Y].mean(0), rel=1e-12)
    assert g.cov == pytest.approx(np.cov(np.c_[X, Y].T, bias=True), rel=1e-9, abs=1e-9)


def test_ordinary_least_squares(g):
    fit = G.ridge(g, COLUMNS[:3], "y")
    a = np.c_[np.ones(N), X[:, :3] - X[:, :3].mean(0)]
    want = np.linalg.lstsq(a, Y, rcond=None)[0]
    assert fit.coefficients == pytest.approx(want[1:], rel=1e-7)
    error = Y - a @ want
    assert fit.r2 == pytest.approx(1 - error @ error / ((Y - Y.mean()) @ (Y - Y.mean())), rel=1e-9)


def test_standardised_ridge_is_mllibs(rows):
    """On columns that MLlib's uncentred sums keep digits of."""
    rows = rows.na.drop().withColumns({"a": F.col("a") - 1e6, "y": F.col("y") - 2.5e6})
    g = G.gram(rows, [*COLUMNS, "y"])
    data = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(rows)
    for penalty in (0.1, 30.0):
        model = LinearRegression(regParam=penalty, labelCol="y", solver="normal").fit(data)
        fit = G.standardised_ridge(g, COLUMNS, "y", penalty)
        assert fit.coefficients == pytest.approx(model.coefficients.toArray(), rel=1e-6, abs=1e-9)
        assert fit.intercept == pytest.approx(model.intercept, rel=1e-6)
    predicted = rows.select(F.avg(fit.prediction() - F.col("y"))).first()[0]
    assert predicted == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("penalty", [0.0, 0.1, 5.0, 1e9])
def test_lasso_is_optimal(g, penalty):
    """Where a coefficient isn't 0 the gradient is the penalty, elsewhere it is less."""
    fit = G.lasso(g, COLUMNS[:3], "y", penalty)
    x = X[:, :3] - X[:, :3].mean(0)
    gradient = x.T @ (Y - Y.mean() - x @ fit.coefficients) / N
    for b, v in zip(fit.coefficients, gradient, strict=True):
        assert v == pytest.approx(np.sign(b) * penalty, abs=1e-5) if b else abs(v) <= penalty + 1e-5
    assert penalty < 1e9 or not fit.coefficients.any()


def test_fixed_lasso_and_shares():
    """Small fixed tables: orthogonal columns are shrunk one by one; shares of a known correlation matrix."""
    g = G.Gram(("x", "z", "y"), 10, np.array([0.0, 0.0, 1.0]), np.array([[2.0, 0, 3.0], [0, 1.0, -0.05], [3.0, -0.05, 9.0]]))
    assert G.lasso(g, ["x", "z"], "y", 0.1).coefficients.tolist() == [1.45, 0.0]
    assert G.ridge(g, ["x", "z"], "y", 1.0).coefficients.tolist() == pytest.approx([1.0, -0.025])
    h = G.Gram(("a", "b", "c"), 10, np.zeros(3), np.array([[4.0, 1.0, 0], [1.0, 1.0, 0], [0, 0, 0.0]]))
    assert G.principal_shares(h).tolist() == pytest.approx([0.75, 0.25, 0.0])


def test_standardised_columns(rows):
    out = G.standardised(rows, COLUMNS)
    r = out.select(*[F.avg(c) for c in COLUMNS], *[F.stddev(c) for c in COLUMNS]).first()
    assert out.count() == N + 1 and list(r) == pytest.approx([0] * 4 + [1, 1, 1, 0], abs=1e-6)


def test_linear_model_is_the_fitted_regressors_one(rows):
    rows = rows.na.drop()
    metrics, fit = MD.fit_linear(rows, ["b", "c"], "y", "id")
    data = VectorAssembler(inputCols=["b", "c"], outputCol="features").transform(MD.split(rows, "id", 0.8, 42)[0])
    model = LinearRegression(regParam=0.1, labelCol="y", solver="normal").fit(data)
    assert fit.coefficients == pytest.approx(model.coefficients.toArray(), rel=1e-6) and metrics.first().n > 20


def test_empty_table(rows):
    g = G.gram(rows.limit(0), ["a", "y"])
    assert g.n == 0 and np.isnan(g.mean).all()
