"""Linear models from one aggregate (M1 linear, M9, M15, M17, M21).

Counts, means and covariances of d columns are d (d + 3) / 2 + 1 partial aggregates of one pass; least
squares, ridge, lasso and principal components need nothing else of the data, so they are solved on
the d x d result. The size of what comes to the driver depends on the number of columns alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gram:
    """Rows, means and population covariances of some columns, over rows without a null in any of them."""

    columns: tuple[str, ...]
    n: int
    mean: np.ndarray
    cov: np.ndarray

    def part(self, rows: Sequence[str], columns: Sequence[str]) -> np.ndarray:
        at = self.columns.index
        return self.cov[np.ix_([at(r) for r in rows], [at(c) for c in columns])]

    def mean_of(self, columns: Sequence[str]) -> np.ndarray:
        return self.mean[[self.columns.index(c) for c in columns]]


def gram(df: DataFrame, columns: Sequence[str]) -> Gram:
    """One pass over the rows without nulls; an empty table gives n = 0 and NaN elsewhere. Covariances are
    merged as deviations from means, so large means cost no digits."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    r = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
    values = np.array([np.nan if x is None else x for x in r[1:]], float)
    cov = np.empty((len(columns), len(columns)))
    for (i, j), v in zip(pairs, values[len(columns):], strict=True):
        cov[i, j] = cov[j, i] = v
    return Gram(tuple(columns), r[0], values[:len(columns)], cov)


@dataclass(frozen=True)
class LinearFit:
    features: tuple[str, ...]
    intercept: float
    coefficients: np.ndarray
    r2: float

    def prediction(self) -> Column:
        out = F.lit(self.intercept)
        for f, b in zip(self.features, self.coefficients.tolist(), strict=True):
            out = out + F.lit(b) * F.col(f).cast("double")
        return out

    def rows(self) -> list[tuple[str, float]]:
        return [("intercepto", self.intercept), *zip(self.features, self.coefficients.tolist(), strict=True)]


def _fit(g: Gram, features: Sequence[str], label: str, beta: np.ndarray) -> LinearFit:
    c, vxx, vyy = g.part(features, [label])[:, 0], g.part(features, features), g.part([label], [label])[0, 0]
    error = vyy - 2 * beta @ c + beta @ vxx @ beta
    return LinearFit(tuple(features), float(g.mean_of([label])[0] - beta @ g.mean_of(features)), beta, float(1 - error / vyy) if vyy > 0 else float("nan"))


def ridge(g: Gram, features: Sequence[str], label: str, penalty: float = 0.0) -> LinearFit:
    """Least squares with ``penalty`` / 2 times the squared coefficients added to half the mean squared error;
    0 is ordinary least squares (columns that depend on others get the least-norm solution)."""
    vxx = g.part(features, features) + penalty * np.eye(len(features))
    return _fit(g, features, label, np.linalg.lstsq(vxx, g.part(features, [label])[:, 0], rcond=None)[0])


def standardised_ridge(g: Gram, features: Sequence[str], label: str, penalty: float) -> LinearFit:
    """As ``ridge`` on columns and label divided by their deviations, the penalty too (MLlib's linear
    regression with ``regParam``). A constant column has coefficient 0."""
    sx = np.sqrt(np.diag(g.part(features, features)))
    sy = float(np.sqrt(g.part([label], [label])[0, 0]))
    use = sx > 0
    beta = np.zeros(len(features))
    if sy > 0 and use.any():
        s = sx[use]
        r = g.part(features, features)[np.ix_(use, use)] / np.outer(s, s) + penalty / sy * np.eye(len(s))
        beta[use] = np.linalg.solve(r, g.part(features, [label])[use, 0] / s / sy) * sy / s
    return _fit(g, features, label, beta)


def lasso(g: Gram, features: Sequence[str], label: str, penalty: float, tolerance: float = 1e-12, rounds: int = 100_000) -> LinearFit:
    """Least squares with ``penalty`` times the absolute coefficients added to half the mean squared error, by
    coordinate descent on the covariances."""
    vxx, c = g.part(features, features), g.part(features, [label])[:, 0]
    beta = np.zeros(len(features))
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(features)):
            if vxx[j, j] <= 0:
                continue
            free = c[j] - vxx[j] @ beta + vxx[j, j] * beta[j]
            new = np.sign(free) * max(abs(free) - penalty, 0.0) / vxx[j, j]
            moved = max(moved, abs(new - beta[j]) * np.sqrt(vxx[j, j]))
            beta[j] = new
        if moved <= tolerance * np.sqrt(max(float(np.abs(c).max()), 1e-300)):
            break
    return _fit(g, features, label, beta)


def deviations(g: Gram) -> np.ndarray:
    """Sample standard deviations, as the scaler takes them."""
    return np.sqrt(np.diag(g.cov) * g.n / max(g.n - 1, 1))


def standardised(df: DataFrame, columns: Sequence[str], with_mean: bool = True) -> DataFrame:
    """Rows without nulls in the columns, these divided by their sample deviation (and centred); a
    constant column becomes 0. The pass over the table runs when this is called."""
    g = gram(df, columns)
    scaled = {}
    for c, m, s in zip(columns, g.mean.tolist(), deviations(g).tolist(), strict=True):
        scaled[c] = (F.col(c).cast("double") - (m if with_mean else 0.0)) / s if s > 0 else F.lit(0.0)
    return df.na.drop(subset=list(columns)).withColumns(scaled)


def principal_shares(g: Gram) -> np.ndarray:
    """Shares of the standardised columns' variance by component, largest first (eigenvalues of the
    correlation matrix; a constant column has none)."""
    s = np.sqrt(np.diag(g.cov))
    safe = np.where(s > 0, s, 1.0)
    values = np.linalg.eigvalsh(g.cov / np.outer(safe, safe))[::-1]
    return values / values.sum()
