"""Linear models from mergeable cross products.

What a linear fit needs of its rows is the matrix of sums of all products of (1, features, label). Such matrices add
and subtract: the executors merge them in a tree, folds of a cross-validation are subtracted from the whole, and fits,
hold-out errors and fold errors are arithmetic on them, a few hundred numbers whatever the table. Features enter
centred and scaled by one common pair of numbers each, so that sums of large values don't cancel; that changes
no fit, since each fit scales again by its own rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a feature's own square that must be left once the features before it are known; below it the feature
#: is a linear combination of them and gets the coefficient 0.
ALIASED = 1e-9


@dataclass(frozen=True)
class Fit:
    """Coefficients of the features scaled by the fitted rows (mean 0, sample deviation 1), the label's mean, and
    the same line on the common scale of the cross products."""
    coefficients: np.ndarray
    intercept: float
    line: np.ndarray


@dataclass(frozen=True)
class CrossProducts:
    """Sums of products of (1, features, label), all on a common scale."""
    sums: np.ndarray

    def __add__(self, other: CrossProducts) -> CrossProducts:
        return CrossProducts(self.sums + other.sums)

    def __sub__(self, other: CrossProducts) -> CrossProducts:
        return CrossProducts(self.sums - other.sums)

    @property
    def n(self) -> int:
        return round(self.sums[0, 0])

    def centred(self) -> np.ndarray:
        """Sums of products of the features and the label about their own means."""
        s = self.sums
        return s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:]) / s[0, 0]

    def fit(self, alpha: float = 0.0) -> Fit:
        """Least squares with the penalty ``alpha`` on the coefficients of the scaled features."""
        c, means = self.centred(), self.sums[0, 1:] / self.sums[0, 0]
        sd = np.sqrt(np.maximum(np.diag(c)[:-1], 0) / max(self.n - 1, 1))
        scale = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
        w = solve(c[:-1, :-1] * np.outer(scale, scale) + alpha * np.eye(len(sd)), c[:-1, -1] * scale)
        own = w * scale
        return Fit(w, float(means[-1]), np.concatenate([[means[-1] - own @ means[:-1]], own]))

    def rmse(self, fit: Fit) -> float:
        return math.sqrt(self.squared_error(fit) / self.n) if self.n else math.nan

    def r2(self, fit: Fit) -> float:
        total = self.centred()[-1, -1]
        return 1 - self.squared_error(fit) / total if total > 0 else math.nan

    def squared_error(self, fit: Fit) -> float:
        v = np.append(-fit.line, 1.0)
        return max(float(v @ self.sums @ v), 0.0)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of a·x = b for a positive semi-definite ``a`` by elimination in order; aliased unknowns are 0."""
    m = np.column_stack([a, b]).astype(float)
    for k in range(len(m)):
        if m[k, k] <= ALIASED * a[k, k]:
            m[k, :] = m[:, k] = 0.0
            continue
        m[k] /= m[k, k]
        for i in range(len(m)):
            if i != k:
                m[i] -= m[i, k] * m[k]
    return m[:, -1]


def common_scale(data: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of each feature and of the label, in one aggregate."""
    cols = [*features, "label"]
    r = data.agg(*[f(c) for c in cols for f in (F.avg, F.stddev_samp)]).first()
    return {c: (float(r[2 * i] or 0.0), float(r[2 * i + 1] or 0.0) or 1.0) for i, c in enumerate(cols)}


def cross_products(data: DataFrame, features: list[str], scale: dict[str, tuple[float, float]]) -> CrossProducts:
    """Cross products of rows with the features and ``label``, merged in a tree over the partitions; the label is
    centred only, so errors are in its own unit."""
    z = [((F.col(c) - m) / (1.0 if c == "label" else s)).alias(f"z{i}")
         for i, (c, (m, s)) in enumerate((c, scale[c]) for c in [*features, "label"])]
    rows = data.select(F.lit(1.0).alias("one"), *z)
    vectors = VectorAssembler(inputCols=rows.columns, outputCol="v").transform(rows).select("v")
    if vectors.isEmpty():
        return CrossProducts(np.zeros((len(z) + 1, len(z) + 1)))
    return CrossProducts(RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray())


def by_fold(data: DataFrame, features: list[str], scale: dict[str, tuple[float, float]], n_folds: int) -> list[CrossProducts]:
    return [cross_products(data.filter(F.col("fold") == f), features, scale) for f in range(n_folds)]


def cross_validation(folds: list[CrossProducts], alpha: float = 0.0) -> list[tuple[int, int, float]]:
    """(fold, rows, RMSE) of the fit on all other folds: the whole less the fold."""
    whole = CrossProducts(sum(f.sums for f in folds))
    return [(i, f.n, f.rmse((whole - f).fit(alpha))) for i, f in enumerate(folds)]


def oracle_sql(task: str, model: str, rows: str, label: str, features: list[str], alpha: float,
               folds: bool) -> tuple[str, str]:
    """The same fits in DuckDB SQL over ``rows`` (features, label, ``bucket``): coefficients and errors of the 80 %
    split, or the errors of each fold, as (common table expressions, query); elimination is a recursive query over
    the matrix."""
    d = len(features)
    groups = "(VALUES (0), (1), (2), (3), (4)) g(f)" if folds else "(VALUES (0)) g(f)"
    used = "bucket % 5 <> f" if folds else "bucket >= 20"
    cols = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS x{i}" for i, c in enumerate(features))
    stats = ", ".join(f"avg(x{i}) AS m{i}, stddev_samp(x{i}) AS s{i}" for i in range(d))
    z = ", ".join(f"CASE WHEN s{i} > 0 THEN (x{i} - m{i}) / s{i} ELSE 0 END AS z{i}" for i in range(d))
    cells = ", ".join("[" + ", ".join(
        [f"sum(z{i} * z{j})" + (f" + {alpha}" if i == j else "") for j in range(d)] + [f"sum(z{i} * v)"]) + "]"
        for i in range(d))
    name = f"{task}_{model}".lower()
    fit = f"""
{name}_x AS (SELECT f, {used} AS used, CAST({label} AS DOUBLE) AS y, {cols} FROM {rows}, {groups}),
{name}_s AS (SELECT f, avg(y) AS my, {stats} FROM {name}_x WHERE used GROUP BY f),
{name}_z AS (SELECT f, used, y, y - my AS v, my, {z} FROM {name}_x JOIN {name}_s USING (f)),
{name}_g AS (SELECT f, [{cells}] AS m FROM {name}_z WHERE used GROUP BY f),
{name}_e(f, k, m, d) AS (
    SELECT f, 1, m, list_transform(range(1, {d + 1}), lambda i: m[i][i]) FROM {name}_g
    UNION ALL
    SELECT f, k + 1, list_transform(m, lambda r, i: list_transform(r, lambda c, j: CASE
               WHEN m[k][k] <= {ALIASED} * d[k] THEN CASE WHEN i = k OR j = k THEN 0 ELSE c END
               WHEN i = k THEN c / m[k][k] ELSE c - r[k] * m[k][j] / m[k][k] END)), d
    FROM {name}_e WHERE k <= {d}),
{name}_w AS (SELECT f, list_transform(m, lambda r: r[{d + 1}]) AS w FROM {name}_e WHERE k = {d + 1}),
{name}_p AS (SELECT f, used, y, my, my + list_dot_product([{', '.join(f'z{i}' for i in range(d))}], w) AS p
             FROM {name}_z JOIN {name}_w USING (f))"""
    if folds:
        out = f"""SELECT '{task}' AS task, '{model}' AS model, CAST(f AS INTEGER) AS fold, count(*) AS n,
       round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM {name}_p WHERE NOT used GROUP BY f"""
    else:
        names = ", ".join(f"'{c}'" for c in features)
        side = {s: f"(SELECT round(sqrt(avg((y - p) * (y - p))), 6) FROM {name}_p WHERE {w}) AS {s}_rmse, "
                   f"(SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) FROM {name}_p WHERE {w}) "
                   f"AS {s}_r2" for s, w in (("train", "used"), ("test", "NOT used"))}
        out = f"""SELECT '{task}' AS task, '{model}' AS model, feature, round(c, 6) AS coefficient, {side['train']}, {side['test']}
FROM (SELECT unnest(['intercept', {names}]) AS feature, unnest(list_prepend(my, w)) AS c
      FROM {name}_w JOIN {name}_s USING (f))"""
    return fit, out
