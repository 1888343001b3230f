"""One-feature least squares from moments: the value-checked candidate models.

A least-squares line y = a + b·x needs the counts, means and co-moments of (x, y). One wide aggregate takes them for
all features at once, per (hold-out side, fold): ten rows of stable, mergeable moments, whatever the data size. The
moments of "all folds but f" are combined from those rows algebraically, so cross-validation reads no row twice. A
second wide aggregate sums the errors, with the fitted coefficients as literals. Both passes read the same narrow
rows, which are kept for the two passes only; no row is multiplied by features or folds.

``candidate_metrics`` scores one such line per feature on the hold-out split and with k-fold CV; this is the model
set that the selection operators rank in the value-checked queries (the MLlib learners live in
``tripstar.ml.train``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstar.ml.evaluate import N_FOLDS, with_fold, with_split


@dataclass
class Moments:
    """Count, means and central (co-)moments of (x, y); they add up without cancellation."""

    n: float = 0.0
    mx: float = 0.0
    my: float = 0.0
    xx: float = 0.0
    xy: float = 0.0
    yy: float = 0.0

    def __add__(self, o: "Moments") -> "Moments":
        n = self.n + o.n
        if not self.n or not o.n:
            return self if self.n else o
        dx, dy, w = o.mx - self.mx, o.my - self.my, self.n * o.n / n
        return Moments(n, self.mx + dx * o.n / n, self.my + dy * o.n / n, self.xx + o.xx + dx * dx * w,
                       self.xy + o.xy + dx * dy * w, self.yy + o.yy + dy * dy * w)

    def line(self) -> tuple[float, float]:
        """Intercept and slope; a constant feature gets slope 0 (predicts the mean)."""
        slope = self.xy / self.xx if self.xx > 0 else 0.0
        return self.my - slope * self.mx, slope


def _total(moments) -> Moments:
    out = Moments()
    for m in moments:
        out = out + m
    return out


def _moments(rows: DataFrame, features: list[str]) -> dict[tuple[bool, int], dict[str, Moments]]:
    """Per (is_test, fold) and feature, over the rows where the feature is known."""
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f)
        y = F.when(x.isNotNull(), F.col("y"))
        aggs += [F.count(y).alias(f"n{i}"), F.avg(F.when(y.isNotNull(), x)).alias(f"mx{i}"), F.avg(y).alias(f"my{i}"),
                 F.var_pop(F.when(y.isNotNull(), x)).alias(f"xx{i}"), F.covar_pop(x, y).alias(f"xy{i}"),
                 F.var_pop(y).alias(f"yy{i}")]
    out = {}
    for r in rows.groupBy("is_test", "fold").agg(*aggs).collect():     # at most 2 × folds rows
        out[r["is_test"], r["fold"]] = {
            f: Moments(r[f"n{i}"], r[f"mx{i}"], r[f"my{i}"], r[f"xx{i}"] * r[f"n{i}"], r[f"xy{i}"] * r[f"n{i}"],
                       r[f"yy{i}"] * r[f"n{i}"]) if r[f"n{i}"] else Moments()
            for i, f in enumerate(features)}
    return out


def _errors(rows: DataFrame, features: list[str], hold: dict, folds: dict) -> dict:
    """Per (is_test, fold) and feature: sums of squared, absolute and relative errors of the hold-out line, and of
    squared errors of the line fitted on the other folds."""
    aggs = []
    for i, f in enumerate(features):
        x, y = F.col(f), F.col("y")
        a, b = hold[f]
        e = y - (F.lit(a) + F.lit(b) * x)
        own = F.array(*[F.lit(folds[f][k][0]) for k in sorted(folds[f])])
        slope = F.array(*[F.lit(folds[f][k][1]) for k in sorted(folds[f])])
        cv = y - (F.element_at(own, F.col("fold") + 1) + F.element_at(slope, F.col("fold") + 1) * x)
        aggs += [F.sum(e * e).alias(f"se{i}"), F.sum(F.abs(e)).alias(f"ae{i}"),
                 F.sum(F.when(y != 0, F.abs(e / y))).alias(f"re{i}"),
                 F.count(F.when(y != 0, e)).alias(f"rn{i}"), F.sum(cv * cv).alias(f"cv{i}")]
    return {(r["is_test"], r["fold"]): r for r in rows.groupBy("is_test", "fold").agg(*aggs).collect()}


@dataclass
class Candidates:
    """The two passes' results, a few numbers per feature, side and fold."""

    features: list[str]
    moments: dict
    errors: dict
    n_folds: int

    def side(self, f: str, test: bool) -> dict[str, float | None]:
        i = self.features.index(f)
        keys = [k for k in self.moments if k[0] == test]
        m = _total(self.moments[k][f] for k in keys)
        add = lambda c: sum(self.errors[k][f"{c}{i}"] or 0.0 for k in keys)
        if not m.n:
            return dict.fromkeys(("rmse", "mae", "r2", "mape"))
        return {"rmse": math.sqrt(add("se") / m.n), "mae": add("ae") / m.n,
                "r2": 1 - add("se") / m.yy if m.yy > 0 else None,
                "mape": add("re") / add("rn") * 100 if add("rn") else None}

    def fold(self, f: str, k: int) -> tuple[int, float] | None:
        """Held-out rows of fold k and the RMSE on them of the line fitted on the other folds."""
        i = self.features.index(f)
        keys = [key for key in self.moments if key[1] == k]
        n = sum(self.moments[key][f].n for key in keys)
        return (int(n), math.sqrt(sum(self.errors[key][f"cv{i}"] or 0.0 for key in keys) / n)) if n else None


def fit_candidates(df: DataFrame, features: list[str], label: str, key, n_folds: int = N_FOLDS) -> Candidates:
    # kept in their own types: whole numbers are stored in a few bits, doubles of them are not
    kept = (with_fold(with_split(df, key), key, n_folds)
            .select(*dict.fromkeys(features), F.col(label).alias("y"), "is_test", "fold")
            .persist(StorageLevel.MEMORY_AND_DISK))
    rows = kept.select(*[F.col(c).cast("double").alias(c) for c in (*dict.fromkeys(features), "y")], "is_test", "fold")
    try:
        moments = _moments(rows, features)
        hold, folds = {}, {}
        for f in features:
            hold[f] = _total(m[f] for k, m in moments.items() if not k[0]).line()
            folds[f] = {j: _total(m[f] for k, m in moments.items() if k[1] != j).line() for j in range(n_folds)}
        return Candidates(features, moments, _errors(rows, features, hold, folds), n_folds)
    finally:
        kept.unpersist()


def candidate_metrics(df: DataFrame, features: list[str], label: str, key, task: str,
                      n_folds: int = N_FOLDS) -> DataFrame:
    """Hold-out and CV metrics of one least-squares line per feature.

    Columns: task, model, model_order, train/test rmse, mae, r2, mape,
    cv_rmse_mean, cv_rmse_std (population std over folds).
    """
    c = fit_candidates(df, features, label, key, n_folds)
    rows = []
    for i, f in enumerate(features):
        train, test = c.side(f, False), c.side(f, True)
        cv = [x[1] for x in (c.fold(f, k) for k in range(n_folds)) if x]
        mean = sum(cv) / len(cv) if cv else None
        std = math.sqrt(sum((x - mean) ** 2 for x in cv) / len(cv)) if cv else None
        rows.append((task, f"OLS:{f}", i + 1,
                     *[v for m in ("rmse", "mae", "r2", "mape") for v in (train[m], test[m])], mean, std))
    return df.sparkSession.createDataFrame(
        rows, "task string, model string, model_order int, train_rmse double, test_rmse double, train_mae double, "
              "test_mae double, train_r2 double, test_r2 double, train_mape double, test_mape double, "
              "cv_rmse_mean double, cv_rmse_std double")


def cv_folds(df: DataFrame, features: list[str], label: str, key, task: str, n_folds: int = N_FOLDS) -> DataFrame:
    """Per (candidate, fold): held-out rows and RMSE of the line fit on the other folds."""
    c = fit_candidates(df, features, label, key, n_folds)
    rows = [(task, f"OLS:{f}", i + 1, k, *got) for i, f in enumerate(features) for k in range(n_folds)
            if (got := c.fold(f, k))]
    return df.sparkSession.createDataFrame(
        rows, "task string, model string, model_order int, fold int, n long, rmse double")
