"""MLlib model set, training loop, cross-validation and model persistence.

Every fit is an MLlib ``Pipeline`` (VectorAssembler → StandardScaler →
regressor) that runs on the executors; the driver only loops over the model
set and the folds and collects per-model metric rows (a handful of numbers).
The trees of the ensembles are grown by ``trees``, from the regressors' settings, and become MLlib models.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
import math
import re
import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstar.ml.evaluate import (N_FOLDS, SEED, regression_metrics, select_best, with_fold, with_scores,
                                  with_split)
from tripstar.ml import trees
from tripstar.session import checkpoint_dir, written

log = logging.getLogger(__name__)

# The model set, in the order that breaks selection ties, and
# the hyper-parameters of each set-up.
MODEL_ORDER = ["LinearRegression", "Ridge", "RandomForest", "GradientBoosting", "GradientBoostingSubsampled"]
RIDGE_ALPHA = 1.0
FOREST = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 5}
BOOSTING = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1}
SUBSAMPLE = 0.8
# Bytes of prepared rows in a partition.
PARTITION_BYTES = 128 << 20


def make_regressor(name: str, label_std: float | None = None, n_train: int | None = None,
                   tree_memory_mb: int = 256):
    if name == "LinearRegression":
        return LinearRegression(regParam=0.0, solver="normal")
    if name == "Ridge":
        # penalty α‖w‖² on the scaled features: Spark's objective divides the
        # squared error by 2n and measures the penalty against a σ_y-scaled label.
        if not label_std or not n_train:
            raise ValueError("Ridge needs the training label std and row count")
        return LinearRegression(regParam=RIDGE_ALPHA * label_std / n_train, elasticNetParam=0.0,
                                standardization=False, solver="normal")
    if name == "RandomForest":
        return RandomForestRegressor(featureSubsetStrategy="all", seed=SEED, maxMemoryInMB=tree_memory_mb,
                                     cacheNodeIds=True, checkpointInterval=10, **FOREST)
    if name == "GradientBoosting":
        return GBTRegressor(seed=SEED, checkpointInterval=10, maxMemoryInMB=tree_memory_mb, **BOOSTING)
    if name == "GradientBoostingSubsampled":
        return GBTRegressor(seed=SEED, checkpointInterval=10, subsamplingRate=SUBSAMPLE,
                            featureSubsetStrategy=str(SUBSAMPLE), maxMemoryInMB=tree_memory_mb, **BOOSTING)
    raise ValueError(f"unknown model {name!r}")


def _memory_mb(value: str) -> int:
    v = value.strip().lower()
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    if v and v[-1] == "b":
        v = v[:-1]
    if v and v[-1] in units:
        return int(float(v[:-1]) * units[v[-1]])
    return int(float(v))  # Spark reads a unit-less memory size as MiB


def tree_memory_mb(spark) -> int:
    """Per-task node-statistics budget for tree learners, 16–2048 MB.

    A quarter of an executor's heap shared by its concurrent tasks, so that all of them together fit. A larger
    budget lets a forest split more nodes per pass over the data (fewer passes
    for deep trees); it is an engine knob, the fitted model is the same.
    """
    sc = spark.sparkContext
    conf = sc.getConf()
    # local-cluster[executors,cores,MB]: the work is in executors of its own, not in the driver's heap
    several = re.fullmatch(r"local-cluster\[\s*\d+\s*,\s*(\d+)\s*,\s*\d+\s*\]", sc.master)
    if several:
        mb, cores = _memory_mb(conf.get("spark.executor.memory", "1g")), int(several[1])
    elif sc.master.startswith("local"):
        mb, cores = spark._jvm.java.lang.Runtime.getRuntime().maxMemory() >> 20, sc.defaultParallelism
    else:
        mb, cores = _memory_mb(conf.get("spark.executor.memory", "1g")), int(conf.get("spark.executor.cores", "4"))
    return max(16, min(2048, mb // (4 * max(1, cores))))


def make_pipeline(features: list[str], regressor, label: str = "label") -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        regressor.setFeaturesCol("features").setLabelCol(label).setPredictionCol("prediction"),
    ])


def fit_pipeline(features: list[str], regressor, train: DataFrame) -> PipelineModel:
    """The pipeline fitted on the rows of ``train``."""
    pipeline = make_pipeline(features, regressor)
    if not isinstance(regressor, (RandomForestRegressor, GBTRegressor)):
        return pipeline.fit(train)
    scaling = Pipeline(stages=pipeline.getStages()[:-1]).fit(train)
    return PipelineModel(stages=[*scaling.stages, trees.fit(regressor, scaling.transform(train))])


def prepare(df: DataFrame, features: list[str], label: str, key, n_folds: int = N_FOLDS, spread: bool = True) -> DataFrame:
    """Model rows: features as doubles (null → 0), label, hash split and fold. Persisted.

    ``spread``: dealt evenly, for a learner that passes over them hundreds of times, in a number of partitions that
    follows the counted rows: one a core, more beyond PARTITION_BYTES each. The session's number of shuffle partitions
    has no say: every pass of a tree learner starts two tasks a partition and merges the statistics of all its nodes
    from each of them."""
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    out = with_fold(with_split(df, key), key, n_folds).select(
        *cols, F.col(label).cast("double").alias("label"), "is_test", "fold")
    if spread:
        out = written(out, "model-rows")
        n = max(df.sparkSession.sparkContext.defaultParallelism, -(-out.count() * 8 * len(out.columns) // PARTITION_BYTES))
        out = out.repartition(n, F.xxhash64(*[F.col(c) for c in features], "label"))
    return out.persist(StorageLevel.MEMORY_AND_DISK)


def _label_stats(train: DataFrame) -> tuple[float, int]:
    r = train.agg(F.stddev_samp("label"), F.count(F.lit(1))).first()
    return float(r[0] or 0.0), int(r[1])


def fit_one(name: str, data: DataFrame, features: list[str], **kw) -> PipelineModel:
    kw.setdefault("tree_memory_mb", tree_memory_mb(data.sparkSession))
    train = data.filter(~F.col("is_test"))
    std, n = _label_stats(train) if name == "Ridge" else (None, None)
    return fit_pipeline(features, make_regressor(name, std, n, **kw), train)


_SCORING = threading.Lock()


class TreeFit:
    """A fitted tree ensemble of the set: scores rows from its nodes, and is an MLlib pipeline on request."""

    def __init__(self, scaling: PipelineModel, ensemble: trees.Ensemble):
        self.scaling, self.ensemble, self._pipeline, self._lock = scaling, ensemble, None, threading.Lock()

    def errors(self, data: DataFrame, by: list[str]) -> list:
        """The metrics of ``data`` by ``by``. One ensemble's nodes at a time pass the driver."""
        with _SCORING:
            try:
                scored = self.ensemble.score(self.scaling.transform(data), ["label", *by])
                return regression_metrics(scored, by=by).collect()
            finally:
                self.ensemble.release()

    def pipeline(self) -> PipelineModel:
        with self._lock:
            if self._pipeline is None:
                self._pipeline = PipelineModel(stages=[*self.scaling.stages, self.ensemble.model()])
            return self._pipeline


def pipeline(model: PipelineModel | TreeFit) -> PipelineModel:
    """The MLlib pipeline of a model of :func:`train_models`."""
    return model.pipeline() if isinstance(model, TreeFit) else model


class TreeRows:
    """A training set scaled and binned once, for all its tree ensembles."""

    def __init__(self, train: DataFrame, features: list[str], **kw):
        self.features, self.kw = features, {"tree_memory_mb": tree_memory_mb(train.sparkSession), **kw}
        stages = make_pipeline(features, self._regressor(TREE_MODELS[0])).getStages()
        self.scaling = Pipeline(stages=stages[:-1]).fit(train)
        self.binned = trees.Binned(self.scaling.transform(train), stages[-1].getFeaturesCol(), stages[-1].getLabelCol(),
                                   stages[-1].getMaxBins())

    def _regressor(self, name: str):
        return make_regressor(name, **self.kw)

    def fit(self, name: str) -> TreeFit:
        return TreeFit(self.scaling, self.binned.fit(make_pipeline(self.features, self._regressor(name)).getStages()[-1]))

    def unpersist(self) -> None:
        self.binned.unpersist()


def holdout(model: PipelineModel | TreeFit, data: DataFrame) -> dict:
    if isinstance(model, TreeFit):
        rows = model.errors(data, by=["is_test"])
    else:
        rows = regression_metrics(model.transform(data), by=["is_test"]).collect()
    out = {}
    for r in rows:
        side = "test" if r["is_test"] else "train"
        for m in ("rmse", "mae", "r2", "mape"):
            out[f"{side}_{m}"] = float(r[m]) if r[m] is not None else None
    return out


def cross_validate(name: str, data: DataFrame, features: list[str], n_folds: int = N_FOLDS,
                   parallelism: int = 1, **kw) -> tuple[float, float]:
    """RMSE mean and population std over hash folds of all rows; NaN if a fit fails."""
    kw.setdefault("tree_memory_mb", tree_memory_mb(data.sparkSession))

    def one(f: int) -> float:
        train = data.filter(F.col("fold") != f)
        std, n = _label_stats(train) if name == "Ridge" else (None, None)
        model = fit_pipeline(features, make_regressor(name, std, n, **kw), train)
        r = regression_metrics(model.transform(data.filter(F.col("fold") == f))).first()
        return float(r["rmse"])

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            rmses = list(pool.map(one, range(n_folds)))
    except Exception as e:  # the training loop records NaN for a failed CV, and says why
        log.warning("cross-validation of %s failed: %s", name, e)
        return math.nan, math.nan
    mean = sum(rmses) / len(rmses)
    return mean, math.sqrt(sum((x - mean) ** 2 for x in rmses) / len(rmses))


LINEAR_MODELS = ("LinearRegression", "Ridge")
TREE_MODELS = ("GradientBoosting", "GradientBoostingSubsampled", "RandomForest")
# Rows of a fold's fit from which one tree-ensemble fit alone keeps the executors busy.
BUSY_ROWS = 5_000_000


def default_cv_parallelism(name: str, n_folds: int, rows: int) -> int:
    """Folds fit concurrently, with the same results: all of them for the linear fits and for tree ensembles on few
    rows, whose jobs are too short to fill the executors; one at a time on many rows, where a single fit does (and
    its node statistics are sized per task by ``tree_memory_mb``)."""
    return n_folds if name in LINEAR_MODELS or rows < BUSY_ROWS else 1


METRICS = ("task string, model string, model_order int, train_rmse double, test_rmse double, "
           "train_mae double, test_mae double, train_r2 double, test_r2 double, "
           "cv_rmse_mean double, cv_rmse_std double")


def _metrics_row(task: str, name: str, m: dict, mean: float, std: float) -> tuple:
    return (task, name, MODEL_ORDER.index(name), m.get("train_rmse"), m.get("test_rmse"), m.get("train_mae"),
            m.get("test_mae"), m.get("train_r2"), m.get("test_r2"), mean, std)


def train_model(name: str, data: DataFrame, features: list[str], task: str, cv: bool = True, n_folds: int = N_FOLDS,
                cv_parallelism: int | None = None, **kw) -> tuple[tuple, PipelineModel]:
    """Fit one model of the set on prepared rows: (a row of METRICS, the fitted pipeline)."""
    model = fit_one(name, data, features, **kw)
    m = holdout(model, data)
    par = cv_parallelism or default_cv_parallelism(name, n_folds, data.count())
    mean, std = cross_validate(name, data, features, n_folds, par, **kw) if cv else (math.nan, math.nan)
    return _metrics_row(task, name, m, mean, std), model


def train_models(names: list[str], data: DataFrame, features: list[str], task: str, cv: tuple[str, ...] = (),
                 n_folds: int = N_FOLDS, parallelism: int = 1, **kw) -> dict[str, tuple[tuple, PipelineModel | TreeFit]]:
    """Model → (a row of METRICS, the fitted model) on prepared rows; those named in ``cv`` are cross-validated.

    The tree ensembles of a training set (all training rows, or those of a fold's fit) share its scaled and binned rows.
    ``parallelism`` > 1: sets and fits side by side, for few rows; else a set at a time."""
    ensembles = [n for n in TREE_MODELS if n in names]        # the longest tasks first
    folds = range(n_folds) if any(n in cv for n in ensembles) else ()
    wanted = {None: ensembles, **{f: [n for n in ensembles if n in cv] for f in folds}} if ensembles else {}

    def rows_of(f: int | None) -> TreeRows:
        return TreeRows(data.filter(~F.col("is_test") if f is None else F.col("fold") != f), features, **kw)

    def fold_rows(f: int) -> TreeRows | None:
        try:
            return rows_of(f)
        except Exception as e:  # as in cross_validate
            log.warning("rows of fold %s failed: %s", f, e)

    def one(rows: TreeRows | None, f: int | None, name: str):
        if f is None:
            model = rows.fit(name)
            return holdout(model, data), model
        try:
            return float(rows.fit(name).errors(data.filter(F.col("fold") == f), by=[])[0]["rmse"])
        except Exception as e:
            log.warning("cross-validation of %s failed: %s", name, e)
            return math.nan

    out, got = {}, {}
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        def fits_of(sets: dict) -> None:
            try:
                todo = sorted(((f, n) for f in sets for n in wanted[f]), key=lambda x: ensembles.index(x[1]))
                got.update(zip(todo, pool.map(lambda x: one(sets[x[0]], *x), todo)))
            finally:
                for rows in sets.values():
                    if rows is not None:
                        rows.unpersist()

        linear = {n: pool.submit(train_model, n, data, features, task, n in cv, n_folds, **kw) for n in names if n not in ensembles}
        make = lambda f: rows_of(f) if f is None else fold_rows(f)
        if parallelism > 1:
            fits_of(dict(zip(wanted, pool.map(make, wanted))))
        else:
            for f in wanted:
                fits_of({f: make(f)})
        for n in names:
            if n in linear:
                out[n] = linear[n].result()
                continue
            m, model = got[None, n]
            rmses = [got[f, n] for f in folds if n in cv]
            mean = sum(rmses) / len(rmses) if rmses else math.nan
            std = math.sqrt(sum((x - mean) ** 2 for x in rmses) / len(rmses)) if rmses else math.nan
            out[n] = _metrics_row(task, n, m, mean, std), model
    return out


def train_all(df: DataFrame, features: list[str], label: str, key, task: str,
              models: list[str] | None = None, cv: bool = True, n_folds: int = N_FOLDS,
              cv_parallelism: int | None = None, **kw) -> tuple[DataFrame, dict[str, PipelineModel], str]:
    """Fit every model of the set, score it, pick the best. Returns (metrics, models, best name).

    CV folds are independent fits submitted from a small driver thread pool, so
    the executors work on several folds at once; results do not depend on it.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)  # tree learners checkpoint their node ids
    data = prepare(df, features, label, key, n_folds)
    if data.limit(1).count() == 0:
        data.unpersist()
        raise ValueError(f"no training rows for task {task!r}")
    names = models or MODEL_ORDER
    rows, fitted = [], {}
    try:
        for name in names:
            row, fitted[name] = train_model(name, data, features, task, cv, n_folds, cv_parallelism, **kw)
            rows.append(row)
    finally:
        data.unpersist()
    metrics = with_scores(spark.createDataFrame(rows, METRICS))
    best = select_best(metrics).first()["model"]
    return metrics, fitted, best


# ---------------------------------------------------------------- persistence
def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_metrics(metrics: DataFrame, json_path: str, csv_path: str) -> None:
    """Nested JSON (task → model → metrics) and a flat CSV, both written by Spark."""
    metrics = metrics.persist()  # written twice below; a metrics table is a few rows per model
    metric_cols = [c for c in metrics.columns if c not in ("task", "model", "model_order")]
    nested = (metrics.groupBy("task")
              .agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct(*metric_cols)))).alias("models")))
    nested.coalesce(1).write.mode("overwrite").json(json_path)
    metrics.drop("model_order").orderBy("task", "model").coalesce(1) \
        .write.mode("overwrite").option("header", True).csv(csv_path)
    metrics.unpersist()


def best_info(metrics: DataFrame) -> DataFrame:
    """Timestamp plus the best model's name and metrics, per task."""
    best = select_best(metrics)
    metric_cols = [c for c in metrics.columns if c not in ("task", "model", "model_order")]
    return best.select(F.current_timestamp().alias("timestamp"), "task", F.col("model").alias("name"),
                       F.to_json(F.struct(*metric_cols)).alias("metrics"))


def best_info_json(metrics: DataFrame) -> str:
    rows = best_info(metrics).collect()
    return json.dumps({"timestamp": str(dt.datetime.now()),
                       **{f"{r['task']}_model": {"name": r["name"], "metrics": json.loads(r["metrics"])}
                          for r in rows}}, indent=4)
