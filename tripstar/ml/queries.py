"""Model operators over the warehouse: split, scaling, fits, metrics, CV, selection, scoring.

The value-checked operators run on the fare and demand training rows of the
whole warehouse; the candidate model set for selection is one least-squares
line per feature (``tripstar.ml.linear``), whose numbers an SQL engine can
reproduce. The MLlib learners (``tripstar.ml.train``) produce rows-only results.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstar.functions import features as fx
from tripstar.ml import evaluate as ev
from tripstar.ml import compiled, gram, linear, score, train
from tripstar.operators import questions, star, views
from tripstar.session import checkpoint_dir, scratch_path, written
from tripstar.sources.warehouse import Warehouse

DIGITS = 6


def _r(df: DataFrame, keep: list[str]) -> DataFrame:
    """Round every double column not in ``keep`` to ``DIGITS`` places (engine-independent output)."""
    return df.select(*[F.round(F.col(f.name), DIGITS).alias(f.name)
                       if f.dataType.typeName() == "double" and f.name not in keep else F.col(f.name)
                       for f in df.schema.fields])


def _staged(wh: Warehouse) -> Warehouse:
    """The warehouse with its weather, a row a zone and day, read from files: their size is known to the planner, so
    the rides aren't shuffled by zone and day to meet it while it is small."""
    return wh.staged("dim_weather")


def fare_rows(wh: Warehouse) -> DataFrame:
    return views.fare_feature_rows(_staged(wh))


def demand_rows(wh: Warehouse) -> DataFrame:
    return views.demand_feature_rows(_staged(wh))


def fare_key():
    return F.col("ride_id")


def demand_key():
    return F.concat_ws("|", F.col("zone_id").cast("string"), F.col("date").cast("string"),
                       F.col("hour").cast("string"))


# ---------------------------------------------------------------- value-checked
def ml_split(wh: Warehouse) -> DataFrame:
    """The split needs a ride's id alone: it runs over the filtered fact, without the joins of the features."""
    rows = star.fare_rides(wh).select("ride_id")
    return ev.with_split(rows, fare_key()).withColumn("bucket", ev.hash_bucket(fare_key()))


def ml_scale(wh: Warehouse) -> DataFrame:
    """Mean and (sample) standard deviation the scaler learns on the training rows."""
    rows = ev.with_split(fare_rows(wh), fare_key()).filter(~F.col("is_test"))
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in fx.FARE_FEATURES]
    vec = VectorAssembler(inputCols=fx.FARE_FEATURES, outputCol="v").transform(rows.select(*cols))
    m = StandardScaler(inputCol="v", outputCol="s", withMean=True, withStd=True).fit(vec)
    spark = wh.spark
    data = [(f, i, float(m.mean[i]), float(m.std[i])) for i, f in enumerate(fx.FARE_FEATURES)]
    return _r(spark.createDataFrame(data, "feature string, feature_order int, mean double, std double"), [])


def _one_feature_fit(wh: Warehouse, feature: str = "distance_km"):
    # three narrow columns, written once: the fit and the errors pass over them several times
    data = written(ev.with_split(fare_rows(wh), fare_key()).select(
        F.col(feature).cast("double").alias("x"), F.col("fare_amount").cast("double").alias("label"), "is_test"), "line-rows")
    vec = VectorAssembler(inputCols=["x"], outputCol="features").transform(data)
    model = LinearRegression(regParam=0.0, solver="normal").fit(vec.filter(~F.col("is_test")))
    return model, vec


def ml_linear(wh: Warehouse) -> DataFrame:
    """Ordinary least squares, fare on distance, fit by MLlib on the training rows."""
    model, _ = _one_feature_fit(wh)
    return _r(wh.spark.createDataFrame([("distance_km", float(model.intercept), float(model.coefficients[0]))],
                                       "feature string, intercept double, slope double"), [])


def _one_feature_metrics(wh: Warehouse) -> DataFrame:
    model, vec = _one_feature_fit(wh)
    return ev.regression_metrics(model.transform(vec), by=["is_test"])


def ml_metrics(wh: Warehouse) -> DataFrame:
    return _r(_one_feature_metrics(wh).select("is_test", "n", "rmse", "mae", "r2"), [])


def ml_mape(wh: Warehouse) -> DataFrame:
    return _r(_one_feature_metrics(wh).select("is_test", "mape"), [])


def _linear_data(wh: Warehouse, task: str):
    """Prepared rows of a task, its features and their common scale. The rows stay persisted: unpersist them."""
    rows, features, label, key = _task(wh, task)
    data = train.prepare(rows, features, label, key, spread=False)
    return data, features, gram.common_scale(data, features)


def _linear_fits(wh: Warehouse, name: str, alpha: float) -> DataFrame:
    """Coefficients on the scaled features and the errors of both sides, from the cross products of each side."""
    out = []
    for task in ("fare", "demand"):
        data, features, scale = _linear_data(wh, task)
        try:
            sides = [gram.cross_products(data.filter(F.col("is_test") == t), features, scale) for t in (False, True)]
        finally:
            data.unpersist()
        fit = sides[0].fit(alpha)
        errors = [float(x) for s in sides for x in (s.rmse(fit), s.r2(fit))]
        # The label is centred on the mean of all rows.
        out += [(task, name, f, float(c), *errors) for f, c in
                zip(["intercept", *features], [fit.intercept + scale["label"][0], *fit.coefficients])]
    return _r(wh.spark.createDataFrame(out, "task string, model string, feature string, coefficient double, "
                                            "train_rmse double, train_r2 double, test_rmse double, test_r2 double"), [])


def ml_linear_all_features(wh: Warehouse) -> DataFrame:
    """Ordinary least squares on all features of both tasks, from merged cross products."""
    return _linear_fits(wh, "LinearRegression", 0.0)


def ml_ridge(wh: Warehouse) -> DataFrame:
    """Ridge regression (alpha 1 on the scaled features) on all features of both tasks, from merged cross products."""
    return _linear_fits(wh, "Ridge", train.RIDGE_ALPHA)


def ml_cv_linear_models(wh: Warehouse) -> DataFrame:
    """Five-fold errors of the two linear set-ups on all features: each fold's fit is that of the whole table's
    cross products less the fold's own."""
    out = []
    for task in ("fare", "demand"):
        data, features, scale = _linear_data(wh, task)
        try:
            folds = gram.by_fold(data, features, scale, ev.N_FOLDS)
        finally:
            data.unpersist()
        out += [(task, name, *row) for name, alpha in (("LinearRegression", 0.0), ("Ridge", train.RIDGE_ALPHA))
                for row in gram.cross_validation(folds, alpha)]
    return _r(wh.spark.createDataFrame(out, "task string, model string, fold int, n long, rmse double"), [])


def candidates(wh: Warehouse) -> DataFrame:
    """Metrics of the candidate lines of both tasks. The rides are read and joined once: the demand rows are counted
    from them, then the fare rows made of them."""
    wh = _staged(wh).kept("fact_rides", star.TRAINING_COLUMNS)
    try:
        return _candidates(wh)
    finally:
        wh.fact_rides.unpersist()


def _candidates(wh: Warehouse) -> DataFrame:
    demand = linear.candidate_metrics(demand_rows(wh), fx.DEMAND_FEATURES, "ride_count", demand_key(), "demand")
    fare = linear.candidate_metrics(fare_rows(wh), fx.FARE_FEATURES, "fare_amount", fare_key(), "fare")
    return fare.unionByName(demand)


def ml_cv(wh: Warehouse) -> DataFrame:
    return _r(linear.cv_folds(fare_rows(wh), fx.FARE_FEATURES, "fare_amount", fare_key(), "fare"), [])


def ml_selection_score(wh: Warehouse) -> DataFrame:
    return _r(ev.with_scores(candidates(wh)).select(
        "task", "model", "model_order", "train_r2", "test_r2", "r2_gap", "selection_score"), [])


def ml_score_backfill(wh: Warehouse) -> DataFrame:
    """Rows of an older metrics format (no gap, no score on odd positions) filled in."""
    scored = ev.with_scores(candidates(wh))
    old = scored.withColumns({
        "r2_gap": F.when(F.col("model_order") % 2 == 0, F.col("r2_gap")),
        "selection_score": F.when(F.col("model_order") % 2 == 0, F.col("selection_score")),
    })
    return _r(ev.backfill_scores(old).select("task", "model", "model_order", "r2_gap", "selection_score"), [])


def ml_select_best(wh: Warehouse) -> DataFrame:
    return _r(ev.select_best(ev.with_scores(candidates(wh))).select(
        "task", "model", "test_r2", "selection_score"), [])


def ml_metrics_table(wh: Warehouse) -> DataFrame:
    return _r(ev.metrics_table(ev.with_scores(candidates(wh))), [])


# ---------------------------------------------------------------- MLlib learners
# Fitted once a process for an application, data state, task and model, and used by every query below that needs it.
_FITTED: dict[tuple, tuple] = {}
# Fits of a task that run at a time on few rows.
SIDE_BY_SIDE = 8


def _data_state(wh: Warehouse) -> tuple:
    """Path, size and last change of the files that the model rows come from: a changed table is fitted anew."""
    jvm, conf = wh.spark._jvm, wh.spark._jsparkSession.sessionState().newHadoopConf()
    out = []
    for name in ("lineitem", "orders", "customer", "supplier", "part", "nation"):
        path = jvm.org.apache.hadoop.fs.Path(f"{wh.raw.sf_dir}/{name}.parquet")
        fs = path.getFileSystem(conf)
        out.append((path.toString(), fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def _task(wh: Warehouse, task: str):
    """(rows, features, label, key) of a task."""
    if task == "fare":
        return fare_rows(wh), fx.FARE_FEATURES, "fare_amount", fare_key()
    if task == "demand":
        return demand_rows(wh), fx.DEMAND_FEATURES, "ride_count", demand_key()
    return fare_rows(wh), fx.DURATION_FEATURES, "duration_minutes", fare_key()


def fitted(wh: Warehouse, task: str, names: list[str] | None = None, cv: tuple[str, ...] = train.LINEAR_MODELS) -> dict[str, tuple]:
    """Model → (metrics row, model) for the models of the set (all five unless named).

    Every fit is on all training rows with the full hyper-parameters. The models named in ``cv`` are cross-validated, five
    more fits each; it has no part in the choice of the best, which compares train and hold-out R²."""
    names = names or train.MODEL_ORDER
    base = (wh.spark.sparkContext.applicationId, _data_state(wh), task)
    key_of = lambda n: (*base, n, n in cv)
    todo = [n for n in names if key_of(n) not in _FITTED]
    if todo:
        checkpoint_dir(wh.spark)
        rows, features, label, key = _task(wh, task)
        data = train.prepare(rows, features, label, key)
        # on few rows the jobs of one fit are too short to fill the executors: the models are fitted side by side
        side_by_side = SIDE_BY_SIDE if data.count() < train.BUSY_ROWS else 1
        try:
            got = train.train_models(todo, data, features, task, cv, parallelism=side_by_side)
            _FITTED.update((key_of(n), got[n]) for n in todo)
        finally:
            data.unpersist()
    return {n: _FITTED[key_of(n)] for n in names}


def _metrics(wh: Warehouse, tasks: list[str], names: list[str] | None = None, **kw) -> DataFrame:
    with ThreadPoolExecutor(max_workers=len(tasks)) as pool:
        rows = [row for got in pool.map(lambda t: fitted(wh, t, names, **kw), tasks) for row, _ in got.values()]
    return ev.with_scores(wh.spark.createDataFrame(rows, train.METRICS))


def ml_random_forest(wh: Warehouse) -> DataFrame:
    return _metrics(wh, ["fare", "demand"], ["RandomForest"])


def ml_gbt(wh: Warehouse) -> DataFrame:
    return _metrics(wh, ["fare", "demand"], ["GradientBoosting"])


def ml_gbt_subsampled(wh: Warehouse) -> DataFrame:
    return _metrics(wh, ["fare", "demand"], ["GradientBoostingSubsampled"])


def ml_train_all(wh: Warehouse) -> DataFrame:
    """Fit, hold-out metrics and scores of the whole model set for both tasks."""
    return _metrics(wh, ["fare", "demand"])


def ml_duration(wh: Warehouse) -> DataFrame:
    """Trip-duration models: fare features without duration and speed, label duration_minutes; all five cross-validated."""
    return _metrics(wh, ["duration"], cv=tuple(train.MODEL_ORDER))


def best_model(wh: Warehouse, task: str):
    """(pipeline, hold-out RMSE) of the best model of the whole set."""
    models = fitted(wh, task)
    best = ev.select_best(_metrics(wh, [task])).first()["model"]
    row, model = models[best]
    return train.pipeline(model), row[4]


def ml_score_fare(wh: Warehouse) -> DataFrame:
    model, rmse = best_model(wh, "fare")
    rows = fare_rows(wh).select("ride_id", *fx.FARE_FEATURES)
    return score.score_fare(model, rows, rmse).drop(*fx.FARE_FEATURES)


def ml_score_demand(wh: Warehouse) -> DataFrame:
    model, _ = best_model(wh, "demand")
    rows = demand_rows(wh)
    return score.score_demand(model, rows.select("zone_id", "date", *[c for c in fx.DEMAND_FEATURES if c != "zone_id"])) \
        .select("zone_id", "date", "hour", "predicted_demand", "predicted_rides", "demand_level")


def ml_normal_equations(wh: Warehouse) -> DataFrame:
    """Optimality of the two linear fits on all features: per task, model and feature the residual of the normal
    equation, Σ e·z = α·w on the scaled features (α 0 for least squares), as a share of n·σ_y, rounded. All are 0."""
    out = []
    for task in ("fare", "demand"):
        rows, features, label, key = _task(wh, task)
        data = train.prepare(rows, features, label, key, spread=False)
        try:
            for name, alpha in (("LinearRegression", 0.0), ("Ridge", train.RIDGE_ALPHA)):
                model = train.fit_one(name, data, features)
                side = model.transform(data.filter(~F.col("is_test")))
                z = vector_to_array("features")
                e = F.col("label") - F.col("prediction")
                r = side.agg(F.count("*").alias("n"), F.stddev_samp("label").alias("sd"),
                             *[F.sum(e * z[i]).alias(f"g{i}") for i in range(len(features))]).first()
                w = model.stages[-1].coefficients.toArray()
                out += [(task, name, f, round(abs((r[f"g{i}"] - alpha * float(w[i])) / (r["n"] * r["sd"])), 6))
                        for i, f in enumerate(features)]
        finally:
            data.unpersist()
    return wh.spark.createDataFrame(out, "task string, model string, feature string, residual double")


def ml_segment_customers(wh: Warehouse) -> DataFrame:
    return score.segment_customers(questions.agg_customer_ticket_profile(wh))


# ---------------------------------------------------------------- sinks (write, read back)
def _path(wh: Warehouse, name: str) -> str:
    """A fresh folder for every call: no query overwrites the files of another that is still to be read."""
    return scratch_path(wh.spark, f"models-{uuid.uuid4().hex[:12]}/{name}")


def _saved(wh: Warehouse) -> dict[str, str]:
    """Save the best pipeline of each task and return its path."""
    paths = {}
    for task in ("fare", "demand"):
        paths[task] = _path(wh, f"best_{task}_model")
        train.save_model(best_model(wh, task)[0], paths[task])
    return paths


def _model_rows(wh: Warehouse, task: str) -> DataFrame:
    """row_key, features and label of a task's rows, as the pipelines take them."""
    rows, features, label, key = _task(wh, task)
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    return ev.with_split(rows, key).select(key.cast("string").alias("row_key"), *cols,
                                           F.col(label).cast("double").alias("label"), "is_test")


def sink_models(wh: Warehouse) -> DataFrame:
    """Save the best fare and demand pipelines, load them back and score with the loaded copies."""
    parts = [train.load_model(path).transform(_model_rows(wh, task))
             .select(F.lit(task).alias("task"), "label", "prediction", "is_test") for task, path in _saved(wh).items()]
    return parts[0].unionByName(parts[1])


def src_models(wh: Warehouse) -> DataFrame:
    """Load the saved best pipelines and score the rows of the tables with them."""
    parts = [train.load_model(path).transform(_model_rows(wh, task))
             .select(F.lit(task).alias("task"), "row_key", "prediction") for task, path in _saved(wh).items()]
    return parts[0].unionByName(parts[1])


def ml_compiled_models(wh: Warehouse) -> DataFrame:
    """Every model of the set, stored and compiled to relational scoring: per task, model and side the rows, and those on
    which the compiled form and the learner's own prediction differ by more than rounding. None do."""
    out = []
    for task in ("fare", "demand"):
        features = _task(wh, task)[1]
        for name, (_, model) in fitted(wh, task).items():
            path = _path(wh, f"{task}_{name}")
            model = train.pipeline(model)
            train.save_model(model, path)
            own = model.transform(_model_rows(wh, task)).select("is_test", "prediction", *features)
            both = compiled.score(wh.spark, path, own, features)
            off = F.abs(F.col("compiled") - F.col("prediction")) > 1e-9 * (1 + F.abs(F.col("prediction")))
            # One model at a time: each holds its node table in memory. Two rows come back.
            out += [(task, name, r["is_test"], r["n"], r["unequal"]) for r in both.groupBy("is_test").agg(
                F.count("*").alias("n"), F.count_if(off).alias("unequal")).collect()]
    return wh.spark.createDataFrame(out, "task string, model string, is_test boolean, n long, unequal long")


_STORED = ["train_rmse", "test_rmse", "train_mae", "test_mae", "train_r2", "test_r2", "train_mape", "test_mape",
           "cv_rmse_mean", "cv_rmse_std", "r2_gap", "selection_score"]


def _store_metrics(wh: Warehouse) -> tuple[str, str]:
    jp, cp = _path(wh, "metrics_json"), _path(wh, "metrics_csv")
    train.save_metrics(ev.with_scores(candidates(wh)), jp, cp)
    return jp, cp


def sink_metrics_json(wh: Warehouse) -> DataFrame:
    """Write the metrics as nested JSON (task → model → metrics), read them back as rows."""
    metric = "struct<" + ",".join(f"{c}:double" for c in _STORED) + ">"
    nested = wh.spark.read.schema(f"task string, models map<string,{metric}>").json(_store_metrics(wh)[0])
    return _r(nested.select("task", F.explode("models").alias("model", "m")).select("task", "model", "m.*"), [])


def sink_metrics_csv(wh: Warehouse) -> DataFrame:
    """Write the metrics as a flat CSV, read them back."""
    cp = _store_metrics(wh)[1]
    schema = "task string, model string, " + ", ".join(f"{c} double" for c in _STORED)
    return _r(wh.spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(cp), [])


def sink_best_info(wh: Warehouse) -> DataFrame:
    """Write the best model's name and metrics of each task with a timestamp, read them back."""
    p = _path(wh, "best_info")
    train.best_info(ev.with_scores(candidates(wh))).write.mode("overwrite").json(p)
    rows = wh.spark.read.schema("timestamp timestamp, task string, name string, metrics string").json(p)
    num = lambda c: F.round(F.get_json_object("metrics", f"$.{c}").cast("double"), DIGITS).alias(c)
    return rows.select("task", "name", F.col("timestamp").isNotNull().alias("stamped"), num("test_r2"),
                       num("selection_score"))


def sink_risk_zones(wh: Warehouse) -> DataFrame:
    p = _path(wh, "high_risk_zones")
    questions.agg_zone_risk(wh).write.mode("overwrite").option("header", True).csv(p)
    return wh.spark.read.option("header", True).schema(
        "pickup_zone_id int, total_rides long, risk_score double").csv(p)


def sink_segments(wh: Warehouse) -> DataFrame:
    p = _path(wh, "customer_segments")
    ml_segment_customers(wh).write.mode("overwrite").option("header", True).csv(p)
    return wh.spark.read.option("header", True).schema(
        "customer_id long, ticket_count long, avg_resolution_time double, App long, Driver long, Fare long, Other long, "
        "Vehicle long, cluster int").csv(p)
