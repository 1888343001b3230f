"""Model selection invariants, metrics and the MLlib training loop."""

import math

import pytest
from pyspark.sql import functions as F

from tripstar.ml import evaluate as ev
from tripstar.ml import linear, train

from conftest import SMOKE

SHIPPED = [
    ("fare", "LinearRegression", 0, 0.9127397963645174, 0.9429974498233639, 1.0035127567410567),
    ("fare", "RandomForest", 2, 0.9568148494791074, 0.9421407105438183, 0.9127924326732401),
    ("fare", "GradientBoosting", 3, 0.9909056723766947, 0.9711512894916529, 0.9316425237215692),
    ("demand", "LinearRegression", 0, 0.5180446700871364, 0.521984951898478, 0.5298655155211613),
    ("demand", "RandomForest", 2, 0.9470169202830439, 0.9424477962682679, 0.933309548238716),
    ("demand", "GradientBoosting", 3, 0.9868968131038414, 0.9266148595006426, 0.8060509522942451),
]
SCHEMA = "task string, model string, model_order int, train_r2 double, test_r2 double, stored double"


def test_signed_gap_reproduces_shipped_scores_and_winners(spark):
    m = ev.with_scores(spark.createDataFrame(SHIPPED, SCHEMA))
    for r in m.collect():
        assert r.selection_score == pytest.approx(r.stored, abs=1e-12)
        assert r.r2_gap == pytest.approx(abs(r.train_r2 - r.test_r2))
    best = {r.task: r.model for r in ev.select_best(m).collect()}
    assert best == {"fare": "LinearRegression", "demand": "RandomForest"}


def test_absolute_gap_changes_the_fare_winner(spark):
    m = spark.createDataFrame(SHIPPED, SCHEMA).withColumn(
        "selection_score", ev.selection_score(F.col("test_r2"), F.col("train_r2"), gap="absolute"))
    best = {r.task: r.model for r in ev.select_best(m).collect()}
    assert best["fare"] == "GradientBoosting"


def test_backfill_uses_stored_values_first(spark):
    rows = [("t", "a", 0, 0.9, 0.8, 0.05, None), ("t", "b", 1, 0.7, 0.75, None, None)]
    m = spark.createDataFrame(rows, "task string, model string, model_order int, train_r2 double, test_r2 double, "
                                    "r2_gap double, selection_score double")
    got = {r.model: (r.r2_gap, r.selection_score) for r in ev.backfill_scores(m).collect()}
    assert got["a"] == pytest.approx((0.05, 0.8 - 2 * 0.05))
    assert got["b"] == pytest.approx((-0.05, 0.75 + 0.1))


def test_first_model_wins_ties(spark):
    m = spark.createDataFrame([("t", "b", 1, 0.5), ("t", "a", 0, 0.5)],
                              "task string, model string, model_order int, selection_score double")
    assert ev.select_best(m).first().model == "a"


def test_metrics_formulas(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0), (4.0, 4.0)], "label double, prediction double")
    r = ev.regression_metrics(df).first()
    assert r.rmse == pytest.approx(math.sqrt((1 + 0 + 1 + 0) / 4))
    assert r.mae == pytest.approx(0.5)
    assert r.r2 == pytest.approx(1 - 2 / 5)
    assert r.mape == pytest.approx((1 + 0 + 1 / 3 + 0) / 4 * 100)


def test_split_is_stable_and_near_80_20(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = ev.with_split(df, F.col("k")).filter("is_test").count()
    b = ev.with_split(df.repartition(13), F.col("k")).filter("is_test").count()
    assert a == b and 0.18 < a / 20000 < 0.22


def test_line_fit_matches_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(1e6, 3.0, 400)
    y = 5e8 + 2.0 * x + rng.normal(0, 0.01, 400)
    parts = [linear.Moments(len(a), a.mean(), b.mean(), ((a - a.mean()) ** 2).sum(),
                            ((a - a.mean()) * (b - b.mean())).sum(), ((b - b.mean()) ** 2).sum())
             for a, b in zip(np.split(x, 8), np.split(y, 8))]
    whole = linear._total(parts)
    slope = np.polyfit(x - x.mean(), y - y.mean(), 1)[0]
    assert whole.line()[1] == pytest.approx(slope, rel=1e-6)
    assert whole.yy == pytest.approx(((y - y.mean()) ** 2).sum(), rel=1e-6)


def test_candidates_leave_no_cache_and_multiply_no_rows(spark):
    rows = [(i, float(i % 17), float(i % 5), 7.0, 3.0 * (i % 17) + 1e9) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y double")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    m = {r.model: r for r in linear.candidate_metrics(df, ["a", "b", "c"], "y", F.col("k"), "t").collect()}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert m["OLS:a"].test_r2 == pytest.approx(1.0) and m["OLS:a"].test_r2 <= 1.0
    assert abs(m["OLS:c"].train_r2) < 1e-9      # a constant feature predicts the mean
    assert linear.cv_folds(df, ["a"], "y", F.col("k"), "t").count() == 5


def _fare_rows(spark):
    from tripstar.operators import views
    from tripstar.sources.warehouse import Warehouse
    return views.fare_feature_rows(Warehouse.from_testdata(spark, SMOKE))


def test_linear_training_loop_selects_and_scores(spark):
    from tripstar.functions.features import FARE_FEATURES
    metrics, models, best = train.train_all(_fare_rows(spark), FARE_FEATURES, "fare_amount", F.col("ride_id"),
                                            "fare", models=["LinearRegression", "Ridge"])
    rows = {r.model: r for r in metrics.collect()}
    assert set(rows) == {"LinearRegression", "Ridge"} and best in rows
    for r in rows.values():
        # the synthetic fares barely depend on the trip features: only sanity bounds here
        assert -0.5 < r.test_r2 <= 1.0 and r.cv_rmse_mean > 0 and not math.isnan(r.cv_rmse_std)
    # With the σ_y/n scaling, a unit ridge penalty barely moves a well-posed fit.
    assert rows["Ridge"].test_r2 == pytest.approx(rows["LinearRegression"].test_r2, abs=0.01)


@pytest.mark.slow
def test_full_model_set_with_cv(spark):
    from tripstar.functions.features import FARE_FEATURES
    metrics, _, best = train.train_all(_fare_rows(spark), FARE_FEATURES, "fare_amount", F.col("ride_id"), "fare")
    assert metrics.count() == len(train.MODEL_ORDER) and best in train.MODEL_ORDER


def test_saved_models_are_loaded_and_score_both_tasks(spark, monkeypatch):
    from tripstar.ml import queries
    from tripstar.sources.warehouse import Warehouse

    monkeypatch.setattr(train, "MODEL_ORDER", ["LinearRegression", "Ridge"])   # the wiring, on the quick models
    wh = Warehouse.from_testdata(spark, SMOKE)
    scored = queries.src_models(wh)
    assert scored.columns == ["task", "row_key", "prediction"]
    counts = {r.task: r["count"] for r in scored.filter("prediction IS NOT NULL").groupBy("task").count().collect()}
    assert counts == {"fare": queries.fare_rows(wh).count(), "demand": queries.demand_rows(wh).count()}
    again = {r.task for r in queries.sink_models(wh).select("task").distinct().collect()}
    assert again == {"fare", "demand"}
