"""Cross products and their fits, and stored ensembles compiled to relational scoring."""

import duckdb
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tripstar.ml import compiled, evaluate as ev, gram, train

FEATURES = ["a", "b", "c", "twice_a", "flat"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 900
    a, b, c = rng.normal(1e6, 2, n), rng.integers(0, 5, n).astype(float), rng.exponential(1, n)
    y = 3 * a - b * c + rng.normal(0, .5, n)
    rows = [(float(i % 5 == 0), i % 5, *map(float, r)) for i, r in enumerate(zip(a, b, c, 2 * a, 0 * a, y))]
    df = spark.createDataFrame(rows, "t double, fold int, a double, b double, c double, twice_a double, flat double, label double")
    df = df.withColumn("is_test", F.col("t") == 1).drop("t").persist()
    yield df
    df.unpersist()


def products(df, scale):
    return gram.cross_products(df, FEATURES, scale)


def test_cross_products_merge_and_subtract(data):
    scale = gram.common_scale(data, FEATURES)
    folds = gram.by_fold(data, FEATURES, scale, 5)
    whole = products(data, scale)
    assert whole.n == 900 and [f.n for f in folds] == [180] * 5
    np.testing.assert_allclose((folds[0] + folds[1]).sums, products(data.filter("fold < 2"), scale).sums, atol=1e-8)
    np.testing.assert_allclose((whole - folds[4]).sums, products(data.filter("fold < 4"), scale).sums, atol=1e-8)
    assert products(data.filter("false"), scale).n == 0


def test_ridge_is_the_learners_and_aliased_features_get_nothing(data):
    scale = gram.common_scale(data, FEATURES)
    side, test = (products(data.filter(F.col("is_test") == t), scale) for t in (False, True))
    varied = FEATURES[:4]   # with a constant feature the learner falls back to an iterative solver
    fit = gram.cross_products(data.filter(~F.col("is_test")), varied, scale).fit(train.RIDGE_ALPHA)
    model = train.fit_one("Ridge", data, varied)
    np.testing.assert_allclose(fit.coefficients, model.stages[-1].coefficients.toArray(), atol=1e-5)
    plain = side.fit()   # twice_a and flat add nothing to the features before them
    assert plain.coefficients[3] == plain.coefficients[4] == 0 and abs(plain.coefficients[0]) > 1
    held = train.holdout(train.fit_one("LinearRegression", data, FEATURES[:3]), data)
    assert side.rmse(plain) == pytest.approx(held["train_rmse"], abs=1e-5)
    assert test.rmse(plain) == pytest.approx(held["test_rmse"], abs=1e-5)
    assert test.r2(plain) == pytest.approx(held["test_r2"], abs=1e-6)


def test_fold_errors_are_those_of_separate_fits(data):
    varied = FEATURES[:4]
    got = gram.cross_validation(gram.by_fold(data, varied, gram.common_scale(data, varied), 5), train.RIDGE_ALPHA)
    mean, sd = train.cross_validate("Ridge", data, varied)
    rmse = [r for _, _, r in got]
    assert np.mean(rmse) == pytest.approx(mean, abs=1e-5) and np.std(rmse) == pytest.approx(sd, abs=1e-5)


@pytest.mark.parametrize("learner", [lambda: GBTRegressor(maxIter=6, maxDepth=3, seed=1, stepSize=.3),
                                     lambda: RandomForestRegressor(numTrees=7, maxDepth=6, seed=1, minInstancesPerNode=5)])
@pytest.mark.parametrize("broadcast", [True, False])
def test_compiled_ensembles_score_every_row_alike(spark, data, learner, broadcast, tmp_path, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(compiled, "BROADCAST_BYTES", 0)
    path = str(tmp_path / "model")
    model = train.make_pipeline(FEATURES, learner()).fit(data)
    train.save_model(model, path)
    own = PipelineModel.load(path).transform(data.withColumn("id", F.monotonically_increasing_id()).unionAll(
        data.limit(3).withColumn("id", F.lit(-1).cast("long"))))
    both = compiled.score(spark, path, own.select("id", "prediction", *FEATURES), FEATURES).toPandas()
    assert len(both) == 903 and both.prediction.nunique() > 20
    np.testing.assert_allclose(both.compiled, both.prediction, rtol=1e-9)
    if broadcast:   # the export and the SQL text in another engine
        nodes = compiled.node_table(spark, path).toPandas()
        points = own.filter("id >= 0").select("id", compiled.Stored(spark, path).scaled(FEATURES).alias("z"), "prediction").toPandas()
        con = duckdb.connect()
        con.register("nodes", nodes), con.register("points", points)
        scored = con.execute(compiled.scoring_sql(model.stages[-1].getMaxDepth())).df().merge(points, on="id")
        assert len(scored) == 900
        np.testing.assert_allclose(scored.prediction_x, scored.prediction_y, rtol=1e-9)


def test_compiled_linear_model(spark, data, tmp_path):
    path = str(tmp_path / "linear")
    train.save_model(train.fit_one("Ridge", data, FEATURES), path)
    own = train.load_model(path).transform(data).select("prediction", *FEATURES)
    both = compiled.score(spark, path, own, FEATURES).toPandas()
    np.testing.assert_allclose(both.compiled, both.prediction, rtol=1e-9)
