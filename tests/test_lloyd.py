"""K-Means on whole numbers: a fixpoint, the same whatever the partitions, and as good as the library's."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tripstar.ml import lloyd, score

XY = ["x", "y"]


def cloud(seed=3, n=1500):
    rng = np.random.default_rng(seed)
    middles = rng.integers(-50_000, 50_000, size=(6, 2))
    return [tuple(map(int, middles[i % 6] + rng.normal(0, 3_000, 2))) for i in range(n)]


def cost(points, centres):
    x, c = np.array(points, dtype=float), np.array(centres, dtype=float)
    return ((x[:, None, :] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_fit_is_a_fixpoint_whatever_the_partitions(spark):
    rows = cloud()
    df = spark.createDataFrame(rows + rows[:200], "x long, y long")
    points = lloyd.collapsed(df, XY)
    centres = lloyd.fit(points, XY, 6, rounds=100)
    assert lloyd.moved(points, XY, centres, "weight") == centres
    assert lloyd.fit(lloyd.collapsed(df.repartition(13, "y"), XY), XY, 6, rounds=100) == centres
    # the means of the rows that are nearest to each centre, by numpy
    x = np.array(rows + rows[:200])
    near = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2).argmin(axis=1)
    for i, c in enumerate(centres):
        own = x[near == i]
        assert [(2 * int(s) + len(own)) // (2 * len(own)) for s in own.sum(axis=0)] == list(c)


def test_fit_is_as_good_as_the_library(spark):
    rows = cloud()
    df = spark.createDataFrame(rows, "x long, y long")
    own = lloyd.fit(lloyd.collapsed(df, XY), XY, 6)
    model = KMeans(k=6, seed=42).fit(VectorAssembler(inputCols=XY, outputCol="features").transform(df))
    assert cost(rows, own) <= 1.3 * cost(rows, [c.tolist() for c in model.clusterCenters()])


def test_fewer_points_than_centres_and_none(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (-3, 5)], "x long, y long")
    assert sorted(lloyd.fit(lloyd.collapsed(df, XY), XY, 4)) == [(-3, 5), (1, 1)]
    assert lloyd.fit(lloyd.collapsed(df.limit(0), XY), XY, 4) == []


def test_segments_of_constant_features_and_of_no_customers(spark):
    kind = "customer_id long, ticket_count long, avg_resolution_time double, " + ", ".join(
        f"{f} long" for f in score.PROFILE_FEATURES[2:])
    rows = [(i, 1 + 9 * (i % 2), None, 1 + 9 * (i % 2), 0, 0, 0, 0) for i in range(21)]
    out = score.segment_customers(spark.createDataFrame(rows, kind), k=4)
    assert {(r.ticket_count, r.cluster) for r in out.collect()} == {(1, 0), (10, 1)}
    assert out.schema["cluster"].dataType.simpleString() == "int" and out.filter(F.col("avg_resolution_time") != 0).count() == 0
    assert score.segment_customers(spark.createDataFrame([], kind)).collect() == []
