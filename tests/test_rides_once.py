"""Ride landing batches and validation: one reading of the tables, rows with a key of their own left in place."""

from pyspark.sql import functions as F

from tripstar.ml import queries as mlq, train
from tripstar.operators import etl, loading
from tripstar.sources import landing
from tripstar.sources.warehouse import Warehouse

from conftest import SMOKE


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_batch_reads_each_table_once_and_holds_both_kinds_of_copies(spark):
    wh = Warehouse.from_testdata(spark, SMOKE)
    rides, once = landing.landing_rides(wh.raw), landing._landing_rides_once(wh.raw)
    assert _plan(rides).count("Join ") == 1
    order = (F.col("source_key") / 10).cast("long")
    wrong = once.filter(order % 131 == 0).withColumns({
        "pickup_datetime": F.timestamp_add("MINUTE", F.lit(-60), F.col("pickup_datetime")), "fare_amount": F.lit(-1.0)})
    expected = once.unionByName(wrong).unionByName(once.filter(order % 137 == 0))
    assert rides.dtypes == once.dtypes
    assert rides.exceptAll(expected).isEmpty() and expected.exceptAll(rides).isEmpty()


def test_rows_with_a_key_of_their_own_are_not_grouped(spark):
    wh = Warehouse.from_testdata(spark, SMOKE)
    raw = landing.landing_rides(wh.raw).filter("source_key % 7 > 0 OR source_key IS NULL")
    grouped = etl.clean_validate_rides(raw)
    keys = raw.filter(F.col("fare_amount") >= 0).groupBy("source_key").count().filter("count > 1").count()
    got = {r.reject_reason: r["count"] for r in grouped.groupBy("reject_reason").count().collect()}
    assert sum(got.values()) == raw.count() and got["duplicate"] >= 1 and keys >= 1
    assert "LeftAnti" in _plan(grouped)


def test_replaced_ids_are_read_from_files(spark):
    replaced = loading._replaced(Warehouse.from_testdata(spark, SMOKE))
    assert all("Aggregate" not in _plan(df) for df in replaced.values())


def test_the_line_and_the_weather_are_written_once(spark):
    wh = Warehouse.from_testdata(spark, SMOKE)
    _, vec = mlq._one_feature_fit(wh)
    assert "Join " not in _plan(vec)
    mlq.fare_rows(wh), mlq.demand_rows(wh)
    staged = wh.staged("dim_weather").dim_weather
    assert staged is wh.staged("dim_weather").dim_weather and "Aggregate" not in _plan(staged)


def test_partitions_of_model_rows_follow_the_rows_not_the_session(spark):
    df = spark.range(500).selectExpr("id", "double(id % 7) AS a", "double(id) AS y")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        data = train.prepare(df, ["a"], "y", F.col("id"))
        assert data.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and data.count() == 500
        data.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


class _Context:
    def __init__(self, master):
        self.master, self.defaultParallelism = master, 12

    def getConf(self):
        return {"spark.executor.memory": "6g"}


def test_node_statistics_of_a_local_cluster_fit_its_executors():
    class Session:
        sparkContext = _Context("local-cluster[3,4,10240]")
    assert train.tree_memory_mb(Session) == 6 * 1024 // 16
