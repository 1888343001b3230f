"""The production path: load the star once (fact partitioned by month), answer from the loaded warehouse."""

import os
import tempfile

import pytest

from tripstar.catalog import all_operators
from tripstar.checks import normalise
from tripstar.operators.etl import load_star
from tripstar.sources.warehouse import Warehouse

from conftest import SMOKE

QUESTIONS = ["q01_top_pickup_zones", "q02_demand_by_weekday", "q05_vehicle_revenue", "q06_weather_demand",
             "q07_weather_trip_metrics", "q10_agent_performance", "rev_daily", "agg_demand_grain", "flt_slice",
             "q_issue_by_location"]


@pytest.fixture(scope="module")
def loaded(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="warehouse-"), "star")
    load_star(Warehouse.from_testdata(spark, SMOKE), root)
    return Warehouse.from_parquet(spark, root)


@pytest.mark.parametrize("name", QUESTIONS)
def test_loaded_warehouse_gives_the_same_answers(spark, loaded, name):
    op = all_operators()[name]
    a = op(Warehouse.from_testdata(spark, SMOKE))
    b = op(loaded)
    assert a.columns == b.columns
    assert normalise(a.columns, [tuple(r) for r in a.collect()]) == normalise(b.columns, [tuple(r) for r in b.collect()])


def test_slice_prunes_day_partitions(spark, loaded):
    df = all_operators()["flt_slice"](loaded)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ride_month" in text and "GreaterThanOrEqual(ride_day" in text


def test_a_load_leaves_none_of_its_steps_files(spark, tmp_path):

    from tripstar.session import staging, written

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    kept = written(rows, "outside")
    with staging(spark):
        step = written(rows.groupBy("k").count(), "step")
        folder = step.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert os.path.isdir(folder) and spark.conf.get(key) == "true"
        step.write.parquet(str(tmp_path / "loaded"))
    assert not os.path.exists(folder) and spark.conf.get(key, None) == before      # the step's table stayed before
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "loaded")).collect()} == {(1, 2), (None, 1)}
    assert kept.count() == 3
    with pytest.raises(ValueError):
        with staging(spark):
            raise ValueError
    assert spark.conf.get(key, None) == before
