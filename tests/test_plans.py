"""Plan shapes: no Python in the query path, no cartesian products, pushed-down scans."""

import pytest

import __spark_entry__ as entry

from conftest import SMOKE

# Operators whose plans we inspect (cheap to plan; model operators run actions while planning).
PLANNED = [n for n in entry.oracle_sql() if not n.startswith(("ml_", "sink_", "src_csv", "ingest_rides_batch",
                                                             "ingest_stream", "op", "pipeline"))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(PLANNED))
def test_no_python_no_cartesian(spark, name):
    p = plan(entry.queries()[name](spark, SMOKE))
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{name}: {bad}"


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = entry.queries()["flt_slice"](spark, SMOKE)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey)" in text
    q1 = entry.queries()["q01_top_pickup_zones"](spark, SMOKE)
    p = q1._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in p and "l_comment" not in p  # only the needed lineitem columns


def test_small_dimensions_are_broadcast_and_large_ones_sort_merged(spark):
    from tripstar.checks import normalise

    ask = lambda: entry.queries()["src_fare_training"](spark, SMOKE)
    rows = lambda df: normalise(df.columns, [tuple(r) for r in df.collect()])
    small = ask()
    assert plan(small).count("BroadcastHashJoin") >= 4
    want = rows(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        large = ask()
        p = plan(large)
        assert "BroadcastHashJoin" not in p and p.count("SortMergeJoin") >= 6
        assert rows(large) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_building_a_query_runs_no_job_but_schema_reading(spark):
    sc = spark.sparkContext
    # queries that write files of their own while they are built
    landed = ("src_weather_files", "etl_")
    for name in [n for n in PLANNED if not n.startswith((*landed, "op", "pipeline"))] + ["q06_temperature_bins"]:
        sc.setJobGroup(f"build-{name}", name)
        entry.queries()[name](spark, SMOKE)
        jobs = sc.statusTracker().getJobIdsForGroup(f"build-{name}")
        sc.setJobGroup("rest", "rest")
        assert len(jobs) <= 8, (name, len(jobs))     # one a table that is read, for its schema
