"""Candidate lines: both tasks from one joined reading of the rides, which are not kept afterwards."""

from tripstar.ml import linear, queries as mlq
from tripstar.operators import star
from tripstar.sources.warehouse import Warehouse

from conftest import SMOKE


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rides_of_both_tasks_are_joined_once_and_given_back(spark, monkeypatch):
    wh, seen = Warehouse.from_testdata(spark, SMOKE), []

    def spy(df, features, label, key, task, **kw):
        seen.append((task, _plan(df).count("InMemoryRelation"), _plan(df).count("l_orderkey")))
        return own(df, features, label, key, task, **kw)

    own = linear.candidate_metrics
    monkeypatch.setattr(linear, "candidate_metrics", spy)
    got = mlq.candidates(wh).collect()
    assert {t for t, *_ in seen} == {"fare", "demand"}
    assert all(n == 1 for _, n, _ in seen)
    assert not wh.fact_rides.select(*star.TRAINING_COLUMNS).is_cached
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    monkeypatch.undo()
    fare = linear.candidate_metrics(mlq.fare_rows(wh), mlq.fx.FARE_FEATURES, "fare_amount", mlq.fare_key(), "fare")
    assert [r for r in got if r.task == "fare"] == fare.collect()


def test_lines_cross_the_join_with_what_the_rides_need(spark):
    """The raw discount, tax, price and quantity stay on the lines' side."""
    plan = _plan(Warehouse.from_testdata(spark, SMOKE).fact_rides)
    left = plan[plan.index("Join "):]
    first = left.splitlines()[1]
    assert "Project" in first and "AS fare_amount" in first and "AS distance_km" in first
