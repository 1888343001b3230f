"""pandas-vs-Spark semantics on hand-made frames."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import ride, warehouse
from tripstar.functions import features as fx
from tripstar.operators import questions as qs

MON = dt.datetime(2024, 1, 1, 8, 0)  # a Monday


def test_null_group_key_is_dropped(spark):
    wh = warehouse(spark, rides=[ride(1, zone=None), ride(2, zone=None), ride(3, zone=4)])
    rows = qs.q01_top_pickup_zones(wh).collect()
    assert [(r.pickup_zone_id, r.rides) for r in rows] == [(4, 1)]


def test_rides_without_date_are_not_counted(spark):
    wh = warehouse(spark, rides=[ride(1, when=None), ride(2)])
    assert qs.trip_kpis(wh).first().total_rides == 1


def test_mean_of_all_null_group_is_null_and_sorts_last(spark):
    t = [(1, 1, 1, "App", "Low", "Open", MON, None, None, None, None),
         (2, 1, 1, "Fare", "Low", "Open", MON, MON, 120, None, None)]
    wh = warehouse(spark, tickets=t)
    rows = qs.q09_resolution_by_issue(wh).collect()
    assert [r.issue_type for r in rows] == ["Fare", "App"]
    assert rows[0].avg_resolution_hours == 2.0 and rows[1].avg_resolution_hours is None


def test_missing_weekday_is_listed_with_null(spark):
    wh = warehouse(spark, rides=[ride(1, when=MON), ride(2, when=MON + dt.timedelta(days=2))])
    rows = qs.q02_demand_by_weekday(wh).collect()
    assert [r.day_of_week for r in rows][:3] == ["Monday", "Tuesday", "Wednesday"]
    assert [r.ride_count for r in rows] == [1, None, 1, None, None, None, None]


def test_unmatched_weather_is_clear_and_snow_beats_rain(spark):
    day = MON.date()
    weather = [(1, day, 5.0, 1.0, 1.0, 0.0, 10.0, 3.0), (2, day, 5.0, 1.0, 1.0, 2.0, 10.0, 3.0)]
    wh = warehouse(spark, rides=[ride(1, zone=1), ride(2, zone=2), ride(3, zone=2), ride(4, zone=7)],
                   zones=[(1, 40.5, -74.0), (2, 40.6, -74.1), (7, 40.7, -74.2)], weather=weather)
    got = {r.weather_condition: r.rides for r in qs.q06_weather_demand(wh).collect()}
    assert got == {"Rainy": 1, "Snowy": 2, "Clear": 1}


def test_duplicate_weather_rows_fan_out(spark):
    day = MON.date()
    weather = [(1, day, 5.0, 0.0, 0.0, 0.0, 10.0, 3.0), (1, day, 6.0, 0.0, 0.0, 0.0, 10.0, 3.0)]
    wh = warehouse(spark, rides=[ride(1, zone=1)], weather=weather)
    assert qs.q06_weather_demand(wh).first().rides == 2


def test_top_k_ties_break_on_key(spark):
    rides = [ride(i, zone=z) for i, z in enumerate([5, 3, 3, 5, 9, 1])]
    wh = warehouse(spark, rides=rides)
    rows = qs.q01_top_pickup_zones(wh, k=3).collect()
    assert [(r.pickup_zone_id, r.rides) for r in rows] == [(3, 2), (5, 2), (1, 1)]


@pytest.mark.parametrize("values", [[1.0, 2.5, 7.0, 7.0, 10.0, -3.5], [4.0, 4.0, 4.0], [0.0, 0.0]])
def test_temperature_bins_match_pandas_cut(spark, values):
    day = MON.date()
    zones = [(i, 40.0 + i, -74.0) for i in range(len(values))]
    weather = [(i, day, v, 0.0, 0.0, 0.0, 0.0, 0.0) for i, v in enumerate(values)]
    rides = [ride(i, zone=i) for i in range(len(values))]
    wh = warehouse(spark, rides=rides, zones=zones, weather=weather)
    got = qs.q06_temperature_bins(wh).collect()
    want = pd.cut(pd.Series(values), bins=10).value_counts(sort=False)
    assert [r.rides for r in got] == list(want.values)
    assert [r.temp_range for r in got] == [str(i) for i in want.index]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(x,) for x in [0.5, 1.5, 2.5, 2.4999, 3.5, -0.5]], "p double")
    got = [r[0] for r in df.select(fx.demand_rounded("p")).collect()]
    assert got == [round(x) for x in [0.5, 1.5, 2.5, 2.4999, 3.5, -0.5]]


def test_demand_levels(spark):
    df = spark.createDataFrame([(x,) for x in [4.99, 5.0, 14.99, 15.0]], "p double")
    assert [r[0] for r in df.select(fx.demand_level("p")).collect()] == ["Low", "Medium", "Medium", "High"]


def test_vehicle_label_is_null_when_a_part_is_missing(spark):
    df = spark.createDataFrame([("A", "B"), ("A", None)], "make string, model string")
    assert [r[0] for r in df.select(fx.vehicle_label()).collect()] == ["A B", None]


def test_numeric_coerce(spark):
    df = spark.createDataFrame([("12",), (" 3.5 ",), ("abc",), (None,)], "s string")
    assert [r[0] for r in df.select(fx.numeric_or("s", 7)).collect()] == [12.0, 3.5, 7.0, 7.0]


def test_tenure_and_vehicle_age_defaults(spark):
    df = spark.createDataFrame([(MON, None, None, None)], "ts timestamp_ntz, d date, ry int, vy int")
    r = df.select(fx.tenure_days("ts", "d").alias("t"), fx.vehicle_age("ry", "vy").alias("a")).first()
    assert (r.t, r.a) == (0, 4)


def test_zone_risk_is_proportional(spark):
    wh = warehouse(spark, rides=[ride(i, zone=i % 3) for i in range(10)])
    for r in qs.agg_zone_risk(wh, risk_rate=0.12).collect():
        assert math.isclose(r.risk_score, 0.12 * r.total_rides)


def test_ticket_profile_issue_columns_sum_to_count(spark):
    issues = ["App", "Driver", "Fare", "Other", "Vehicle", "App"]
    t = [(i, i % 2, None, it, "Low", "Open", MON, None, None, None, None) for i, it in enumerate(issues)]
    wh = warehouse(spark, tickets=t)
    for r in qs.agg_customer_ticket_profile(wh).collect():
        assert r.App + r.Driver + r.Fare + r.Other + r.Vehicle == r.ticket_count


def test_weekend_convention_sunday_zero(spark):
    sun = dt.datetime(2024, 1, 7, 12)  # Sunday
    df = spark.createDataFrame([(sun,)], "ts timestamp_ntz")
    from tripstar.functions import calendar as cal
    r = df.select(cal.dow_sunday0("ts").alias("a"), cal.dow_monday0("ts").alias("b")).first()
    assert (r.a, r.b) == (0, 6)
    # {5, 6} is Friday + Saturday when 0 = Sunday, Saturday + Sunday when 0 = Monday
    assert df.select(fx.is_weekend(cal.dow_sunday0("ts"))).first()[0] == 0
    assert df.select(fx.is_weekend(cal.dow_monday0("ts"))).first()[0] == 1


def test_day_and_month_names_match_pandas(spark):
    from tripstar.functions import calendar as cal
    days = pd.date_range("2023-12-25", periods=400, freq="D")
    df = spark.createDataFrame([(d.to_pydatetime(),) for d in days], "ts timestamp_ntz")
    got = df.select(cal.day_name("ts").alias("d"), cal.month_name("ts").alias("m")).collect()
    assert [r.d for r in got] == list(days.day_name())
    assert [r.m for r in got] == list(days.month_name())
