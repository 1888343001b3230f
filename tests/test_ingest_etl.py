"""Ingest contracts, CSV reading, dedupe, ids and zone assignment on hand-made batches."""

import datetime as dt
import os
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tripstar.operators import etl, ids, ingest
from tripstar.sources import files, loads

T0 = dt.datetime(2024, 3, 1, 9, 30)


def test_customer_required_fields(spark):
    df = spark.createDataFrame([("A", "B", "a@b", "1"), ("A", " ", "a@b", None)],
                               "first_name string, last_name string, email string, phone string")
    got = [r.reject_reason for r in ingest.validate_customers(df).collect()]
    assert got == [None, "missing_last_name;missing_phone"]


def test_vehicle_year_and_type(spark):
    df = spark.createDataFrame([("P1", "M", "X", 1989, "Red", "SUV", None), ("P2", "M", "X", 2025, "Red", "Van", False)],
                               "license_plate string, make string, model string, year int, color string, "
                               "vehicle_type string, is_active boolean")
    rows = ingest.validate_vehicles(df).collect()
    assert [r.reject_reason for r in rows] == ["year_out_of_range", "bad_vehicle_type"]
    assert [r.is_active for r in rows] == [True, False]


def test_ticket_zero_ids_become_null_and_defaults(spark):
    df = spark.createDataFrame([(5, 1, 0, "App", "text", None, None, 0)],
                               "ride_id long, customer_id long, driver_id long, issue_type string, description string, "
                               "status string, priority string, assigned_agent_id long")
    r = ingest.validate_tickets(df).first()
    assert (r.driver_id, r.assigned_agent_id, r.status, r.priority, r.reject_reason) == (None, None, "Open", "Medium", None)


def _upload(tmp, header, rows):
    os.makedirs(tmp, exist_ok=True)
    with open(os.path.join(tmp, "part.csv"), "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")
    return tmp


def test_csv_bad_cells_are_quarantined_not_fatal(spark):
    header = ["customer_id", "driver_id", "vehicle_id", "pickup_datetime", "trip_distance", "pickup_longitude",
              "pickup_latitude", "dropoff_longitude", "dropoff_latitude", "fare_amount", "total_amount",
              "payment_method_id"]
    good = ["1", "2", "3", "2024-03-01 09:30:00", "2.5", "-74.0", "40.7", "-74.1", "40.8", "12.5", "15", "1"]
    bad = list(good)
    bad[9] = "n/a"
    path = _upload(tempfile.mkdtemp(prefix="csv-"), header, [good, bad])
    v = ingest.validate_rides_batch(files.read_rides_csv(spark, path, typed=False)).collect()
    assert [r.reject_reason for r in v] == [None, "bad_fare_amount;missing_fare_amount"]
    assert v[0].passenger_count == 1 and v[0].ride_status == "Completed"
    typed = files.read_rides_csv(spark, path, typed=True).collect()
    assert typed[0][files.CORRUPT_COL] is None and typed[1][files.CORRUPT_COL] is not None
    assert typed[1].fare_amount is None and typed[1].customer_id == 1


def test_csv_missing_required_column_is_an_error(spark):
    path = _upload(tempfile.mkdtemp(prefix="csv-"), ["customer_id", "driver_id"], [["1", "2"]])
    with pytest.raises(files.MissingColumnsError, match="vehicle_id"):
        files.read_rides_csv(spark, path)


def _raw_ride(key, pickup=T0, fare=10.0, lat=40.5):
    return (key, 1, 2, 3, None, pickup, pickup + dt.timedelta(minutes=12) if pickup else None, 1, 2.0,
            -74.0, lat, -74.1, 40.6, fare, None, 0.5, 1.0, None, 0.3, fare + 2, None, None, 1, None)


RAW = ("source_key long, customer_id long, driver_id long, vehicle_id long, vendor_id int, "
       "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, passenger_count int, trip_distance double, "
       "pickup_longitude double, pickup_latitude double, dropoff_longitude double, dropoff_latitude double, "
       "fare_amount double, extra double, mta_tax double, tip_amount double, tolls_amount double, "
       "improvement_surcharge double, total_amount double, ratecode_id int, store_and_fwd_flag string, "
       "payment_method_id int, ride_status string")


def test_dedupe_keeps_one_copy_of_a_hot_key(spark):
    hot = [_raw_ride(7, pickup=T0 + dt.timedelta(minutes=i % 50), fare=float(i)) for i in range(3000)]
    rows = hot + [_raw_ride(8), _raw_ride(None), _raw_ride(9, fare=-1.0)]
    out = etl.clean_validate_rides(spark.createDataFrame(rows, RAW))
    kept = out.filter(F.col("reject_reason").isNull()).collect()
    assert sorted(r.source_key for r in kept) == [7, 8]
    winner = [r for r in kept if r.source_key == 7][0]
    assert winner.pickup_datetime == T0 and winner.fare_amount == 0.0
    assert out.count() == len(rows)
    reasons = {r.source_key: r.reject_reason for r in out.filter(F.col("source_key").isin(9) | F.col("source_key").isNull()).collect()}
    assert reasons == {9: "negative_fare", None: "missing_key"}


def reasons(out):
    return sorted(((r.source_key, r.reject_reason) for r in out.select("source_key", "reject_reason").collect()), key=str)


def test_invalid_first_copy_does_not_lose_the_ride(spark):
    rows = [_raw_ride(7, pickup=T0 - dt.timedelta(hours=1), fare=-5.0), _raw_ride(7), _raw_ride(7, fare=11.0)]
    out = etl.clean_validate_rides(spark.createDataFrame(rows, RAW))
    assert reasons(out) == [(7, "duplicate"), (7, "negative_fare"), (7, None)]
    fact = etl.build_fact_rides(out, [(1, 40.5, -74.0)]).collect()
    assert [(r.ride_id, float(r.fare_amount)) for r in fact] == [(7, 10.0)]


def test_odd_amounts_are_quarantined(spark):
    rows = [_raw_ride(1, fare=1e12), _raw_ride(2, fare=float("nan")), _raw_ride(3)]
    out = etl.clean_validate_rides(spark.createDataFrame(rows, RAW))
    assert reasons(out) == [(1, "out_of_range"), (2, "not_a_number"), (3, None)]
    assert sorted(r.ride_id for r in etl.build_fact_rides(out, [(1, 40.5, -74.0)]).collect()) == [3]


def test_identical_copies_and_null_keys(spark):
    rows = [_raw_ride(7)] * 500 + [_raw_ride(None)] * 300
    out = etl.clean_validate_rides(spark.createDataFrame(rows, RAW).repartition(6))
    counts = {(r.source_key, r.reject_reason): r["count"] for r in out.groupBy("source_key", "reject_reason").count().collect()}
    assert counts == {(7, None): 1, (7, "duplicate"): 499, (None, "missing_key"): 300}


def test_copies_of_a_hot_ride_are_written_out_by_many_tasks(spark):
    """65,001 copies are seven blocks: no task writes out all of them, and exactly one copy is kept."""
    raw = spark.createDataFrame([_raw_ride(7)], RAW).crossJoin(spark.range(65_001).select()).unionByName(
        spark.createDataFrame([_raw_ride(8), _raw_ride(8)], RAW))
    out = etl.clean_validate_rides(raw).groupBy("source_key", "reject_reason", F.spark_partition_id().alias("task")).count().collect()
    counts = {}
    for r in out:
        counts[r.source_key, r.reject_reason] = counts.get((r.source_key, r.reject_reason), 0) + r["count"]
    assert counts == {(7, None): 1, (7, "duplicate"): 65_000, (8, None): 1, (8, "duplicate"): 1}
    assert max(r["count"] for r in out) < 65_000


def test_dedupe_of_an_empty_batch(spark):
    assert etl.clean_validate_rides(spark.createDataFrame([], RAW)).count() == 0


def test_two_thousand_zones(spark):
    centres = [(i, 40 + (i % 50) * 0.01, -74 + (i // 50) * 0.01) for i in range(2000)]
    zones = spark.createDataFrame(centres, "zone_id int, center_lat double, center_lon double")
    df = spark.createDataFrame([(40.1234, -73.8765), (41.0, -70.0)], "lat double, lon double")
    got = [r[0] for r in df.select(etl.nearest_zone("lat", "lon", etl.zone_centres(zones))).collect()]
    near = lambda a, o: min(centres, key=lambda c: ((a - c[1]) ** 2 + (o - c[2]) ** 2, c[0]))[0]
    assert got == [near(40.1234, -73.8765), near(41.0, -70.0)]


UPLOAD = ["customer_id", "driver_id", "vehicle_id", "pickup_datetime", "trip_distance", "pickup_longitude",
          "pickup_latitude", "dropoff_longitude", "dropoff_latitude", "fare_amount", "total_amount",
          "payment_method_id"]
GOOD = ["1", "2", "3", "2024-03-01 09:30:00", "2.5", "-74.0", "40.7", "-74.1", "40.8", "12.5", "15", "1"]


def test_upload_with_extra_columns_and_written_out_integers(spark):
    extra = ["note", *UPLOAD, "internal"]
    rows = [["hello", *GOOD, "x"], ["", *["7.0" if i == 0 else c for i, c in enumerate(GOOD)], ""],
            ["", *["7.5" if i == 0 else c for i, c in enumerate(GOOD)], ""],
            ["", *["NaN" if i == 9 else c for i, c in enumerate(GOOD)], ""]]
    path = _upload(tempfile.mkdtemp(prefix="csv-"), extra, rows)
    v = ingest.validate_rides_batch(files.read_rides_csv(spark, path, typed=False)).collect()
    assert [r.reject_reason for r in v] == [None, None, "bad_customer_id;missing_customer_id",
                                            "bad_fare_amount;missing_fare_amount"]
    assert [r.customer_id for r in v][:2] == [1, 7]
    typed = files.read_rides_csv(spark, path, typed=True)
    assert "note" not in typed.columns
    assert [r[files.CORRUPT_COL] is None for r in typed.collect()] == [True, True, False, False]


def test_two_uploads_do_not_overwrite_each_other(spark):
    from conftest import SMOKE
    from tripstar.catalog import all_queries

    first = all_queries()["src_csv_rides"](spark, SMOKE)
    second = all_queries()["ingest_rides_batch"](spark, SMOKE)
    assert first.count() == second.count() > 0


def test_unit_conversion(spark):
    df = etl.unit_convert(spark.createDataFrame([_raw_ride(1)], RAW)).first()
    assert df.distance_km == pytest.approx(2.0 * 1.609344) and df.duration_minutes == 12


def test_surrogate_ids_are_consecutive_across_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumn("x", F.col("id") * 2).drop("id")
    got = sorted(r.cid for r in ids.with_surrogate_ids(df, "cid", base=500).collect())
    assert got == list(range(501, 1501))


def test_nearest_zone_and_ties(spark):
    centres = [(3, 0.0, 1.0), (1, 0.0, -1.0), (2, 5.0, 0.0)]
    df = spark.createDataFrame([(0.0, 0.0), (4.5, 0.2), (None, 0.0)], "lat double, lon double")
    got = [r[0] for r in df.select(etl.nearest_zone("lat", "lon", centres)).collect()]
    assert got == [1, 2, None]  # first point is equidistant from 3 and 1: the smaller id wins


def test_latest_per_key_with_hot_key(spark):
    df = spark.createDataFrame([("k", i, f"v{i}") for i in range(2000)] + [("j", 1, "only")],
                               "k string, version int, value string")
    got = {r.k: r.value for r in etl.latest_per_key(df, "k", "version").collect()}
    assert got == {"k": "v1999", "j": "only"}


def test_zone_kmeans_recovers_separated_centres(spark):
    pts = [(i, 40.0 + (i % 3) * 1.0 + (i % 7) * 1e-4, -74.0 - (i % 3) * 1.0) for i in range(300)]
    df = spark.createDataFrame(pts, "k int, lat double, lon double").select(
        F.col("lat").alias("pickup_latitude"), F.col("lon").alias("pickup_longitude"),
        F.col("lat").alias("dropoff_latitude"), F.col("lon").alias("dropoff_longitude"))
    z = etl.fit_zones(df, k=3).orderBy("zone_id").collect()
    assert [round(r.center_lat) for r in z] == [40, 41, 42]


def test_weather_rollup_is_daily(spark):
    feed = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, h), 10.0 + h, 0.5, 0.25, 0.0, 50.0, 4.0) for h in range(4)],
        "zone_id int, observed_at timestamp_ntz, temperature_2m double, precipitation double, rain double, "
        "snowfall double, cloud_cover double, wind_speed double")
    r = files.weather_daily_rollup(feed).first()
    assert (r.temperature_2m, r.precipitation, r.rain, r.avg_wind_speed) == (11.5, 2.0, 1.0, 4.0)


def test_late_rides_join_their_day_and_reruns_replace_themselves(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="load-"), "fact")
    mk = lambda rows: spark.createDataFrame(rows, "ride_id long, ride_date timestamp_ntz")
    etl.load_partitioned(mk([(1, T0), (2, T0 + dt.timedelta(days=1))]), path, load_id="a")
    etl.load_partitioned(mk([(3, T0)]), path, load_id="late")
    etl.load_partitioned(mk([(3, T0)]), path, load_id="late")
    got = sorted(r.ride_id for r in etl.read_partitioned(spark, path).collect())
    assert got == [1, 2, 3]


def _ride_load(spark, rows):
    return spark.createDataFrame(rows, "ride_id long, ride_date timestamp_ntz")


def test_a_rerun_with_fewer_months_leaves_none_behind(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="load-"), "fact")
    later = T0 + dt.timedelta(days=60)
    etl.load_partitioned(_ride_load(spark, [(1, T0), (2, later)]), path, load_id="a")
    etl.load_partitioned(_ride_load(spark, [(3, later)]), path, load_id="b")
    etl.load_partitioned(_ride_load(spark, [(1, T0)]), path, load_id="a")
    assert sorted(r.ride_id for r in etl.read_partitioned(spark, path).collect()) == [1, 3]
    etl.load_partitioned(_ride_load(spark, []), path, load_id="a")
    etl.load_partitioned(_ride_load(spark, []), path, load_id="b")
    empty = etl.read_partitioned(spark, path)
    assert empty.columns == ["ride_id", "ride_date", "ride_day"] and empty.count() == 0


def test_a_killed_load_is_invisible_and_its_files_expire(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="load-"), "fact")
    with pytest.raises(FileNotFoundError):
        etl.read_partitioned(spark, path)
    etl.load_partitioned(_ride_load(spark, [(1, T0)]), path, load_id="a")
    # a run that ends after its rows are written and before they are committed
    day = F.to_date("ride_date")
    rows = _ride_load(spark, [(2, T0)]).withColumns({"ride_day": day, "ride_month": F.trunc(day, "month")})
    killed = loads.stage(rows, path, ["ride_month"])
    assert [r.ride_id for r in etl.read_partitioned(spark, path).collect()] == [1]
    etl.load_partitioned(_ride_load(spark, [(4, T0)]), path, load_id="a")
    assert loads.expire(spark, path, hours=1) == []
    gone = loads.expire(spark, path, hours=-1)
    assert killed in gone and len(gone) == 2
    assert [r.ride_id for r in etl.read_partitioned(spark, path).collect()] == [4]
    assert loads.expire(spark, path, hours=-1) == []


def test_loads_that_commit_at_the_same_time_all_count(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="load-"), "fact")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: etl.load_partitioned(_ride_load(spark, [(i, T0)]), path, load_id=f"l{i}"), range(6)))
    assert sorted(r.ride_id for r in etl.read_partitioned(spark, path).collect()) == list(range(6))


def test_concurrent_appends_get_ids_of_their_own(spark):
    ledger = os.path.join(tempfile.mkdtemp(prefix="ids-"), "customer_ids")

    def load(i):
        df = spark.range(0, 100 + i, numPartitions=3).select(F.col("id").alias("x"))
        out = ids.with_surrogate_ids(df, "cid", lambda n: ids.reserve(spark, ledger, f"load{i}", n, used=500))
        return sorted(r.cid for r in out.collect())

    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(load, range(6)))
    for i, g in enumerate(got):
        assert g == list(range(g[0], g[0] + 100 + i))       # no gap inside a load
    everything = sorted(x for g in got for x in g)
    assert everything == list(range(501, 501 + sum(100 + i for i in range(6))))
    assert load(2) == got[2]                                 # a load that is run again keeps its ids
    assert ids.reserve(spark, ledger, "load2", 7) == everything[-1]
    assert ids.reserve(spark, ledger, "empty", 0) == everything[-1] + 7


def test_append_counts_and_reruns_are_idempotent(spark):
    base = tempfile.mkdtemp(prefix="append-")
    ok, bad = os.path.join(base, "ok"), os.path.join(base, "bad")
    df = spark.createDataFrame([("A", "B", "a@b", "1"), ("A", "", "a@b", "1"), ("C", "D", "c@d", "2")],
                               "first_name string, last_name string, email string, phone string")
    v = ingest.validate_customers(df)
    assert ingest.append(v, ok, bad, load_id="2024-03-01") == {"valid": 2, "quarantined": 1}
    ingest.append(v, ok, bad, load_id="2024-03-01")  # the same load again: replaced, not doubled
    ingest.append(v, ok, bad, load_id="2024-03-02")
    assert spark.read.parquet(ok).count() == 4 and spark.read.parquet(bad).count() == 2
