"""Ingest, ETL and load steps run over the landing batches of the test data.

Each function takes a ``Warehouse`` bound onto the raw tables and returns the
DataFrame a step produces; steps that land files (CSV uploads, weather feeds,
the partitioned fact) write into the session's shared checkpoint folder and
read the result back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstar.operators import etl, ids, ingest, star
from tripstar.session import scratch_path, staging, written
from tripstar.sources import files, landing
from tripstar.sources.warehouse import Warehouse


def _scratch(wh: Warehouse, name: str) -> str:
    """A fresh folder for every call: no query overwrites the files of another that is still to be read."""
    return scratch_path(wh.spark, f"landing-{uuid.uuid4().hex[:12]}/{name}")


# ---------------------------------------------------------------- ingest
def ingest_customers(wh: Warehouse) -> DataFrame:
    return ingest.validate_customers(landing.landing_customers(wh.raw))


def ingest_drivers(wh: Warehouse) -> DataFrame:
    return ingest.validate_drivers(landing.landing_drivers(wh.raw))


def ingest_vehicles(wh: Warehouse) -> DataFrame:
    return ingest.validate_vehicles(landing.landing_vehicles(wh.raw))


def ingest_tickets(wh: Warehouse) -> DataFrame:
    return ingest.validate_tickets(landing.landing_tickets(wh.raw))


def ingest_rides_full(wh: Warehouse) -> DataFrame:
    return ingest.validate_rides_full(landing.landing_rides(wh.raw))


def ride_upload_csv(wh: Warehouse) -> str:
    """Land the ride upload CSV (derived from the tables) and return its folder."""
    path = _scratch(wh, "ride_upload_csv")
    files.write_csv(landing.ride_upload_rows(wh.raw).drop("source_key"), path)
    return path


def src_csv_rides(wh: Warehouse) -> DataFrame:
    df = files.read_rides_csv(wh.spark, ride_upload_csv(wh), typed=True)
    return (df.withColumn("is_corrupt", F.col(files.CORRUPT_COL).isNotNull())
            .drop(files.CORRUPT_COL))


def ingest_rides_batch(wh: Warehouse) -> DataFrame:
    text = files.read_rides_csv(wh.spark, ride_upload_csv(wh), typed=False)
    return ingest.validate_rides_batch(text)


def sink_surrogate_ids(wh: Warehouse) -> DataFrame:
    """The valid new customers with ids that continue after the largest existing one, in source order; the range is
    reserved for this load, so another load at the same time gets other ids."""
    ok, _ = ingest.split(ingest_customers(wh))
    used = ids.next_base(wh.dim_customers, "customer_id")
    ordered = ok.repartitionByRange("source_key").sortWithinPartitions("source_key")
    ledger = _scratch(wh, "customer_ids")
    return ids.with_surrogate_ids(ordered, "customer_id",
                                  lambda n: ids.reserve(wh.spark, ledger, "customers", n, used))


# ---------------------------------------------------------------- ETL
def etl_clean_validate(wh: Warehouse) -> DataFrame:
    return etl.clean_validate_rides(landing.landing_rides(wh.raw))


def etl_unit_convert(wh: Warehouse) -> DataFrame:
    return etl.unit_convert(landing.landing_rides(wh.raw)).select("source_key", "distance_km", "duration_minutes")


def etl_zones_kmeans(wh: Warehouse, k: int = 10) -> DataFrame:
    return etl.fit_zones(landing.landing_rides(wh.raw), k=k)


def _assigned(wh: Warehouse) -> DataFrame:
    centres = etl.zone_centres(wh.dim_zones)
    return etl.assign_zones(landing.landing_rides(wh.raw), centres)


def etl_zone_assign(wh: Warehouse) -> DataFrame:
    return _assigned(wh).select("source_key", "pickup_zone_id", "dropoff_zone_id")


def etl_weather_enrich(wh: Warehouse) -> DataFrame:
    a = _assigned(wh).select("source_key", "pickup_zone_id", "pickup_datetime")
    return star.join_weather_day(a, wh, ts_col="pickup_datetime").select(
        "source_key", "pickup_zone_id", "temperature_2m", "precipitation", "rain", "snowfall")


def etl_resolution_time(wh: Warehouse) -> DataFrame:
    return etl.resolution_minutes(wh.fact_support_tickets.select("ticket_id", "opened_at", "closed_at")) \
        .select("ticket_id", "resolution_time_minutes")


def etl_dim_build(wh: Warehouse) -> DataFrame:
    return etl.build_dim_vehicles(ingest_vehicles(wh))


def etl_dim_customers(wh: Warehouse) -> DataFrame:
    return etl.build_dim_customers(ingest_customers(wh))


def etl_dim_drivers(wh: Warehouse) -> DataFrame:
    return etl.build_dim_drivers(ingest_drivers(wh))


def _replaced(wh: Warehouse) -> dict[str, DataFrame]:
    """Replaced ids of each dimension, written: the planner knows how few they are and leaves the fact in place."""
    return {"vehicles": written(etl.replaced_ids(ingest_vehicles(wh), "license_plate"), "replaced-vehicles"),
            "customers": written(etl.replaced_ids(ingest_customers(wh), "email"), "replaced-customers"),
            "drivers": written(etl.replaced_ids(ingest_drivers(wh), "license_number"), "replaced-drivers")}


def etl_fact_build(wh: Warehouse) -> DataFrame:
    centres = etl.zone_centres(wh.dim_zones)
    return etl.build_fact_rides(etl.clean_validate_rides(landing.landing_rides(wh.raw)), centres, **_replaced(wh))


def etl_fact_tickets(wh: Warehouse) -> DataFrame:
    r = _replaced(wh)
    return etl.build_fact_tickets(ingest_tickets(wh), r["customers"], r["drivers"])


def etl_star(wh: Warehouse) -> Warehouse:
    """The whole ETL: landing batches to seven dimensions and two facts, loaded and read back.

    Zones are the zone model's centres; payment methods and agents are reference lists that the operational side
    keeps (here those of the binding); weather is the daily rollup of the landed feed."""
    root = _scratch(wh, "star")
    with staging(wh.spark):
        frames = {
            "fact_rides": etl_fact_build(wh), "fact_support_tickets": etl_fact_tickets(wh),
            "dim_customers": etl_dim_customers(wh), "dim_drivers": etl_dim_drivers(wh), "dim_vehicles": etl_dim_build(wh),
            "dim_zones": wh.dim_zones, "dim_payment_methods": wh.dim_payment_methods, "dim_agents": wh.dim_agents,
            "dim_weather": src_weather_files(wh),
        }
        etl.load_star(Warehouse.from_frames(wh.spark, frames), root)
    return Warehouse.from_parquet(wh.spark, root)


# Key of each star table (dim_weather: its zone).
STAR_KEYS = {"fact_rides": "ride_id", "fact_support_tickets": "ticket_id", "dim_customers": "customer_id",
             "dim_drivers": "driver_id", "dim_vehicles": "vehicle_id", "dim_zones": "zone_id",
             "dim_payment_methods": "payment_method_id", "dim_agents": "agent_id", "dim_weather": "zone_id"}


def etl_warehouse(wh: Warehouse) -> DataFrame:
    """One row a table of the loaded warehouse: rows, distinct keys and the sum of the keys."""
    star_ = etl_star(wh)
    parts = None
    for name, key in STAR_KEYS.items():
        k = F.col(key).cast("long")
        part = star_.table(name).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(k).alias("n_keys"),
                                     F.sum(k).alias("key_sum")).select(F.lit(name).alias("table_name"), "*")
        parts = part if parts is None else parts.unionAll(part)
    return parts


def etl_fare_training(wh: Warehouse) -> DataFrame:
    """The fare-model rows read from the ETL's own output."""
    return star.fare_training(etl_star(wh))


def sink_warehouse_load(wh: Warehouse) -> DataFrame:
    path = _scratch(wh, "warehouse/fact_rides")
    with staging(wh.spark):
        etl.load_partitioned(etl_fact_build(wh), path)
    return etl.read_partitioned(wh.spark, path)


# ---------------------------------------------------------------- weather feed
def weather_feed_rows(wh: Warehouse) -> DataFrame:
    """Hourly-style observations derived from the event stream, one per event."""
    e = F.col("event_id")
    return wh.raw.events.select(
        (F.col("user_id") % 24).cast("int").alias("zone_id"),
        F.col("ts").alias("observed_at"),
        (F.col("value") / 2 - 10).alias("temperature_2m"),
        ((e % 4) / 10.0).alias("precipitation"),
        ((e % 3) / 10.0).alias("rain"),
        F.when(e % 17 == 0, F.lit(0.5)).otherwise(F.lit(0.0)).alias("snowfall"),
        (e % 101).cast("double").alias("cloud_cover"),
        (e % 30).cast("double").alias("wind_speed"))


def src_weather_files(wh: Warehouse) -> DataFrame:
    path = _scratch(wh, "weather_feed_json")
    weather_feed_rows(wh).write.mode("overwrite").json(path)
    daily = files.weather_daily_rollup(files.read_weather_feed(wh.spark, path, "json"))
    return daily


# ---------------------------------------------------------------- streaming ingest
def ingest_stream_validate(wh: Warehouse, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """Land the ticket batch, drain it through the validated stream, read back.

    Each run lands into a fresh folder with its own checkpoint, so the stream
    sees exactly the files of this run. The files are those Spark's tasks write,
    so their number follows the input; a micro-batch takes all that have landed,
    up to ``bytes_per_batch``. A valid ticket whose key was taken before is not taken again.
    """
    from tripstar.streaming.ingest import read_ingested, run_validated_ingest

    run = _scratch(wh, "ticket_stream")
    incoming, valid, bad, ckpt = (f"{run}/incoming", f"{run}/valid", f"{run}/quarantine", f"{run}/_checkpoint")
    rows = landing.landing_tickets(wh.raw)
    rows.write.mode("overwrite").parquet(incoming)
    run_validated_ingest(wh.spark, incoming, rows.schema, ingest.validate_tickets, valid, bad, ckpt,
                         max_bytes_per_trigger=bytes_per_batch, key="source_key")
    return read_ingested(wh.spark, valid, bad, ingest.validate_tickets(rows).schema).drop("batch_id")


def flt_required(wh: Warehouse) -> DataFrame:
    """Landing customers whose required fields are all present and non-blank."""
    ok, _ = ingest.split(ingest_customers(wh))
    return ok
