"""Star-schema views: the loaders every question and model starts from.

Each view joins only what its consumers read. Unused left joins are not
removed by the optimizer, so questions start from the smallest view that
carries their columns (``rides``) rather than the widest (``rides_star``).
Dimensions are cut to the needed columns and joined without hints: the planner
(and AQE, from measured sizes) broadcasts them while they are small by bytes
and sort-merge joins them beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstar.functions import calendar as cal
from tripstar.functions import features as fx
from tripstar.sources.warehouse import Warehouse


def rides(wh: Warehouse) -> DataFrame:
    """Fact rides with a known ride date (the dashboard's row set)."""
    return wh.fact_rides.filter(F.col("ride_date").isNotNull())


def zones_as(wh: Warehouse, prefix: str) -> DataFrame:
    """The zone dimension renamed for one role (pickup / dropoff)."""
    return wh.dim("dim_zones").select(
        F.col("zone_id").alias(f"{prefix}_zone_key"),
        F.col("center_lat").alias(f"{prefix}_lat"),
        F.col("center_lon").alias(f"{prefix}_lon"))


def join_zones_role(df: DataFrame, wh: Warehouse) -> DataFrame:
    """Pickup and dropoff coordinates: the zone dimension joined twice, left."""
    pu, do = zones_as(wh, "pickup"), zones_as(wh, "dropoff")
    return (df.join(pu, df.pickup_zone_id == pu.pickup_zone_key, "left")
            .join(do, F.col("dropoff_zone_id") == do.dropoff_zone_key, "left")
            .drop("pickup_zone_key", "dropoff_zone_key"))


def join_vehicle_payment(df: DataFrame, wh: Warehouse) -> DataFrame:
    v = wh.dim("dim_vehicles").select(F.col("vehicle_id").alias("v_key"), "make", "model", "year")
    p = wh.dim("dim_payment_methods").select(F.col("payment_method_id").alias("p_key"),
                                             F.col("method_name").alias("payment_method"))
    return (df.join(v, df.vehicle_id == v.v_key, "left")
            .join(p, F.col("payment_method_id") == p.p_key, "left")
            .drop("v_key", "p_key"))


def rides_star(wh: Warehouse) -> DataFrame:
    """Rides with zones (twice), vehicle and payment method, plus calendar names."""
    base = rides(wh).select("ride_id", "customer_id", "driver_id", "vehicle_id", "payment_method_id",
                            "pickup_zone_id", "dropoff_zone_id", "ride_date", "fare_amount",
                            "distance_km", "duration_minutes")
    df = join_vehicle_payment(join_zones_role(base, wh), wh)
    return df.select(
        "ride_id", "customer_id", "driver_id", "vehicle_id", "pickup_zone_id", "dropoff_zone_id",
        "ride_date", "fare_amount", "distance_km", "duration_minutes",
        "pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon", "make", "model", "year",
        "payment_method",
        cal.hour("ride_date").alias("hour"),
        cal.day_name("ride_date").alias("day_of_week"),
        cal.month_name("ride_date").alias("month"))


def weather_zone(wh: Warehouse) -> DataFrame:
    """Weather rows of known zones (inner join) with a known date."""
    w = wh.table("dim_weather").filter(F.col("date").isNotNull())
    z = wh.dim("dim_zones").select(F.col("zone_id").alias("z_key"), "center_lat", "center_lon")
    return (w.join(z, w.zone_id == z.z_key, "inner")
            .select("zone_id", "date", "temperature_2m", "precipitation", "rain", "snowfall",
                    "avg_wind_speed", "center_lat", "center_lon"))


def weather_for_join(wh: Warehouse, cols=("temperature_2m", "precipitation", "rain", "snowfall")) -> DataFrame:
    """Zone-day weather keyed for the ride join.

    The weather grain (zone × calendar day) does not grow with the ride count,
    so AQE normally makes this a broadcast hash join; past the threshold it is a
    sort-merge join on (zone, day), whose keys spread even a hot zone over its days.
    """
    z = wh.dim("dim_zones").select(F.col("zone_id").alias("z_key"))
    return (wh.table("dim_weather").filter(F.col("date").isNotNull())
            .join(z, F.col("zone_id") == z.z_key, "left_semi")
            .select(F.col("zone_id").alias("w_zone"), F.col("date").alias("w_date"), *cols))


def join_weather_day(df: DataFrame, wh: Warehouse, zone_col: str = "pickup_zone_id",
                     ts_col: str = "ride_date", cols=("temperature_2m", "precipitation", "rain", "snowfall")) -> DataFrame:
    """Left join on (zone, calendar day of the ride). Duplicate weather rows fan out."""
    w = weather_for_join(wh, cols)
    return (df.join(w, (F.col(zone_col) == w.w_zone) & (F.to_date(F.col(ts_col)) == w.w_date), "left")
            .drop("w_zone", "w_date"))


def tickets_agents(wh: Warehouse) -> DataFrame:
    t = wh.fact_support_tickets
    a = wh.dim("dim_agents").select(F.col("agent_id").alias("a_key"), "agent_name", "region")
    return (t.join(a, t.agent_id == a.a_key, "left")
            .select("ticket_id", "customer_id", "agent_id", "issue_type", "priority", "status",
                    "opened_at", "closed_at", "resolution_time_minutes", "agent_name", "region"))


# The columns of the rides that the training rows are made of.
TRAINING_COLUMNS = ["ride_id", "customer_id", "driver_id", "vehicle_id", "payment_method_id", "pickup_zone_id",
                    "dropoff_zone_id", "ride_date", "fare_amount", "distance_km", "duration_minutes"]


def fare_rides(wh: Warehouse) -> DataFrame:
    """The fact rides that a fare model can learn from."""
    return (wh.fact_rides
            .filter(F.col("ride_date").isNotNull() & (F.col("fare_amount") > 0)
                    & (F.col("distance_km") > 0) & (F.col("duration_minutes") > 0))
            .select(*TRAINING_COLUMNS))


def fare_training(wh: Warehouse, weather_join: str = "day", week_start: str = "sunday") -> DataFrame:
    """The fare-model training rows: rides with tenure, vehicle, zones, weather and calendar parts.

    ``weather_join="day"`` matches weather on the ride's calendar day;
    ``"exact"`` compares the raw ride timestamp with the weather date, which
    only matches rides at midnight.
    """
    fr = fare_rides(wh)
    c = wh.dim("dim_customers").select(F.col("customer_id").alias("c_key"), "signup_date")
    d = wh.dim("dim_drivers").select(F.col("driver_id").alias("d_key"), "join_date")
    v = wh.dim("dim_vehicles").select(F.col("vehicle_id").alias("v_key"),
                                      F.col("year").alias("vehicle_year"),
                                      F.col("make").alias("vehicle_make"),
                                      F.col("model").alias("vehicle_model"))
    wcols = ["temperature_2m", "precipitation", "rain", "snowfall", "cloud_cover", "avg_wind_speed"]
    w = wh.table("dim_weather").select(
        F.col("zone_id").alias("w_zone"), F.col("date").alias("w_date"), *wcols)
    if weather_join == "day":
        wcond = (fr.pickup_zone_id == w.w_zone) & (F.to_date(fr.ride_date) == w.w_date)
    elif weather_join == "exact":
        wcond = (fr.pickup_zone_id == w.w_zone) & (fr.ride_date == w.w_date.cast("timestamp_ntz"))
    else:
        raise ValueError(f"weather_join must be 'day' or 'exact', got {weather_join!r}")
    df = (join_zones_role(fr, wh)
          .join(c, fr.customer_id == c.c_key, "left")
          .join(d, fr.driver_id == d.d_key, "left")
          .join(v, fr.vehicle_id == v.v_key, "left")
          .join(w, wcond, "left"))
    ts = F.col("ride_date")
    return df.select(
        "ride_id", "customer_id", "driver_id", "vehicle_id", "payment_method_id",
        "pickup_zone_id", "dropoff_zone_id", "ride_date", "fare_amount", "distance_km", "duration_minutes",
        F.datediff(ts, F.col("signup_date")).alias("customer_age_days"),
        F.datediff(ts, F.col("join_date")).alias("driver_experience_days"),
        "vehicle_year", "vehicle_make", "vehicle_model",
        "pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon", *wcols,
        cal.hour(ts).cast("long").alias("hour"),
        cal.day_of_week(ts, week_start).cast("long").alias("day_of_week"),
        cal.month(ts).cast("long").alias("month"),
        cal.year(ts).cast("long").alias("year"))


def fare_features(df: DataFrame) -> DataFrame:
    """Model-ready fare rows: coerced tenure/years, trip, weather and time features."""
    out = df.withColumns({
        "customer_age_days": fx.coerce_numeric(df, "customer_age_days", 0),
        "driver_experience_days": fx.coerce_numeric(df, "driver_experience_days", 0),
        "vehicle_year": fx.coerce_numeric(df, "vehicle_year", fx.DEFAULT_VEHICLE_YEAR),
        "year": fx.coerce_numeric(df, "year", fx.DEFAULT_RIDE_YEAR),
        "distance_km": fx.coerce_numeric(df, "distance_km", 0),
        "duration_minutes": fx.coerce_numeric(df, "duration_minutes", 0),
    })
    out = out.withColumns({
        "vehicle_age": F.col("year") - F.col("vehicle_year"),
        "avg_speed_kmh": fx.avg_speed_kmh("distance_km", "duration_minutes"),
        "zone_distance": fx.zone_distance("pickup_zone_id", "dropoff_zone_id"),
    })
    out = fx.impute_weather(out)
    out = out.withColumn("weather_severity", fx.weather_severity())
    out = fx.time_flags(out)
    return (out.na.drop(subset=["fare_amount", "distance_km", "duration_minutes"])
            .filter(F.col("fare_amount") > 0))


def demand_training(wh: Warehouse, week_start: str = "sunday") -> DataFrame:
    """Rides per (zone, hour, day) with the zone centre and that day's weather.

    Rides are first counted per (zone, day, hour) — a partial + final hash
    aggregate whose output is bounded by zones × days × 24 — and only those
    counts meet the zone and weather dimensions. The final group by the full
    key then merges identical weather duplicates exactly as a group by over
    the row-level join would.
    """
    ts = F.col("ride_date")
    counts = (rides(wh)
              .groupBy(F.col("pickup_zone_id").alias("zone_id"), F.to_date(ts).alias("date"),
                       cal.hour(ts).cast("long").alias("hour"))
              .agg(F.count(F.lit(1)).alias("n")))
    z = wh.dim("dim_zones").select(F.col("zone_id").alias("z_key"), "center_lat", "center_lon")
    wcols = ["temperature_2m", "precipitation", "rain", "snowfall", "cloud_cover", "avg_wind_speed"]
    w = wh.table("dim_weather").select(
        F.col("zone_id").alias("w_zone"), F.col("date").alias("w_date"), *wcols)
    j = (counts.join(z, counts.zone_id == z.z_key, "left")
         .join(w, (counts.zone_id == w.w_zone) & (counts.date == w.w_date), "left"))
    keys = [
        F.col("zone_id"), F.col("hour"),
        cal.day_of_week(F.col("date"), week_start).cast("long").alias("day_of_week"),
        cal.month(F.col("date")).cast("long").alias("month"), cal.year(F.col("date")).cast("long").alias("year"),
        F.col("date"), F.col("center_lat"), F.col("center_lon"), *[F.col(c) for c in wcols],
    ]
    return j.groupBy(*keys).agg(F.sum("n").alias("ride_count"))


def demand_features(df: DataFrame) -> DataFrame:
    out = fx.impute_location(fx.impute_weather(df))
    out = out.withColumn("weather_severity", fx.weather_severity())
    return fx.time_flags(out)
