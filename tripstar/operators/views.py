"""Projection, filter and join operators over the star views.

Every function takes a ``Warehouse`` and returns a lazy DataFrame over the
whole fact or dimension it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstar.functions import calendar as cal
from tripstar.functions import features as fx
from tripstar.operators import star
from tripstar.operators import questions as qs
from tripstar.sources.warehouse import Warehouse


# ---------------------------------------------------------------- sources
def src_rides_star(wh: Warehouse) -> DataFrame:
    return star.rides_star(wh).withColumn("hour", F.col("hour").cast("long"))


def src_weather_zone(wh: Warehouse) -> DataFrame:
    return star.weather_zone(wh)


def src_tickets_agents(wh: Warehouse) -> DataFrame:
    return star.tickets_agents(wh)


def src_fare_training(wh: Warehouse) -> DataFrame:
    return star.fare_training(wh)


def src_demand_training(wh: Warehouse) -> DataFrame:
    return star.demand_training(wh)


# ---------------------------------------------------------------- projections
def proj_calendar_names(wh: Warehouse) -> DataFrame:
    return star.rides(wh).select("ride_id", "ride_date", cal.hour("ride_date").cast("long").alias("hour"),
                                 cal.day_name("ride_date").alias("day_of_week"),
                                 cal.month_name("ride_date").alias("month"))


def proj_calendar_parts(wh: Warehouse) -> DataFrame:
    ts = F.col("ride_date")
    return star.rides(wh).select(
        "ride_id", "ride_date", cal.hour(ts).cast("long").alias("hour"),
        cal.dow_sunday0(ts).cast("long").alias("day_of_week"), cal.month(ts).cast("long").alias("month"),
        cal.year(ts).cast("long").alias("year"), cal.date_only(ts).alias("date"))


def proj_date_only(wh: Warehouse) -> DataFrame:
    return star.rides(wh).select("ride_id", "ride_date", cal.date_only("ride_date").alias("ride_date_only"))


def _tenure_frame(wh: Warehouse) -> DataFrame:
    fr = wh.fact_rides.select("ride_id", "customer_id", "driver_id", "ride_date")
    c = wh.dim("dim_customers").select(F.col("customer_id").alias("c_key"), "signup_date")
    d = wh.dim("dim_drivers").select(F.col("driver_id").alias("d_key"), "join_date")
    return (fr.join(c, fr.customer_id == c.c_key, "left")
            .join(d, fr.driver_id == d.d_key, "left"))


def proj_tenure_days(wh: Warehouse) -> DataFrame:
    return _tenure_frame(wh).select(
        "ride_id", fx.tenure_days("ride_date", "signup_date").alias("customer_age_days"),
        fx.tenure_days("ride_date", "join_date").alias("driver_experience_days"))


def proj_vehicle_age(wh: Warehouse) -> DataFrame:
    fr = wh.fact_rides.select("ride_id", "vehicle_id", "ride_date")
    v = wh.dim("dim_vehicles").select(F.col("vehicle_id").alias("v_key"), F.col("year").alias("vehicle_year"))
    return (fr.join(v, fr.vehicle_id == v.v_key, "left")
            .select("ride_id", fx.vehicle_age(cal.year("ride_date"), "vehicle_year").alias("vehicle_age")))


def proj_avg_speed(wh: Warehouse) -> DataFrame:
    return wh.fact_rides.select(
        "ride_id", fx.avg_speed_kmh(F.coalesce(F.col("distance_km").cast("double"), F.lit(0.0)),
                                    F.coalesce(F.col("duration_minutes").cast("double"), F.lit(0.0)))
        .alias("avg_speed_kmh"))


def proj_zone_distance(wh: Warehouse) -> DataFrame:
    return wh.fact_rides.select("ride_id", fx.zone_distance("pickup_zone_id", "dropoff_zone_id")
                                .alias("zone_distance"))


def _rides_weather_full(wh: Warehouse) -> DataFrame:
    return star.join_weather_day(star.rides(wh).select("ride_id", "pickup_zone_id", "ride_date"), wh,
                                 cols=tuple(fx.WEATHER_DEFAULTS))


def proj_weather_impute(wh: Warehouse) -> DataFrame:
    return fx.impute_weather(_rides_weather_full(wh)).select("ride_id", *fx.WEATHER_DEFAULTS)


def proj_weather_severity(wh: Warehouse) -> DataFrame:
    return (fx.impute_weather(_rides_weather_full(wh))
            .select("ride_id", fx.weather_severity().alias("weather_severity")))


def proj_location_impute(wh: Warehouse) -> DataFrame:
    fr = wh.fact_rides.select("ride_id", "dropoff_zone_id")
    z = wh.dim("dim_zones").select(F.col("zone_id").alias("z_key"), "center_lat", "center_lon")
    return fx.impute_location(fr.join(z, fr.dropoff_zone_id == z.z_key, "left")).select(
        "ride_id", "dropoff_zone_id", "center_lat", "center_lon")


def proj_time_flags(wh: Warehouse) -> DataFrame:
    ts = F.col("ride_date")
    df = star.rides(wh).select("ride_id", cal.hour(ts).cast("long").alias("hour"),
                               cal.dow_sunday0(ts).cast("long").alias("day_of_week"))
    return fx.time_flags(df)


def proj_weather_condition(wh: Warehouse) -> DataFrame:
    return star.join_weather_day(star.rides(wh).select("ride_id", "pickup_zone_id", "ride_date"), wh).select(
        "ride_id", fx.weather_condition().alias("weather_condition"))


def proj_numeric_coerce(wh: Warehouse) -> DataFrame:
    """Text → number with a default: a numeric text column and a JSON one that never parses."""
    return wh.raw.events.select("event_id", fx.numeric_or(F.col("value"), 0).alias("value_num"),
                                fx.numeric_or(F.col("props"), -1).alias("props_num"))


def fare_feature_rows(wh: Warehouse) -> DataFrame:
    return star.fare_features(star.fare_training(wh))


def proj_feature_vector_fare(wh: Warehouse) -> DataFrame:
    df = fare_feature_rows(wh)
    return df.select("ride_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                  for c in fx.FARE_FEATURES],
                     F.col("fare_amount").cast("double").alias("label"))


def demand_feature_rows(wh: Warehouse) -> DataFrame:
    return star.demand_features(star.demand_training(wh))


def proj_feature_vector_demand(wh: Warehouse) -> DataFrame:
    df = demand_feature_rows(wh)
    return df.select("date", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                               for c in fx.DEMAND_FEATURES],
                     F.col("ride_count").cast("double").alias("label"))


def zone_hour_baseline(wh: Warehouse) -> DataFrame:
    """Historical-average demand per (zone, hour): a transparent baseline prediction."""
    g = star.demand_training(wh)
    return (g.groupBy("zone_id", "hour")
            .agg((F.sum("ride_count").cast("double") / F.count("ride_count")).alias("predicted_demand")))


def proj_demand_level(wh: Warehouse) -> DataFrame:
    return zone_hour_baseline(wh).withColumn("demand_level", fx.demand_level("predicted_demand"))


def proj_demand_rounded(wh: Warehouse) -> DataFrame:
    return zone_hour_baseline(wh).withColumn("predicted_rides", fx.demand_rounded("predicted_demand"))


def proj_minutes_to_hours(wh: Warehouse) -> DataFrame:
    return wh.fact_support_tickets.select(
        "ticket_id", fx.minutes_to_hours("resolution_time_minutes").alias("resolution_hours"))


def proj_vehicle_label(wh: Warehouse) -> DataFrame:
    fr = star.rides(wh).select("ride_id", "vehicle_id")
    v = wh.dim("dim_vehicles").select(F.col("vehicle_id").alias("v_key"), "make", "model")
    return (fr.join(v, fr.vehicle_id == v.v_key, "left")
            .select("ride_id", fx.vehicle_label().alias("vehicle_label")))


def proj_trip_factors(wh: Warehouse) -> DataFrame:
    df = fare_feature_rows(wh)
    return df.select("ride_id", *[c.alias(n) for n, c in fx.trip_factors().items()])


def proj_demand_factors(wh: Warehouse) -> DataFrame:
    df = demand_feature_rows(wh)
    return df.select("zone_id", "date", "hour", *[c.alias(n) for n, c in fx.demand_factors().items()])


def proj_calendar_parts_monday(wh: Warehouse) -> DataFrame:
    """Day of week with the Monday week start that is the default outside the parity queries."""
    return star.rides(wh).select("ride_id", "ride_date",
                                 cal.day_of_week("ride_date", "monday").cast("long").alias("day_of_week"))


# ---------------------------------------------------------------- filters
def flt_ride_date(wh: Warehouse) -> DataFrame:
    return star.rides(wh).select("ride_id", "ride_date")


def flt_weather_date(wh: Warehouse) -> DataFrame:
    return wh.dim_weather.filter(F.col("date").isNotNull()).select("zone_id", "date")


def flt_fare_valid(wh: Warehouse) -> DataFrame:
    return (wh.fact_rides.filter((F.col("fare_amount") > 0) & (F.col("distance_km") > 0)
                                 & (F.col("duration_minutes") > 0))
            .select("ride_id", "fare_amount", "distance_km", "duration_minutes"))


def flt_dropna_fare(wh: Warehouse) -> DataFrame:
    return fare_feature_rows(wh).select("ride_id", F.col("fare_amount").cast("double").alias("fare_amount"),
                                        "distance_km", "duration_minutes")


def flt_min_rides(wh: Warehouse, min_rides: int = 5) -> DataFrame:
    return (star.rides(wh).filter(F.col("driver_id").isNotNull()).groupBy("driver_id")
            .agg(F.count("ride_id").alias("ride_count"))
            .filter(F.col("ride_count") >= min_rides))


def flt_temp_present(wh: Warehouse) -> DataFrame:
    return (star.join_weather_day(star.rides(wh).select("ride_id", "pickup_zone_id", "ride_date"), wh)
            .filter(F.col("temperature_2m").isNotNull()).select("ride_id", "temperature_2m"))


# Default slice of flt_slice: one year, three zones, two payment methods.
SLICE_DEFAULT = {"start": "1996-01-01", "end": "1996-12-31", "zones": [0, 4, 8], "methods": ["Cash", "Card"]}


def flt_slice(wh: Warehouse, start: str = SLICE_DEFAULT["start"], end: str = SLICE_DEFAULT["end"],
              zones=tuple(SLICE_DEFAULT["zones"]), methods=tuple(SLICE_DEFAULT["methods"])) -> DataFrame:
    """Rides of a date range, a zone set and a payment-method set.

    The date predicate is on the partition column of a loaded warehouse, so it
    prunes partitions (statically, or dynamically through the payment join).
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    fr = wh.fact_rides
    if "ride_month" in fr.columns:  # a loaded warehouse: the range prunes month folders, then row groups by day
        fr = fr.filter(F.col("ride_month").between(F.trunc(lo, "month"), F.trunc(hi, "month"))
                       & F.col("ride_day").between(lo, hi))
    fr = fr.filter(F.to_date("ride_date").between(lo, hi) & F.col("pickup_zone_id").isin(list(zones)))
    p = wh.dim("dim_payment_methods").filter(F.col("method_name").isin(list(methods)))
    return (fr.join(p, "payment_method_id")
            .select("ride_id", "ride_date", "pickup_zone_id", "method_name", "fare_amount"))


# ---------------------------------------------------------------- joins
def join_zones_role(wh: Warehouse) -> DataFrame:
    fr = wh.fact_rides.select("ride_id", "pickup_zone_id", "dropoff_zone_id")
    return star.join_zones_role(fr, wh).select("ride_id", "pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon")


def join_vehicle_payment(wh: Warehouse) -> DataFrame:
    fr = wh.fact_rides.select("ride_id", "vehicle_id", "payment_method_id")
    return star.join_vehicle_payment(fr, wh).select("ride_id", "make", "model", "year", "payment_method")


def join_tenure(wh: Warehouse) -> DataFrame:
    return _tenure_frame(wh).select("ride_id", "signup_date", "join_date")


def join_weather_zone_inner(wh: Warehouse) -> DataFrame:
    return star.weather_zone(wh).select("zone_id", "date", "center_lat", "center_lon")


def join_agents(wh: Warehouse) -> DataFrame:
    return star.tickets_agents(wh).select("ticket_id", "agent_id", "agent_name", "region")


def join_weather_day(wh: Warehouse) -> DataFrame:
    return star.join_weather_day(star.rides(wh).select("ride_id", "pickup_zone_id", "ride_date"), wh).select(
        "ride_id", "temperature_2m", "precipitation", "rain", "snowfall")


def join_weather_exact(wh: Warehouse) -> DataFrame:
    return star.fare_training(wh, weather_join="exact").select(
        "ride_id", "temperature_2m", "precipitation", "rain", "snowfall", "cloud_cover", "avg_wind_speed")


def join_calendar_reindex(wh: Warehouse) -> DataFrame:
    """Tickets opened per weekday, all seven days listed Monday first."""
    counts = (wh.fact_support_tickets.groupBy(cal.dow_monday0("opened_at").alias("day_order"))
              .agg(F.count(F.lit(1)).alias("tickets")))
    return qs.join_calendar_reindex(counts, wh.spark, "tickets")

