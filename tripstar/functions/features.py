"""Scalar feature and display expressions (no Python UDF anywhere)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tripstar.functions.calendar import col_

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Weather imputation defaults, location default (New York City centre),
# default years, rush hours, weekend days (in the week convention of the
# caller), night hours, demand-level cut points, speed epsilon.
WEATHER_DEFAULTS = {
    "temperature_2m": 20.0,
    "precipitation": 0.0,
    "rain": 0.0,
    "snowfall": 0.0,
    "cloud_cover": 50.0,
    "avg_wind_speed": 5.0,
}
LOCATION_DEFAULTS = {"center_lat": 40.7128, "center_lon": -74.0060}
DEFAULT_VEHICLE_YEAR = 2020
DEFAULT_RIDE_YEAR = 2024
RUSH_HOURS = [7, 8, 9, 17, 18, 19]
WEEKEND_DAYS = [5, 6]
NIGHT_LAST_HOUR = 5
NIGHT_FIRST_HOUR = 22
DEMAND_LOW_BELOW = 5
DEMAND_MEDIUM_BELOW = 15
SPEED_EPSILON = 1e-6
FARE_FEATURES = [
    "distance_km", "duration_minutes", "avg_speed_kmh",
    "pickup_zone_id", "dropoff_zone_id", "zone_distance",
    "customer_age_days", "driver_experience_days", "vehicle_age",
    "temperature_2m", "precipitation", "weather_severity",
    "cloud_cover", "avg_wind_speed",
    "hour", "day_of_week", "month", "is_weekend", "is_rush_hour", "is_night",
]
DEMAND_FEATURES = [
    "zone_id", "center_lat", "center_lon",
    "temperature_2m", "precipitation", "weather_severity",
    "cloud_cover", "avg_wind_speed",
    "hour", "day_of_week", "month", "is_weekend", "is_rush_hour", "is_night",
]
# ---------------------------------------------------------------------------
# Trip duration must not see its own label or the speed derived from it.
DURATION_FEATURES = [f for f in FARE_FEATURES if f not in ("duration_minutes", "avg_speed_kmh")]


def tenure_days(ride_ts, start_date) -> Column:
    """Whole calendar days from ``start_date`` to the ride; unknown → 0."""
    return F.coalesce(F.datediff(col_(ride_ts), col_(start_date)), F.lit(0))


def vehicle_age(ride_year, vehicle_year) -> Column:
    return (F.coalesce(col_(ride_year), F.lit(DEFAULT_RIDE_YEAR))
            - F.coalesce(col_(vehicle_year), F.lit(DEFAULT_VEHICLE_YEAR)))


def avg_speed_kmh(distance_km, duration_minutes) -> Column:
    return col_(distance_km).cast("double") / (col_(duration_minutes).cast("double") / 60 + SPEED_EPSILON)


def zone_distance(pickup, dropoff) -> Column:
    """Absolute difference of zone ids (an id distance, not a geographic one)."""
    return F.abs(col_(pickup) - col_(dropoff))


def impute(df: DataFrame, defaults: dict) -> DataFrame:
    present = {k: v for k, v in defaults.items() if k in df.columns}
    return df.na.fill(present)


def impute_weather(df: DataFrame) -> DataFrame:
    return impute(df, WEATHER_DEFAULTS)


def impute_location(df: DataFrame) -> DataFrame:
    return impute(df, LOCATION_DEFAULTS)


def weather_severity(precipitation="precipitation", rain="rain", snowfall="snowfall") -> Column:
    return col_(precipitation) + col_(rain) + col_(snowfall)


def is_weekend(day_of_week) -> Column:
    return col_(day_of_week).isin(WEEKEND_DAYS).cast("int")


def is_rush_hour(hour) -> Column:
    return col_(hour).isin(RUSH_HOURS).cast("int")


def is_night(hour) -> Column:
    h = col_(hour)
    return ((h <= NIGHT_LAST_HOUR) | (h >= NIGHT_FIRST_HOUR)).cast("int")


def time_flags(df: DataFrame, hour="hour", day_of_week="day_of_week") -> DataFrame:
    return df.withColumns({
        "is_weekend": is_weekend(day_of_week),
        "is_rush_hour": is_rush_hour(hour),
        "is_night": is_night(hour),
    })


def weather_condition(rain="rain", snowfall="snowfall") -> Column:
    """Snowy beats Rainy beats Clear; rides without weather are Clear."""
    return (F.when(col_(snowfall) > 0, F.lit("Snowy"))
            .when(col_(rain) > 0, F.lit("Rainy"))
            .otherwise(F.lit("Clear")))


def numeric_or(c, default) -> Column:
    """Text or number → double; unparseable or null → ``default``."""
    return F.coalesce(F.trim(col_(c).cast("string")).try_cast("double"), F.lit(float(default)))


def coerce_numeric(df: DataFrame, c: str, default) -> Column:
    """``numeric_or`` that skips the text round trip when ``c`` is already numeric."""
    if isinstance(df.schema[c].dataType, NumericType):
        return F.coalesce(F.col(c).cast("double"), F.lit(float(default)))
    return numeric_or(c, default)


def demand_level(pred) -> Column:
    p = col_(pred)
    return (F.when(p < DEMAND_LOW_BELOW, F.lit("Low"))
            .when(p < DEMAND_MEDIUM_BELOW, F.lit("Medium"))
            .otherwise(F.lit("High")))


def demand_rounded(pred) -> Column:
    """Nearest whole ride count, halves to even."""
    return F.bround(col_(pred), 0).cast("long")


def minutes_to_hours(minutes) -> Column:
    return col_(minutes) / 60


def vehicle_label(make="make", model="model") -> Column:
    """``make model``; null when either part is null."""
    return F.concat(col_(make), F.lit(" "), col_(model))


def trip_factors(distance_km="distance_km", duration_minutes="duration_minutes",
                 avg_speed="avg_speed_kmh", zone_dist="zone_distance",
                 severity="weather_severity", weekend="is_weekend", rush="is_rush_hour") -> dict[str, Column]:
    """Display strings explaining one fare prediction."""
    return {
        "distance_text": F.format_string("%.1f km", col_(distance_km).cast("double")),
        "duration_text": F.format_string("%d min", col_(duration_minutes).cast("int")),
        "speed_text": F.format_string("%.1f km/h", col_(avg_speed).cast("double")),
        "zone_distance_text": col_(zone_dist).cast("string"),
        "weather_text": F.format_string("%.1f mm precipitation", col_(severity).cast("double")),
        "time_period_text": F.concat(
            F.when(col_(weekend) == 1, F.lit("Weekend")).otherwise(F.lit("Weekday")),
            F.lit(", "),
            F.when(col_(rush) == 1, F.lit("Rush Hour")).otherwise(F.lit("Normal"))),
    }


def demand_factors(zone="zone_id", lat="center_lat", lon="center_lon", hour="hour", temperature="temperature_2m",
                   precipitation="precipitation", weekend="is_weekend", rush="is_rush_hour",
                   night="is_night") -> dict[str, Column]:
    """Display strings explaining one demand prediction."""
    return {
        "zone_text": F.concat(F.lit("Zone "), col_(zone).cast("string")),
        "location_text": F.format_string("(%.4f, %.4f)", col_(lat).cast("double"), col_(lon).cast("double")),
        "time_text": F.concat(col_(hour).cast("string"), F.lit(":00 "),
                              F.when(col_(rush) == 1, F.lit("(Rush Hour)")).otherwise(F.lit("")),
                              F.when(col_(night) == 1, F.lit("(Night)")).otherwise(F.lit(""))),
        "weather_text": F.concat(col_(temperature).cast("string"), F.lit("°C, "), col_(precipitation).cast("string"),
                                 F.lit("mm precipitation")),
        "day_type_text": F.when(col_(weekend) == 1, F.lit("Weekend")).otherwise(F.lit("Weekday")),
    }
