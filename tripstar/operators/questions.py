"""The dashboard's business questions as DataFrame plans.

Conventions (the pandas/Spark differences of SURVEY §1.4):

* null group keys are dropped (pandas ``groupby`` drops them, Spark keeps them);
* a mean of money or minutes is ``double(sum) / count`` of the non-null
  values — exact decimal/integer sums, so the result does not depend on the
  summation order across partitions;
* every top-k has a total order (the group key breaks ties ascending) and is
  a ``TakeOrderedAndProject`` (per-partition heaps, no global sort).

Where a question only needs per-(zone, day) statistics of rides, rides are
aggregated to that grain *before* meeting the weather dimension, so the
shuffle carries zone × day rows instead of rides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstar.functions import calendar as cal
from tripstar.functions import features as fx
from tripstar.operators import star
from tripstar.sources.warehouse import Warehouse


def mean_of(c: str):
    """Order-independent mean of a decimal or integer column (nulls skipped)."""
    return F.sum(c).cast("double") / F.count(c)


def top_k(df: DataFrame, k: int, by: str, keys: list[str], ascending: bool = False) -> DataFrame:
    order = [F.col(by).asc() if ascending else F.col(by).desc()] + [F.col(c).asc() for c in keys]
    return df.orderBy(*order).limit(k)


def count_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


# ---------------------------------------------------------------- tab 1: rides & demand
def q01_top_pickup_zones(wh: Warehouse, k: int = 10) -> DataFrame:
    return top_k(count_by(star.rides(wh), "pickup_zone_id", "rides"), k, "rides", ["pickup_zone_id"])


def q01_top_dropoff_zones(wh: Warehouse, k: int = 10) -> DataFrame:
    return top_k(count_by(star.rides(wh), "dropoff_zone_id", "rides"), k, "rides", ["dropoff_zone_id"])


def calendar_days(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(cal.DAY_ORDER)), "day_order int, day_of_week string")


def join_calendar_reindex(counts: DataFrame, spark, value: str) -> DataFrame:
    """All seven weekdays, Monday first; a weekday without rows gets null."""
    days = calendar_days(spark)
    return (counts.join(days, "day_order", "right")
            .select("day_order", "day_of_week", value))


def q02_demand_by_weekday(wh: Warehouse) -> DataFrame:
    counts = (star.rides(wh)
              .groupBy(cal.dow_monday0("ride_date").alias("day_order"))
              .agg(F.count(F.lit(1)).alias("ride_count")))
    return join_calendar_reindex(counts, wh.spark, "ride_count").orderBy("day_order")


def q03_avg_fare_by_zone(wh: Warehouse, min_rides: int = 5, k: int = 15) -> DataFrame:
    g = (star.rides(wh).filter(F.col("pickup_zone_id").isNotNull())
         .groupBy(F.col("pickup_zone_id").alias("zone_id"))
         .agg(mean_of("fare_amount").alias("avg_fare"), F.count("ride_id").alias("ride_count"))
         .filter(F.col("ride_count") >= min_rides))
    return top_k(g, k, "avg_fare", ["zone_id"])


def trip_kpis(wh: Warehouse) -> DataFrame:
    """q04 trip metrics and the revenue KPIs in one pass over the rides."""
    return star.rides(wh).agg(
        mean_of("distance_km").alias("avg_distance_km"),
        mean_of("duration_minutes").alias("avg_duration_min"),
        mean_of("fare_amount").alias("avg_fare"),
        F.sum("fare_amount").cast("double").alias("total_revenue"),
        F.count(F.lit(1)).alias("total_rides"),
        F.sum("distance_km").cast("double").alias("total_distance_km"))


def q04_trip_metrics(wh: Warehouse) -> DataFrame:
    return trip_kpis(wh).select("avg_distance_km", "avg_duration_min", "avg_fare")


def q04_trip_sample(wh: Warehouse, n: int = 1000, seed: int = 42) -> DataFrame:
    """A reproducible sample of ``min(n, rows)`` rides for the distance/duration scatter.

    Rows are ranked by ``md5(seed:ride_id)`` (then by every sampled column, for
    repeated ride ids); the smallest ``n`` are kept via per-partition heaps.
    """
    r = star.rides(wh).select("ride_id", "distance_km", "duration_minutes", "fare_amount")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("ride_id").cast("string")))
    return (r.orderBy(key, "ride_id", F.col("distance_km").asc_nulls_first(), "duration_minutes", "fare_amount")
            .limit(n))


def q05_vehicle_revenue(wh: Warehouse, k: int = 10) -> DataFrame:
    """Revenue and rides per vehicle make and model, top ``k`` by revenue.

    Rides are summed per vehicle first (partial aggregation on the fact side),
    so only one row per vehicle reaches the vehicle dimension.
    """
    per_vehicle = (star.rides(wh).filter(F.col("vehicle_id").isNotNull())
                   .groupBy("vehicle_id")
                   .agg(F.sum("fare_amount").alias("rev"), F.count("ride_id").alias("n")))
    v = wh.dim("dim_vehicles").select(F.col("vehicle_id").alias("v_key"), "make", "model")
    g = (per_vehicle.join(v, per_vehicle.vehicle_id == v.v_key, "inner")
         .filter(F.col("make").isNotNull() & F.col("model").isNotNull())
         .groupBy("make", "model")
         .agg(F.sum("rev").cast("double").alias("total_revenue"), F.sum("n").alias("rides"))
         .withColumn("vehicle_label", fx.vehicle_label()))
    return top_k(g, k, "total_revenue", ["make", "model"]).select(
        "make", "model", "vehicle_label", "total_revenue", "rides")


# ---------------------------------------------------------------- tab 2: weather
def zone_day_ride_stats(wh: Warehouse) -> DataFrame:
    """Per (pickup zone, ride day): ride count and exact sums for the weather questions."""
    return (star.rides(wh)
            .groupBy(F.col("pickup_zone_id").alias("zone_id"), F.to_date("ride_date").alias("day"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum("duration_minutes").alias("dur_sum"), F.count("duration_minutes").alias("dur_n"),
                 F.sum("distance_km").alias("dist_sum"), F.count("distance_km").alias("dist_n"),
                 F.sum("fare_amount").alias("fare_sum"), F.count("fare_amount").alias("fare_n")))


def zone_day_with_weather(wh: Warehouse) -> DataFrame:
    """Zone-day ride stats left-joined to that zone-day's weather (fan-out kept)."""
    s = zone_day_ride_stats(wh)
    w = star.weather_for_join(wh)
    return s.join(w, (s.zone_id == w.w_zone) & (s.day == w.w_date), "left")


def q06_weather_demand(wh: Warehouse) -> DataFrame:
    return (zone_day_with_weather(wh)
            .groupBy(fx.weather_condition().alias("weather_condition"))
            .agg(F.sum("n").alias("rides")))


def _rounded_edge(x, places):
    """``x`` to so many decimal places, halves to even; below 1 the places count from the first digit that is not 0."""
    digits = F.when((x != 0) & (F.abs(x) < 1), -F.floor(F.log10(F.abs(x))) - 1 + places).otherwise(places)
    scale = F.pow(F.lit(10.0), digits.cast("double"))
    return F.rint(x * scale) / scale


def _bin_label(lower, upper, places):
    """``(lower, upper]``, both ends rounded."""
    def shown(c):
        text = F.regexp_replace(F.format_string("%.12f", _rounded_edge(c, places)), "0+$", "")
        return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)
    return F.concat(F.lit("("), shown(lower), F.lit(", "), shown(upper), F.lit("]"))


def _one(column):
    """The column as it is, computed once: a generated row isn't merged into the expressions that use it."""
    return F.explode(F.array(column))


def _bin_edges(temps: DataFrame, nbins: int) -> DataFrame:
    """One row (no row without rides): the ``edges`` of the bins and the ``places`` their labels show."""
    wide = lambda c: F.when(c != 0, F.abs(c) * 0.001).otherwise(F.lit(0.001))
    lo, hi, a, b = (F.col(c) for c in ("lo", "hi", "a", "b"))
    # the sum of n keeps this aggregate's input that of the counts, so both read one exchange
    ends = (temps.agg(F.min("temperature_2m").alias("lo"), F.max("temperature_2m").alias("hi"), F.sum("n").alias("rides"))
            .filter("rides > 0")
            .withColumns({"a": F.when(lo == hi, lo - wide(lo)).otherwise(lo),
                          "b": F.when(lo == hi, hi + wide(hi)).otherwise(hi)}))
    inner = [F.lit(float(i)) * ((b - a) / nbins) + a for i in range(1, nbins)]
    first = F.when(lo == hi, a).otherwise(a - (hi - lo) * 0.001)
    edges = ends.select(_one(F.array(first, *inner, b)).alias("edges"))

    # the fewest places, three at least, at which all edges differ
    def apart(p):
        return F.size(F.array_distinct(F.transform("edges", lambda e: _rounded_edge(e, p)))) == nbins + 1

    enough = F.filter(F.sequence(F.lit(3), F.lit(11)), apart)
    return edges.select("edges", _one(F.coalesce(F.get(enough, F.lit(0)), F.lit(12))).alias("places"))


def q06_temperature_bins(wh: Warehouse, nbins: int = 10) -> DataFrame:
    """Rides per equal-width, right-closed temperature bin (rides with a temperature only), with its label.

    The edges come from one row over the distinct temperatures, which the counts read as a scalar subquery, so no job
    runs while the query is built and nothing is cached. The first edge lies a thousandth of the range below the least
    value; when all values are equal the range is widened by a thousandth of the value on both sides. Empty bins
    are kept by a left join from the list of bin numbers.
    """
    temps = (zone_day_with_weather(wh).filter(F.col("temperature_2m").isNotNull())
             .groupBy("temperature_2m").agg(F.sum("n").alias("n")))
    edges = _bin_edges(temps, nbins)
    k = F.col("temp_bin")
    bins = (edges.select("edges", "places", F.explode(F.sequence(F.lit(1), F.lit(nbins))).alias("temp_bin"))
            .select("temp_bin", F.element_at("edges", k).alias("bin_lower"), F.element_at("edges", k + 1).alias("bin_upper"),
                    "places"))
    # a temperature's bin: 1 + the inner edges strictly below it
    placed = temps.select("temperature_2m", "n", _one(edges.select("edges").scalar()).alias("edges"))
    number = F.lit(1) + F.size(F.filter(F.slice("edges", 2, nbins - 1), lambda e: e < F.col("temperature_2m")))
    counts = placed.groupBy(number.cast("int").alias("temp_bin")).agg(F.sum("n").alias("rides"))
    return (bins.join(counts, "temp_bin", "left")
            .select("temp_bin", "bin_lower", "bin_upper",
                    F.coalesce(F.col("rides"), F.lit(0).cast("long")).alias("rides"),
                    _bin_label(F.col("bin_lower"), F.col("bin_upper"), F.col("places")).alias("temp_range"))
            .orderBy("temp_bin"))


def q07_weather_trip_metrics(wh: Warehouse) -> DataFrame:
    return (zone_day_with_weather(wh)
            .groupBy(fx.weather_condition().alias("weather_condition"))
            .agg((F.sum("dur_sum").cast("double") / F.sum("dur_n")).alias("avg_duration_min"),
                 (F.sum("dist_sum").cast("double") / F.sum("dist_n")).alias("avg_distance_km"),
                 (F.sum("fare_sum").cast("double") / F.sum("fare_n")).alias("avg_fare")))


# ---------------------------------------------------------------- tab 3: support
def q08_issue_types(wh: Warehouse) -> DataFrame:
    return count_by(wh.fact_support_tickets, "issue_type", "tickets").orderBy(
        F.col("tickets").desc(), "issue_type")


def _resolution_by(wh: Warehouse, key: str, ascending: bool) -> DataFrame:
    g = (wh.fact_support_tickets.filter(F.col(key).isNotNull()).groupBy(key)
         .agg(fx.minutes_to_hours(mean_of("resolution_time_minutes")).alias("avg_resolution_hours")))
    o = F.col("avg_resolution_hours")
    return g.orderBy(o.asc_nulls_last() if ascending else o.desc_nulls_last(), key)


def q09_resolution_by_issue(wh: Warehouse) -> DataFrame:
    return _resolution_by(wh, "issue_type", ascending=False)


def q09_resolution_by_priority(wh: Warehouse) -> DataFrame:
    return _resolution_by(wh, "priority", ascending=True)


def q10_agent_performance(wh: Warehouse, k: int = 10) -> DataFrame:
    """Tickets and mean resolution per agent name; tickets without an agent are dropped.

    Tickets are reduced per agent id before meeting the (bounded) agent dimension.
    """
    per_agent = (wh.fact_support_tickets.filter(F.col("agent_id").isNotNull())
                 .groupBy("agent_id")
                 .agg(F.count("ticket_id").alias("n"),
                      F.sum("resolution_time_minutes").alias("res_sum"),
                      F.count("resolution_time_minutes").alias("res_n")))
    a = wh.dim("dim_agents").select(F.col("agent_id").alias("a_key"), "agent_name")
    g = (per_agent.join(a, per_agent.agent_id == a.a_key, "inner")
         .filter(F.col("agent_name").isNotNull())
         .groupBy("agent_name")
         .agg(F.sum("n").alias("tickets"),
              (F.sum("res_sum").cast("double") / F.sum("res_n")).alias("avg_resolution_min")))
    return top_k(g, k, "tickets", ["agent_name"])


# ---------------------------------------------------------------- tab 4: revenue
def rev_overall(wh: Warehouse) -> DataFrame:
    return trip_kpis(wh).select("total_revenue", "total_rides",
                                F.col("avg_fare").alias("avg_revenue_per_ride"), "total_distance_km")


def rev_by_driver(wh: Warehouse, k: int = 15) -> DataFrame:
    g = (star.rides(wh).filter(F.col("driver_id").isNotNull()).groupBy("driver_id")
         .agg(F.sum("fare_amount").cast("double").alias("total_revenue"),
              F.count("fare_amount").alias("rides"),
              mean_of("fare_amount").alias("avg_fare")))
    return top_k(g, k, "total_revenue", ["driver_id"])


def rev_daily(wh: Warehouse) -> DataFrame:
    return (star.rides(wh).groupBy(F.to_date("ride_date").alias("date"))
            .agg(F.sum("fare_amount").cast("double").alias("revenue"), F.count("ride_id").alias("rides"))
            .orderBy("date"))


# ---------------------------------------------------------------- model inputs and profiles
def agg_demand_grain(wh: Warehouse) -> DataFrame:
    return star.demand_training(wh)


# The issue types of the support fact, in column order.
ISSUE_TYPES = ["App", "Driver", "Fare", "Other", "Vehicle"]


def agg_customer_ticket_profile(wh: Warehouse) -> DataFrame:
    """One row per customer: ticket count, mean resolution, and a count per issue type."""
    t = wh.fact_support_tickets.filter(F.col("customer_id").isNotNull())
    per_issue = [F.count(F.when(F.col("issue_type") == v, 1)).alias(v) for v in ISSUE_TYPES]
    return (t.groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("ticket_count"),
                 mean_of("resolution_time_minutes").alias("avg_resolution_time"),
                 *per_issue))


def agg_zone_risk(wh: Warehouse, risk_rate: float = 0.12) -> DataFrame:
    """Rides per pickup zone and a risk score proportional to them, highest first."""
    return (count_by(star.rides(wh), "pickup_zone_id", "total_rides")
            .withColumn("risk_score", F.lit(float(risk_rate)) * F.col("total_rides"))
            .orderBy(F.col("total_rides").desc(), "pickup_zone_id"))


# ---------------------------------------------------------------- claimed in the menu
def q_demand_by_hour(wh: Warehouse) -> DataFrame:
    return (star.rides(wh).groupBy(cal.hour("ride_date").cast("long").alias("hour"))
            .agg(F.count(F.lit(1)).alias("rides")).orderBy("hour"))


def q_demand_by_month(wh: Warehouse) -> DataFrame:
    return (star.rides(wh)
            .groupBy(cal.month("ride_date").cast("long").alias("month"),
                     cal.month_name("ride_date").alias("month_name"))
            .agg(F.count(F.lit(1)).alias("rides")).orderBy("month"))


def q_avg_tip_by_zone(wh: Warehouse) -> DataFrame:
    return (star.rides(wh).filter(F.col("pickup_zone_id").isNotNull())
            .groupBy("pickup_zone_id")
            .agg(mean_of("tip_amount").alias("avg_tip"), F.count("tip_amount").alias("rides"))
            .orderBy("pickup_zone_id"))


WEATHER_CORR_COLS = ["temperature_2m", "precipitation", "rain", "snowfall", "cloud_cover", "avg_wind_speed"]


def q_weather_duration_corr(wh: Warehouse) -> DataFrame:
    """Pearson correlation of trip duration with each weather variable (matched rides).

    Weather is constant over a zone's day, so the moments of its rides' durations (count, sum, sum of squares) are all
    that the correlation needs of them: rides are aggregated first, and only zone-days are joined to the weather."""
    y = F.col("duration_minutes").cast("double")
    days = (star.rides(wh).filter(F.col("duration_minutes").isNotNull())
            .groupBy("pickup_zone_id", F.to_date("ride_date").alias("day"))
            .agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q")))
    cols = WEATHER_CORR_COLS
    w = wh.table("dim_weather").select(F.col("zone_id").alias("w_zone"), F.col("date").alias("w_date"), *cols)
    j = days.join(w, (days.pickup_zone_id == w.w_zone) & (days.day == w.w_date), "inner")

    def corr(c):
        own = F.col(c).isNotNull()
        total = lambda e: F.sum(F.when(own, e))
        n, x = F.col("n"), F.col(c)
        m, sx, sy = total(n), total(n * x), total(F.col("s"))
        cov = m * total(F.col("s") * x) - sx * sy
        both = (m * total(n * x * x) - sx * sx) * (m * total(F.col("q")) - sy * sy)
        return F.round(F.try_divide(cov, F.sqrt(F.greatest(both, F.lit(0.0)))), 6).alias(f"corr_{c}")

    return j.agg(*[corr(c) for c in cols])


def q_issue_by_location(wh: Warehouse) -> DataFrame:
    """Tickets per pickup zone of their ride and issue type.

    Tickets are counted per (ride, issue) and joined once to the rides' zones, one
    zone a ride: the ride side is aggregated by ride_id on the join's own key.
    """
    t = (wh.fact_support_tickets.filter(F.col("ride_id").isNotNull() & F.col("issue_type").isNotNull())
         .groupBy("ride_id", "issue_type").agg(F.count(F.lit(1)).alias("n")))
    loc = (wh.fact_rides.filter(F.col("pickup_zone_id").isNotNull())
           .groupBy("ride_id").agg(F.min("pickup_zone_id").alias("pickup_zone_id")))
    return (t.join(loc, "ride_id").groupBy("pickup_zone_id", "issue_type")
            .agg(F.sum("n").alias("tickets")).orderBy("pickup_zone_id", "issue_type"))


def q_driver_complaints(wh: Warehouse) -> DataFrame:
    """Complaints per driver, the driver's rides, and complaints per 100 rides."""
    c = (wh.fact_support_tickets.filter(F.col("driver_id").isNotNull())
         .groupBy("driver_id").agg(F.count(F.lit(1)).alias("complaints")))
    r = (wh.fact_rides.filter(F.col("driver_id").isNotNull()).groupBy(F.col("driver_id").alias("r_driver"))
         .agg(F.count(F.lit(1)).alias("rides")))
    return (c.join(r, c.driver_id == r.r_driver, "left")
            .select("driver_id", "complaints", F.coalesce("rides", F.lit(0).cast("long")).alias("rides"),
                    ((F.col("complaints") * 100).cast("double") / F.col("rides")).alias("complaints_per_100_rides"))
            .orderBy(F.col("complaints").desc(), "driver_id"))


def q_zone_hour_demand(wh: Warehouse) -> DataFrame:
    return (star.rides(wh).filter(F.col("pickup_zone_id").isNotNull())
            .groupBy("pickup_zone_id", cal.hour("ride_date").cast("long").alias("hour"))
            .agg(F.count(F.lit(1)).alias("rides")).orderBy("pickup_zone_id", "hour"))


# ---------------------------------------------------------------- generic top-k and sorted groups
def topk_10(wh: Warehouse) -> DataFrame:
    """The ten customers with the most rides (ties by id)."""
    return top_k(count_by(star.rides(wh), "customer_id", "rides"), 10, "rides", ["customer_id"])


def topk_15(wh: Warehouse) -> DataFrame:
    """The fifteen drivers with the most rides (ties by id)."""
    return top_k(count_by(star.rides(wh), "driver_id", "rides"), 15, "rides", ["driver_id"])


def sort_groups(wh: Warehouse) -> DataFrame:
    """Tickets per (issue type, priority), the whole grouped result sorted."""
    t = wh.fact_support_tickets.filter(F.col("issue_type").isNotNull() & F.col("priority").isNotNull())
    return (t.groupBy("issue_type", "priority").agg(F.count(F.lit(1)).alias("tickets"))
            .orderBy(F.col("tickets").desc(), "issue_type", "priority"))
