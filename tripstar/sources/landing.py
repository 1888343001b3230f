"""OLTP landing batches bound onto the raw test tables.

The operational side of the warehouse (customers, drivers, vehicles, rides and
support tickets as entered by the data-insertion forms or uploaded as CSV) has
no test data of its own. These bindings derive one landing batch per table from
the driver's tables with fixed rules, including empty fields, missing optional
values and out-of-range values, so the ingest contracts meet both valid and
invalid rows at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstar.sources.tables import Tables
from tripstar.sources.warehouse import ISSUE_BY_EVENT, PRIORITY_CYCLE, STATUS_CYCLE, cycle_of

# Fixed values of the binding: colours and vehicle types cycle by part key
# ('' and 'Van' are deliberately invalid).
COLOR_CYCLE = ["", "Black", "White", "Silver", "Blue"]
TYPE_CYCLE = ["Standard", "Premium", "SUV", "Luxury", "Van"]


def _pad(c, n: int):
    return F.lpad(c.cast("string"), n, "0")


def landing_customers(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("source_key"),
        F.concat(F.lit("First"), (k % 97).cast("string")).alias("first_name"),
        F.col("c_name").alias("last_name"),
        F.when(k % 53 == 0, F.lit(""))
        .otherwise(F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@mail.test"))).alias("email"),
        F.when(k % 71 != 0, F.concat(F.lit("555-"), _pad(k % 10000, 4))).alias("phone"),
        F.date_add(F.lit("1994-01-01").cast("date"), (k % 365).cast("int")).alias("created_at"))


def landing_drivers(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("source_key"),
        F.lit("Driver").alias("first_name"), F.col("s_name").alias("last_name"),
        F.when(k % 17 == 0, F.lit("  ")).otherwise(F.concat(F.lit("LIC"), _pad(k, 7))).alias("license_number"),
        F.concat(F.lit("555-"), _pad(k % 10000, 4)).alias("phone"),
        F.date_add(F.lit("1993-01-01").cast("date"), (k % 365).cast("int")).alias("hire_date"),
        F.when(k % 3 != 0, k % 2 == 0).alias("is_active"))


def landing_vehicles(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("source_key"),
        # every 89th vehicle takes over the plate of the one before
        F.concat(F.lit("PL-"), (k - F.when((k % 89 == 0) & (k > 0), 1).otherwise(0)).cast("string"))
        .alias("license_plate"),
        F.col("p_brand").alias("make"), F.col("p_type").alias("model"),
        (F.lit(1985) + F.col("p_size") % 45).cast("int").alias("year"),
        cycle_of(k, COLOR_CYCLE).alias("color"),
        cycle_of(k, TYPE_CYCLE).alias("vehicle_type"),
        F.when(k % 4 != 0, F.lit(True)).alias("is_active"))


def landing_tickets(t: Tables) -> DataFrame:
    e = F.col("event_id")
    issue = None
    for ev_type, label in ISSUE_BY_EVENT.items():
        cond = F.col("event_type") == ev_type
        issue = F.when(cond, label) if issue is None else issue.when(cond, label)
    return t.events.select(
        e.alias("source_key"),
        F.when(e % 19 != 0, e * 10 + 1).alias("ride_id"),
        F.col("user_id").alias("customer_id"),
        (e % 100).alias("driver_id"),
        issue.alias("issue_type"),
        F.when(e % 29 == 0, F.lit(" ")).otherwise(F.col("props")).alias("description"),
        F.when(e % 5 != 0, cycle_of(e, STATUS_CYCLE)).alias("status"),
        F.when(e % 7 != 0, cycle_of(e, PRIORITY_CYCLE)).alias("priority"),
        (e % 10).alias("assigned_agent_id"),
        F.col("ts").alias("created_at"),
        F.when(e % 4 >= 2, F.timestamp_add("MINUTE", (e % 10080).cast("int"), F.col("ts"))).alias("resolved_at"))


def landing_rides(t: Tables) -> DataFrame:
    """Rides as the OLTP system records them: 23 columns, distances in miles.

    Copies: rides of every 131st order come a second time, an hour earlier and with a negative fare (an invalid
    first copy); rides of every 137th order come a second time unchanged.
    """
    once = _landing_rides_once(t)
    order = (F.col("source_key") / 10).cast("long")
    earlier = F.timestamp_add("MINUTE", F.lit(-60), F.col("pickup_datetime"))
    # 0: the ride, 1: the invalid copy, 2: the unchanged copy; the tables are read and joined once
    kinds = F.filter(F.array(F.lit(0), F.when(order % 131 == 0, F.lit(1)), F.when(order % 137 == 0, F.lit(2))), lambda k: k.isNotNull())
    wrong = F.col("_kind") == 1
    return once.withColumn("_kind", F.explode(kinds)).withColumns({
        "pickup_datetime": F.when(wrong, earlier).otherwise(F.col("pickup_datetime")),
        "fare_amount": F.when(wrong, F.lit(-1.0)).otherwise(F.col("fare_amount"))}).drop("_kind")


def _landing_rides_once(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                           "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_custkey")
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    pz = (F.col("o_custkey") % 5) * (ok % 6)
    dz = F.col("l_partkey") % 25
    pickup = F.when(ok % 211 != 0, F.timestamp_add("MINUTE", (ok * 37 + ln * 53) % 1440, F.col("l_shipdate")))
    dur = (F.col("l_quantity") * 2 + ln).cast("int")
    tip = F.round(F.col("l_tax") * 100, 2)
    return (li.join(o, li.l_orderkey == o.o_orderkey).select(
        (ok * 10 + ln).alias("source_key"),
        F.col("o_custkey").alias("customer_id"), F.col("l_suppkey").alias("driver_id"),
        F.col("l_partkey").alias("vehicle_id"),
        F.when(ln % 2 != 0, F.lit(2)).alias("vendor_id"),
        pickup.alias("pickup_datetime"),
        F.timestamp_add("MINUTE", dur, pickup).alias("dropoff_datetime"),
        F.when(ok % 7 != 0, (F.lit(1) + ln % 4)).alias("passenger_count"),
        F.col("l_quantity").alias("trip_distance"),
        (F.lit(-74.25) + pz * F.lit(0.02) + ln * F.lit(0.001)).alias("pickup_longitude"),
        (F.lit(40.5) + pz * F.lit(0.02) + ln * F.lit(0.001)).alias("pickup_latitude"),
        (F.lit(-74.25) + dz * F.lit(0.02) - ln * F.lit(0.001)).alias("dropoff_longitude"),
        (F.lit(40.5) + dz * F.lit(0.02) - ln * F.lit(0.001)).alias("dropoff_latitude"),
        F.col("l_extendedprice").alias("fare_amount"),
        F.lit(None).cast("double").alias("extra"),
        F.lit(0.5).alias("mta_tax"),
        tip.alias("tip_amount"),
        F.lit(None).cast("double").alias("tolls_amount"),
        F.lit(0.3).alias("improvement_surcharge"),
        (F.col("l_extendedprice") + tip + F.lit(0.8)).alias("total_amount"),
        F.lit(None).cast("int").alias("ratecode_id"),
        F.lit(None).cast("string").alias("store_and_fwd_flag"),
        (ok % 5 + 1).cast("int").alias("payment_method_id"),
        F.when(F.col("l_returnflag") == "R", F.lit("Cancelled")).alias("ride_status")))


# The upload CSV carries the 15 columns of the batch ride insert.
RIDE_CSV_COLUMNS = [
    "customer_id", "driver_id", "vehicle_id", "pickup_datetime", "dropoff_datetime", "passenger_count",
    "trip_distance", "pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude",
    "fare_amount", "total_amount", "payment_method_id", "ride_status",
]


def ride_upload_rows(t: Tables) -> DataFrame:
    """The CSV upload as text cells; every 997th order has an unparseable fare."""
    r = landing_rides(t)
    cells = []
    for c in RIDE_CSV_COLUMNS:
        v = F.col(c).cast("string")
        if c == "fare_amount":
            v = F.when((F.col("source_key") / 10).cast("long") % 997 == 0, F.lit("n/a")).otherwise(v)
        cells.append(v.alias(c))
    return r.select("source_key", *cells)
