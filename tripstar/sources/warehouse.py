"""The star-schema warehouse as a set of lazy DataFrames.

A ``Warehouse`` maps table names (``fact_rides``, ``dim_zones`` …) to
DataFrames. Three back ends produce the same schema:

* ``Warehouse.from_testdata`` binds the star schema onto the driver's TPC-H-like
  parquet tables (the bindings of ``FIXTURES.md``), all as Spark expressions;
* ``Warehouse.from_parquet`` reads a warehouse folder written by the ETL
  (``tripstar.operators.etl.load_star``);
* ``Warehouse.from_jdbc`` reads the tables of a relational warehouse with
  partitioned JDBC scans (``tripstar.sources.jdbc``).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstar.session import written
from tripstar.sources import loads
from tripstar.sources.tables import Tables

STAR_TABLES = (
    "fact_rides", "dim_zones", "dim_customers", "dim_drivers", "dim_vehicles",
    "dim_payment_methods", "dim_agents", "dim_weather", "fact_support_tickets",
)

# Fixed values of the test-data binding (FIXTURES.md): payment methods, the
# event-type → issue-type map, and the priority / status cycles.
PAYMENT_METHODS = [(1, "Cash"), (2, "Card"), (3, "Wallet"), (4, "Corporate")]
ISSUE_BY_EVENT = {"signup": "App", "click": "Driver", "view": "Vehicle",
                  "purchase": "Fare", "error": "Other"}
PRIORITY_CYCLE = ["Low", "Medium", "High"]
STATUS_CYCLE = ["Open", "In Progress", "Resolved", "Closed"]
N_ZONES = 24


def cycle_of(col, values):
    """values[col % len(values)] as a CASE expression."""
    expr = None
    for i, v in enumerate(values):
        cond = (col % len(values)) == i
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def _add_minutes(ts, minutes):
    return F.timestamp_add("MINUTE", minutes, ts)


class Warehouse:
    def __init__(self, spark: SparkSession, builders: dict[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._builders = builders
        self._frames: dict[str, DataFrame] = {}
        self._staged: dict[str, DataFrame] = {}
        self.raw: Tables | None = None  # raw tables, when bound onto test data

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in STAR_TABLES:
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._builders[name]()
        return self._frames[name]

    def staged(self, name: str) -> "Warehouse":
        """This warehouse with one table written to the shared folder, once, and read back."""
        if name not in self._staged:
            self._staged[name] = written(self.table(name), name)
        out = Warehouse(self.spark, self._builders)
        out._frames, out._staged, out.raw = {**self._frames, name: self._staged[name]}, self._staged, self.raw
        return out

    def kept(self, name: str, columns: list[str]) -> "Warehouse":
        """This warehouse with some columns of one table persisted, for several uses of them. Unpersist the table."""
        out = Warehouse(self.spark, self._builders)
        out._frames = {**self._frames, name: self.table(name).select(*columns).persist(StorageLevel.MEMORY_AND_DISK)}
        out._staged, out.raw = self._staged, self.raw
        return out

    def dim(self, name: str) -> DataFrame:
        """A dimension for a join. It carries no hint: after the columns are selected the planner and AQE decide by
        bytes whether it is broadcast."""
        return self.table(name)

    # ------------------------------------------------------------------ back ends
    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, **kw) -> "Warehouse":
        def table(name: str) -> DataFrame:
            path = os.path.join(root, name)
            return loads.read(spark, path) if loads.is_managed(spark, path) else spark.read.parquet(path)

        return cls(spark, {n: (lambda n=n: table(n)) for n in STAR_TABLES}, **kw)

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: dict[str, DataFrame], **kw) -> "Warehouse":
        return cls(spark, {n: (lambda df=df: df) for n, df in frames.items()}, **kw)

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, properties: dict, read: dict | None = None, **kw) -> "Warehouse":
        """``read``: further arguments of ``read_jdbc_table`` (number of ranges, rows a range, fetch size)."""
        from tripstar.sources.jdbc import read_jdbc_table

        builders = {n: (lambda n=n: read_jdbc_table(spark, url, n, properties, **(read or {}))) for n in STAR_TABLES}
        return cls(spark, builders, **kw)

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, **kw) -> "Warehouse":
        t = Tables(spark, sf_dir)
        b = _TestdataBindings(t)
        builders = {n: getattr(b, n) for n in STAR_TABLES}
        wh = cls(spark, builders, **kw)
        wh.raw = t
        return wh


class _TestdataBindings:
    """FIXTURES.md bindings, one method per star table."""

    def __init__(self, t: Tables):
        self.t = t

    def dim_zones(self) -> DataFrame:
        n = F.col("n_nationkey")
        return (self.t.nation.filter(n < N_ZONES)
                .select(n.cast("int").alias("zone_id"),
                        (F.lit(40.5) + n * F.lit(0.02)).alias("center_lat"),
                        (F.lit(-74.25) + n * F.lit(0.02)).alias("center_lon")))

    def dim_customers(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.t.customer.select(
            k.alias("customer_id"), F.col("c_name").alias("customer_name"),
            F.date_add(F.lit("1994-01-01").cast("date"), (k % 365).cast("int")).alias("signup_date"))

    def dim_drivers(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.t.supplier.select(
            k.alias("driver_id"), F.col("s_name").alias("driver_name"),
            F.date_add(F.lit("1993-01-01").cast("date"), (k % 365).cast("int")).alias("join_date"))

    def dim_vehicles(self) -> DataFrame:
        return self.t.part.select(
            F.col("p_partkey").alias("vehicle_id"), F.col("p_brand").alias("make"),
            F.col("p_type").alias("model"), (F.lit(1985) + F.col("p_size") % 16).cast("int").alias("year"))

    def dim_payment_methods(self) -> DataFrame:
        # a literal table, whose size the planner knows
        rows = ", ".join(f"({i}, '{name}')" for i, name in PAYMENT_METHODS)
        return self.t.spark.sql(f"SELECT * FROM VALUES {rows} AS t(payment_method_id, method_name)")

    def dim_agents(self) -> DataFrame:
        s = self.t.supplier.filter(F.col("s_suppkey") < 9).select("s_suppkey", "s_name", "s_nationkey")
        n = self.t.nation.select("n_nationkey", "n_regionkey")
        r = self.t.region.select("r_regionkey", "r_name")
        return (s.join(n, s.s_nationkey == n.n_nationkey)
                .join(r, F.col("n_regionkey") == r.r_regionkey)
                .select(F.col("s_suppkey").alias("agent_id"), F.col("s_name").alias("agent_name"),
                        F.col("r_name").alias("region")))

    def fact_rides(self) -> DataFrame:
        ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
        money = "decimal(12,2)"
        # what a line alone decides is worked out before the join: the results are shorter than the raw columns
        li = self.t.lineitem.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
            F.col("l_extendedprice").cast(money).alias("fare_amount"),
            F.when(F.col("l_discount") != 0, F.col("l_quantity").cast(money)).alias("distance_km"),
            (F.col("l_quantity") * 2 + ln).cast("int").alias("duration_minutes"),
            (F.col("l_tax") * 100).cast(money).alias("tip_amount"))
        o = self.t.orders.select("o_orderkey", "o_custkey")
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                .select(
                    (ok * 10 + ln).alias("ride_id"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("l_suppkey").alias("driver_id"),
                    F.when(F.col("l_partkey") % 97 != 0, F.col("l_partkey")).alias("vehicle_id"),
                    (ok % 5 + 1).cast("int").alias("payment_method_id"),
                    ((F.col("o_custkey") % 5) * (ok % 6)).cast("int").alias("pickup_zone_id"),
                    (F.col("l_partkey") % 25).cast("int").alias("dropoff_zone_id"),
                    F.when(ok % 211 != 0, _add_minutes(F.col("l_shipdate"), (ok * 37 + ln * 53) % 1440))
                    .alias("ride_date"),
                    "fare_amount", "distance_km", "duration_minutes", "tip_amount"))

    def dim_weather(self) -> DataFrame:
        # One row per (shipping day, zone): the day list is a distinct over one
        # column (partial aggregation, bounded by the calendar); zones come from
        # an array explode, not a join.
        days = self.t.lineitem.select(F.to_date("l_shipdate").alias("date")).distinct()
        grid = days.select("date", F.explode(F.sequence(F.lit(0), F.lit(N_ZONES - 1))).alias("zone_id"))
        doy, z = F.dayofyear("date"), F.col("zone_id")
        s = doy + z
        return (grid.filter(s % 11 != 0)
                .select(z.cast("int").alias("zone_id"), "date",
                        (((doy * 3 + z * 5) % 90) / 2 - 10).cast("double").alias("temperature_2m"),
                        (s % 4).cast("double").alias("precipitation"),
                        F.when(s % 4 == 0, F.lit(0.0)).otherwise((s % 3).cast("double")).alias("rain"),
                        F.when(s % 17 == 0, F.lit(1.5)).otherwise(F.lit(0.0)).alias("snowfall"),
                        ((doy * 7 + z) % 101).cast("double").alias("cloud_cover"),
                        ((doy + z * 3) % 30).cast("double").alias("avg_wind_speed")))

    def fact_support_tickets(self) -> DataFrame:
        ev = self.t.events.select("event_id", "ts", "user_id", "event_type")
        eid = F.col("event_id")
        # First line of the order whose key equals the ticket id: a semi join keeps
        # only the lines that can match, then a partial+final aggregate per order.
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
        link = (li.join(ev.select(eid.alias("l_orderkey")), "l_orderkey", "left_semi")
                .groupBy("l_orderkey")
                .agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ride_id"),
                     F.min("l_suppkey").alias("driver_id")))
        issue = None
        for ev_type, label in ISSUE_BY_EVENT.items():
            cond = F.col("event_type") == ev_type
            issue = F.when(cond, label) if issue is None else issue.when(cond, label)
        res = F.when(eid % 4 >= 2, (eid % 10080).cast("int"))
        return (ev.join(link, ev.event_id == link.l_orderkey, "left")
                .select(eid.alias("ticket_id"), F.col("user_id").alias("customer_id"),
                        F.when(eid % 13 != 0, eid % 10).alias("agent_id"),
                        issue.alias("issue_type"),
                        cycle_of(eid, PRIORITY_CYCLE).alias("priority"),
                        cycle_of(eid, STATUS_CYCLE).alias("status"),
                        F.col("ts").alias("opened_at"),
                        _add_minutes(F.col("ts"), res).alias("closed_at"),
                        res.alias("resolution_time_minutes"),
                        "ride_id", "driver_id"))
