"""Relational warehouse and OLTP databases over JDBC.

Reads are split into parallel range scans on a numeric key
(``partitionColumn`` / ``lowerBound`` / ``upperBound``); their number follows
the row count, and bounds and count come from one query pushed to the database,
so no table is pulled through a single connection. Writes append in parallel
batches, each row with its ``load_id``. Connection
settings (URL, user, password, driver) always come from the caller; nothing
is hard-coded here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Numeric key used to split the scan of each star / OLTP table.
PARTITION_KEYS = {
    "fact_rides": "ride_id", "fact_support_tickets": "ticket_id", "dim_customers": "customer_id",
    "dim_drivers": "driver_id", "dim_vehicles": "vehicle_id", "dim_zones": "zone_id",
    "dim_payment_methods": "payment_method_id", "dim_agents": "agent_id", "dim_weather": "zone_id",
    "customers": "customer_id", "drivers": "driver_id", "vehicles": "vehicle_id", "rides": "ride_id",
    "support_tickets": "ticket_id",
}


def _reader(spark: SparkSession, url: str, properties: dict):
    r = spark.read.format("jdbc").option("url", url)
    for k, v in properties.items():
        r = r.option(k, v)
    return r


def key_bounds(spark: SparkSession, url: str, table: str, key: str, properties: dict) -> tuple[int, int, int] | None:
    """Least and greatest key and the number of rows; None for an empty table."""
    q = f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT(*) AS n FROM {table}) b"
    row = _reader(spark, url, properties).option("dbtable", q).load().first()
    if row is None or row["lo"] is None:
        return None
    return int(row["lo"]), int(row["hi"]), int(row["n"])


def read_jdbc_table(spark: SparkSession, url: str, table: str, properties: dict,
                    num_partitions: int | None = None, rows_per_partition: int = 1_000_000,
                    fetch_size: int = 10_000, key: str | None = None) -> DataFrame:
    """Parallel range-partitioned scan of ``table`` (single scan only for keyless tables): ``num_partitions``
    ranges, or as many as rows need. ``key`` overrides the table's numeric key."""
    key = key or PARTITION_KEYS.get(table)
    r = _reader(spark, url, properties).option("dbtable", table).option("fetchsize", fetch_size)
    if key is not None:
        bounds = key_bounds(spark, url, table, key, properties)
        if bounds is not None and bounds[1] > bounds[0]:
            num_partitions = num_partitions or max(1, -(-bounds[2] // rows_per_partition))
            r = (r.option("partitionColumn", key).option("lowerBound", bounds[0])
                 .option("upperBound", bounds[1] + 1).option("numPartitions", num_partitions))
    return r.load()


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict, load_id: str, batch_size: int = 5_000,
                max_connections: int = 32) -> None:
    """Append ``df`` in batched inserts over at most ``max_connections`` connections at a time (a limit of the
    database, a parameter). Every row carries ``load_id``: a task that is tried again can append its rows twice, so
    a reader takes the distinct rows of a load, or the load is deleted by its id and written again."""
    writer = (df.withColumn("load_id", F.lit(load_id)).write.format("jdbc").option("url", url)
              .option("dbtable", table).option("batchsize", batch_size).option("numPartitions", max_connections))
    for k, v in properties.items():
        writer = writer.option(k, v)
    writer.mode("append").save()
