"""Consecutive surrogate ids for an appended batch, without a global sort.

``base + 1 … base + n`` are assigned as: (1) cut the batch's lineage with a
reliable checkpoint so its partitions are fixed; (2) count rows per partition
(one small row per partition reaches the driver); (3) prefix-sum those counts
into per-partition offsets; (4) id = base + offset[partition] + position in
partition. Every step is a narrow, parallel pass; no single-partition window.

Loads that run at the same time get their base from :func:`reserve`, which gives each a range of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstar.session import checkpoint_dir
from tripstar.sources import ledger

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | position


def with_surrogate_ids(df: DataFrame, id_col: str, base: int | Callable[[int], int] = 0) -> DataFrame:
    """``base``: the largest id in use, or a function from the number of rows to it (:func:`reserve`)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    fixed = df.checkpoint(eager=True)
    pid = F.spark_partition_id()
    counts = fixed.groupBy(pid.alias("pid")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, run = [], 0
    for r in sorted(counts, key=lambda r: r["pid"]):
        offsets.append((int(r["pid"]), run))
        run += int(r["n"])
    if callable(base):
        base = base(run)
    off = spark.createDataFrame(offsets or [(0, 0)], "pid int, offset long")
    pos = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    with_pos = fixed.select("*", pid.alias("_pid"), pos.alias("_pos"))
    return (with_pos.join(F.broadcast(off), with_pos._pid == off.pid)
            .withColumn(id_col, F.lit(int(base)) + F.col("offset") + F.col("_pos") + 1)
            .drop("_pid", "_pos", "pid", "offset"))


def next_base(existing: DataFrame, id_col: str) -> int:
    """Largest id already used (0 for an empty table): one aggregate, one value."""
    v = existing.agg(F.max(id_col)).first()[0]
    return int(v) if v is not None else 0


def reserve(spark: SparkSession, folder: str, load_id: str, n: int, used: int = 0) -> int:
    """The id before the first of ``n`` consecutive ids that belong to this load alone.

    ``folder`` holds the ledger of the ranges given away; ``used`` is the largest id used before there was one. Two
    loads never get the same id, whatever their timing; a load that is run again with as many rows gets its own range
    again, with another number of rows a new one (its first range stays unused).
    """
    def change(state: dict) -> dict:
        ranges = state.get("ranges", {})
        if load_id in ranges and ranges[load_id][1] == n:
            return state
        first = max(state.get("last", 0), used)
        return {"last": first + n, "ranges": {**ranges, load_id: [first, n]}}

    return ledger.update(spark, folder, change)["ranges"][load_id][0]
