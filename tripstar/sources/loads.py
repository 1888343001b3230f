"""Tables made of loads: a load's rows appear all at once, replace those of the load's earlier run, or don't appear.

Every run of a load (an attempt) writes a folder of its own; a manifest (``ledger``) then names the attempt that stands
for the load. Readers take the attempts that the manifest names and nothing else, so a run that was killed is invisible,
a run with other input leaves no file of its predecessor in the table, and loads that commit at the same time both
count. The manifest keeps the schema of the last commit, so a table without rows can be read too.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tripstar.sources import ledger

MANIFEST = "_manifest"


def write(df: DataFrame, path: str, load_id: str, partition_by: list[str], fmt: str = "parquet") -> str:
    """Write one run of a load and commit it; returns its attempt."""
    attempt = stage(df, path, partition_by, fmt)
    commit(df.sparkSession, path, load_id, attempt, df.schema)
    return attempt


def stage(df: DataFrame, path: str, partition_by: list[str], fmt: str = "parquet") -> str:
    """Write the rows of a run into a folder of their own, which no reader sees yet."""
    attempt = f"run-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).format(fmt).save(f"{path}/attempt={attempt}")
    return attempt


def commit(spark: SparkSession, path: str, load_id: str, attempt: str, schema: StructType) -> None:
    """Let ``attempt`` stand for the load from now on; the attempt before it is retired."""
    def change(state: dict) -> dict:
        loads, retired = state.get("loads", {}), state.get("retired", {})
        if load_id in loads and loads[load_id] != attempt:
            retired[loads[load_id]] = int(time.time())
        return {"loads": {**loads, load_id: attempt}, "retired": retired, "schema": json.loads(schema.json())}

    ledger.update(spark, f"{path}/{MANIFEST}", change)


def is_managed(spark: SparkSession, path: str) -> bool:
    fs, p = ledger.file_system(spark, f"{path}/{MANIFEST}")
    return fs.exists(p)


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The rows of all committed loads, as of now; partition columns prune as in any partitioned table."""
    version, state = ledger.latest(spark, f"{path}/{MANIFEST}")
    if not version:
        raise FileNotFoundError(f"no committed load under {path}")
    schema = StructType.fromJson(state["schema"])
    folders = [f"{path}/attempt={a}" for a in sorted(state["loads"].values())]
    return (spark.read.schema(schema).option("basePath", path).format(fmt).load(folders)
            .select(*schema.fieldNames()))


def expire(spark: SparkSession, path: str, hours: float) -> list[str]:
    """Delete the files of attempts that were retired, or left behind by runs that never committed, over ``hours`` ago
    (longer than any reader or load runs); returns the attempts deleted."""
    limit = time.time() - hours * 3600
    _, state = ledger.latest(spark, f"{path}/{MANIFEST}")
    current, retired = set(state.get("loads", {}).values()), state.get("retired", {})
    fs, p = ledger.file_system(spark, path)
    gone = []
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if not name.startswith("attempt="):
            continue
        attempt = name[len("attempt="):]
        since = retired.get(attempt, f.getModificationTime() / 1000)
        if attempt not in current and since <= limit:
            fs.delete(f.getPath(), True)
            gone.append(attempt)

    def forget(state: dict) -> dict:
        return {**state, "retired": {a: t for a, t in state.get("retired", {}).items() if a not in gone}}

    if gone:
        ledger.update(spark, f"{path}/{MANIFEST}", forget)
    return sorted(gone)
