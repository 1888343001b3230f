"""Validated streaming ingest: landed files → validate → valid / quarantine tables.

A Structured Streaming file source picks up newly landed batch files; each
micro-batch goes through the same ingest contract as a batch load
(``tripstar.operators.ingest``) inside ``foreachBatch``. Both sides are
written partitioned by micro-batch id with dynamic partition overwrite, so
a micro-batch replayed after a failure replaces its own output instead of
duplicating it (exactly-once effect with an at-least-once sink). The
``availableNow`` trigger drains everything landed so far and stops, which
suits scheduled runs; a ``processingTime`` trigger keeps it running.

With a ``key``, a valid row whose key was taken by an earlier row (of the same micro-batch, of one before it, or before
a restart) is not taken again for as long as ``remember`` says. The keys are the stream's own state, kept in RocksDB in
the checkpoint folder and dropped by a watermark over the time a row arrived, not over a time the row carries: so
nothing is ever too late to be taken, however old the times in it. Rejected rows and rows without a key have no
identity and are all kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tripstar.operators.ingest import split
from tripstar.session import conf_scope

# State beyond the executors' heap: keys lie in RocksDB files, snapshots of them in the checkpoint folder.
STATE = {"spark.sql.streaming.stateStore.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def first_of_key(validated: DataFrame, key: str, remember: str) -> DataFrame:
    """A validated stream without the valid rows whose ``key`` was taken within ``remember``.

    A key's rows meet in two steps: first those of each input task (the second key column is its number), then the
    one row a task that is left of them, so a key that holds a third of all rows loads no single task. A key may be
    remembered longer than ``remember``, by as long again at most."""
    taken = F.col("reject_reason").isNull() & F.col(key).isNotNull()
    first = (validated.filter(taken)
             .withColumns({"__seen": F.current_timestamp(), "__task": F.spark_partition_id()})
             .withWatermark("__seen", remember)
             .dropDuplicatesWithinWatermark([key, "__task"]).dropDuplicatesWithinWatermark([key])
             .select(*validated.columns))
    return first.unionByName(validated.filter(~taken))


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def run_validated_ingest(spark: SparkSession, source_dir: str, schema: StructType,
                         validate: Callable[[DataFrame], DataFrame], valid_path: str, quarantine_path: str,
                         checkpoint_path: str, source_format: str = "parquet",
                         max_files_per_trigger: int | None = None, max_bytes_per_trigger: int | None = None,
                         available_now: bool = True,
                         processing_time: str = "1 minute", key: str | None = None, remember: str = "7 days"):
    """Start (and, with ``available_now``, finish) the validated ingest stream; ``key``: see the module."""
    reader = spark.readStream.schema(schema).format(source_format)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    elif max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    stream = validate(reader.load(source_dir))
    if key:
        stream = first_of_key(stream, key, remember)

    def handle(batch: DataFrame, batch_id: int) -> None:
        validated = batch.persist()
        try:
            ok, bad = split(validated)
            _write_batch(ok, valid_path, batch_id)
            _write_batch(bad, quarantine_path, batch_id)
        finally:
            validated.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    with conf_scope(spark, STATE):
        query = writer.start()
    if available_now:
        query.awaitTermination()
    return query


def read_ingested(spark: SparkSession, valid_path: str, quarantine_path: str, schema: StructType) -> DataFrame:
    """Valid and quarantined rows together (``reject_reason`` null for valid ones).

    ``schema`` is that of the validated rows (``reject_reason`` included), so a side without any row, whose folder
    holds no file to take a schema from, reads as empty."""
    batch = StructField("batch_id", LongType())
    valid = StructType([f for f in schema.fields if f.name != "reject_reason"] + [batch])
    full = StructType(list(schema.fields) + [batch])
    ok = _read_side(spark, valid_path, valid).withColumn("reject_reason", F.lit(None).cast("string"))
    return ok.unionByName(_read_side(spark, quarantine_path, full))


def _read_side(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One side's table; a side that was never written to is empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
