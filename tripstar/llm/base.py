"""Helpers shared by the training-data operators: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tripstar.session import checkpoint_dir, ship_package

#: Texts of one Arrow batch are worked through in slices of about this many bytes, so a batch of very long
#: documents needs no more memory than one of short documents (a single longer text is a slice of its own).
SLICE_BYTES = 8 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, so lost executors
    cost no recomputation of what came before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def written_buckets(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """:func:`written` as a table in buckets by ``key``: a join by it, with as many shuffle partitions as buckets,
    doesn't exchange its rows."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._shared_path, out._shared_table = path, table
    return out


def drop_written(df: DataFrame) -> None:
    """Remove a table made by :func:`written` or :func:`written_buckets` that nothing reads any more."""
    path = df._shared_path
    if hasattr(df, "_shared_table"):
        df.sparkSession.sql(f"DROP TABLE {df._shared_table}")
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into slices of at most ``size`` bytes of text (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False),
                     dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def spark_schema(df: DataFrame, columns: list[str]) -> str:
    """DDL of some columns of ``df``, for the schema of a mapInArrow."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)
