"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every tripstar job relies on. AQE re-plans joins from runtime sizes
# (broadcast vs sort-merge, skew splits, partition coalescing); UTC keeps the
# zone-less timestamps of the warehouse stable across hosts.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "tripstar", master: str | None = None,
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Runtime (session-level) settings also apply when the session already existed.
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled"):
        spark.conf.set(k, conf[k])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system path and is only read.
    When it is unset (local runs and tests) a fresh folder is made under the
    system temp dir and registered as the context's checkpoint directory, so
    lineage cuts still have a target.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(path)
        return path
    current = sc.getCheckpointDir()
    if current:
        # the context adds a per-application sub-folder; scratch tables go beside it
        return os.path.dirname(current.rstrip("/"))
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage: "
                           "checkpoints and intermediate tables must survive a lost executor")
    path = tempfile.mkdtemp(prefix="tripstar-ckpt-")
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


def written(df, name: str):
    """``df`` written as Parquet to a fresh shared folder and read back: what follows starts from the files, so the
    rows are computed once and a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    staged = _STAGED.get()
    if staged is not None:
        staged.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STAGED: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("staged", default=None)


@contextlib.contextmanager
def staging(spark: SparkSession):
    """For a load whose result is in files of its own: the shuffle files of each query inside go when the query ends, and
    the tables :func:`written` inside go at the end, so disk holds one step's files and not those of all steps."""
    token = _STAGED.set([])
    try:
        with conf_scope(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            yield
    finally:
        staged = _STAGED.get()
        _STAGED.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for p in staged:
            path(p).getFileSystem(conf).delete(path(p), True)


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once an application), so that tasks can import it anywhere."""
    sc = spark.sparkContext
    with _SHIPPING:
        if sc.applicationId in _SHIPPED:
            return
        root = os.path.dirname(os.path.abspath(__file__))
        name = os.path.basename(root)
        target = os.path.join(tempfile.mkdtemp(prefix=f"{name}-code-"), f"{name}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join(name, os.path.relpath(full, root)))
        sc.addPyFile(target)
        _SHIPPED.add(sc.applicationId)


class conf_scope:
    """Set session configs for the duration of a ``with`` block, then restore them."""

    def __init__(self, spark: SparkSession, settings: dict[str, str]):
        self.spark, self.settings, self.saved = spark, settings, {}

    def __enter__(self):
        for k, v in self.settings.items():
            self.saved[k] = self.spark.conf.get(k, None)
            self.spark.conf.set(k, v)
        return self.spark

    def __exit__(self, *exc):
        for k, v in self.saved.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)
        return False


def sizing(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle and scan settings for a run over ``input_bytes`` of parquet on ``total_cores`` cores.

    Scan splits and shuffle partitions aim at ``target_partition_bytes`` each
    (about 256 MB: fits an executor core's share of memory with room to spill),
    with at least two waves of tasks so stragglers overlap; AQE then coalesces
    small partitions and splits skewed ones (a partition over five times the
    median and over 1 GB is split). For 100 TB on 1,000 executors × 8 cores
    this gives ~400k shuffle partitions, i.e. ~50 waves of 256 MB tasks.
    """
    parts = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
