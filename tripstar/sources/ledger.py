"""Small shared state (the committed loads of a table, the ids already given away), changed by one writer at a time.

A ledger is a folder of numbered JSON files, each the whole state after one change. A writer reads the latest, works out
the next state and tries to take the next number; whoever comes second finds the number taken, reads again and works the
change out anew. A file gets its name only when it is complete, so a reader sees either the state before a change or the
state after it, also when the writer dies in between. Taking a name is a rename that never replaces a file, which shared
file systems with atomic renames (HDFS and the like) give; on a local disk it is a hard link. Versions are never
removed: a number must not become free again.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and state of the latest version; (0, {}) where there is none."""
    fs, p = file_system(spark, folder)
    if not fs.exists(p):
        return 0, {}
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    versions = [int(n[:-len(".json")]) for n in names if n.endswith(".json") and not n.startswith(".")]
    if not versions:
        return 0, {}
    stream = fs.open(file_system(spark, f"{folder}/{max(versions):012d}.json")[1])
    try:
        return max(versions), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _taken(spark: SparkSession, folder: str, version: int, state: dict) -> bool:
    """Whether ``state`` became version ``version``; False where another writer had the number first."""
    fs, draft = file_system(spark, f"{folder}/.{uuid.uuid4().hex}.draft")
    _, final = file_system(spark, f"{folder}/{version:012d}.json")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(state, sort_keys=True), "utf-8"))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), final.toUri().getPath())
            return True
        hadoop = spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
        plain = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), plain)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)


def update(spark: SparkSession, folder: str, change: Callable[[dict], dict]) -> dict:
    """Make ``change(state)`` the next state and return it; ``change`` runs again when another writer was faster. A
    change that leaves the state as it is writes nothing."""
    while True:
        version, state = latest(spark, folder)
        after = change(json.loads(json.dumps(state)))
        if after == state or _taken(spark, folder, version + 1, after):
            return after
