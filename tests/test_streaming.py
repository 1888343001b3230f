"""Validated streaming ingest: drains landed files, replays are idempotent."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from tripstar.operators import ingest
from tripstar.streaming.ingest import read_ingested, run_validated_ingest

SCHEMA = "first_name string, last_name string, email string, phone string"


def test_stream_validates_and_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="stream-")
    src, ok, bad, ck = (os.path.join(base, p) for p in ("in", "ok", "bad", "ck"))
    rows = [("A", "B", f"a{i}@x", "1") if i % 4 else ("A", "", f"a{i}@x", "1") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(4).write.parquet(src)
    schema = df.schema
    run_validated_ingest(spark, src, schema, ingest.validate_customers, ok, bad, ck, max_files_per_trigger=1)
    full = ingest.validate_customers(df).schema
    first = read_ingested(spark, ok, bad, full)
    assert first.count() == 40 and first.filter("reject_reason is not null").count() == 10
    assert first.select("batch_id").distinct().count() == 4
    # A second run on the same checkpoint finds nothing new and writes nothing twice.
    run_validated_ingest(spark, src, schema, ingest.validate_customers, ok, bad, ck, max_files_per_trigger=1)
    assert read_ingested(spark, ok, bad, full).count() == 40


def test_a_side_without_rows_reads_as_empty(spark):
    for last, n_bad in (("B", 0), ("", 6)):
        base = tempfile.mkdtemp(prefix="stream-")
        src, ok, bad, ck = (os.path.join(base, p) for p in ("in", "ok", "bad", "ck"))
        df = spark.createDataFrame([("A", last, f"a{i}@x", "1") for i in range(6)], SCHEMA)
        df.write.parquet(src)
        run_validated_ingest(spark, src, df.schema, ingest.validate_customers, ok, bad, ck,
                             max_bytes_per_trigger=1 << 30)
        out = read_ingested(spark, ok, bad, ingest.validate_customers(df).schema)
        assert out.count() == 6 and out.filter("reject_reason is not null").count() == n_bad


KEYED = "k long, first_name string, last_name string, email string, phone string, at timestamp"


def _keyed(spark, ids, day=1, last="B"):
    return spark.createDataFrame([(i, "A", last, f"{i}@x", "1", dt.datetime(2024, 3, day)) for i in ids], KEYED)


def test_keys_are_remembered_over_batches_and_restarts(spark):
    base = tempfile.mkdtemp(prefix="stream-")
    src, ok, bad, ck = (os.path.join(base, p) for p in ("in", "ok", "bad", "ck"))

    def land(df, n=1):
        df.repartition(n).write.mode("append").parquet(src)
        run_validated_ingest(spark, src, df.schema, ingest.validate_customers, ok, bad, ck, max_files_per_trigger=2,
                             key="k")
        out = read_ingested(spark, ok, bad, ingest.validate_customers(df).schema)
        return sorted((r.k is None, r.k or 0, r.reject_reason is not None) for r in out.collect())

    plain = lambda ids: sorted((False, i, False) for i in ids)
    # a hot key in every file of several micro-batches
    assert land(_keyed(spark, list(range(20)) + [7] * 400), 6) == plain(range(20))
    # the same rows again in another file, after a restart, with two new ones
    assert land(_keyed(spark, range(22))) == plain(range(22))
    # rows whose own time is far behind all others are taken, and taken once
    assert land(_keyed(spark, [30, 31, 30, 5]).withColumn("at", F.lit("1999-01-01").cast("timestamp"))) \
        == plain([*range(22), 30, 31])
    # a rejected row takes no key: the valid copy that comes later is kept; rejected rows are all kept
    assert land(_keyed(spark, [40, 40, 41], last="")) == sorted(plain([*range(22), 30, 31])
                                                               + [(False, 40, True)] * 2 + [(False, 41, True)])
    got = land(_keyed(spark, [40, 41]))
    assert (False, 40, False) in got and got.count((False, 41, False)) == 1 and len(got) == 29
    # rows without a key have no identity
    got = land(_keyed(spark, [None, None, 1]))
    assert got.count((True, 0, False)) == 2 and len(got) == 31
