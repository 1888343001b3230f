"""The driver contract: entry(), queries() and oracle_sql()."""

import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["pickup_zone_id", "rides"]
    assert 0 < len(rows) <= 10
    assert [r.rides for r in rows] == sorted((r.rides for r in rows), reverse=True)


def test_every_oracle_has_a_query():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 90


def test_registry_imports_without_session():
    # oracle_sql() must not need a running Spark session.
    import importlib
    import tripstar.oracle_queries as oq
    importlib.reload(oq)
    assert "q01_top_pickup_zones" in oq.SQL


def test_sizing_targets_partition_size_and_waves():
    from tripstar.session import sizing
    big = sizing(100 * 2 ** 40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 2 ** 40 // (256 << 20)
    small = sizing(10 << 20, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16  # at least two waves
