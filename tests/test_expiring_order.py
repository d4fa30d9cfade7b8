"""Expiring values of a key whose rows are many, tied and out of order."""

import duckdb
import pytest
from compare import same
from pyspark.sql import functions as F

from chronovec.plans import catalog
from chronovec.streaming import telemetry as streams


@pytest.fixture
def small_batches(spark):
    name, provider = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "16")
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)
    spark.conf.unset(provider)


def test_query_with_files_out_of_order(spark, sf_dir, tmp_path, small_batches):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").limit(200)
    e = e.withColumn("user_id", F.col("user_id") * 0).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")).persist()
    last = e.agg(F.max("event_id")).first()[0]
    for k in (2, 1, 0):  # later files hold earlier rows
        e.where(f"event_id * 3 div {last + 1} = {k}").orderBy(F.desc("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    same(catalog.QUERIES["s3_expiring"](spark, str(tmp_path)), con.execute(catalog.ORACLE_SQL["s3_expiring"]))


def test_stream_with_a_key_larger_than_a_batch(spark, tmp_path, small_batches):
    rows = [(1, float(k), float(k)) for k in range(99, -1, -1)]
    spark.createDataFrame(rows, "key long, t double, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.expiring(streams.read_stream(spark, str(tmp_path / "in")), "key", 5.0)
    got = sorted(tuple(r) for r in streams.finish(s, str(tmp_path / "out")).collect())
    assert got == [(1, 0.0, False, None)] + [(1, float(k), True, float(k - 1)) for k in range(1, 100)]
