"""Rows at the bounds of telemetry windows."""

import duckdb
from compare import same
from pyspark.sql import functions as F

from chronovec.plans import catalog


def test_window_of_a_time_just_before_it(spark, tmp_path):
    """Whole seconds decide, as in the SQL: half a second before a window is in it."""
    times = ["05:59:59.499999", "05:59:59.5", "05:59:59.6", "06:00:00.5", "11:59:59.999999", "12:00:00"]
    events = spark.createDataFrame([(k, f"2024-01-01 {t}", 1, "view", float(k)) for k, t in enumerate(times)], "event_id long, ts string, user_id long, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.QUERIES["s2_telemetry_windows"](spark, str(tmp_path))
    assert sorted(r.n for r in got.collect()) == [1, 2, 3]
    same(got, con.execute(catalog.ORACLE_SQL["s2_telemetry_windows"]))
