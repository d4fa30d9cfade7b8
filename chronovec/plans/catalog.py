"""Every query of the library by name, with its SQL.

Queries run the operators over the driver's tables: ``events`` stand for
timelines (one per user, an error is an absence), ``embeddings`` for vectors,
and for boxes derived from their components (four to a frame), ``conversations``
for threads, ``customer`` for keyed records, ``orders`` and ``lineitem`` for
jobs and their telemetry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, with DuckDB SQL where SQL can express it; CTEs of ``BASE`` may be used."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            own = [c for n, c in BASE.items() if f" {n}" in sql or f"({n}" in sql]
            if any("FROM tl" in c for c in own) and BASE["tl"] not in own:
                own.insert(0, BASE["tl"])
            head = next((w for w in ("WITH RECURSIVE ", "WITH ") if sql.startswith(w)), "")
            body = f", {sql[len(head) :]}" if head else f" {sql}"
            ORACLE_SQL[name] = (head or "WITH ") + ", ".join(own) + body if own else sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BASE = {
    "tl": """tl AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
        (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 1e6 AS t, event_type <> 'error' AS present, value, event_type, event_id FROM events)""",
    "bx": """bx AS (SELECT vec_id, vec_id // 4 AS frame, vec_id % 4 AS det, label, x1, y1, x1 + w AS x2, y1 + h AS y2, w, h, conf FROM (
        SELECT vec_id, label, 500 + 1000 * embedding[1]::DOUBLE AS x1, 300 + 800 * embedding[2]::DOUBLE AS y1,
        80 + 200 * abs(embedding[3]::DOUBLE) AS w, 80 + 200 * abs(embedding[4]::DOUBLE) AS h, least(1.0, 0.4 + 2 * abs(embedding[5]::DOUBLE)) AS conf FROM embeddings))""",
    "vec": "vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)",
}


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, i, t, present, value, event_type, event_id``: each user's events in order, t in seconds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(
        "user_id",
        (F.row_number().over(w) - 1).cast("long").alias("i"),
        (micros.cast("double") / 1e6).alias("t"),
        (F.col("event_type") != "error").alias("present"),
        "value",
        "event_type",
        "event_id",
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, frame, det, label, x1, y1, x2, y2, w, h, conf``: boxes from vector components."""
    return as_boxes(table(spark, sf_dir, "embeddings"))


def as_boxes(embeddings: DataFrame) -> DataFrame:
    e = [F.col("embedding")[k].cast("double") for k in range(5)]
    b = embeddings.select(
        "vec_id", "label", (500 + 1000 * e[0]).alias("x1"), (300 + 800 * e[1]).alias("y1"),
        (80 + 200 * F.abs(e[2])).alias("w"), (80 + 200 * F.abs(e[3])).alias("h"), F.least(F.lit(1.0), 0.4 + 2 * F.abs(e[4])).alias("conf"),
    )
    return b.select(
        "vec_id", F.floor(F.col("vec_id") / 4).alias("frame"), (F.col("vec_id") % 4).alias("det"), "label",
        "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"), "w", "h", "conf",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, v``: vectors as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


from . import box_queries, record_queries, sequence_queries, state_queries, telemetry_queries, vector_queries  # noqa: E402, F401
