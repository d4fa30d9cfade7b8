"""Streams: telemetry windows, deduplicated updates, timelines with gaps, identities with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over parquet files, a few at a time."""
    schema = spark.read.parquet(path).schema
    # as a pattern, a path may be a folder or a single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def windows(stream: DataFrame, ts: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and means of tumbling windows; rows later than the watermark are dropped."""
    t = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    w = t.groupBy(F.window("_t", width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("peak"))
    return w.select(F.unix_seconds("window.start").alias("start"), *keys, "n", "mean", "peak")


def once(stream: DataFrame, id_: str, ts: str, late: str) -> DataFrame:
    """Each update once, by id within the watermark."""
    return stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([id_]).drop("_t")


def restored(frames: DataFrame, keys: list[str], frame: str, value: str) -> DataFrame:
    """Every frame of a timeline in order, missing ones as nulls (S1, S4): for a finished batch."""
    span = frames.groupBy(*keys).agg(F.explode(F.sequence(F.min(frame), F.max(frame))).alias(frame))
    return span.join(frames.select(*keys, frame, value), [*keys, frame], "left")


DAY = 86400


class Expiring(StatefulProcessor):
    """Last value of each key (S3, G4); a timer drops it once the watermark is past its time to live."""

    def __init__(self, ttl: float) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t double, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # a key's rows of a micro-batch come in chunks, which are in no order
        pdf, out = pd.concat(list(rows)), []
        before = self.last.get() if self.last.exists() else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for t, v in pdf.sort_values([c for c in ("t", "event_id") if c in pdf], kind="stable")[["t", "value"]].itertuples(index=False):
            alive = before is not None and t - before[0] <= self.ttl
            out.append((key[0], t, alive, before[1] if alive else None))
            before = (t, v)
        self.last.update(before)
        self.handle.registerTimer(int((before[0] + self.ttl + DAY) * 1000) + 1)
        yield pd.DataFrame(out, columns=["key", "t", "alive", "previous"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def expiring(stream: DataFrame, key: str, ttl: float, late: str = "0 seconds") -> DataFrame:
    """Rows ``key, t, value`` with the value that the store still held (S3); t is in seconds, from 0 on.

    Keys whose value is past its time to live leave the state, so it holds the
    live ones only. Rows later than the watermark (``late``) are dropped.

    Rows are in order of t, then of event_id where there is one, within a
    micro-batch; micro-batches are taken as they arrive. ``held`` gives the
    same for a finished table, in order throughout.
    """
    # a day on, as rows at the time where watermarks start would count as late
    timed = stream.withColumn("_at", F.timestamp_seconds(F.col("t") + DAY)).withWatermark("_at", late)
    return timed.groupBy(key).transformWithStateInPandas(Expiring(ttl), "key long, t double, alive boolean, previous double", "Append", "EventTime")


def held(df: DataFrame, key: str, order: list[str], t: str, value: str, ttl: float) -> DataFrame:
    """``key, t, alive, previous`` of each row of a finished table: the value before, if it is not too old (S3)."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumns({"alive": F.coalesce(F.col(t) - F.lag(t).over(w) <= ttl, F.lit(False)), "_before": F.lag(value).over(w)})
    return rows.select(F.col(key).alias("key"), F.col(t).alias("t"), "alive", F.when(F.col("alive"), F.col("_before")).alias("previous"))


def finish(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table, and read the table."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/data").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def finish_all(stream: DataFrame, path: str) -> DataFrame:
    """Run an aggregating stream over all that is there and keep its last state of every group.

    Each micro-batch writes the aggregate of all rows read so far as a table of
    its own, and the newest is read: a lost batch is written again, and readers
    of an older table are not disturbed.
    """

    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/data/batch={n}")

    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = stream.sparkSession.read.parquet(f"{path}/data")
    return found.where(F.col("batch") == found.agg(F.max("batch")).first()[0]).select(*stream.columns)


def notify(stream: DataFrame, checkpoint: str, send) -> None:
    """Hand each micro-batch to ``send(df, batch_id)`` (B2); repeated batches carry the same id."""
    stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
