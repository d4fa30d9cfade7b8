"""Operators on run telemetry: stages, batches, errors, resources, pools, sessions, scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import exact_mean
from ..storage import written


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def stage_shares(df: DataFrame, keys: list[str], stage: str, seconds: str, frames: str, total: str | None = None) -> DataFrame:
    """Share of the whole and frames a second of each stage (E18); with ``total``, the rest as stage "other"."""
    s = df.groupBy(*keys, stage).agg(F.sum(seconds).alias("seconds"), F.sum(frames).alias("frames"))
    if total:
        rest = df.groupBy(*keys).agg((F.max(total) - F.sum(seconds)).alias("seconds")).where("seconds > 0")
        s = s.unionByName(rest.select(*keys, F.lit("other").alias(stage), "seconds", F.lit(0).cast("long").alias("frames")))
    whole = F.sum("seconds").over(Window.partitionBy(*keys))
    return s.select(*keys, stage, "seconds", (ratio(F.col("seconds"), whole) * 100).alias("percent"), ratio(F.col("frames"), F.col("seconds")).alias("fps"))


def batch_report(df: DataFrame, batch: str, ok: Column, seconds: str, frames: str, media_s: str) -> DataFrame:
    """Success rate, time and means over successes of each batch and, with a null batch, of the session."""
    done = lambda c: F.avg(F.when(ok, c))
    return df.rollup(batch).agg(
        F.count("*").alias("videos"), F.count_if(ok).alias("succeeded"), (ratio(F.count_if(ok), F.count("*")) * 100).alias("success_rate"), F.sum(seconds).alias("seconds"),
        F.coalesce(done(ratio(F.col(frames), F.col(seconds))), F.lit(0.0)).alias("fps"), F.coalesce(done(ratio(F.col(media_s), F.col(seconds))), F.lit(0.0)).alias("realtime"),
    )


def stages_from_events(df: DataFrame, keys: list[str], kind: str, t: str, frames: str) -> DataFrame:
    """Start and end events of a stage as one record."""
    s = df.groupBy(*keys).agg(F.min(F.when(F.col(kind) == "start", F.col(t))).alias("start"), F.max(F.when(F.col(kind) == "end", F.col(t))).alias("end"), F.sum(frames).alias("frames"))
    return s.where("start is not null and end is not null").withColumns({"seconds": F.col("end") - F.col("start"), "fps": ratio(F.col("frames"), F.col("end") - F.col("start"))})


def histogram(df: DataFrame, keys: list[str], t: str, ok: Column, recent: float = 3600.0) -> DataFrame:
    """Counts, success rate and counts of the last hour before the newest record."""
    now = df.agg(F.max(t).alias("_now"))  # one row
    d = df.join(F.broadcast(now))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), ratio(F.count_if(ok), F.count("*")).alias("success_rate"), F.count_if(F.col(t) > F.col("_now") - recent).alias("recent"))


def load_summary(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """Mean, peak, samples and a label for the mean."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("peak"), F.count("*").alias("samples"), exact_mean(F.col(value)).alias("_m"))
    return s.withColumn("status", F.when(F.col("_m") < low, "underused").when(F.col("_m") > high, "overloaded").otherwise("good")).drop("_m")


def job_stats(df: DataFrame, keys: list[str], status: str, seconds: str) -> DataFrame:
    """Totals, mean time of finished jobs, error rate and progress."""
    is_ = lambda s: F.col(status) == s
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(is_("completed")).alias("completed"), F.count_if(is_("failed")).alias("failed"), F.coalesce(F.avg(F.when(is_("completed"), F.col(seconds))), F.lit(0.0)).alias("mean_s"),
        ratio(F.count_if(is_("failed")), F.count("*")).alias("error_rate"), (ratio(F.count_if(is_("completed") | is_("failed")), F.count("*")) * 100).alias("progress"),
    )


def pool_stats(df: DataFrame, keys: list[str], status: str, statuses: list[str], allocated: Column, size: str, used: str) -> DataFrame:
    """Blocks by status, utilisation and fragmentation of a pool."""
    a, u = F.sum(F.when(allocated, F.col(size)).otherwise(0)), F.sum(F.when(allocated, F.col(used)).otherwise(0))
    return df.groupBy(*keys).agg(*[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses], ratio(a, F.sum(size)).alias("utilisation"), ratio(a - u, a).alias("fragmentation"))


def engine_stats(df: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """Runs, total and mean milliseconds, and frames a second."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(ms).alias("total_ms"), F.avg(ms).alias("mean_ms"), ratio(F.lit(1000.0), F.avg(ms)).alias("fps"))


def activation_stats(df: DataFrame, keys: list[str], order: str, active: Column, ms: str, target: float = 0.1, last: int = 10) -> DataFrame:
    """Activations, their rate against a target, mean time, and the latest ones in order."""
    d = df.withColumn("_on", active)
    r = F.row_number().over(Window.partitionBy(*keys, "_on").orderBy(F.desc(order)))
    d = d.withColumn("_r", r)
    rate = ratio(F.count_if("_on"), F.count("*"))
    return d.groupBy(*keys).agg(
        F.count("*").alias("frames"), F.count_if("_on").alias("activations"), rate.alias("rate"), F.coalesce(F.avg(F.when(F.col("_on"), F.col(ms))), F.lit(0.0)).alias("mean_ms"),
        F.sort_array(F.collect_list(F.when(F.col("_on") & (F.col("_r") <= last), F.col(order)))).alias("latest"), F.when(rate <= 1.2 * target, "within target").otherwise("above target").alias("status"),
    )


def report_labels(fps: Column, success: Column, gpu: Column) -> Column:
    """Remarks of a report, in order."""
    return F.array_compact(F.array(
        F.when(fps < 30, "slow").when(fps > 100, "fast"), F.when(success < 95, "failures"), F.when(gpu < 50, "gpu underused").when(gpu > 95, "gpu saturated"),
    ))


def shown(df: DataFrame, keys: list[str], order: list[Column], item: str, n: int = 10) -> DataFrame:
    """The first ``n`` items of each key and how many more there are."""
    d = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    names = F.sort_array(F.collect_list(F.when(F.col("_r") <= n, F.struct("_r", F.col(item).alias("item")))))
    return d.groupBy(*keys).agg(F.transform(names, lambda x: x["item"]).alias("items"), F.greatest(F.count("*") - n, F.lit(0)).alias("more"))


def least_loaded(df: DataFrame, keys: list[str], id_: str, *by: str) -> DataFrame:
    """The resource with the least load; ties by the next measure, then id."""
    return df.groupBy(*keys).agg(F.min(F.struct(*by, id_))[id_].alias(id_))


def best_fit_block(requests: DataFrame, blocks: DataFrame, keys: list[str], size: str, need: str, most: float = 4.0) -> DataFrame:
    """The smallest free block that holds a request, unless it wastes too much.

    Blocks and requests are put in one order of size within a pool, so a
    running window, from the largest down, finds each request's next block; no
    pairs are formed.
    """
    b = blocks.select(*keys, F.col(size).cast("double").alias("_s"), F.lit(1).alias("_kind"), F.struct(F.col(size).cast("double").alias("size"), "block_id").alias("_b"), F.lit(None).cast("long").alias("request_id"))
    r = requests.select(*keys, F.col(need).cast("double").alias("_s"), F.lit(0).alias("_kind"), F.lit(None).cast("struct<size:double,block_id:bigint>").alias("_b"), F.col("request_id").cast("long"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_s"), F.desc("_kind"), F.desc("_b.block_id")).rowsBetween(Window.unboundedPreceding, -1)
    found = b.unionByName(r).withColumn("_next", F.last("_b", ignorenulls=True).over(w)).where("_kind = 0")
    fits = F.col("_next.size") <= most * F.col("_s")
    return found.select(*keys, "request_id", F.when(fits, F.col("_next.block_id")).alias("block_id"))


def idle_blocks(df: DataFrame, allocated: Column, last_used: str, now: Column, most: float = 300.0, emergency: bool = False) -> DataFrame:
    """Free blocks to give back: idle for long, or all in an emergency."""
    free = df.where(~allocated)
    return free if emergency else free.where(now - F.col(last_used) > most)


def overlap(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Most sessions open at a time: +1 at starts, -1 at ends, summed in order (M3)."""
    marks = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("m")).select(*keys, "m.t", "m.d")
    w = Window.partitionBy(*keys).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("open", F.sum("d").over(w)).groupBy(*keys).agg(F.max("open").alias("most_open"))


def scenario_summary(df: DataFrame, ok: Column, score: str, seconds: str) -> DataFrame:
    """Scenarios, passed ones, mean score and time."""
    return df.agg(F.count("*").alias("scenarios"), F.count_if(ok).alias("passed"), (ratio(F.count_if(ok), F.count("*")) * 100).alias("success_rate"), F.avg(score).alias("mean_score"), F.sum(seconds).alias("seconds"))


def in_batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Number rows into batches of a size, in order (M1).

    Counts by range are summed first, so no task numbers all rows. The ranges
    are written once, as their bounds may differ from run to run.
    """
    parts = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    local = parts.withColumn("_l", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    before = parts.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("batch", F.floor((F.col("_before") + F.col("_l")) / size)).drop("_p", "_l", "_before")
