"""Operators on ordered timelines: runs, gaps, rolling rates, predictions, slices.

Every operator takes explicit keys and a total order. All are windows and
aggregates over one partitioning by the keys, so a plan sorts a timeline once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _w(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def with_runs(df: DataFrame, keys: list[str], order: list[str], state: Column, run: str = "run_id") -> DataFrame:
    """Number the maximal runs of equal state, from 0."""
    w = _w(keys, order)
    change = F.when(state.eqNullSafe(F.lag(state).over(w)) | (F.row_number().over(w) == 1), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(run, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def run_segments(df: DataFrame, keys: list[str], order: list[str], state: str, start: str, end: str) -> DataFrame:
    """One row for each run: state, rows, first and last value of a column."""
    runs = with_runs(df, keys, order, F.col(state))
    return runs.groupBy(*keys, "run_id").agg(F.first(state).alias(state), F.count("*").alias("n"), F.min(start).alias("start"), F.max(end).alias("end"))


def condense(df: DataFrame, keys: list[str], frame: str, present: str, fps: float, cut: float = 5.0) -> DataFrame:
    """Segments in seconds to keep: present runs, and absent runs of ``cut`` seconds or less (F1)."""
    s = run_segments(df, keys, [frame], present, frame, frame)
    s = s.withColumns({"start_s": F.col("start") / fps, "end_s": (F.col("end") + 1) / fps})
    return s.where(F.col(present) | (F.col("end_s") - F.col("start_s") <= cut)).select(*keys, "run_id", "start_s", "end_s")


def drop_null_runs(df: DataFrame, keys: list[str], frame: str, value: str, threshold: int, fps: float) -> DataFrame:
    """Segments left when runs of ``threshold`` or more missing values go; neighbours that stay are joined (F2)."""
    runs = with_runs(df.withColumn("_has", F.col(value).isNotNull()), keys, [frame], F.col("_has"))
    size = F.count("*").over(Window.partitionBy(*keys, "run_id"))
    kept = runs.withColumn("_keep", F.col("_has") | (size < threshold)).drop("run_id")
    s = run_segments(kept, keys, [frame], "_keep", frame, frame).where("_keep")
    return s.select(*keys, (F.col("start") / fps).alias("start_s"), ((F.col("end") + 1) / fps).alias("end_s"))


def rolling(df: DataFrame, keys: list[str], order: list[str], value: Column, n: int, name: str, empty: float = 0.0) -> DataFrame:
    """Mean of the last ``n`` values."""
    return df.withColumn(name, F.coalesce(F.avg(value).over(_w(keys, order).rowsBetween(-(n - 1), 0)), F.lit(empty)))


def low_trigger(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, below: float, share: float = 0.8) -> DataFrame:
    """True where at least ``share`` of the last ``n`` values, all there, are below (F16)."""
    w = _w(keys, order)
    low = F.sum((F.col(value) < below).cast("int")).over(w.rowsBetween(-(n - 1), 0))
    return df.withColumn("trigger", (F.row_number().over(w) >= n) & (low >= share * n))


def adaptive_interval(rate: Column, base: int) -> Column:
    """Longer intervals at high success rates, shorter at low ones."""
    return F.when(rate > 0.95, base * 2).when(rate > 0.8, base).when(rate > 0.6, F.lit(base // 2)).otherwise(F.lit(base // 4)).cast("int")


def motion_score(df: DataFrame, keys: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """Mean displacement between neighbours over 50, at most 1; 0 for a single row."""
    w = _w(keys, order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return df.withColumn("_d", F.sqrt(dx * dx + dy * dy)).groupBy(*keys).agg(F.coalesce(F.least(F.avg("_d") / 50, F.lit(1.0)), F.lit(0.0)).alias("motion"))


def speaker_change(df: DataFrame, keys: list[str], frame: str, speaker: str, window: int = 90) -> DataFrame:
    """Most common speaker of two neighbouring windows, the first half of them ahead (F9); ties go to the first seen."""
    half = window // 2
    w = _w(keys, [frame])

    def mode(lo: int, hi: int) -> Column:
        seen = F.collect_list(F.when(F.col(speaker).isNotNull(), F.col(speaker))).over(w.rowsBetween(lo, hi))
        best = F.aggregate(
            F.array_distinct(seen),
            F.struct(F.lit(None).cast("string").alias("s"), F.lit(0).alias("n")),
            lambda acc, s: F.when(F.size(F.filter(seen, lambda x: x == s)) > acc["n"], F.struct(s.alias("s"), F.size(F.filter(seen, lambda x: x == s)).alias("n"))).otherwise(acc),
        )
        return best["s"]

    out = df.withColumn("now", mode(-half, half - 1)).withColumn("before", mode(-window, -half - 1))
    return out.withColumn("changed", F.coalesce(F.col("now") != F.col("before"), F.lit(False)))


def amplitude_windows(samples: DataFrame, keys: list[str], idx: str, value: str, size: int, hop: int) -> DataFrame:
    """Root mean square of hopping windows that end before the signal does."""
    last = F.max(idx).over(Window.partitionBy(*keys))
    ids = F.sequence(F.greatest(F.lit(0), F.ceil((F.col(idx) - size + 1) / hop)).cast("long"), F.floor(F.col(idx) / hop).cast("long"))
    hops = samples.withColumn("_last", last).withColumn("win", F.explode(F.when(F.ceil((F.col(idx) - size + 1) / hop) <= F.floor(F.col(idx) / hop), ids)))
    hops = hops.where(F.col("win") * hop + size <= F.col("_last"))
    return hops.groupBy(*keys, "win").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def amplitude_activity(samples: DataFrame, keys: list[str], idx: str, value: str, size: int, hop: int) -> DataFrame:
    """Runs of windows louder than mean + half a standard deviation."""
    rms = amplitude_windows(samples, keys, idx, value, size, hop)
    all_ = Window.partitionBy(*keys)
    loud = rms.withColumn("loud", F.col("rms") > F.avg("rms").over(all_) + 0.5 * F.stddev_pop("rms").over(all_))
    s = run_segments(loud, keys, ["win"], "loud", "win", "win").where("loud")
    return s.select(*keys, (F.col("start") * hop).alias("start"), ((F.col("end") + 1) * hop).alias("end"))


def frame_activity(samples: DataFrame, keys: list[str], idx: str, value: str, per_frame: int) -> DataFrame:
    """Root mean square of each frame over the largest of all."""
    f = samples.groupBy(*keys, F.floor(F.col(idx) / per_frame).alias("frame")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return f.withColumn("activity", F.coalesce(F.try_divide("rms", F.max("rms").over(Window.partitionBy(*keys))), F.lit(0.0)))


def velocity(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Mean absolute change of the last five values, or the last change while there are fewer."""
    w = _w(keys, order)
    d = df.withColumns({"_d": F.abs(F.col(value) - F.lag(value).over(w)), "_n": F.row_number().over(w)})
    v = F.when(F.col("_n") >= 5, F.avg("_d").over(w.rowsBetween(-3, 0))).otherwise(F.coalesce("_d", F.lit(0.0)))
    v = d.withColumn("velocity", v)
    return v.withColumn("acceleration", F.coalesce(F.col("velocity") - F.lag("velocity").over(w), F.lit(0.0))).drop("_d", "_n")


def predicted(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Next value from the last three, blended with the mean velocity from five on."""
    w = _w(keys, order)
    p = [F.col(value), *[F.lag(value, k).over(w) for k in range(1, 4)]]
    n = F.row_number().over(w)
    near = F.when(n >= 3, 0.2 * p[2] + 0.3 * p[1] + 0.5 * p[0]).when(n == 2, 0.4 * p[1] + 0.6 * p[0]).otherwise(p[0])
    speed = (p[0] - p[3]) / 3
    return df.withColumn("predicted", F.when(n >= 5, 0.5 * near + 0.5 * (p[0] + 1.5 * speed)).otherwise(near))


def recency_distance(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, to_x: float, to_y: float, n: int = 5) -> DataFrame:
    """Distance of a point from the last ``n`` places, later ones weighing more."""
    w = _w(keys, order)
    have = F.least(F.row_number().over(w), F.lit(n))
    total, weights = F.lit(0.0), F.lit(0.0)
    for k in range(n):
        px, py = F.lag(x, k).over(w) if k else F.col(x), F.lag(y, k).over(w) if k else F.col(y)
        weight = F.when(have > k, 0.10 + 0.05 * (have - 1 - k)).otherwise(0.0)
        d = F.sqrt((px - to_x) * (px - to_x) + (py - to_y) * (py - to_y))
        total, weights = total + weight * F.coalesce(d, F.lit(0.0)), weights + weight
    return df.withColumn("distance", total / weights)


def leak(df: DataFrame, keys: list[str], t: str, value: str, span: float = 1800.0, least: int = 10, recent: int = 5, share: float = 0.7) -> DataFrame:
    """Whether most steps of the last ``span`` seconds go up (F17); the newest reading is now."""
    end = F.max(t).over(Window.partitionBy(*keys))
    d = df.withColumns({"_total": F.count("*").over(Window.partitionBy(*keys)), "_end": end}).where(F.col(t) > F.col("_end") - span)
    d = d.withColumn("_up", (F.col(value) > F.lag(value).over(_w(keys, [t]))).cast("int"))
    rate = F.avg("_up")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(rate, F.lit(0.0)).alias("rising"), ((F.max("_total") >= least) & (F.count("*") >= recent) & (F.coalesce(rate, F.lit(0.0)) > share)).alias("leak"))


def trend(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 10) -> DataFrame:
    """Mean of the last two minus mean of the first two of the last ``n`` values; 0 under three."""
    down = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    d = df.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= n)
    d = d.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    late, early = F.avg(F.when(F.col("_r") <= 2, F.col(value))), F.avg(F.when(F.col("_r") > F.col("_n") - 2, F.col(value)))
    return d.groupBy(*keys).agg(F.when(F.max("_n") >= 3, late - early).otherwise(0.0).alias("trend"))


def trim_segments(df: DataFrame, keys: list[str], frame: str, present: str, fps: float, gap: float = 2.0, buffer: float = 0.5) -> DataFrame:
    """Segments left when long absences go, with a buffer around what stays.

    An absence counts from its first frame to the next present frame. If
    nothing is left, or one segment under half a second, the whole stays.
    """
    all_ = Window.partitionBy(*keys)
    runs = with_runs(df, keys, [frame], F.col(present)).groupBy(*keys, "run_id").agg(F.min(frame).alias("a"), F.max(frame).alias("b"), F.first(present).alias("_in"), F.count("*").alias("_n"))
    runs = runs.withColumns({"total": F.sum("_n").over(all_) / fps, "_open": F.col("b") == F.max("b").over(all_), "_first": F.row_number().over(all_.orderBy("a")) == 1})
    until = F.when(F.col("_open"), F.col("total")).otherwise((F.col("b") + 1) / fps)
    gone = ~F.col("_in") & (until - F.col("a") / fps >= gap)
    mark = lambda a, stop, resume: F.struct(a.cast("long").alias("a"), stop.cast("double").alias("stop"), resume.cast("double").alias("resume"))
    none, resume = F.lit(None), F.when(~F.col("_open"), F.greatest(F.lit(0.0), until - buffer))
    both = F.array_compact(F.array(F.when(F.col("_first"), mark(none, none, F.lit(0.0))), F.when(gone, mark(F.col("a"), F.col("a") / fps - buffer, resume))))
    marks = runs.select(*keys, "total", F.explode(both).alias("m")).select(*keys, "total", "m.*")
    order = all_.orderBy(F.asc_nulls_first("a"))
    end = F.when(F.lead("a").over(order).isNotNull(), F.greatest("resume", F.lead("stop").over(order))).otherwise(F.col("total"))
    segs = marks.withColumn("end_s", end).withColumn("_ok", F.col("resume").isNotNull() & (F.col("end_s") > F.col("resume")))
    segs = segs.withColumn("_good", F.col("_ok") & ~((F.count_if("_ok").over(all_) == 1) & (F.col("end_s") - F.col("resume") < 0.5)))
    segs = segs.withColumn("_lost", F.col("a").isNull() & (F.count_if("_good").over(all_) == 0))  # nothing is left: the whole stays
    lost = F.col("_lost")
    out = segs.where("_good or _lost").select(*keys, F.when(lost, 0.0).otherwise(F.col("resume")).alias("start_s"), F.when(lost, F.col("total")).otherwise(F.col("end_s")).alias("end_s"), "total")
    out = out.where("end_s - start_s >= 0.1")
    return out.select(*keys, F.greatest(F.lit(0.0), "start_s").alias("start_s"), F.least("total", "end_s").alias("end_s")).where("end_s > start_s")


def fixed_slices(df: DataFrame, keys: list[str], duration: str, length: int = 10) -> DataFrame:
    """Whole slices of a duration; a shorter tail is dropped."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor(duration).cast("int") - 1, F.lit(0)), F.lit(length))
    s = df.select(*keys, duration, F.explode(starts).alias("start_s"))
    return s.where(F.least(F.col("start_s") + length, F.col(duration)) - F.col("start_s") >= length).select(*keys, "start_s", (F.col("start_s") + length).alias("end_s"))


def rank_split(df: DataFrame, keys: list[str], order: list[Column], share: float = 0.5) -> DataFrame:
    """First part of a ranking against the rest: rank <= floor(n * share)."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(*order))
    return df.withColumn("part", F.when(rank <= F.floor(F.count("*").over(w) * share), "first").otherwise("second"))


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, name: str = "ema", jump: float | None = None) -> DataFrame:
    """Exponential smoothing from the first value on (N8, N24); steps beyond ``jump`` are ignored.

    Each step needs the one before, so a key's rows are folded in order in one
    task, which holds them; missing values leave the last one.
    """
    schema = df.select(*df.columns, F.lit(None).cast("double").alias(name)).schema

    def fold(pdf):
        pdf = pdf.sort_values(order)
        if jump is None:
            return pdf.assign(**{name: pdf[value].astype(float).ewm(alpha=alpha, adjust=False, ignore_na=True).mean()})
        last, out = None, []
        for v in pdf[value]:
            if v == v and v is not None:
                last = v if last is None else last if abs(v - last) > jump else alpha * v + (1 - alpha) * last
            out.append(last)
        return pdf.assign(**{name: out})

    return df.groupBy(*keys).applyInPandas(fold, schema)


def streaks(df: DataFrame, keys: list[str], order: list[str], bad: Column) -> DataFrame:
    """Length so far of the run of bad rows that a row ends, 0 for good ones."""
    runs = with_runs(df.withColumn("_bad", bad), keys, order, F.col("_bad"))
    n = F.row_number().over(Window.partitionBy(*keys, "run_id").orderBy(*order))
    return runs.withColumn("streak", F.when(F.col("_bad"), n).otherwise(0)).drop("_bad", "run_id")


def best_so_far(df: DataFrame, keys: list[str], order: list[str], score: str, config: str) -> DataFrame:
    """Running best score with the first configuration that reached it."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(score).over(w)
    out = df.withColumn("best_score", best)
    first = F.when(F.col(score) == F.col("best_score"), F.col(config))
    new = F.col("best_score").eqNullSafe(F.lag("best_score").over(_w(keys, order)))
    return out.withColumn("best_config", F.last(F.when(~new, first), ignorenulls=True).over(w))
