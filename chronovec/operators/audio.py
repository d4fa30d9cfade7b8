"""Operators on speakers, faces and paired timelines: top ids, interval joins, profiles, lags, votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_ids(df: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    """The ``n`` most frequent values with their counts; ties go to the first seen."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "_first"))
    return c.withColumn("r", r).where(F.col("r") <= n).drop("_first")


def top_two(df: DataFrame, keys: list[str], order: str, value: str, dominant: float = 0.9) -> DataFrame:
    """The two most frequent values and the first one's share of both."""
    t = top_ids(df, keys, order, value, 2)
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    share = pick("n", 1) / F.sum("n")
    return t.groupBy(*keys).agg(pick(value, 1).alias("first_id"), pick(value, 2).alias("second_id"), share.alias("share"), (share > dominant).alias("dominant"))


def coverage(df: DataFrame, keys: list[str], matches: Column) -> DataFrame:
    """Rows, matching rows and their ratio."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(matches).alias("matching"), F.coalesce(F.try_divide(F.count_if(matches), F.count("*")), F.lit(0.0)).alias("ratio"))


def interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, keys: list[str], width: float) -> DataFrame:
    """Points with the intervals [start, end) that hold them.

    Both sides are dealt by key and time bucket of ``width``, so the join is
    an equality join; an interval is copied once for each bucket it touches.
    """
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    last = F.ceil(F.col(end) / width) - 1
    i = intervals.where(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.greatest(last, F.floor(F.col(start) / width)))))
    return p.join(i, [*keys, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def last_wins(joined: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Where intervals overlap, the later one's value."""
    return joined.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def speaker_stats(df: DataFrame, keys: list[str], speaker: str, segment: str, start: str, end: str, face: str) -> DataFrame:
    """Segments, seconds and distinct faces of each speaker."""
    once = df.groupBy(*keys, speaker, segment).agg(F.first(start).alias("_a"), F.first(end).alias("_b"), F.collect_set(face).alias("_f"))
    out = once.groupBy(*keys, speaker).agg(F.count("*").alias("segments"), F.sum(F.col("_b") - F.col("_a")).alias("seconds"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_f")))).alias("ids"))
    return out.withColumn("ids", F.array_join("ids", ","))


def speaker_profiles(df: DataFrame, keys: list[str], speaker: str, start: str, end: str, confidence: str, total: float) -> DataFrame:
    """Count, total, mean and share of speech, with the segments in order."""
    d = F.col(end) - F.col(start)
    return df.groupBy(*keys, speaker).agg(
        F.count("*").alias("n"), F.sum(d).alias("total"), F.avg(d).alias("mean"), F.coalesce(F.try_divide(F.sum(d), F.lit(total)), F.lit(0.0)).alias("share"),
        F.sort_array(F.collect_list(F.struct(F.col(start).alias("start"), F.col(end).alias("end")))).alias("segments"), F.avg(confidence).alias("confidence"),
    )


def cooccurrence(df: DataFrame, keys: list[str], speaker: str, slots: dict[str, Column]) -> DataFrame:
    """Rows of each speaker in which each slot is filled."""
    return df.groupBy(*keys, speaker).agg(*[F.count_if(c).alias(n) for n, c in slots.items()])


def match_slots(counts: DataFrame, keys: list[str], speaker: str, a: str, b: str) -> DataFrame:
    """The speaker with the largest count takes its slot, the next the other one, the rest none."""
    w = Window.partitionBy(*keys)
    r = counts.withColumns({
        "_r": F.row_number().over(w.orderBy(F.greatest(a, b).desc(), speaker)),
        "_p": F.when(F.col(a) >= F.col(b), a).otherwise(b),
    })
    first = F.max(F.when(F.col("_r") == 1, F.col("_p"))).over(w)
    slot = F.when(F.col("_r") == 1, F.col("_p")).when(F.col("_r") == 2, F.when(first == a, b).otherwise(a))
    return r.select(*keys, speaker, slot.alias("slot"))


def pearson(x: str, y: str) -> Column:
    """Correlation, 0 where it is not defined."""
    return F.when(F.count("*") < 2, 0.0).otherwise(F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0)))


#: Steps of the order in a stretch that ``lag_correlation`` deals to one task at a time.
STRETCH = 4096


def lag_correlation(a: DataFrame, b: DataFrame, order: str, x: str, y: str, most: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Correlation of a[t] with b[t + lag] for every lag up to ``most`` either way (D7), for each key.

    Rows of both sides are dealt by key and stretch of the order, those of b
    also to a stretch beside theirs that they reach. A window then shows each
    row of a those of b around it: rows are exchanged once, not once a lag,
    and neither side is broadcast.
    """
    at, part = F.col(order), lambda c: F.floor(c / STRETCH)
    there = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*keys, order)])
    left = a.where(there).select(*keys, at.alias("_at"), part(at).alias("_part"), F.col(x).alias("_x"), F.lit(None).alias("_y"), F.lit(True).alias("_own"))
    reached = F.explode(F.sequence(part(at - most), part(at + most)))
    right = b.where(there).select(*keys, at.alias("_at"), reached.alias("_part"), F.lit(None).alias("_x"), F.col(y).alias("_y"), F.lit(False).alias("_own"))
    around = Window.partitionBy(*keys, "_part").orderBy("_at").rangeBetween(-most, most)
    near = F.collect_list(F.when(~F.col("_own"), F.struct("_at", "_y"))).over(around)
    j = left.unionByName(right).withColumn("_near", near).where("_own").select(*keys, "_at", "_x", F.explode("_near").alias("_b"))
    j = j.withColumn("lag", (F.col("_b._at") - F.col("_at")).cast("int")).where(F.col("_at") + F.col("lag") == F.col("_b._at")).withColumn("_y", F.col("_b._y"))
    return j.groupBy(*keys, "lag").agg(F.count("*").alias("n"), pearson("_x", "_y").alias("corr"))


def best_lag(corrs: DataFrame, least: int = 10) -> DataFrame:
    """The lag with the largest correlation, the smallest such; (0, 0) under ``least`` rows."""
    usable = corrs.agg(F.max("n").alias("_n"), F.max_by(F.struct("lag", "corr"), F.struct(F.col("corr"), -F.col("lag"))).alias("_b"))
    ok = F.col("_n") >= least
    return usable.select(F.when(ok, F.col("_b.lag")).otherwise(0).alias("lag"), F.when(ok, F.col("_b.corr")).otherwise(0.0).alias("corr"))


def vote(keys: list[str], speaker: str, slot: str, ballots: list[tuple[DataFrame, float]]) -> DataFrame:
    """The slot with the largest sum of weighted votes."""
    rows = reduce(DataFrame.unionByName, [b.select(*keys, speaker, slot).withColumn("_w", F.lit(w)) for b, w in ballots])
    s = rows.groupBy(*keys, speaker, slot).agg(F.sum("_w").alias("votes"))
    r = F.row_number().over(Window.partitionBy(*keys, speaker).orderBy(F.desc("votes"), slot))
    return s.withColumn("_r", r).where("_r = 1").drop("_r")


def active_score(mouth: Column, correlation: Column, face: Column) -> Column:
    """Weighted activity of a speaker."""
    return 0.4 * mouth + 0.4 * F.greatest(F.lit(0.0), correlation) + 0.2 * face


def entropy(df: DataFrame, keys: list[str], bin_: str, bits: int) -> DataFrame:
    """Shannon entropy of a histogram over its largest value."""
    b = df.groupBy(*keys, bin_).count()
    p = b.withColumn("_p", F.col("count") / F.sum("count").over(Window.partitionBy(*keys)))
    return p.groupBy(*keys).agg((-F.sum(F.col("_p") * F.log2("_p")) / bits).alias("entropy"))


def mock_segments(tracks: DataFrame, key: str, duration: str, speakers: int = 2) -> DataFrame:
    """Made-up speech turns (A13): 3 to 8 s long, half a second to two of silence, a new speaker seven times in ten.

    Draws are hashes of the key and the turn, so every run gives the same rows.
    """
    hashed = lambda salt: F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("turn").cast("string"), F.lit(salt)).cast("binary"))
    draw = lambda salt: F.conv(F.substring(hashed(salt), 1, 8), 16, 10).cast("long") % 1000 / 1000.0
    n = F.ceil(F.col(duration) / 3.5).cast("int")
    t =tracks.select(key, duration, F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).alias("turn"))
    t = t.withColumns({"_len": 3 + 5 * draw("length"), "_gap": 0.5 + 1.5 * draw("gap"), "_next": (draw("next") < 0.7).cast("int"), "confidence": 0.7 + 0.2 * draw("sure")})
    before = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"start_time": F.coalesce(F.sum(F.col("_len") + F.col("_gap")).over(before), F.lit(0.0)), "_turns": F.coalesce(F.sum("_next").over(before), F.lit(0))})
    t = t.withColumns({"end_time": F.least(F.col("start_time") + F.col("_len"), F.col(duration)), "speaker": F.concat(F.lit("SPEAKER_"), F.lpad(F.pmod("_turns", F.lit(speakers)).cast("string"), 2, "0"))})
    return t.where(F.col("end_time") - F.col("start_time") >= 0.5 - 1e-9).select(key, "turn", "speaker", "start_time", "end_time", "confidence")
