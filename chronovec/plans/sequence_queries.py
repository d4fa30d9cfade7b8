"""Timeline queries: runs, gaps, rolling rates, predictions, slices, speakers, audio-like activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import audio, frames, recovery, sequence
from .catalog import query, timeline, vectors

KEY = ["user_id"]
RUNS = """runs AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS run_id FROM (
  SELECT *, CASE WHEN lag(present) OVER w IS NULL OR lag(present) OVER w = present THEN 0 ELSE 1 END AS c FROM tl WINDOW w AS (PARTITION BY user_id ORDER BY i)))"""


@query("f1_run_segments", f"WITH {RUNS} SELECT user_id, run_id::BIGINT AS run_id, present, count(*) AS n, min(t) AS start, max(t) AS \"end\" FROM runs GROUP BY ALL")
def f1(spark, d) -> DataFrame:
    return sequence.run_segments(timeline(spark, d), KEY, ["i"], "present", "t", "t").select("user_id", F.col("run_id").cast("long").alias("run_id"), "present", "n", "start", "end")


@query("f1_condense", f"""WITH {RUNS}, s AS (SELECT user_id, run_id, present, min(i) / 1.0 AS a, (max(i) + 1) / 1.0 AS b FROM runs GROUP BY ALL)
SELECT user_id, run_id::BIGINT AS run_id, a::DOUBLE AS start_s, b::DOUBLE AS end_s FROM s WHERE present OR b - a <= 1""")
def f1_condense(spark, d) -> DataFrame:
    return sequence.condense(timeline(spark, d), KEY, "i", "present", 1.0, 1.0).withColumn("run_id", F.col("run_id").cast("long"))


@query("f2_null_mask", f"""WITH {RUNS}, k AS (SELECT *, present OR count(*) OVER (PARTITION BY user_id, run_id) < 2 AS keep FROM runs),
r2 AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM k WHERE keep)
SELECT user_id, min(i)::DOUBLE AS start_s, (max(i) + 1)::DOUBLE AS end_s FROM r2 GROUP BY user_id, g""")
def f2(spark, d) -> DataFrame:
    return sequence.drop_null_runs(timeline(spark, d).withColumn("id", F.when(F.col("present"), 1)), KEY, "i", "id", 2, 1.0)


@query("f3_rolling_rate", "SELECT user_id, i, round(avg(CASE WHEN present THEN 1.0::DOUBLE ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY i ROWS 19 PRECEDING), 6) AS rate FROM tl")
def f3(spark, d) -> DataFrame:
    return sequence.rolling(timeline(spark, d), KEY, ["i"], F.col("present").cast("double"), 20, "rate").select("user_id", "i", F.round("rate", 6).alias("rate"))


@query("f16_low_trigger", """SELECT user_id, i, row_number() OVER w >= 10 AND sum((value < 60)::INT) OVER (PARTITION BY user_id ORDER BY i ROWS 9 PRECEDING) >= 8 AS trigger
FROM tl WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def f16(spark, d) -> DataFrame:
    return sequence.low_trigger(timeline(spark, d), KEY, ["i"], "value", 10, 60.0).select("user_id", "i", "trigger")


@query("f23_adaptive_interval", """WITH r AS (SELECT user_id, i, avg(CASE WHEN present THEN 1.0::DOUBLE ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY i ROWS 29 PRECEDING) AS rate FROM tl)
SELECT user_id, i, (CASE WHEN rate > 0.95 THEN 80 WHEN rate > 0.8 THEN 40 WHEN rate > 0.6 THEN 20 ELSE 10 END)::INT AS step FROM r""")
def f23(spark, d) -> DataFrame:
    r = sequence.rolling(timeline(spark, d), KEY, ["i"], F.col("present").cast("double"), 30, "rate")
    return r.select("user_id", "i", sequence.adaptive_interval(F.col("rate"), 40).alias("step"))


@query("f4_motion", """WITH m AS (SELECT user_id, sqrt((t/3600 - lag(t/3600) OVER w)**2 + (value - lag(value) OVER w)**2) AS d FROM tl WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, round(coalesce(least(avg(d) / 50, 1.0), 0.0), 6) AS motion FROM m GROUP BY user_id""")
def f4(spark, d) -> DataFrame:
    m = sequence.motion_score(timeline(spark, d).withColumn("hour", F.col("t") / 3600), KEY, ["i"], "hour", "value")
    return m.select("user_id", F.round("motion", 6).alias("motion"))


_MODE = """(SELECT user_id, i, arg_min(who, (-n) * 1000000 + first) AS who FROM (SELECT a.user_id, a.i, b.who, count(*) AS n, min(b.i) AS first FROM o a JOIN o b ON a.user_id = b.user_id AND b.i BETWEEN a.i - {lo} AND a.i + {hi}
WHERE b.who IS NOT NULL GROUP BY ALL) GROUP BY 1, 2)"""


@query("f9_speaker_change", f"""WITH o AS (SELECT user_id, i, CASE WHEN present THEN event_type END AS who FROM tl)
SELECT o.user_id, o.i, n.who AS now, b.who AS before, coalesce(n.who <> b.who, false) AS changed FROM o
LEFT JOIN {_MODE.format(lo=4, hi=3)} n USING (user_id, i) LEFT JOIN {_MODE.format(lo=8, hi=-5)} b USING (user_id, i)""")
def f9(spark, d) -> DataFrame:
    out = sequence.speaker_change(timeline(spark, d).withColumn("who", F.when(F.col("present"), F.col("event_type"))), KEY, "i", "who", 8)
    return out.select("user_id", "i", "now", "before", "changed")


@query("f11_hop_windows", """WITH n AS (SELECT user_id, max(i) AS last FROM tl GROUP BY 1), h AS (SELECT user_id, unnest(range(0, (last - 5) // 2 + 1)) AS win FROM n WHERE last >= 5)
SELECT h.user_id, win, round(sqrt(avg(value * value)), 6) AS rms FROM h JOIN tl ON tl.user_id = h.user_id AND i BETWEEN win * 2 AND win * 2 + 4 GROUP BY 1, 2""")
def f11_windows(spark, d) -> DataFrame:
    return sequence.amplitude_windows(timeline(spark, d), KEY, "i", "value", 5, 2).select("user_id", "win", F.round("rms", 6).alias("rms"))


@query("f11_amplitude_activity", """WITH n AS (SELECT user_id, max(i) AS last FROM tl GROUP BY 1), h AS (SELECT user_id, unnest(range(0, (last - 5) // 2 + 1)) AS win FROM n WHERE last >= 5),
r AS (SELECT h.user_id, win, sqrt(avg(value * value)) AS rms FROM h JOIN tl ON tl.user_id = h.user_id AND i BETWEEN win * 2 AND win * 2 + 4 GROUP BY 1, 2),
l AS (SELECT *, rms > avg(rms) OVER (PARTITION BY user_id) + 0.5 * stddev_pop(rms) OVER (PARTITION BY user_id) AS loud FROM r),
g AS (SELECT *, win - row_number() OVER (PARTITION BY user_id ORDER BY win) AS g FROM l WHERE loud)
SELECT user_id, min(win) * 2 AS start, (max(win) + 1) * 2 AS "end" FROM g GROUP BY user_id, g""")
def f11(spark, d) -> DataFrame:
    return sequence.amplitude_activity(timeline(spark, d), KEY, "i", "value", 5, 2)


@query("f12_frame_activity", """WITH f AS (SELECT user_id, i // 4 AS frame, sqrt(avg(value * value)) AS rms FROM tl GROUP BY 1, 2)
SELECT user_id, frame, round(rms, 6) AS rms, round(coalesce(rms / nullif(max(rms) OVER (PARTITION BY user_id), 0), 0), 6) AS activity FROM f""")
def f12(spark, d) -> DataFrame:
    f = sequence.frame_activity(timeline(spark, d), KEY, "i", "value", 4)
    return f.select("user_id", "frame", F.round("rms", 6).alias("rms"), F.round("activity", 6).alias("activity"))


@query("f10_voice_runs", f"WITH {RUNS} SELECT user_id, min(i) * 0.03::DOUBLE AS start_s, (max(i) + 1) * 0.03::DOUBLE AS end_s FROM runs WHERE present GROUP BY user_id, run_id")
def f10(spark, d) -> DataFrame:
    s = sequence.run_segments(timeline(spark, d), KEY, ["i"], "present", "i", "i").where("present")
    return s.select("user_id", (F.col("start") * F.lit(0.03)).alias("start_s"), ((F.col("end") + 1) * F.lit(0.03)).alias("end_s"))


@query("f13_velocity", """WITH a AS (SELECT user_id, i, abs(value - lag(value) OVER w) AS d, row_number() OVER w AS n FROM tl WINDOW w AS (PARTITION BY user_id ORDER BY i)),
b AS (SELECT user_id, i, CASE WHEN n >= 5 THEN avg(d) OVER (PARTITION BY user_id ORDER BY i ROWS 3 PRECEDING) ELSE coalesce(d, 0) END AS v FROM a)
SELECT user_id, i, round(v, 6) AS velocity, round(coalesce(v - lag(v) OVER (PARTITION BY user_id ORDER BY i), 0), 4) AS acceleration FROM b""")
def f13(spark, d) -> DataFrame:
    v = sequence.velocity(timeline(spark, d), KEY, ["i"], "value")
    return v.select("user_id", "i", F.round("velocity", 6).alias("velocity"), F.round("acceleration", 4).alias("acceleration"))


@query("f14_predicted", """WITH a AS (SELECT user_id, i, value p0, lag(value, 1) OVER w p1, lag(value, 2) OVER w p2, lag(value, 3) OVER w p3, row_number() OVER w n FROM tl WINDOW w AS (PARTITION BY user_id ORDER BY i)),
b AS (SELECT *, CASE WHEN n >= 3 THEN 0.2 * p2 + 0.3 * p1 + 0.5 * p0 WHEN n = 2 THEN 0.4 * p1 + 0.6 * p0 ELSE p0 END AS near FROM a)
SELECT user_id, i, round(CASE WHEN n >= 5 THEN 0.5 * near + 0.5 * (p0 + 1.5 * (p0 - p3) / 3) ELSE near END, 4) AS predicted FROM b""")
def f14(spark, d) -> DataFrame:
    return sequence.predicted(timeline(spark, d), KEY, ["i"], "value").select("user_id", "i", F.round("predicted", 4).alias("predicted"))


@query("f15_recency_distance", """WITH a AS (SELECT user_id, i, least(row_number() OVER w, 5) AS n, [value, lag(value, 1) OVER w, lag(value, 2) OVER w, lag(value, 3) OVER w, lag(value, 4) OVER w] AS ys,
  [t, lag(t, 1) OVER w, lag(t, 2) OVER w, lag(t, 3) OVER w, lag(t, 4) OVER w] AS xs FROM tl WINDOW w AS (PARTITION BY user_id ORDER BY i)),
b AS (SELECT user_id, i, n, unnest(range(0, n)) AS k, xs, ys FROM a)
SELECT user_id, i, round(sum((0.10 + 0.05 * (n - 1 - k)) * sqrt((xs[k + 1] / 86400 - 10)**2 + (ys[k + 1] - 50)**2)) / sum(0.10 + 0.05 * (n - 1 - k)), 4) AS distance FROM b GROUP BY 1, 2""")
def f15(spark, d) -> DataFrame:
    r = sequence.recency_distance(timeline(spark, d).withColumn("day", F.col("t") / 86400), KEY, ["i"], "day", "value", 10.0, 50.0)
    return r.select("user_id", "i", F.round("distance", 4).alias("distance"))


@query("f17_leak", """WITH e AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS mx, count(*) OVER (PARTITION BY user_id) AS total FROM tl),
r AS (SELECT *, (value > lag(value) OVER (PARTITION BY user_id ORDER BY t))::INT AS up FROM e WHERE t > mx - 604800)
SELECT user_id, count(*) AS n, round(coalesce(avg(up), 0), 6) AS rising, max(total) >= 10 AND count(*) >= 5 AND coalesce(avg(up), 0) > 0.5 AS leak FROM r GROUP BY user_id""")
def f17(spark, d) -> DataFrame:
    return sequence.leak(timeline(spark, d), KEY, "t", "value", 604800.0, share=0.5).withColumn("rising", F.round("rising", 6))


@query("f18_trend", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS r FROM tl),
n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM r WHERE r <= 10)
SELECT user_id, round(CASE WHEN max(n) >= 3 THEN avg(value) FILTER (r <= 2) - avg(value) FILTER (r > n - 2) ELSE 0 END, 4) AS trend FROM n GROUP BY user_id""")
def f18(spark, d) -> DataFrame:
    return sequence.trend(timeline(spark, d), KEY, ["i"], "value").withColumn("trend", F.round("trend", 4))


@query("f19_trim_segments", f"""WITH {RUNS}, tot AS (SELECT user_id, count(*)::DOUBLE AS total, max(i) AS last FROM tl GROUP BY 1),
ab AS (SELECT user_id, min(i)::DOUBLE AS a, max(i) AS b FROM runs WHERE NOT present GROUP BY user_id, run_id),
ab2 AS (SELECT ab.*, total, b = last AS open, CASE WHEN b = last THEN total ELSE b + 1 END AS until FROM ab JOIN tot USING (user_id)),
mk AS (SELECT user_id, a, a - 0.5 AS stop, CASE WHEN NOT open THEN greatest(0, until - 0.5) END AS resume FROM ab2 WHERE until - a >= 2 UNION ALL SELECT user_id, NULL, NULL, 0 FROM tot),
sg AS (SELECT *, lead(stop) OVER w AS nstop, lead(a) OVER w IS NOT NULL AS more FROM mk WINDOW w AS (PARTITION BY user_id ORDER BY a NULLS FIRST)),
s2 AS (SELECT user_id, resume AS s, CASE WHEN more THEN greatest(resume, nstop) ELSE total END AS e, total FROM sg JOIN tot USING (user_id) WHERE resume IS NOT NULL),
s3 AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s2 WHERE e > s), s4 AS (SELECT user_id, s, e, total FROM s3 WHERE NOT (n = 1 AND e - s < 0.5)),
s5 AS (SELECT * FROM s4 UNION ALL SELECT user_id, 0, total, total FROM tot WHERE user_id NOT IN (SELECT user_id FROM s4))
SELECT user_id, greatest(0, s)::DOUBLE AS start_s, least(total, e)::DOUBLE AS end_s FROM s5 WHERE e - s >= 0.1""")
def f19(spark, d) -> DataFrame:
    return sequence.trim_segments(timeline(spark, d), KEY, "i", "present", 1.0)


@query("f20_slices", """WITH n AS (SELECT user_id, max(t) / 86400 AS dur FROM tl GROUP BY 1)
SELECT user_id, s::INT AS start_s, (s + 10)::INT AS end_s FROM (SELECT user_id, dur, unnest(range(0, greatest(floor(dur)::BIGINT - 1, 0) + 1, 10)) AS s FROM n) WHERE least(s + 10, dur) - s >= 10""")
def f20(spark, d) -> DataFrame:
    return sequence.fixed_slices(timeline(spark, d).groupBy("user_id").agg((F.max("t") / 86400).alias("dur")), KEY, "dur")


@query("f21_median_split", "SELECT user_id, i, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY value, i) <= floor(count(*) OVER (PARTITION BY user_id) * 0.5) THEN 'first' ELSE 'second' END AS part FROM tl")
def f21(spark, d) -> DataFrame:
    return sequence.rank_split(timeline(spark, d), KEY, [F.asc("value"), F.asc("i")]).select("user_id", "i", "part")


@query("f22_size_split", "SELECT user_id, i, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY value DESC, i) <= floor(count(*) OVER (PARTITION BY user_id) * 0.6::DOUBLE) THEN 'first' ELSE 'second' END AS part FROM tl")
def f22(spark, d) -> DataFrame:
    return sequence.rank_split(timeline(spark, d), KEY, [F.desc("value"), F.asc("i")], 0.6).select("user_id", "i", "part")


@query("n17_error_streak", f"WITH {RUNS} SELECT user_id, i, (CASE WHEN present THEN 0 ELSE row_number() OVER (PARTITION BY user_id, run_id ORDER BY i) END)::INT AS streak FROM runs")
def n17(spark, d) -> DataFrame:
    return sequence.streaks(timeline(spark, d), KEY, ["i"], ~F.col("present")).select("user_id", "i", F.col("streak").cast("int").alias("streak"))


# one step a row: streak, kinds that have turned to the safest action, whether it goes on
_RECOVERY = """WITH RECURSIVE o AS (SELECT user_id, i, event_type IN ('error', 'view', 'click') AS bad, value AS used, ['gpu_memory', 'frame_processing', 'single_face_missing', 'dual_face_missing', 'resize', 'composition', 'cuda', 'unknown', 'other'][event_id % 9 + 1] AS kind FROM tl),
p AS (SELECT *, CASE WHEN kind = 'other' THEN 'unknown' ELSE kind END AS k FROM o),
k AS (SELECT DISTINCT user_id, -1::BIGINT AS i, 0 AS streak, []::VARCHAR[] AS hard, NULL::VARCHAR AS action, false AS stopped FROM p UNION ALL
SELECT user_id, i, streak, hard, CASE WHEN bad THEN CASE WHEN list_contains(hard, k) THEN 'use_black_frame' ELSE CASE k WHEN 'gpu_memory' THEN 'reduce_quality' WHEN 'resize' THEN 'reduce_quality' WHEN 'single_face_missing' THEN 'use_single_frame'
WHEN 'dual_face_missing' THEN 'use_fallback_frame' WHEN 'cuda' THEN 'retry_with_cpu' ELSE 'use_previous_frame' END END END, bad AND (streak >= 6 OR (k = 'gpu_memory' AND used > 85)) FROM (
SELECT *, CASE WHEN bad AND streak >= 3 THEN list_append(before, k) ELSE before END AS hard FROM (
SELECT p.user_id, p.i, p.bad, p.k, p.used, CASE WHEN p.bad THEN k.streak + 1 ELSE 0 END AS streak, k.hard AS before FROM k JOIN p ON p.user_id = k.user_id AND p.i = k.i + 1 WHERE NOT k.stopped)))
SELECT user_id, i, streak, action, stopped FROM k WHERE i >= 0"""


@query("n17_recovery_plan", _RECOVERY)
def n17_plan(spark, d) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in [*recovery.ACTIONS, "other"]])
    t = timeline(spark, d).withColumn("kind", F.element_at(kinds, (F.col("event_id") % 9 + 1).cast("int")))
    plan = recovery.recovery_plan(t, KEY, ["i"], F.col("event_type").isin("error", "view", "click"), "kind", "value", most=6)
    return plan.select("user_id", "i", F.col("streak").cast("int").alias("streak"), "action", "stopped")


@query("n23_best_so_far", """WITH b AS (SELECT user_id, i, value, event_type, max(value) OVER (PARTITION BY user_id ORDER BY i) AS best FROM tl)
SELECT user_id, i, best AS best_score, (SELECT max_by(event_type, -x.i) FROM tl x WHERE x.user_id = b.user_id AND x.value = b.best AND x.i <= b.i) AS best_config FROM b""")
def n23(spark, d) -> DataFrame:
    return sequence.best_so_far(timeline(spark, d), KEY, ["i"], "value", "event_type").select("user_id", "i", "best_score", "best_config")


@query("n8_ema", """WITH RECURSIVE e AS (SELECT user_id, i, value AS ema FROM tl WHERE i = 0 UNION ALL
SELECT tl.user_id, tl.i, 0.15 * tl.value + (1 - 0.15) * e.ema FROM e JOIN tl ON tl.user_id = e.user_id AND tl.i = e.i + 1) SELECT user_id, i, round(ema + 1e-9, 6) AS ema FROM e""")
def n8(spark, d) -> DataFrame:
    e = sequence.ema(timeline(spark, d).select("user_id", "i", "value"), KEY, ["i"], "value", 0.15)
    return e.select("user_id", "i", F.round(F.col("ema") + 1e-9, 6).alias("ema"))


# ---- identities on a timeline ----

IDS = "ids AS (SELECT user_id, i, event_type AS id FROM tl WHERE present)"
FREQ = f"{IDS}, fr AS (SELECT user_id, id, count(*) AS n, min(i) AS first FROM ids GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM fr)"


@query("e1_mode_id", f"WITH {FREQ} SELECT user_id, id, n FROM rk WHERE r = 1")
def e1(spark, d) -> DataFrame:
    return audio.top_ids(_ids(spark, d), KEY, "i", "id", 1).select("user_id", "id", "n")


@query("e2_top2_ids", f"""WITH {FREQ} SELECT user_id, max(id) FILTER (r = 1) AS first_id, max(id) FILTER (r = 2) AS second_id,
round(max(n) FILTER (r = 1) / sum(n)::DOUBLE, 6) AS share, max(n) FILTER (r = 1) / sum(n)::DOUBLE > 0.9 AS dominant FROM rk WHERE r <= 2 GROUP BY user_id""")
def e2(spark, d) -> DataFrame:
    return audio.top_two(_ids(spark, d), KEY, "i", "id").withColumn("share", F.round("share", 6))


@query("e3_first_id", f"WITH {IDS} SELECT user_id, min_by(id, i) AS id FROM ids GROUP BY 1")
def e3(spark, d) -> DataFrame:
    return _ids(spark, d).where("id is not null").groupBy("user_id").agg(F.min_by("id", "i").alias("id"))


@query("e4_coverage", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'view') AS matching, round(count(*) FILTER (event_type = 'view') / count(*)::DOUBLE, 6) AS ratio FROM tl GROUP BY 1")
def e4(spark, d) -> DataFrame:
    return audio.coverage(timeline(spark, d), KEY, F.col("event_type") == "view").withColumn("ratio", F.round("ratio", 6))


def _ids(spark, d) -> DataFrame:
    return timeline(spark, d).withColumn("id", F.when(F.col("present"), F.col("event_type")))


# ---- segments and speakers: ten-hour segments of a day, spoken by turns ----

SEG = "sg AS (SELECT user_id, s AS seg, CASE WHEN s % 2 = 0 THEN 'A' ELSE 'B' END AS speaker, s * 86400.0::DOUBLE AS a, s * 86400.0::DOUBLE + 36000 AS b FROM (SELECT DISTINCT user_id FROM tl), (SELECT unnest(range(0, 30)) AS s))"


def _segments(spark, d) -> DataFrame:
    s = timeline(spark, d).select("user_id").distinct().withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))))
    a = F.col("seg") * 86400.0
    return s.select("user_id", "seg", F.when(F.col("seg") % 2 == 0, "A").otherwise("B").alias("speaker"), a.alias("a"), (a + 36000).alias("b"))


@query("d5_interval_join", f"WITH {SEG} SELECT t.user_id, t.event_id, s.seg, s.speaker FROM tl t JOIN sg s ON t.user_id = s.user_id AND t.t >= s.a AND t.t < s.b")
def d5(spark, d) -> DataFrame:
    return audio.interval_join(timeline(spark, d), "t", _segments(spark, d), "a", "b", KEY, 86400.0).select("user_id", "event_id", "seg", "speaker")


@query("e5_segment_top2", f"""WITH {SEG}, j AS (SELECT t.user_id, t.i, t.event_type AS id, s.seg FROM tl t JOIN sg s ON t.user_id = s.user_id AND t.t >= s.a AND t.t < s.b),
c AS (SELECT user_id, seg, id, count(*) AS n, min(i) AS first FROM j GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, seg ORDER BY n DESC, first) AS r FROM c)
SELECT user_id, seg, id, n, r::INT AS r FROM r WHERE r <= 2""")
def e5(spark, d) -> DataFrame:
    j = audio.interval_join(timeline(spark, d), "t", _segments(spark, d), "a", "b", KEY, 86400.0)
    return audio.top_ids(j, ["user_id", "seg"], "i", "event_type", 2).select("user_id", "seg", F.col("event_type").alias("id"), "n", "r")


@query("e6_speaker_stats", f"""WITH {SEG}, j AS (SELECT t.user_id, t.event_type, s.seg, s.speaker, s.a, s.b FROM tl t JOIN sg s ON t.user_id = s.user_id AND t.t >= s.a AND t.t < s.b),
k AS (SELECT DISTINCT user_id, speaker, seg, a, b FROM j), q AS (SELECT user_id, speaker, count(*) AS segments, sum(b - a) AS seconds FROM k GROUP BY ALL),
f AS (SELECT user_id, speaker, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS ids FROM j GROUP BY ALL) SELECT * FROM q JOIN f USING (user_id, speaker)""")
def e6(spark, d) -> DataFrame:
    j = audio.interval_join(timeline(spark, d), "t", _segments(spark, d), "a", "b", KEY, 86400.0)
    return audio.speaker_stats(j, KEY, "speaker", "seg", "a", "b", "event_type")


@query("e7_speaker_profile", f"""WITH {SEG}, x AS (SELECT user_id, speaker, seg, a, b, seg / 30.0::DOUBLE AS conf FROM sg)
SELECT user_id, speaker, count(*) AS n, round(sum(b - a), 4) AS total, round(avg(b - a), 4) AS mean, round(sum(b - a) / 2592000.0, 6) AS share,
array_to_string(list(a::BIGINT || '-' || b::BIGINT ORDER BY a), ',') AS segments, round(avg(conf), 6) AS confidence FROM x GROUP BY ALL""")
def e7(spark, d) -> DataFrame:
    s = _segments(spark, d).withColumn("conf", F.col("seg") / 30.0)
    p = audio.speaker_profiles(s, KEY, "speaker", "a", "b", "conf", 2592000.0)
    text = F.array_join(F.transform("segments", lambda x: F.concat_ws("-", x["start"].cast("long"), x["end"].cast("long"))), ",")
    return p.select("user_id", "speaker", "n", F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"), F.round("share", 6).alias("share"), text.alias("segments"), F.round("confidence", 6).alias("confidence"))


@query("e8_cooccurrence", f"""WITH {SEG}, j AS (SELECT t.user_id, t.event_type, s.speaker FROM tl t JOIN sg s ON t.user_id = s.user_id AND t.t >= s.a AND t.t < s.b)
SELECT user_id, speaker, count(*) FILTER (event_type IN ('view', 'click')) AS slot_a, count(*) FILTER (event_type IN ('purchase', 'click')) AS slot_b FROM j GROUP BY ALL""")
def e8(spark, d) -> DataFrame:
    return _cooccurrence(spark, d)


def _cooccurrence(spark, d) -> DataFrame:
    j = audio.interval_join(timeline(spark, d), "t", _segments(spark, d), "a", "b", KEY, 86400.0)
    slots = {"slot_a": F.col("event_type").isin("view", "click"), "slot_b": F.col("event_type").isin("purchase", "click")}
    return audio.cooccurrence(j, KEY, "speaker", slots)


@query("n7_slot_match", f"""WITH {SEG}, j AS (SELECT t.user_id, t.event_type, s.speaker FROM tl t JOIN sg s ON t.user_id = s.user_id AND t.t >= s.a AND t.t < s.b),
c AS (SELECT user_id, speaker, count(*) FILTER (event_type IN ('view', 'click')) AS a, count(*) FILTER (event_type IN ('purchase', 'click')) AS b FROM j GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY greatest(a, b) DESC, speaker) AS r, CASE WHEN a >= b THEN 'slot_a' ELSE 'slot_b' END AS pref FROM c),
f AS (SELECT user_id, max(pref) FILTER (r = 1) AS p1 FROM r GROUP BY 1)
SELECT user_id, speaker, CASE WHEN r = 1 THEN pref WHEN r = 2 THEN CASE WHEN p1 = 'slot_a' THEN 'slot_b' ELSE 'slot_a' END END AS slot FROM r JOIN f USING (user_id)""")
def n7(spark, d) -> DataFrame:
    return audio.match_slots(_cooccurrence(spark, d), KEY, "speaker", "slot_a", "slot_b")


@query("e9_mean_confidence", "SELECT event_type, round(avg(value), 6) AS confidence FROM tl GROUP BY 1")
def e9(spark, d) -> DataFrame:
    return timeline(spark, d).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("confidence"))


def _next_user(spark, d) -> tuple[DataFrame, DataFrame]:
    """Every user's timeline, and beside it the next user's, under the first one's id."""
    t = timeline(spark, d)
    u = t.select("user_id").distinct().withColumn("run", F.floor(F.col("user_id") / 1024))
    # the next id is in the same run of ids, or the first of the next run; only one row a run is sorted as a whole
    first = u.groupBy("run").agg(F.min("user_id").alias("first")).withColumn("after", F.lead("first").over(Window.orderBy("run"))).select("run", "after")
    near = F.lead("user_id").over(Window.partitionBy("run").orderBy("user_id"))
    # users and their events grow with the table: joins are merges, as files look small enough to be broadcast when rows are not
    pairs = u.withColumn("near", near).join(first.hint("merge"), "run").select("user_id", F.coalesce("near", "after").alias("next")).where("next is not null")
    a = t.select("user_id", "i", F.col("value").alias("a"))
    b = t.select(F.col("user_id").alias("next"), "i", F.col("value").alias("b")).join(pairs.hint("merge"), "next").select("user_id", "i", "b")
    return a, b


NEXT_USER = "u AS (SELECT user_id, lead(user_id) OVER (ORDER BY user_id) AS nx FROM (SELECT DISTINCT user_id FROM tl)), a AS (SELECT user_id, i, value FROM tl), b AS (SELECT u.user_id, i, value FROM u JOIN tl ON tl.user_id = u.nx)"


@query("d6_zip_timelines", f"WITH {NEXT_USER} SELECT a.user_id, a.i, a.value AS a, b.value AS b FROM a JOIN b ON a.user_id = b.user_id AND a.i = b.i")
def d6(spark, d) -> DataFrame:
    a, b = _next_user(spark, d)
    return a.join(b.hint("merge"), ["user_id", "i"])


@query("d7_lag_correlation", f"""WITH {NEXT_USER}, s AS (SELECT unnest(range(-10, 11)) AS lag), j AS (SELECT a.user_id, lag, a.value AS x, b.value AS y FROM a, s, b WHERE a.user_id = b.user_id AND b.i = a.i + lag)
SELECT user_id, lag::INT AS lag, count(*) AS n, round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0), 6) AS corr FROM j GROUP BY ALL""")
def d7(spark, d) -> DataFrame:
    a, b = _next_user(spark, d)
    return audio.lag_correlation(a, b, "i", "a", "b", 10, ("user_id",)).withColumn("corr", F.round("corr", 6))


@query("j9_pearson", "SELECT user_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(covar_pop(t / 3600, value) / nullif(stddev_pop(t / 3600) * stddev_pop(value), 0), 0) END, 6) AS corr FROM tl GROUP BY 1")
def j9(spark, d) -> DataFrame:
    t = timeline(spark, d).withColumn("h", F.col("t") / 3600)
    return t.groupBy("user_id").agg(F.round(audio.pearson("h", "value"), 6).alias("corr"))


@query("j22_vote_match", f"""WITH {SEG}, j AS (SELECT t.user_id, t.event_type, s.speaker FROM tl t JOIN sg s ON t.user_id = s.user_id AND t.t >= s.a AND t.t < s.b),
c AS (SELECT user_id, speaker, count(*) FILTER (event_type IN ('view', 'click')) AS a, count(*) FILTER (event_type IN ('purchase', 'click')) AS b, count(*) AS n FROM j GROUP BY ALL),
v AS (SELECT user_id, speaker, CASE WHEN a >= b THEN 'slot_a' ELSE 'slot_b' END AS slot, 2.0::DOUBLE AS w FROM c
UNION ALL SELECT user_id, speaker, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY n DESC, speaker) = 1 THEN 'slot_a' ELSE 'slot_b' END, 1.5 FROM c
UNION ALL SELECT user_id, speaker, CASE WHEN speaker = 'A' THEN 'slot_a' ELSE 'slot_b' END, 1.0 FROM c), s AS (SELECT user_id, speaker, slot, sum(w) AS w FROM v GROUP BY ALL)
SELECT user_id, speaker, slot, w AS votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id, speaker ORDER BY w DESC, slot) AS r FROM s) WHERE r = 1""")
def j22(spark, d) -> DataFrame:
    j = audio.interval_join(timeline(spark, d), "t", _segments(spark, d), "a", "b", KEY, 86400.0)
    c = audio.cooccurrence(j, KEY, "speaker", {"a": F.col("event_type").isin("view", "click"), "b": F.col("event_type").isin("purchase", "click"), "n": F.lit(True)})
    by_n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "speaker"))
    slot = lambda first: F.when(first, "slot_a").otherwise("slot_b").alias("slot")
    temporal = c.select("user_id", "speaker", slot(F.col("a") >= F.col("b")))
    frequency = c.withColumn("r", by_n).select("user_id", "speaker", slot(F.col("r") == 1))
    correlation = c.select("user_id", "speaker", slot(F.col("speaker") == "A"))
    return audio.vote(KEY, "speaker", "slot", [(temporal, 2.0), (frequency, 1.5), (correlation, 1.0)])


@query("j23_active_score", """WITH u AS (SELECT user_id, avg(value) / 500 AS mouth, coalesce(covar_pop(t / 3600, value) / nullif(stddev_pop(t / 3600) * stddev_pop(value), 0), 0) AS c, avg(present::INT) AS face FROM tl GROUP BY 1)
SELECT user_id, round(0.4 * mouth + 0.4 * greatest(0, c) + 0.2 * face, 6) AS score FROM u""")
def j23(spark, d) -> DataFrame:
    t = timeline(spark, d).withColumn("h", F.col("t") / 3600).groupBy("user_id").agg((F.avg("value") / 500).alias("mouth"), audio.pearson("h", "value").alias("c"), F.avg(F.col("present").cast("int")).alias("face"))
    return t.select("user_id", F.round(audio.active_score(F.col("mouth"), F.col("c"), F.col("face")), 6).alias("score"))


@query("e27_entropy", """WITH b AS (SELECT user_id, least(floor(value / 2), 255) AS bin, count(*) AS n FROM tl GROUP BY 1, 2), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS p FROM b)
SELECT user_id, round(-sum(p * log2(p)) / 8, 6) AS entropy FROM p GROUP BY 1""")
def e27(spark, d) -> DataFrame:
    return audio.entropy(timeline(spark, d).withColumn("bin", F.least(F.floor(F.col("value") / 2), F.lit(255))), KEY, "bin", 8).withColumn("entropy", F.round("entropy", 6))


@query("e27_complexity", """WITH p AS (SELECT vec_id, k // 8 AS y, k % 8 AS x, greatest(0, least(255, floor(128 + 400 * v[k + 1])))::INT AS g FROM vec, (SELECT unnest(range(64)) AS k)),
m AS (SELECT a.vec_id, a.y, a.x, sum(b.g * (b.x - a.x) * (2 - abs(b.y - a.y)) * CASE WHEN a.x IN (0, 7) THEN 0 ELSE n END) AS gx, sum(b.g * (b.y - a.y) * (2 - abs(b.x - a.x)) * CASE WHEN a.y IN (0, 7) THEN 0 ELSE n END) AS gy
FROM p a JOIN (SELECT vec_id, y, x, g FROM p) b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1, LATERAL (SELECT CASE WHEN (a.y IN (0, 7) AND b.y <> a.y) OR (a.x IN (0, 7) AND b.x <> a.x) THEN 2 ELSE 1 END AS n) GROUP BY ALL),
e AS (SELECT vec_id, avg(sqrt(gx * gx + gy * gy)) / 255 AS edge_density FROM m GROUP BY 1), u AS (SELECT vec_id, var_pop(g) / 65025 AS variance FROM p GROUP BY 1),
h AS (SELECT vec_id, -sum(n / 64.0 * log2(n / 64.0)) / 8 AS entropy FROM (SELECT vec_id, g, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1)
SELECT vec_id, round(edge_density, 6) AS edge_density, round(variance, 6) AS variance, round(entropy, 6) AS entropy, round(greatest(0, least(1, 0.3 * edge_density + 0.3 * variance + 0.4 * entropy)), 6) AS complexity FROM e JOIN u USING (vec_id) JOIN h USING (vec_id)""")
def e27_complexity(spark, d) -> DataFrame:
    # the 64 components of a vector as a frame of 8 x 8 values
    p = vectors(spark, d).select("vec_id", F.posexplode("v").alias("k", "z"))
    g = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * F.col("z")))).cast("int")
    found = frames.complexity(p.select("vec_id", F.floor(F.col("k") / 8).alias("y"), (F.col("k") % 8).alias("x"), g.alias("g")), ["vec_id"], "y", "x", "g")
    return found.select("vec_id", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query("a4_every_nth", "SELECT user_id, i, event_id FROM tl WHERE i % 5 = 0")
def a4(spark, d) -> DataFrame:
    return timeline(spark, d).where(F.col("i") % 5 == 0).select("user_id", "i", "event_id")


@query("a5_prefix", "SELECT user_id, i, event_id FROM tl t WHERE i < least(12, (SELECT count(*) FROM tl x WHERE x.user_id = t.user_id))")
def a5(spark, d) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("user_id"))
    return timeline(spark, d).withColumn("_n", n).where(F.col("i") < F.least(F.floor(F.lit(0.2) * 60), F.col("_n"))).select("user_id", "i", "event_id")


@query("n24_carried_ema", """WITH RECURSIVE o AS (SELECT user_id, i, CASE WHEN present THEN value END AS v, sum(present::INT) OVER (PARTITION BY user_id ORDER BY i) AS hits FROM tl),
e AS (SELECT user_id, i, v AS s, hits FROM o WHERE i = 0 UNION ALL
SELECT o.user_id, o.i, CASE WHEN o.v IS NULL THEN e.s WHEN e.s IS NULL THEN o.v ELSE 0.2 * o.v + 0.8 * e.s END, o.hits FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1)
SELECT user_id, i, round(s + 1e-9, 4) AS smooth, hits::BIGINT AS hits, (i + 1 - hits)::BIGINT AS misses FROM e""")
def n24(spark, d) -> DataFrame:
    t = timeline(spark, d).select("user_id", "i", F.when(F.col("present"), F.col("value")).alias("value"))
    e = sequence.ema(t, KEY, ["i"], "value", 0.2)
    w = Window.partitionBy("user_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hits = F.sum(F.col("value").isNotNull().cast("int")).over(w)
    return e.select("user_id", "i", F.round(F.col("ema") + 1e-9, 4).alias("smooth"), hits.alias("hits"), (F.col("i") + 1 - hits).alias("misses"))


_DRAW = "(('0x' || md5(user_id || ':' || turn || ':{}')[1:8])::BIGINT % 1000 / 1000.0::DOUBLE)"


@query("a13_mock_segments", f"""WITH t AS (SELECT user_id, duration, unnest(range(0, greatest(ceil(duration / 3.5)::BIGINT, 1))) AS turn FROM (SELECT user_id, count(*) * 2.0::DOUBLE AS duration FROM tl GROUP BY 1)),
w AS (SELECT *, 3 + 5 * {_DRAW.format('length')} AS len, 0.5 + 1.5 * {_DRAW.format('gap')} AS gap, ({_DRAW.format('next')} < 0.7)::INT AS nxt, 0.7 + 0.2 * {_DRAW.format('sure')} AS confidence FROM t),
s AS (SELECT *, coalesce(sum(len + gap) OVER p, 0) AS start_time, coalesce(sum(nxt) OVER p, 0)::BIGINT AS turns FROM w WINDOW p AS (PARTITION BY user_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, least(start_time + len, duration) AS end_time FROM s)
SELECT user_id, turn::INT AS turn, 'SPEAKER_' || lpad((turns % 2)::VARCHAR, 2, '0') AS speaker, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, round(confidence, 6) AS confidence
FROM e WHERE end_time - start_time >= 0.5 - 1e-9""")
def a13(spark, d) -> DataFrame:
    u = timeline(spark, d).groupBy("user_id").agg((F.count("*") * 2.0).alias("duration"))
    s = audio.mock_segments(u, "user_id", "duration")
    return s.select("user_id", "turn", "speaker", *[F.round(c, 6).alias(c) for c in ("start_time", "end_time", "confidence")])
