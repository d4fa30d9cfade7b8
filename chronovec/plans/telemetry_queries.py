"""Telemetry queries: orders are jobs, line items their stages, parts and suppliers pools and resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import identity, telemetry
from .catalog import query, table, timeline

R = lambda c, n=6: F.round(c, n)


@query("e18_stage_shares", """WITH s AS (SELECT l_returnflag AS job, l_linestatus AS stage, sum(l_quantity) AS seconds, sum(l_linenumber)::BIGINT AS frames FROM lineitem GROUP BY 1, 2),
o AS (SELECT * FROM s UNION ALL SELECT job, 'other', 2000000 - sum(seconds), 0 FROM s GROUP BY job HAVING 2000000 - sum(seconds) > 0)
SELECT job, stage, round(seconds, 2) AS seconds, round(seconds / sum(seconds) OVER (PARTITION BY job) * 100, 6) AS percent, round(frames / seconds, 6) AS fps FROM o""")
def e18(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("job"), F.col("l_linestatus").alias("stage"), "l_quantity", F.col("l_linenumber").cast("long").alias("n"), F.lit(2000000.0).alias("total"))
    return telemetry.stage_shares(li, ["job"], "stage", "l_quantity", "n", "total").select("job", "stage", R("seconds", 2).alias("seconds"), R("percent").alias("percent"), R("fps").alias("fps"))


@query("e17_batch_report", """SELECT o_orderpriority AS batch, count(*) AS videos, count(*) FILTER (o_orderstatus <> 'P') AS succeeded, round(count(*) FILTER (o_orderstatus <> 'P') / count(*)::DOUBLE * 100, 6) AS success_rate, round(sum(s), 2) AS seconds,
round(avg(f / s) FILTER (o_orderstatus <> 'P'), 6) AS fps, round(avg(m / s) FILTER (o_orderstatus <> 'P'), 6) AS realtime
FROM (SELECT *, o_totalprice / 1000 AS s, o_orderkey % 1000 AS f, o_orderkey % 60 AS m FROM orders) GROUP BY ROLLUP (o_orderpriority)""")
def e17(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("batch"), "o_orderstatus", (F.col("o_totalprice") / 1000).alias("s"), (F.col("o_orderkey") % 1000).alias("f"), (F.col("o_orderkey") % 60).alias("m"))
    b = telemetry.batch_report(o, "batch", F.col("o_orderstatus") != "P", "s", "f", "m")
    return b.select("batch", "videos", "succeeded", R("success_rate").alias("success_rate"), R("seconds", 2).alias("seconds"), R("fps").alias("fps"), R("realtime").alias("realtime"))


@query("e30_stage_records", """WITH s AS (SELECT user_id, i // 2 AS stage, min(t) FILTER (i % 2 = 0) AS a, max(t) FILTER (i % 2 = 1) AS b, sum(event_id % 100)::BIGINT AS frames FROM tl GROUP BY 1, 2)
SELECT user_id, stage, frames, round(b - a, 4) AS seconds, round(coalesce(frames / nullif(b - a, 0), 0), 6) AS fps FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
def e30(spark, d) -> DataFrame:
    t = timeline(spark, d).select("user_id", F.floor(F.col("i") / 2).alias("stage"), F.when(F.col("i") % 2 == 0, "start").otherwise("end").alias("kind"), "t", (F.col("event_id") % 100).alias("n"))
    s = telemetry.stages_from_events(t, ["user_id", "stage"], "kind", "t", "n")
    return s.select("user_id", "stage", "frames", R("seconds", 4).alias("seconds"), R("fps").alias("fps"))


@query("e20_error_histogram", "SELECT event_type, count(*) AS n, round(count(*) FILTER (value > 50) / count(*)::DOUBLE, 6) AS success_rate, count(*) FILTER (t > (SELECT max(t) FROM tl) - 86400) AS recent FROM tl GROUP BY 1")
def e20(spark, d) -> DataFrame:
    return telemetry.histogram(timeline(spark, d), ["event_type"], "t", F.col("value") > 50, 86400.0).withColumn("success_rate", R("success_rate"))


@query("e21_load_summary", "SELECT user_id, round(avg(value), 6) AS mean, max(value) AS peak, count(*) AS samples, CASE WHEN avg(value) < 50 THEN 'underused' WHEN avg(value) > 110 THEN 'overloaded' ELSE 'good' END AS status FROM tl GROUP BY 1")
def e21(spark, d) -> DataFrame:
    return telemetry.load_summary(timeline(spark, d), ["user_id"], "value", 50, 110).withColumn("mean", R("mean"))


@query("e22_detection_stats", """WITH r AS (SELECT user_id, present, value, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS r FROM tl)
SELECT user_id, count(*) FILTER (present) AS success, count(*) FILTER (NOT present) AS fail, round(avg(present::INT), 6) AS rate, round(avg(value) FILTER (r <= 30), 6) AS last_mean FROM r GROUP BY 1""")
def e22(spark, d) -> DataFrame:
    t = timeline(spark, d)
    last = identity.last_n(t, ["user_id"], [F.desc("i")], 30).groupBy("user_id").agg(R(F.avg("value")).alias("last_mean"))
    s = t.groupBy("user_id").agg(F.count_if("present").alias("success"), F.count_if(~F.col("present")).alias("fail"), R(telemetry.ratio(F.count_if("present"), F.count("*"))).alias("rate"))
    return s.join(last, "user_id")


@query("e23_job_stats", """SELECT o_orderpriority, count(*) AS total, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed, round(avg(o_totalprice) FILTER (s = 'completed'), 2) AS mean_s,
round(count(*) FILTER (s = 'failed') / count(*)::DOUBLE, 6) AS error_rate, round(count(*) FILTER (s <> 'pending') / count(*)::DOUBLE * 100, 6) AS progress
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS s FROM orders) GROUP BY 1""")
def e23(spark, d) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    j = telemetry.job_stats(table(spark, d, "orders").withColumn("s", s), ["o_orderpriority"], "s", "o_totalprice")
    return j.withColumns({"mean_s": R("mean_s", 2), "error_rate": R("error_rate"), "progress": R("progress")})


@query("e24_pool_stats", """SELECT p_brand, count(*) FILTER (st = 'free') AS n_free, count(*) FILTER (st = 'busy') AS n_busy, round(sum(CASE WHEN st = 'busy' THEN p_size ELSE 0 END) / sum(p_size)::DOUBLE, 6) AS utilisation,
round(sum(CASE WHEN st = 'busy' THEN p_size - p_size // 2 ELSE 0 END) / sum(CASE WHEN st = 'busy' THEN p_size ELSE 0 END)::DOUBLE, 6) AS fragmentation FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'free' ELSE 'busy' END AS st FROM part) GROUP BY 1""")
def e24(spark, d) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_size", F.floor(F.col("p_size") / 2).alias("used"), F.when(F.col("p_partkey") % 3 == 0, "free").otherwise("busy").alias("st"))
    return telemetry.pool_stats(p, ["p_brand"], "st", ["free", "busy"], F.col("st") == "busy", "p_size", "used").withColumns({"utilisation": R("utilisation"), "fragmentation": R("fragmentation")})


GPU = "CASE WHEN g BETWEEN 70 AND 90 THEN 100 WHEN g < 70 THEN g / 70 * 100 ELSE greatest(0, 100 - (g - 90) * 2) END"


@query("e25_scenario_scores", f"""SELECT o_orderkey, round(o_orderkey % 101 * 0.4::DOUBLE + (CASE WHEN s > 0 THEN least(100, 6000 / s * 20) ELSE 0 END) * 0.3 + ({GPU}) * 0.2 + greatest(0, 100 - (o_orderkey % 13) * 10) * 0.1, 4) AS score
FROM (SELECT *, o_totalprice / 100 AS s, (o_custkey % 110)::DOUBLE AS g FROM orders)""")
def e25(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    s = scalar.scenario_score(F.col("o_orderkey") % 101, F.lit(6000.0), F.col("o_totalprice") / 100, (F.col("o_custkey") % 110).cast("double"), F.col("o_orderkey") % 13)
    return o.select("o_orderkey", R(s, 4).alias("score"))


@query("e25_scenario_summary", "SELECT count(*) AS scenarios, count(*) FILTER (o_orderstatus <> 'P') AS passed, round(count(*) FILTER (o_orderstatus <> 'P') / count(*)::DOUBLE * 100, 6) AS success_rate, round(avg(o_totalprice), 2) AS mean_score, round(sum(o_totalprice), 0) AS seconds FROM orders")
def e25_summary(spark, d) -> DataFrame:
    s = telemetry.scenario_summary(table(spark, d, "orders"), F.col("o_orderstatus") != "P", "o_totalprice", "o_totalprice")
    return s.withColumns({"success_rate": R("success_rate"), "mean_score": R("mean_score", 2), "seconds": R("seconds", 0)})


@query("e28_activation_stats", """WITH r AS (SELECT *, value > 150 AS act, row_number() OVER (PARTITION BY user_id, value > 150 ORDER BY i DESC) AS r FROM tl)
SELECT user_id, count(*) AS frames, count(*) FILTER (act) AS activations, round(count(*) FILTER (act) / count(*)::DOUBLE, 6) AS rate, round(coalesce(avg(value) FILTER (act), 0), 6) AS mean_ms,
coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (act AND r <= 10), '') AS latest, CASE WHEN count(*) FILTER (act) / count(*)::DOUBLE <= 0.24 THEN 'within target' ELSE 'above target' END AS status FROM r GROUP BY 1""")
def e28(spark, d) -> DataFrame:
    a = telemetry.activation_stats(timeline(spark, d), ["user_id"], "i", F.col("value") > 150, "value", 0.2)
    return a.withColumns({"rate": R("rate"), "mean_ms": R("mean_ms"), "latest": F.array_join(F.col("latest").cast("array<string>"), ",")})


@query("e29_engine_stats", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total_ms, round(avg(value), 6) AS mean_ms, round(1000 / avg(value), 6) AS fps FROM tl GROUP BY 1")
def e29(spark, d) -> DataFrame:
    e = telemetry.engine_stats(timeline(spark, d), ["event_type"], "value")
    return e.select("event_type", "n", R("total_ms", 2).alias("total_ms"), R("mean_ms").alias("mean_ms"), R("fps").alias("fps"))


@query("e31_report_labels", """WITH u AS (SELECT user_id, avg(value) AS fps, avg(present::INT) * 100 AS ok, max(value) / 2 AS gpu FROM tl GROUP BY 1)
SELECT user_id, concat_ws(',', CASE WHEN fps < 30 THEN 'slow' WHEN fps > 100 THEN 'fast' END, CASE WHEN ok < 95 THEN 'failures' END, CASE WHEN gpu < 50 THEN 'gpu underused' WHEN gpu > 95 THEN 'gpu saturated' END) AS labels FROM u""")
def e31(spark, d) -> DataFrame:
    u = timeline(spark, d).groupBy("user_id").agg(scalar.exact_mean(F.col("value")).alias("fps"), (F.avg(F.col("present").cast("int")) * 100).alias("ok"), (F.max("value") / 2).alias("gpu"))
    return u.select("user_id", F.array_join(telemetry.report_labels(F.col("fps"), F.col("ok"), F.col("gpu")), ",").alias("labels"))


@query("e31_first_items", "SELECT o_orderpriority, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (r <= 10) AS items, greatest(count(*) - 10, 0)::BIGINT AS more FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1")
def e31_items(spark, d) -> DataFrame:
    s = telemetry.shown(table(spark, d, "orders"), ["o_orderpriority"], [F.asc("o_orderkey")], "o_orderkey")
    return s.withColumns({"items": F.array_join(F.col("items").cast("array<string>"), ","), "more": F.col("more").cast("long")})


@query("e32_tracker_counters", "SELECT user_id, count(*) FILTER (present) AS updates, count(*) FILTER (NOT present) AS predictions, max_by(value, i) AS last_value FROM tl GROUP BY 1")
def e32(spark, d) -> DataFrame:
    return timeline(spark, d).groupBy("user_id").agg(F.count_if("present").alias("updates"), F.count_if(~F.col("present")).alias("predictions"), F.max_by("value", "i").alias("last_value"))


@query("e19_split_quality", """WITH u AS (SELECT user_id, avg((event_type <> 'view')::INT) * 100 AS a, avg((event_type IN ('purchase', 'signup', 'view'))::INT) * 100 AS b FROM tl GROUP BY 1)
SELECT user_id, round((a + b) / 2, 4) AS rate, round(abs(a - b), 4) AS balance, CASE WHEN (a + b) / 2 >= 80 AND abs(a - b) <= 30 THEN 'excellent' WHEN (a + b) / 2 >= 60 AND abs(a - b) <= 50 THEN 'good' ELSE 'poor' END AS label FROM u""")
def e19(spark, d) -> DataFrame:
    share = lambda c: F.avg(c.cast("int")) * 100
    u = timeline(spark, d).groupBy("user_id").agg(share(F.col("event_type") != "view").alias("a"), share(F.col("event_type").isin("purchase", "signup", "view")).alias("b"))
    rate, balance = (F.col("a") + F.col("b")) / 2, F.abs(F.col("a") - F.col("b"))
    return u.select("user_id", R(rate, 4).alias("rate"), R(balance, 4).alias("balance"), scalar.split_label(rate, balance).alias("label"))


@query("j12_performance_score", f"""SELECT event_id, round(least(100, value / 30 * 100) * 0.3 + ({GPU}) * 0.25 + (CASE WHEN m <= 80 THEN 100 ELSE greatest(0, 100 - (m - 80) * 5) END) * 0.2
+ (CASE WHEN value <= 50 THEN 100 ELSE greatest(0, 100 - (value - 50)) END) * 0.15 + greatest(0, 100 - (event_id % 100) / 100.0::DOUBLE * 100) * 0.1, 4) AS score
FROM (SELECT *, (event_id % 101)::DOUBLE AS g, (event_id % 32000) / 32000.0::DOUBLE * 100 AS m FROM events)""")
def j12(spark, d) -> DataFrame:
    e = F.col("event_id")
    s = scalar.performance_score(F.col("value"), (e % 101).cast("double"), (e % 32000).cast("double"), F.col("value"), (e % 100) / 100.0)
    return table(spark, d, "events").select("event_id", R(s, 4).alias("score"))


@query("j13_tuning_actions", """WITH u AS (SELECT user_id, avg(value) / 3 AS fps, avg(value) AS gpu, max(value) * 70 AS mem, max(value) AS lat FROM tl GROUP BY 1),
a AS (SELECT user_id, unnest([CASE WHEN fps < 20 AND gpu < 70 THEN 'batch_size:increase' END, CASE WHEN fps < 20 AND gpu < 70 THEN 'cuda_streams:increase' END, CASE WHEN fps < 20 AND gpu >= 70 THEN 'encoding_crf:increase' END, CASE WHEN fps < 20 AND gpu >= 70 THEN 'frame_skip_ratio:increase' END,
CASE WHEN mem / 32000 * 100 > 85 THEN 'batch_size:decrease' END, CASE WHEN mem / 32000 * 100 > 85 THEN 'memory_pool_mb:decrease' END, CASE WHEN lat > 100 THEN 'batch_size:decrease' END, CASE WHEN lat > 100 THEN 'frame_skip_ratio:increase' END, CASE WHEN gpu < 50 THEN 'batch_size:increase' END, CASE WHEN gpu < 50 THEN 'cuda_streams:increase' END,
CASE WHEN fps > 40 THEN 'encoding_crf:decrease' END]) AS x FROM u) SELECT user_id, x AS action FROM a WHERE x IS NOT NULL""")
def j13(spark, d) -> DataFrame:
    mean = scalar.exact_mean(F.col("value"))
    u = timeline(spark, d).groupBy("user_id").agg((mean / 3).alias("fps"), mean.alias("gpu"), (F.max("value") * 70).alias("mem"), F.max("value").alias("lat"))
    a = u.select("user_id", F.explode(scalar.tuning_actions(F.col("fps"), F.col("gpu"), F.col("mem"), F.col("lat"), "aggressive")).alias("a"))
    return a.select("user_id", F.concat_ws(":", "a.parameter", "a.action").alias("action"))


@query("j14_batch_policies", """SELECT event_id, (CASE WHEN event_id % 700 > 512 THEN 256 WHEN event_id % 700 > 256 THEN 128 WHEN event_id % 700 > 128 THEN 64 ELSE 32 END)::INT AS by_queue,
(CASE WHEN value / 100 > 0.8 THEN greatest(1, event_id % 130 - 1) WHEN value / 100 < 0.4 THEN least(128, event_id % 130 + 1) ELSE event_id % 130 END)::BIGINT AS by_memory,
greatest(1, least(8, floor(value * 0.8 / 7.5)))::BIGINT AS by_free, greatest(1, floor((event_id % 130) / pow(2, event_id % 5)))::BIGINT AS halved FROM events""")
def j14(spark, d) -> DataFrame:
    e, b = F.col("event_id"), F.col("event_id") % 130
    return table(spark, d, "events").select(
        "event_id", scalar.batch_for_queue(e % 700).alias("by_queue"), scalar.batch_for_memory(b, F.col("value") / 100).cast("long").alias("by_memory"), scalar.batch_for_free(F.col("value"), 7.5, most=8).alias("by_free"), scalar.halved(b, e % 5).alias("halved")
    )


@query("j15_duration_text", """SELECT user_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%dm %.1fs', floor(s / 60)::BIGINT, s - floor(s / 60) * 60) ELSE printf('%dh %dm %.1fs', floor(s / 3600)::BIGINT, floor((s - floor(s / 3600) * 3600) / 60)::BIGINT, s - floor(s / 60) * 60) END AS took
FROM (SELECT user_id, min(i) + user_id * 37 + 0.3::DOUBLE AS s FROM tl GROUP BY 1, user_id)""")
def j15(spark, d) -> DataFrame:
    s = timeline(spark, d).groupBy("user_id").agg(F.min("i").alias("m")).select("user_id", (F.col("m") + F.col("user_id") * 37 + F.lit(0.3)).alias("s"))
    return s.select("user_id", scalar.duration_text(F.col("s")).alias("took"))


@query("g5_least_loaded", "SELECT s_nationkey, min_by(s_suppkey, n * 1000000 + s_suppkey) AS s_suppkey FROM (SELECT s_nationkey, s_suppkey, count(*) AS n FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2) GROUP BY 1")
def g5(spark, d) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    j = table(spark, d, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"))
    return telemetry.least_loaded(j, ["s_nationkey"], "s_suppkey", "n")


@query("g6_best_fit_block", """WITH b AS (SELECT p_brand, p_partkey AS id, p_retailprice AS s FROM part WHERE p_partkey % 3 = 0), r AS (SELECT p_brand, p_partkey AS id, p_size * 30.0::DOUBLE AS need FROM part WHERE p_partkey % 3 <> 0),
c AS (SELECT r.p_brand, r.id, r.need, (SELECT min(s) FROM b WHERE b.p_brand = r.p_brand AND b.s >= r.need) AS s FROM r)
SELECT p_brand, c.id AS request_id, CASE WHEN s <= 4 * need THEN (SELECT min(id) FROM b WHERE b.p_brand = c.p_brand AND b.s = c.s) END AS block_id FROM c""")
def g6(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    blocks = p.where("p_partkey % 3 = 0").select("p_brand", F.col("p_partkey").alias("block_id"), "p_retailprice")
    need = p.where("p_partkey % 3 <> 0").select("p_brand", F.col("p_partkey").alias("request_id"), (F.col("p_size") * 30.0).alias("need"))
    return telemetry.best_fit_block(need, blocks, ["p_brand"], "p_retailprice", "need")


@query("g10_idle_blocks", "SELECT user_id, event_id FROM tl WHERE NOT present AND (SELECT max(t) FROM tl) - t > 1000000")
def g10(spark, d) -> DataFrame:
    t = timeline(spark, d)
    j = t.join(F.broadcast(t.agg(F.max("t").alias("now"))))
    return telemetry.idle_blocks(j, F.col("present"), "t", F.col("now"), 1000000.0).select("user_id", "event_id")


@query("m3_session_overlap", """WITH s AS (SELECT user_id % 10 AS pool, t AS a, t + value * 100 AS b FROM tl), m AS (SELECT pool, a AS t, 1 AS d FROM s UNION ALL SELECT pool, b, -1 FROM s)
SELECT pool, max(o)::BIGINT AS most_open FROM (SELECT pool, sum(d) OVER (PARTITION BY pool ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o FROM m) GROUP BY 1""")
def m3(spark, d) -> DataFrame:
    s = timeline(spark, d).select((F.col("user_id") % 10).alias("pool"), F.col("t").alias("a"), (F.col("t") + F.col("value") * 100).alias("b"))
    return telemetry.overlap(s, ["pool"], "a", "b")


@query("m1_batches", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders")
def m1(spark, d) -> DataFrame:
    return telemetry.in_batches(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 64)


@query("m2_parallel_slices", "SELECT o_custkey % 8 AS slice, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM orders GROUP BY 1")
def m2(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy((F.col("o_custkey") % 8).alias("slice")).agg(F.count("*").alias("n"), R(F.sum("o_totalprice"), 0).alias("total"))


@query("b5_segment_names", "SELECT user_id, 'segment_' || s || '_' || (s + 10) || '.mp4' AS name FROM (SELECT user_id, unnest(range(0, 30, 10)) AS s FROM (SELECT DISTINCT user_id FROM tl))")
def b5(spark, d) -> DataFrame:
    from ..sources.reports import segment_name

    s = timeline(spark, d).select("user_id").distinct().withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(29), F.lit(10))))
    return s.select("user_id", segment_name(F.col("s"), F.col("s") + 10).alias("name"))


@query("b7_filter_graph", """WITH s AS (SELECT user_id, i, t / 3600 AS a, t / 3600 + 1 AS b, count(*) OVER (PARTITION BY user_id) AS n FROM tl)
SELECT user_id, CASE WHEN max(n) = 1 THEN max(printf('[0:v]trim=start=%.3f:end=%.3f,setpts=PTS-STARTPTS[v]', a, b)) ELSE string_agg(printf('[0:v]trim=start=%.3f:end=%.3f,setpts=PTS-STARTPTS[v%d]', a, b, i), ';' ORDER BY i)
 || ';' || string_agg('[v' || i || ']', '' ORDER BY i) || 'concat=n=' || max(n) || ':v=1[v]' END AS graph FROM s GROUP BY 1""")
def b7(spark, d) -> DataFrame:
    from ..sources.reports import filter_graph

    s = timeline(spark, d).select("user_id", "i", (F.col("t") / 3600).alias("a"), (F.col("t") / 3600 + 1).alias("b"))
    return filter_graph(s, ["user_id"], "i", "a", "b")


@query("b4_json_report", "SELECT user_id, '{\"user_id\":' || user_id || ',\"n\":' || count(*) || '}' AS report FROM tl GROUP BY user_id")
def b4(spark, d) -> DataFrame:
    from ..sources.reports import json_report

    return json_report(timeline(spark, d).groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"])
