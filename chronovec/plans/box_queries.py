"""Box queries: filters, geometry, costs, slot assignment, swap risk. A frame holds four boxes; a box's place in it is its track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import vectors as V
from ..operators import identity, tracking
from .catalog import boxes, query, vectors

R = lambda c, n=4: F.round(c, n)
IOU = """(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"""
UNION = f"(a.w * a.h + b.w * b.h - {IOU})"
PAIRS = "FROM bx a JOIN bx b ON a.frame = b.frame AND a.det < b.det"
DIST = "sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2)**2 + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2)**2)"
SIZE = "(least(a.w * a.h, b.w * b.h) / greatest(a.w * a.h, b.w * b.h))"


@query("c5_top_faces", "SELECT frame, det FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, vec_id) AS r FROM bx WHERE w >= 95 AND h >= 95) WHERE r <= 2")
def c5(spark, d) -> DataFrame:
    return tracking.top_faces(boxes(spark, d), ["frame"], "vec_id", 95).select("frame", "det")


@query("c6_confidence_band", "SELECT vec_id, CASE WHEN conf >= 0.6 THEN 'high' ELSE 'low' END AS band FROM bx WHERE conf >= 0.5")
def c6(spark, d) -> DataFrame:
    return boxes(spark, d).where("conf >= 0.5D").select("vec_id", tracking.band(F.col("conf")).alias("band"))


@query("c7_box_quality", "SELECT vec_id, w >= 30 AND h >= 30 AND x1 >= 0 AND y1 >= 0 AND x2 <= 700 AND y2 <= 500 AND w / h BETWEEN 0.8 AND 1.25 AS good FROM bx")
def c7(spark, d) -> DataFrame:
    return boxes(spark, d).select("vec_id", B.good_quality(tracking.box_of(), 700, 500, 30, 0.8, 1.25).alias("good"))


@query("c8_left_right", "SELECT vec_id, CASE WHEN (x1 + x2) / 2 < 550 THEN 'L' ELSE 'R' END AS side FROM bx")
def c8(spark, d) -> DataFrame:
    return boxes(spark, d).select("vec_id", F.when((F.col("x1") + F.col("x2")) / 2 < 550, "L").otherwise("R").alias("side"))


@query("c9_detector_rows", """WITH s AS (SELECT vec_id, list_transform(range(6, 11), lambda k: abs(v[k])) AS s, 320 + 500 * v[11] AS cx, 320 + 500 * v[12] AS cy, 60 + 100 * abs(v[13]) AS w, 60 + 100 * abs(v[14]) AS h FROM vec),
c AS (SELECT *, list_max(s) AS m, list_position(s, list_max(s)) - 1 AS c FROM s)
SELECT vec_id, round(m, 6) AS confidence, c::INT AS class_id, round(greatest(0, least((cx - w / 2 - 10) / 0.5, 1200)), 4) AS x1, round(greatest(0, least((cy - h / 2 - 20) / 0.5, 1080)), 4) AS y1,
round(greatest(0, least((cx + w / 2 - 10) / 0.5, 1200)), 4) AS x2, round(greatest(0, least((cy + h / 2 - 20) / 0.5, 1080)), 4) AS y2 FROM c WHERE m >= 0.15 AND c IN (0, 2, 4)""")
def c9(spark, d) -> DataFrame:
    v = F.col("v")
    raw = vectors(spark, d).select("vec_id", F.transform(F.slice(v, 6, 5), lambda x: F.abs(x)).alias("s"), (320 + 500 * v[10]).alias("cx"), (320 + 500 * v[11]).alias("cy"), (60 + 100 * F.abs(v[12])).alias("w"), (60 + 100 * F.abs(v[13])).alias("h"))
    out = raw.select("vec_id", *[c.alias(n) for n, c in B.detection(F.col("s"), F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), 0.5, 10.0, 20.0, 1200, 1080).items()])
    return out.where((F.col("confidence") >= 0.15) & F.col("class_id").isin(0, 2, 4)).select("vec_id", R("confidence", 6).alias("confidence"), "class_id", *[R(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("c10_box_columns", "SELECT vec_id, round(w, 4) AS width, round(h, 4) AS height, round(w * h, 2) AS area, round((x1 + x2) / 2, 4) AS center_x, round((y1 + y2) / 2, 4) AS center_y, round(w / h, 6) AS aspect FROM bx")
def c10(spark, d) -> DataFrame:
    digits = {"area": 2, "aspect": 6}
    return boxes(spark, d).select("vec_id", *[R(c, digits.get(n, 4)).alias(n) for n, c in B.derived(tracking.box_of()).items()])


@query("c11_crop_window", """WITH s AS (SELECT vec_id, floor((x1 + x2) / 2) AS cx, floor((y1 + y2) / 2) AS cy, floor(greatest(w, h) * 2) AS z FROM bx), c AS (SELECT *, greatest(0, least(cx - floor(z / 2), 900 - z)) AS a, greatest(0, least(cy - floor(z / 2), 600 - z)) AS b FROM s)
SELECT vec_id, a::BIGINT AS crop_x1, b::BIGINT AS crop_y1, least(a + z, 900)::BIGINT AS crop_x2, least(b + z, 600)::BIGINT AS crop_y2 FROM c""")
def c11(spark, d) -> DataFrame:
    s = F.floor(F.greatest("w", "h") * 2)
    return boxes(spark, d).select("vec_id", *[c.cast("long").alias(n) for n, c in B.crop_window((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, s, 900, 600).items()])


@query("c11_clamped_crop", """SELECT vec_id, greatest(0, floor((x1 + x2) / 2 - 125))::BIGINT AS crop_x1, greatest(0, floor((y1 + y2) / 2 - 125))::BIGINT AS crop_y1,
least(640, floor((x1 + x2) / 2 + 125))::BIGINT AS crop_x2, least(480, floor((y1 + y2) / 2 + 125))::BIGINT AS crop_y2 FROM bx""")
def c11_clamped(spark, d) -> DataFrame:
    return boxes(spark, d).select("vec_id", *[c.cast("long").alias(n) for n, c in B.clamped_crop((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, 250, 250, 640, 480).items()])


@query("c12_fit", """WITH s AS (SELECT vec_id, w, h, least(320 / w, 240 / h) AS a, greatest(320 / w, 240 / h) AS b FROM bx)
SELECT vec_id, round(a, 6) AS scale, floor(w * a)::BIGINT AS new_w, floor(h * a)::BIGINT AS new_h, floor((320 - floor(w * a)) / 2)::BIGINT AS off_x, floor((240 - floor(h * a)) / 2)::BIGINT AS off_y,
round(b, 6) AS cover, floor((320 - floor(w * b)) / 2)::BIGINT AS cover_x FROM s""")
def c12(spark, d) -> DataFrame:
    a, b = B.fit(F.col("w"), F.col("h"), 320, 240), B.fit(F.col("w"), F.col("h"), 320, 240, True)
    return boxes(spark, d).select("vec_id", R(a["scale"], 6).alias("scale"), *[a[n].cast("long").alias(n) for n in ("new_w", "new_h", "off_x", "off_y")], R(b["scale"], 6).alias("cover"), b["off_x"].cast("long").alias("cover_x"))


@query("c15_adaptive_crop", "SELECT vec_id, greatest(100, least(floor(greatest(w, h) * CASE WHEN w * h < 5000 THEN 3.5 WHEN w * h < 15000 THEN 2.5 ELSE 2.0 END), 480))::BIGINT AS size FROM bx")
def c15(spark, d) -> DataFrame:
    return boxes(spark, d).select("vec_id", B.adaptive_crop_size(F.col("w") * F.col("h"), F.col("w"), F.col("h"), 640, 480).cast("long").alias("size"))


@query("c16_split_widths", "SELECT vec_id, round(r, 6) AS ratio, floor(1920 * r)::BIGINT AS left_width, 1920 - floor(1920 * r)::BIGINT AS right_width FROM (SELECT vec_id, coalesce(least(greatest(w / (w + h * 2), 0.3), 0.7), 0.5) AS r FROM bx)")
def c16(spark, d) -> DataFrame:
    s = B.split_widths(F.col("w"), F.col("h") * 2)
    return boxes(spark, d).select("vec_id", R(s["ratio"], 6).alias("ratio"), s["left_width"].cast("long").alias("left_width"), s["right_width"].cast("long").alias("right_width"))


@query("c17_background_tracks", "SELECT frame, det FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY det) AS r FROM bx WHERE conf > 0.5 AND vec_id % 12 > 5) WHERE r <= 2")
def c17(spark, d) -> DataFrame:
    return identity.last_n(boxes(spark, d).where("conf > 0.5D AND vec_id % 12 > 5"), ["frame"], [F.asc("det")], 2).select("frame", "det")


def _pairs(spark, d) -> tuple[DataFrame, B.Box, B.Box]:
    p = identity.pairs(boxes(spark, d), ["frame"], "det", ["x1", "y1", "x2", "y2", "w", "h", "conf"])
    side = lambda s: tuple(F.col(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2"))
    return p, side("a"), side("b")


@query("j5_iou", f"SELECT a.frame, a.det AS det_a, b.det AS det_b, round(CASE WHEN {UNION} > 0 THEN {IOU} / {UNION} ELSE 0 END, 6) AS iou {PAIRS}")
def j5(spark, d) -> DataFrame:
    p, a, b = _pairs(spark, d)
    return p.select("frame", "det_a", "det_b", R(B.iou(a, b), 6).alias("iou"))


@query("j6_distances", f"SELECT a.frame, a.det AS det_a, b.det AS det_b, round({DIST}, 4) AS distance, round({SIZE}, 6) AS size_similarity {PAIRS}")
def j6(spark, d) -> DataFrame:
    p, a, b = _pairs(spark, d)
    return p.select("frame", "det_a", "det_b", R(B.center_distance(a, b)).alias("distance"), R(B.size_similarity(a, b), 6).alias("size_similarity"))


@query("j7_combined_cost", f"SELECT a.frame, a.det AS det_a, b.det AS det_b, round(0.7 * (1 - CASE WHEN {UNION} > 0 THEN {IOU} / {UNION} ELSE 0 END) + 0.2 * least({DIST} / 1000, 1) + 0.1 * (1 - {SIZE}), 6) AS cost {PAIRS}")
def j7(spark, d) -> DataFrame:
    p, a, b = _pairs(spark, d)
    return p.select("frame", "det_a", "det_b", R(B.combined_cost(a, b), 6).alias("cost"))


@query("d4_detections_by_tracks", f"SELECT b.frame, a.det AS track, b.det AS det, round(CASE WHEN {UNION} > 0 THEN {IOU} / {UNION} ELSE 0 END, 6) AS iou FROM bx a JOIN bx b ON a.frame + 1 = b.frame")
def d4(spark, d) -> DataFrame:
    b = boxes(spark, d)
    t = b.select((F.col("frame") + 1).alias("frame"), F.col("det").alias("track"), *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    return t.join(b, "frame").select("frame", "track", "det", R(B.iou(tracking.box_of("t_"), tracking.box_of()), 6).alias("iou"))


@query("j8_hybrid_scores", f"SELECT a.frame, a.det AS det_a, b.det AS det_b, round(0.7 * a.conf + 0.3 * (1 / (1 + {DIST} / 100)), 6) AS inverse, round(0.9 * a.conf + 0.1 * greatest(0, 1 - {DIST} / 200), 6) AS linear, round((0.6 * a.conf + 0.2 * {SIZE}) / 0.8, 6) AS profile {PAIRS}")
def j8(spark, d) -> DataFrame:
    p, a, b = _pairs(spark, d)
    s, dist = F.col("conf_a"), B.center_distance(a, b)
    return p.select("frame", "det_a", "det_b", R(B.hybrid_inverse(s, dist), 6).alias("inverse"), R(B.hybrid_linear(s, dist), 6).alias("linear"), R(B.hybrid_profile(s, F.lit(None).cast("double"), B.size_similarity(a, b)), 6).alias("profile"))


@query("j10_mouth_aspect", """WITH p AS (SELECT vec_id, list_transform(range(0, 8), lambda k: [v[2 * k + 1], v[2 * k + 2]]) AS p FROM vec)
SELECT vec_id, round(coalesce((list_distance(p[2], p[8]) + list_distance(p[3], p[7]) + list_distance(p[4], p[6])) / 3 / nullif(list_distance(p[1], p[5]), 0), 0), 6) AS mar FROM p""")
def j10(spark, d) -> DataFrame:
    p = F.array(*[F.struct(F.col("v")[2 * k].alias("x"), F.col("v")[2 * k + 1].alias("y")) for k in range(8)])
    return vectors(spark, d).withColumn("p", p).select("vec_id", R(B.mouth_aspect(F.col("p"), [1, 2, 3], [7, 6, 5], 0, 4), 6).alias("mar"))


@query("g7_two_largest", "SELECT frame, max(det) FILTER (r = 1) AS first, max(det) FILTER (r = 2) AS second FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY w * h DESC, det) AS r FROM bx) GROUP BY 1")
def g7(spark, d) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc(F.col("w") * F.col("h")), "det"))
    pick = lambda n: F.max(F.when(F.col("r") == n, F.col("det")))
    return boxes(spark, d).withColumn("r", r).where("r <= 2").groupBy("frame").agg(pick(1).alias("first"), pick(2).alias("second"))


@query("g9_importance_rank", """WITH s AS (SELECT frame, det, 0.5 * greatest(0, 1 - sqrt(((x1 + x2) / 2 - 550)**2 + ((y1 + y2) / 2 - 350)**2) / 500) + 0.3 * least(w * h / 20000, 1) + 0.2 * conf AS s FROM bx)
SELECT frame, det, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY s DESC, det) AS r FROM s) WHERE r <= 2""")
def g9(spark, d) -> DataFrame:
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    mid = F.greatest(F.lit(0.0), 1 - F.sqrt((cx - 550) * (cx - 550) + (cy - 350) * (cy - 350)) / 500)
    s = boxes(spark, d).withColumn("score", 0.5 * mid + 0.3 * F.least(F.col("w") * F.col("h") / 20000, F.lit(1.0)) + 0.2 * F.col("conf"))
    return identity.last_n(s, ["frame"], [F.desc("score"), F.asc("det")], 2).select("frame", "det", R("score", 6).alias("score"))


TRACKS = """tr AS (SELECT frame, det, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, w * h AS area, conf AS score, frame % 16 AS age FROM bx),
pv AS (SELECT a.*, b.cx AS px, b.cy AS py, b.area AS pa, sqrt((a.cx - b.cx)**2 + (a.cy - b.cy)**2) AS dist, abs(a.area - b.area) / greatest(a.area, b.area) AS ratio FROM tr a JOIN tr b ON a.det = b.det AND a.frame = b.frame + 1)"""
JUMPS = "ju AS (SELECT frame, 'position' AS type, least(dist / 200, 1) AS risk, least(age / 10, 1) * 0.3 + score * 0.4 + least(dist / 300, 1) * 0.3 AS confidence, det FROM pv WHERE dist > 100)"
SIZES = "si AS (SELECT frame, 'size' AS type, least(ratio / (0.3 * 1.5), 1) AS risk, least(age / 10, 1) * 0.3 + score * 0.3 + least(ratio / 0.6, 1) * 0.4 AS confidence, det FROM pv WHERE ratio > 0.3)"
CROSS = """xp AS (SELECT a.frame, a.det AS da, b.det AS db, a.score AS sa, b.score AS sb, (a.age + b.age) / 2 AS age, sqrt((a.cx - b.cx)**2 + (a.cy - b.cy)**2) AS now, sqrt((a.px - b.px)**2 + (a.py - b.py)**2) AS was,
 (((b.cy - a.py) * (b.px - a.px) > (b.py - a.py) * (b.cx - a.px)) <> ((b.cy - a.cy) * (b.px - a.cx) > (b.py - a.cy) * (b.cx - a.cx)))
 AND (((b.py - a.py) * (a.cx - a.px) > (a.cy - a.py) * (b.px - a.px)) <> ((b.cy - a.py) * (a.cx - a.px) > (a.cy - a.py) * (b.cx - a.px))) AS x FROM pv a JOIN pv b ON a.frame = b.frame AND a.det < b.det),
cr AS (SELECT frame, 'crossing' AS type, risk, least(age / 10, 1) * 0.5 + (sa + sb) / 2 * 0.5 AS confidence, da, db FROM (SELECT *, CASE WHEN now > 300 OR abs(now - was) < 5 THEN 0 WHEN x THEN 0.8 + 0.2 * greatest(0, 1 - now / 200) WHEN now < 100 AND now < was THEN 0.3 + 0.3 * (1 - now / 100) ELSE 0 END AS risk FROM xp) WHERE risk > 0.5)"""


def _tracks(spark, d) -> DataFrame:
    cols = [((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), (F.col("w") * F.col("h")).alias("area"), F.col("conf").alias("score"), (F.col("frame") % 16).alias("age")]
    return tracking.with_previous(boxes(spark, d).select("frame", "det", *cols), [], "frame", "det", ["cx", "cy", "area"])


@query("d9_previous_frame", f"WITH {TRACKS} SELECT frame, det, round(dist, 4) AS moved FROM pv")
def d9(spark, d) -> DataFrame:
    dx, dy = F.col("cx") - F.col("prev_cx"), F.col("cy") - F.col("prev_cy")
    return _tracks(spark, d).select("frame", "det", R(F.sqrt(dx * dx + dy * dy)).alias("moved"))


@query("f5_position_jumps", f"WITH {TRACKS}, {JUMPS} SELECT frame, det, round(risk, 6) AS risk, round(confidence, 6) AS confidence FROM ju")
def f5(spark, d) -> DataFrame:
    return tracking.position_jumps(_tracks(spark, d)).select("frame", "det", R("risk", 6).alias("risk"), R("confidence", 6).alias("confidence"))


@query("f6_size_changes", f"WITH {TRACKS}, {SIZES} SELECT frame, det, round(risk, 6) AS risk, round(confidence, 6) AS confidence FROM si")
def f6(spark, d) -> DataFrame:
    return tracking.size_changes(_tracks(spark, d), 0.3).select("frame", "det", R("risk", 6).alias("risk"), R("confidence", 6).alias("confidence"))


@query("f7_crossings", f"WITH {TRACKS}, {CROSS} SELECT frame, da AS det_a, db AS det_b, round(risk, 6) AS risk, round(confidence, 6) AS confidence FROM cr")
def f7(spark, d) -> DataFrame:
    return tracking.crossings(_tracks(spark, d), ["frame"], "det", 100.0).select("frame", "det_a", "det_b", R("risk", 6).alias("risk"), R("confidence", 6).alias("confidence"))


RISK = f"""{TRACKS}, {JUMPS}, {SIZES}, {CROSS}, al AS (SELECT frame, type, risk, confidence FROM ju UNION ALL SELECT frame, type, risk, confidence FROM si UNION ALL SELECT frame, type, risk, confidence FROM cr),
g AS (SELECT frame, sum(risk * confidence * w) / sum(w) AS risk, avg(confidence) AS confidence FROM (SELECT *, CASE type WHEN 'position' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS w FROM al) GROUP BY 1),
o AS (SELECT f.frame, coalesce(risk, 0.0) AS risk, coalesce(confidence, 1.0) AS confidence FROM (SELECT DISTINCT frame FROM bx) f LEFT JOIN g USING (frame))"""


@query("f8_swap_risk", f"WITH {RISK} SELECT frame, round(risk, 6) AS risk, round(confidence, 6) AS confidence, CASE WHEN risk < 0.3 THEN 'continue' WHEN risk < 0.6 THEN 'monitor' WHEN risk < 0.8 THEN 're-identify' ELSE 're-identify at once' END AS label, risk > 0.6 AS swap FROM o")
def f8(spark, d) -> DataFrame:
    return swap_risk(spark, d).withColumns({"risk": R("risk", 6), "confidence": R("confidence", 6)})


def swap_risk(spark, d) -> DataFrame:
    t = _tracks(spark, d)
    return tracking.overall_risk(boxes(spark, d).select("frame").distinct(), ["frame"], [tracking.position_jumps(t), tracking.size_changes(t, 0.3), tracking.crossings(t, ["frame"], "det", 100.0)])


COSTS = f"""c AS (SELECT a.frame, a.vec_id, 0.45 * (1 - list_cosine_similarity(v.v, p.v)) + 0.45 * (1 - CASE WHEN {UNION} > 0 THEN {IOU} / {UNION} ELSE 0 END) + CASE WHEN 1 - list_cosine_similarity(v.v, p.v) > 0.95 THEN 10 ELSE 0 END AS cost, b.det AS slot
 FROM bx a JOIN bx b ON b.frame = a.frame - 1 AND b.det < 2 JOIN vec v ON v.vec_id = a.vec_id JOIN vec p ON p.vec_id = b.vec_id),
k AS (SELECT frame, vec_id, max(cost) FILTER (slot = 0) AS ca, max(cost) FILTER (slot = 1) AS cb FROM c GROUP BY 1, 2)"""


@query("n6_two_slot_assign", f"""WITH {COSTS}, p AS (SELECT x.frame, x.vec_id AS id_a, y.vec_id AS id_b, x.ca + y.cb AS cost FROM k x JOIN k y ON x.frame = y.frame AND x.vec_id <> y.vec_id)
SELECT frame, id_a, id_b, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY cost, id_a, id_b) AS r FROM p) WHERE r = 1""")
def n6(spark, d) -> DataFrame:
    b = boxes(spark, d).join(vectors(spark, d).select("vec_id", "v"), "vec_id")
    slots = b.where("det < 2").select((F.col("frame") + 1).alias("frame"), F.col("det").alias("slot"), *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2", "v")])
    cost = tracking.slot_cost(V.cosine(F.col("v"), F.col("p_v")), B.iou(tracking.box_of(), tracking.box_of("p_")), 0.95)
    c = b.join(slots, "frame").withColumn("cost", cost).groupBy("frame", "vec_id").agg(F.max(F.when(F.col("slot") == 0, F.col("cost"))).alias("ca"), F.max(F.when(F.col("slot") == 1, F.col("cost"))).alias("cb"))
    return tracking.best_pairs(c, ["frame"], "vec_id", "ca", "cb").withColumn("cost", R("cost", 6))


@query("d8_unmatched", "SELECT vec_id FROM bx WHERE vec_id NOT IN (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, vec_id) AS r FROM bx) WHERE r <= 2)")
def d8(spark, d) -> DataFrame:
    b = boxes(spark, d)
    return tracking.unmatched(b, tracking.top_faces(b, ["frame"], "vec_id", 0).select("vec_id"), ["vec_id"]).select("vec_id")


@query("d10_nearest_face", """WITH f AS (SELECT frame, det, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, conf FROM bx), j AS (SELECT f.frame, p.det AS track, f.det, sqrt((f.cx - p.cx)**2 + (f.cy - p.cy)**2) AS d FROM f JOIN f p ON f.frame = p.frame + 1 WHERE f.conf >= 0.5)
SELECT frame, track, det, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY frame, track ORDER BY d, det) AS r FROM j WHERE d <= 200) WHERE r = 1""")
def d10(spark, d) -> DataFrame:
    f = boxes(spark, d).select("frame", "det", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), "conf")
    p = f.select((F.col("frame") + 1).alias("frame"), F.col("det").alias("track"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    near = tracking.nearest(p.drop("track"), f, ["frame"], 200.0, 0.5)
    return near.join(p, ["frame", "px", "py"]).select("frame", "track", "det", R("distance").alias("distance"))


CL = "cl AS (SELECT label, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, w * h AS area, vec_id / 30.0::DOUBLE AS ts, conf, w, h, vec_id FROM bx)"


def _clusters(spark, d) -> DataFrame:
    # detections of a cluster in the order of their ids
    return boxes(spark, d).select("label", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), (F.col("w") * F.col("h")).alias("area"), (F.col("vec_id") / 30.0).alias("ts"), "conf", "w", "h", "vec_id")


@query("e11_cluster_stats", f"WITH {CL} SELECT label, count(*) AS n, round(avg(cx), 4) AS cx, round(avg(cy), 4) AS cy, round(avg(area), 2) AS area, round(max(ts) - min(ts), 6) AS span FROM cl GROUP BY 1")
def e11(spark, d) -> DataFrame:
    return _clusters(spark, d).groupBy("label").agg(F.count("*").alias("n"), R(F.avg("cx")).alias("cx"), R(F.avg("cy")).alias("cy"), R(F.avg("area"), 2).alias("area"), R(F.max("ts") - F.min("ts"), 6).alias("span"))


@query("e12_side_profile", f"""WITH {CL} SELECT CASE WHEN cx < 550 THEN 'L' ELSE 'R' END AS side, count(*) AS n, round(avg(cx), 4) AS cx, round(avg(area), 2) AS area, round(min(area), 2) AS min_area, round(max(area), 2) AS max_area,
round(max(cx) - min(cx), 4) AS x_range, round(max(cy) - min(cy), 4) AS y_range FROM cl GROUP BY 1""")
def e12(spark, d) -> DataFrame:
    c = _clusters(spark, d).withColumn("side", F.when(F.col("cx") < 550, "L").otherwise("R"))
    return c.groupBy("side").agg(F.count("*").alias("n"), R(F.avg("cx")).alias("cx"), R(F.avg("area"), 2).alias("area"), R(F.min("area"), 2).alias("min_area"), R(F.max("area"), 2).alias("max_area"), R(F.max("cx") - F.min("cx")).alias("x_range"), R(F.max("cy") - F.min("cy")).alias("y_range"))


@query("e16_importance", f"""WITH {CL}, m AS (SELECT *, sqrt((cx - lag(cx) OVER w)**2 + (cy - lag(cy) OVER w)**2) AS mv, greatest(0, 1 - sqrt((cx - 960)**2 + (cy - 540)**2) / 800) AS mid FROM cl WINDOW w AS (PARTITION BY label ORDER BY ts))
SELECT label, count(*) AS n, round(0.2 * least(count(*) / 100, 1) + 0.2 * least(sum(area) / 1000000, 1) + 0.15 * avg(mid) + 0.15 * least((max(ts) - min(ts)) / 60, 1) + 0.1 * coalesce(least(avg(mv) / 50, 1), 0)
+ 0.1 * greatest(0, 1 - stddev_pop(area) / (avg(area) + 1e-6)) + 0.1 * avg(conf), 6) AS importance FROM m GROUP BY 1""")
def e16(spark, d) -> DataFrame:
    weights = {"frequency": 0.2, "size": 0.2, "center": 0.15, "time_distribution": 0.15, "motion": 0.1, "consistency": 0.1, "confidence": 0.1}
    return identity.importance(_clusters(spark, d), ["label"], weights, 60.0).withColumn("importance", R("importance", 6))


@query("d2_frame_pairs", f"SELECT a.frame, a.det AS det_a, b.det AS det_b {PAIRS}")
def d2(spark, d) -> DataFrame:
    return identity.pairs(boxes(spark, d), ["frame"], "det", ["det"])


@query("j21_bitrate", """SELECT vec_id, floor(4000000 * (w * h) / 8294.4)::BIGINT AS scaled, CASE WHEN abs(t - 4000000) / 4000000 < 0.05 THEN 4000000 ELSE floor(t)::BIGINT END AS adapted
FROM (SELECT *, greatest(2000000, least(8000000, 4000000 * CASE WHEN conf > 0.7 THEN 1.1 WHEN conf < 0.45 THEN 0.9 ELSE 1.0 END)) AS t FROM bx)""")
def j21(spark, d) -> DataFrame:
    from ..functions import scalar

    area = F.col("w") * F.col("h")
    return boxes(spark, d).select("vec_id", scalar.scaled_bitrate(4000000, area, 8294.4).alias("scaled"), scalar.adapted_bitrate(4000000, F.col("conf"), 0.7, 0.45, 2000000, 8000000).alias("adapted"))
