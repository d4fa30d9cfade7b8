"""Vector queries: similarity, prototypes, thresholds, matching, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import identity
from ..storage import scratch
from ..streaming import live
from ..streaming import telemetry as streams
from .catalog import query, table, vectors

R6 = lambda c: F.round(c, 6)
PAIR = "FROM vec a JOIN vec b ON a.vec_id = b.vec_id - 1"
DOT = "list_sum(list_transform(range(1, 65), lambda k: {a}[k] * {b}[k]))"


def _next(spark, d) -> DataFrame:
    """Each vector with the next one."""
    v = vectors(spark, d)
    return v.select("vec_id", F.col("v").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b")), "vec_id")


@query("j1_cosine", f"SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cos {PAIR}")
def j1(spark, d) -> DataFrame:
    return _next(spark, d).select("vec_id", R6(V.cosine(F.col("a"), F.col("b"))).alias("cos"))


@query("j2_cosine01", f"SELECT a.vec_id, round((greatest(-1, least(1, {DOT.format(a='a.v', b='b.v')})) + 1) / 2, 6) AS cos {PAIR}")
def j2(spark, d) -> DataFrame:
    return _next(spark, d).select("vec_id", R6(V.cosine01(F.col("a"), F.col("b"))).alias("cos"))


@query("j3_prototype_distance", """WITH l AS (SELECT label, k, avg(v[k]) AS x FROM vec, (SELECT unnest(range(1, 65)) AS k) WHERE label < 9 GROUP BY 1, 2), q AS (SELECT label, list(x ORDER BY k) AS x FROM l GROUP BY 1)
SELECT vec_id, round(coalesce(1 - list_cosine_similarity(v, x), 1), 6) AS cosine_distance, round(coalesce(list_distance(v, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x)))), 1), 6) AS distance
FROM vec LEFT JOIN q USING (label)""")
def j3(spark, d) -> DataFrame:
    v = vectors(spark, d)
    p = V.mean_prototype(v.where("label < 9"), ["label"], "v")  # label 9 shows what a vector without a prototype gets
    j = v.join(p, "label", "left")
    return j.select("vec_id", R6(V.prototype_distance(F.col("v"), F.col("proto"))).alias("cosine_distance"), R6(V.prototype_distance(F.col("v"), F.col("proto"), False)).alias("distance"))


@query("j4_l2norm", "SELECT vec_id, round(v[1] * 3 / (sqrt(list_dot_product(list_transform(v, lambda x: x * 3), list_transform(v, lambda x: x * 3))) + 1e-8), 6) AS x0 FROM vec")
def j4(spark, d) -> DataFrame:
    return vectors(spark, d).select("vec_id", R6(V.l2norm(F.transform("v", lambda x: x * 3))[0]).alias("x0"))


PROTO = """l AS (SELECT label, k, {agg} AS x FROM (SELECT *, vec_id % 5 + 1 AS q FROM vec), (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2), q AS (SELECT label, list(x ORDER BY k) AS x FROM l GROUP BY 1)
SELECT label, array_to_string(list_transform(range(1, 65), lambda k: round(x[k] / (sqrt(list_dot_product(x, x)) {eps}), 4)::DECIMAL(9, 4)::VARCHAR), ',') AS proto FROM q"""


def _text(proto: DataFrame) -> DataFrame:
    return proto.select("label", F.array_join(F.transform("proto", lambda x: F.round(x, 4).cast("decimal(9,4)").cast("string")), ",").alias("proto"))


@query("e13_mean_prototype", "WITH " + PROTO.format(agg="avg(v[k])", eps=""))
def e13(spark, d) -> DataFrame:
    return _text(V.mean_prototype(vectors(spark, d), ["label"], "v"))


@query("e14_median_prototype", "WITH " + PROTO.format(agg="quantile_cont(v[k], 0.5)", eps="+ 1e-8"))
def e14(spark, d) -> DataFrame:
    return _text(V.median_prototype(vectors(spark, d), ["label"], "v"))


@query("e15_weighted_prototype", "WITH " + PROTO.format(agg="sum(v[k] * q) / sum(q)", eps=""))
def e15(spark, d) -> DataFrame:
    return _text(V.weighted_prototype(vectors(spark, d).withColumn("q", F.col("vec_id") % 5 + 1), ["label"], "v", "q"))


@query("g1_top_similar", """WITH s AS (SELECT a.vec_id AS q, b.vec_id AS s, list_cosine_similarity(a.v, b.v) AS c FROM vec a, vec b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT q, s, round(c, 6) AS similarity, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, s) AS r FROM s WHERE c >= 0.2) WHERE r <= 5""")
def g1(spark, d) -> DataFrame:
    v = vectors(spark, d)
    return identity.top_similar(v.where("vec_id % 20 = 0"), v, "vec_id", "v", 5, 0.2).withColumn("similarity", R6("similarity"))


@query("g2_track_best", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY v[1] DESC, vec_id) AS r FROM vec) WHERE r <= 7")
def g2(spark, d) -> DataFrame:
    return identity.last_n(vectors(spark, d), ["label"], [F.col("v")[0].desc(), F.asc("vec_id")], 7).select("label", "vec_id")


@query("g3_last_n", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM vec) WHERE r <= 20")
def g3(spark, d) -> DataFrame:
    return identity.last_n(vectors(spark, d), ["label"], [F.desc("vec_id")], 20).select("label", "vec_id")


@query("g4_retained", """WITH t AS (SELECT label, max(vec_id)::DOUBLE AS last FROM vec GROUP BY 1), n AS (SELECT max(last) AS now FROM t)
SELECT label, last FROM t, n WHERE now - last <= 30 ORDER BY last DESC, label LIMIT 5""")
def g4(spark, d) -> DataFrame:
    v = vectors(spark, d).withColumn("ts", F.col("vec_id").cast("double"))
    now = v.agg(F.max("ts").alias("now"))  # one row
    return identity.retained(v.join(F.broadcast(now)), "label", "ts", F.col("now"), 5)


@query("e10_distribution", f"""WITH s AS (SELECT a.label = b.label AS same, list_cosine_similarity(a.v, b.v) AS c {PAIR})
SELECT same, count(*) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, round(min(c), 6) AS min, round(max(c), 6) AS max, round(quantile_cont(c, 0.1), 6) AS p10,
round(quantile_cont(c, 0.15), 6) AS p15, round(quantile_cont(c, 0.9), 6) AS p90 FROM s GROUP BY 1""")
def e10(spark, d) -> DataFrame:
    v = vectors(spark, d)
    n = v.select("vec_id", F.col("v").alias("a"), F.col("label").alias("la")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b"), F.col("label").alias("lb")), "vec_id")
    s = n.select((F.col("la") == F.col("lb")).alias("same"), V.cosine(F.col("a"), F.col("b")).alias("c"))
    s = identity.distribution(s, ["same"], "c")
    return s.select("same", "n", *[R6(c).alias(c) for c in s.columns[2:]])


@query("n15_adaptive_threshold", """WITH s AS (SELECT list_cosine_similarity(a.v, b.v) AS c FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id < b.vec_id),
f AS (SELECT label, min_by(v, vec_id) AS v FROM vec GROUP BY 1), o AS (SELECT list_cosine_similarity(a.v, b.v) AS c FROM f a JOIN f b ON a.label < b.label),
x AS (SELECT count(*) sn, avg(c) sm, stddev_pop(c) ss, min(c) smin, quantile_cont(c, 0.15) p15 FROM s), y AS (SELECT count(*) n, avg(c) om, stddev_pop(c) os, max(c) omax FROM o)
SELECT sn AS same_n, n AS other_n, round(greatest(0.05, least(0.95, CASE WHEN smin > omax THEN (smin + omax) / 2 WHEN sm - ss > om + os THEN (sm - ss + om + os) / 2 ELSE p15 END)), 6) AS threshold,
CASE WHEN smin > omax THEN 'high' WHEN sm - ss > om + os THEN 'medium' ELSE 'low' END AS confidence,
abs(greatest(0.05, least(0.95, CASE WHEN smin > omax THEN (smin + omax) / 2 ELSE (sm - ss + om + os) / 2 END)) - 0.7) / 0.7 * 100 >= 2 AND sm - ss > om + os OR (smin > omax AND abs(greatest(0.05, least(0.95, (smin + omax) / 2)) - 0.7) / 0.7 * 100 >= 2) AS apply FROM x, y""")
def n15(spark, d) -> DataFrame:
    return identity.adaptive_threshold(vectors(spark, d), "label", "vec_id", "v", low=0.05).select("same_n", "other_n", R6("threshold").alias("threshold"), "confidence", "apply")


# similarity and confidence of the pairs of tracks (labels) of a scene (a hundred vectors)
_TRACKS = """r AS (SELECT vec_id // 100 AS scene, label, vec_id, vec_id::DOUBLE AS ts, v, (vec_id % 7 + 1) / 8.0::DOUBLE AS q FROM vec),
bs AS (SELECT scene, label, first(v ORDER BY q DESC, vec_id) AS v, count(*) AS n, avg(q) AS q FROM r GROUP BY 1, 2),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene, label ORDER BY vec_id) AS n FROM r) WHERE n <= 5),
oc AS (SELECT scene, label, k, sum(v[k] * q) / sum(q) AS x FROM o, (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2, 3), ov AS (SELECT scene, label, list(x ORDER BY k) AS x FROM oc GROUP BY 1, 2),
oe AS (SELECT scene, label, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS e FROM ov),
la AS (SELECT *, exp((ts - max(ts) OVER (PARTITION BY scene)) / 10) AS w FROM (SELECT *, row_number() OVER (PARTITION BY scene, label ORDER BY vec_id DESC) AS n FROM r) WHERE n <= 3),
rc AS (SELECT a.scene, a.label AS la, b.label AS lb, sum((greatest(-1, least(1, list_dot_product(a.v, b.v))) + 1) / 2 * ((a.w + b.w) / 2 * (a.q + b.q) / 2)) / sum((a.w + b.w) / 2 * (a.q + b.q) / 2) AS c
 FROM la a JOIN la b ON a.scene = b.scene AND a.label < b.label GROUP BY 1, 2, 3),
ts AS (SELECT rc.scene, la AS label_a, lb AS label_b, x.n + y.n AS records, (x.q + y.q) / 2 AS q, 0.4 * (greatest(-1, least(1, list_dot_product(x.v, y.v))) + 1) / 2 + 0.4 * (greatest(-1, least(1, list_dot_product(p.e, q.e))) + 1) / 2 + 0.2 * c AS similarity
FROM rc JOIN bs x ON x.scene = rc.scene AND x.label = la JOIN bs y ON y.scene = rc.scene AND y.label = lb JOIN oe p ON p.scene = rc.scene AND p.label = la JOIN oe q ON q.scene = rc.scene AND q.label = lb),
tc AS (SELECT *, least(records / 10.0, 1) * 0.3 + q * 0.4 + similarity * 0.3 AS confidence FROM ts)"""


def _tracks(spark, d) -> DataFrame:
    r = vectors(spark, d).select(F.floor(F.col("vec_id") / 100).alias("scene"), "label", "vec_id", F.col("vec_id").cast("double").alias("ts"), "v", ((F.col("vec_id") % 7 + 1) / 8.0).alias("q"))
    return identity.track_similarity(r, "label", "vec_id", "ts", "v", "q")


# vectors of the test tables are alike by chance only: the cuts of both are lower than the operators' own
@query("n13_track_match", f"""WITH {_TRACKS}, b AS (SELECT scene, label_a AS source, label_b AS matched, similarity, confidence, records FROM tc WHERE similarity >= 0.5 UNION ALL SELECT scene, label_b, label_a, similarity, confidence, records FROM tc WHERE similarity >= 0.5)
SELECT scene, source, matched, round(similarity, 6) AS similarity, round(confidence, 6) AS confidence, records, (row_number() OVER (PARTITION BY scene, source ORDER BY similarity DESC, matched))::INT AS place FROM b""")
def n13(spark, d) -> DataFrame:
    return identity.track_matches(_tracks(spark, d), "label", 0.5).withColumns({c: R6(c) for c in ("similarity", "confidence")})


# the strongest pair that is left, one at a time
@query("n14_corrections", f"""WITH RECURSIVE {_TRACKS}, e AS (SELECT scene, list({{'a': label_a, 'b': label_b, 's': similarity, 'c': confidence}} ORDER BY similarity * confidence DESC, label_a, label_b) AS es FROM tc WHERE similarity >= 0.48 AND confidence >= 0.6 GROUP BY scene),
k AS (SELECT scene, es[1] AS x, list_filter(es, lambda z: z.a NOT IN (es[1].a, es[1].b) AND z.b NOT IN (es[1].a, es[1].b)) AS es FROM e UNION ALL
SELECT scene, es[1], list_filter(es, lambda z: z.a NOT IN (es[1].a, es[1].b) AND z.b NOT IN (es[1].a, es[1].b)) FROM k WHERE len(es) > 0)
SELECT scene, x.a AS label_a, x.b AS label_b, round(x.s, 6) AS similarity, round(x.c, 6) AS confidence FROM k""")
def n14_corrections(spark, d) -> DataFrame:
    return identity.corrections(_tracks(spark, d), "label", 0.48, 0.6).select("scene", "label_a", "label_b", R6("similarity").alias("similarity"), R6("confidence").alias("confidence"))


@query("j11_embedding_quality", """WITH x AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n, list_sum(v) / 64 AS m FROM vec), y AS (SELECT *, list_sum(list_transform(v, lambda z: (z - m) * (z - m))) / 64 AS s FROM x)
SELECT vec_id, round(((CASE WHEN n BETWEEN 0.8 AND 1.2 THEN 1 ELSE greatest(0.3, 1 - abs(1 - n)) END) + (CASE WHEN s > 0.01 THEN 1 ELSE greatest(0.3, s * 100) END) + 0.9::DOUBLE
+ (least((vec_id % 15) / 10.0, 1) + least((vec_id % 8) / 5.0, 1)) / 2) / 4, 6) AS quality FROM y""")
def j11(spark, d) -> DataFrame:
    return vectors(spark, d).select("vec_id", R6(V.embedding_quality(F.col("v"), F.lit(0.9), F.col("vec_id") % 15, F.col("vec_id") % 8)).alias("quality"))


@query("n22_gated_append", """WITH x AS (SELECT vec_id, label, (vec_id % 11) / 10.0::DOUBLE AS q FROM vec WHERE vec_id % 11 >= 5) SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM x) WHERE r <= 20""")
def n22(spark, d) -> DataFrame:
    good = vectors(spark, d).withColumn("q", (F.col("vec_id") % 11) / 10.0).where("q >= 0.5")
    return identity.last_n(good, ["label"], [F.desc("vec_id")], 20).select("label", "vec_id")


@query("e26_store_stats", "SELECT count(DISTINCT label) AS tracks, count(*) AS records, round(count(*) / count(DISTINCT label)::DOUBLE, 6) AS per_track, round(count(*) FILTER (v[1] > 0) / count(*)::DOUBLE, 6) AS success FROM vec")
def e26(spark, d) -> DataFrame:
    n, k = F.count("*"), F.count_distinct("label")
    return vectors(spark, d).agg(k.alias("tracks"), n.alias("records"), R6(F.try_divide(n, k)).alias("per_track"), R6(F.try_divide(F.count_if(F.col("v")[0] > 0), n)).alias("success"))


@query("j24_same_person", f"SELECT a.vec_id, CASE WHEN a.vec_id % 3 = 0 THEN abs(a.v[1] - b.v[1]) * 1000 <= 150 ELSE list_cosine_similarity(a.v, b.v) >= 0.1 END AS same {PAIR}")
def j24(spark, d) -> DataFrame:
    n = _next(spark, d)
    a = F.when(F.col("vec_id") % 3 != 0, F.col("a"))
    return n.select("vec_id", V.same_person(a, F.col("b"), F.abs(F.col("a")[0] - F.col("b")[0]) * 1000, 0.1, 150.0).alias("same"))


@query("c13_has_embedding", "SELECT vec_id FROM vec WHERE CASE WHEN vec_id % 4 = 0 THEN NULL ELSE v END IS NOT NULL")
def c13(spark, d) -> DataFrame:
    return vectors(spark, d).withColumn("v", F.when(F.col("vec_id") % 4 != 0, F.col("v"))).where(F.col("v").isNotNull()).select("vec_id")


def _scenes(spark, d) -> DataFrame:
    return vectors(spark, d).withColumn("scene", F.floor(F.col("vec_id") / 100))


@query("d3_within_pairs", "SELECT a.vec_id // 100 AS scene, a.label, a.vec_id AS vec_id_a, b.vec_id AS vec_id_b FROM vec a JOIN vec b ON a.vec_id // 100 = b.vec_id // 100 AND a.label = b.label AND a.vec_id < b.vec_id")
def d3(spark, d) -> DataFrame:
    return identity.pairs(_scenes(spark, d), ["scene", "label"], "vec_id", ["vec_id"])


_UNIT = "u AS (SELECT vec_id // 100 AS scene, vec_id, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) AS r, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS x FROM vec)"
_ONLINE = """WITH RECURSIVE {unit}, k AS (SELECT scene, vec_id, r, [x] AS store, 1::BIGINT AS k FROM u WHERE r = 1 UNION ALL
SELECT scene, vec_id, r, CASE WHEN spot > 0 THEN list_concat(list_append(store[1 : spot - 1], x), store[spot + 1 :]) ELSE list_append(store, x) END, CASE WHEN spot > 0 THEN spot ELSE len(store) + 1 END FROM (
SELECT *, coalesce({choice}, 0) AS spot FROM (SELECT u.scene, u.vec_id, u.r, u.x, k.store, list_transform(k.store, lambda s: list_inner_product(s, u.x)) AS sims FROM k JOIN u ON u.scene = k.scene AND u.r = k.r + 1)))
SELECT scene, vec_id, k - 1 AS identity FROM k"""


@query("n1_online_ids", _ONLINE.format(unit=_UNIT, choice="CASE WHEN list_max(sims) > 0.3 THEN list_position(sims, list_max(sims)) END"))
def n1(spark, d) -> DataFrame:
    return identity.online_ids(_scenes(spark, d).select("scene", "vec_id", "v"), ["scene"], ["vec_id"], "v", 0.3)


@query("n1_first_ids", _ONLINE.format(unit=_UNIT, choice="list_position(list_transform(sims, lambda s: s > 0.3), true)"))
def n1_first(spark, d) -> DataFrame:
    return identity.online_ids(_scenes(spark, d).select("scene", "vec_id", "v"), ["scene"], ["vec_id"], "v", 0.3, first=True)


@query("n1_live_ids", _ONLINE.format(unit=_UNIT, choice="CASE WHEN list_max(sims) > 0.3 THEN list_position(sims, list_max(sims)) END"))
def n1_live(spark, d) -> DataFrame:
    # a stream of the table's files, which may come in any order
    path = f"{d}/embeddings.parquet"
    far = (table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1
    source = streams.read_stream(spark, path, 1000).select("vec_id", F.floor(F.col("vec_id") / 100).alias("scene"), F.col("embedding").cast("array<double>").alias("v"), F.col("vec_id").cast("double").alias("t"))
    found = live.drained(source, "scene", "vec_id", "t", lambda s: live.live_identities(s, "scene", F.col("t"), "vec_id", "v", 0.3, late=f"{far} seconds"), scratch(spark), 3.0 * far)
    return found.select(F.col("key").alias("scene"), F.col("id").alias("vec_id"), "identity")


@query("n2_greedy_merge", f"""WITH RECURSIVE {_UNIT}, k AS (SELECT scene, vec_id, r, [{{'i': vec_id, 'x': x}}] AS reps, vec_id AS representative FROM u WHERE r = 1 UNION ALL
SELECT scene, vec_id, r, CASE WHEN rep IS NULL THEN list_append(reps, {{'i': vec_id, 'x': x}}) ELSE reps END, coalesce(rep, vec_id) FROM (
SELECT u.scene, u.vec_id, u.r, u.x, k.reps, list_filter(k.reps, lambda p: list_inner_product(p.x, u.x) >= 0.3)[1].i AS rep FROM k JOIN u ON u.scene = k.scene AND u.r = k.r + 1))
SELECT scene, vec_id, representative FROM k""")
def n2(spark, d) -> DataFrame:
    return identity.greedy_merge(_scenes(spark, d), ["scene"], "vec_id", "v", 0.3)


@query("n11_dbscan", """WITH RECURSIVE p AS (SELECT a.vec_id AS ia, b.vec_id AS ib FROM vec a JOIN vec b ON a.vec_id // 100 = b.vec_id // 100 AND 1 - list_cosine_similarity(a.v, b.v) <= 0.7),
c AS (SELECT ia FROM p GROUP BY 1 HAVING count(*) >= 4), l AS (SELECT ia, ib FROM p WHERE ia IN (SELECT ia FROM c) AND ib IN (SELECT ia FROM c)),
r AS (SELECT ia AS i, ia AS root FROM c UNION SELECT l.ib, r.root FROM r JOIN l ON l.ia = r.i),
o AS (SELECT i, min(root) AS own FROM r GROUP BY 1), n AS (SELECT p.ia AS i, min(own) AS near FROM p JOIN o ON o.i = p.ib GROUP BY 1),
f AS (SELECT vec_id // 100 AS scene, vec_id, coalesce(own, near) AS cluster FROM vec LEFT JOIN o ON o.i = vec_id LEFT JOIN n ON n.i = vec_id),
t AS (SELECT scene, arg_max(cluster, {'n': n, 'c': -cluster}) AS top FROM (SELECT scene, cluster, count(*) AS n FROM f WHERE cluster IS NOT NULL GROUP BY ALL) GROUP BY scene)
SELECT f.scene, vec_id, cluster, coalesce(cluster = top, false) AS largest FROM f LEFT JOIN t USING (scene)""")
def n11(spark, d) -> DataFrame:
    return identity.dbscan(_scenes(spark, d), "scene", "vec_id", "v", 0.7, 4)
