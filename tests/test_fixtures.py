"""Hand-computed cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronovec.functions import boxes as B
from chronovec.functions import scalar
from chronovec.functions import vectors as V
from chronovec.operators import audio, identity, records, sequence, stateful, telemetry


def line(spark, text):
    return spark.createDataFrame([("v", k, c == "T") for k, c in enumerate(text)], "v string, f long, p boolean")


def segments(df):
    return sorted((r.start_s, r.end_s) for r in df.collect())


def test_condense(spark):
    assert segments(sequence.condense(line(spark, "TTFFFFFFT"), ["v"], "f", "p", 1.0)) == [(0, 2), (8, 9)]
    assert segments(sequence.condense(line(spark, "TTFFFFFT"), ["v"], "f", "p", 1.0)) == [(0, 2), (2, 7), (7, 8)]


def test_null_mask(spark):
    ids = [1, None, None, 1, None, None, None, 2]
    df = spark.createDataFrame([("v", k, i) for k, i in enumerate(ids)], "v string, f long, id int")
    assert segments(sequence.drop_null_runs(df, ["v"], "f", "id", 3, 1.0)) == [(0, 4), (7, 8)]


def test_slices(spark):
    df = spark.createDataFrame([("v", 25.0)], "v string, d double")
    assert sorted(tuple(r)[1:] for r in sequence.fixed_slices(df, ["v"], "d").collect()) == [(0, 10), (10, 20)]


def test_trim(spark):
    t = lambda s: segments(sequence.trim_segments(line(spark, s), ["v"], "f", "p", 1.0))
    assert t("TTTT") == [(0, 4)]
    assert t("TTFFFTT") == [(0, 1.5), (4.5, 7)]
    assert t("FFFF") == [(0, 4)]  # nothing left: all stays
    assert t("TTTFFF") == [(0, 2.5)]


def test_mode_tie_and_top_two(spark):
    df = spark.createDataFrame([("v", k, i) for k, i in enumerate([2, 1, 1, 2])], "v string, f long, id int")
    assert audio.top_ids(df, ["v"], "f", "id", 1).first()["id"] == 2
    one = spark.createDataFrame([("v", k, 5) for k in range(2)], "v string, f long, id int")
    r = audio.top_two(one, ["v"], "f", "id").first()
    assert (r.first_id, r.second_id, r.dominant) == (5, None, True)


def boxed(spark, a, b):
    names = [f"{s}{k}" for s in "ab" for k in range(4)]
    return spark.createDataFrame([tuple(float(x) for x in a + b)], ", ".join(f"{n} double" for n in names)), [tuple(F.col(f"{s}{k}") for k in range(4)) for s in "ab"]


@pytest.mark.parametrize(("a", "b", "expected"), [((0, 0, 2, 2), (1, 1, 3, 3), 1 / 7), ((0, 0, 1, 1), (1, 0, 2, 1), 0.0), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0)])
def test_iou(spark, a, b, expected):
    df, (x, y) = boxed(spark, a, b)
    assert df.select(B.iou(x, y)).first()[0] == pytest.approx(expected)


def test_ema_and_jump(spark):
    df = spark.createDataFrame([("v", 0, 0.0), ("v", 1, 10.0), ("v", 2, 500.0), ("v", 3, None)], "v string, f long, x double")
    got = [r.ema for r in sequence.ema(df, ["v"], ["f"], "x", 0.15).orderBy("f").collect()]
    assert got[:2] == pytest.approx([0, 1.5]) and got[2] == got[3]
    calm = [r.ema for r in sequence.ema(df, ["v"], ["f"], "x", 0.15, jump=100).orderBy("f").collect()]
    assert calm[2] == pytest.approx(1.5)


def test_predicted(spark):
    df = lambda n: spark.createDataFrame([("v", k, 10.0 * k) for k in range(n)], "v string, f long, x double")
    last = lambda n: sequence.predicted(df(n), ["v"], ["f"], "x").orderBy(F.desc("f")).first().predicted
    assert last(3) == pytest.approx(13) and last(5) == pytest.approx(44)
    assert stateful.predicted_place([(10.0 * k, 0.0) for k in range(5)])[0] == pytest.approx(44)


def test_percentile_and_corr(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8, 9)], "x double")
    assert df.agg(*identity.summary("x")).first()["p15"] == pytest.approx(1.6)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert flat.agg(audio.pearson("a", "b")).first()[0] == 0


def test_lag(spark):
    a = spark.createDataFrame([(k, x) for k, x in enumerate([0.1, 0.3, 0.7, 0.5, 0.2, 0.8, 0.4])], "i long, a double")
    c = audio.lag_correlation(a, a.withColumnRenamed("a", "b"), "i", "a", "b", 3)
    assert tuple(audio.best_lag(c).first()) == (0, 0.0)  # fewer than ten rows
    assert audio.best_lag(c, 1).first()["corr"] == pytest.approx(1.0)


def test_chunks_and_durations(spark):
    df = spark.createDataFrame([("x" * 4001,), ("",), (None,)], "t string")
    assert [[len(p) for p in r[0]] if r[0] is not None else None for r in df.select(scalar.chunks(F.col("t"))).collect()] == [[4000, 1], [], []]
    s = spark.createDataFrame([(5.04,), (125.0,), (7300.0,)], "s double")
    assert [r[0] for r in s.select(scalar.duration_text(F.col("s"))).collect()] == ["5.0s", "2m 5.0s", "2h 1m 40.0s"]


def test_upsert(spark):
    t = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string")
    s = spark.createDataFrame([("2", "c"), ("3", "d")], "k string, v string")
    assert {tuple(r) for r in records.upsert(t, s, "k").collect()} == {("1", "a"), ("2", "c"), ("3", "d")}
    assert {tuple(r) for r in records.change_log(t, s, "k").collect()} == {("2", "changed", "v: b -> c"), ("3", "new", "")}
    twice = spark.createDataFrame([("2", "x", 1), ("2", "y", 2)], "k string, v string, n int")
    assert records.last_by_key(twice, "k", "n").first()["v"] == "y"


def clusters():
    rng = np.random.default_rng(1)
    rows = []
    for c in range(3):
        for m in range(6):
            noise = rng.standard_normal(8)
            v = np.eye(8)[c] + 0.05 * noise / np.linalg.norm(noise)
            rows.append((0, len(rows), [float(x) for x in v / np.linalg.norm(v)]))
    for k in (5, 6):
        rows.append((0, len(rows), [float(x) for x in np.eye(8)[k]]))
    return rows


def test_dbscan_ids_and_merge(spark):
    df = spark.createDataFrame(clusters(), "scene long, id long, v array<double>")
    found = {r.id: r.cluster for r in identity.dbscan(df, "scene", "id", "v").collect()}
    assert [found[k] for k in range(18)] == [0] * 6 + [6] * 6 + [12] * 6 and found[18] is None and found[19] is None
    ids = [r.identity for r in identity.online_ids(df, ["scene"], ["id"], "v", 0.75).orderBy("id").collect()]
    assert ids == [0] * 6 + [1] * 6 + [2] * 6 + [3, 4]
    reps = [r.representative for r in identity.greedy_merge(df, ["scene"], "id", "v", 0.75).orderBy("id").collect()]
    assert reps == [0] * 6 + [6] * 6 + [12] * 6 + [18, 19]


def test_top_similar_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8))
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "id long, v array<double>")
    got = {(r.q, r["rank"]): r.s for r in identity.top_similar(df.where("id % 20 = 0"), df, "id", "v", 3, -1.0, blocks=4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = u @ u[q]
        s[q] = -2
        assert [got[q, n + 1] for n in range(3)] == np.argsort(-s)[:3].tolist()


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (2, 3), (3, 3), (4, 3), (5, 6)):
        for _ in range(20):
            c = rng.random((n, m))
            small, big = (c, m) if n <= m else (c.T, n)
            best = min(sum(small[k, j] for k, j in enumerate(p)) for p in permutations(range(big), min(n, m)))
            pairs = stateful.assign(c)
            assert len(pairs) == min(n, m) and sum(c[i, j] for i, j in pairs) == pytest.approx(best)
    assert stateful.assign(np.zeros((0, 3))) == []
    assert stateful.matched(np.array([[0.9]]), 0.7) == []


def detections(spark, frames):
    rows = [(0, f, 10 * f + k, *map(float, b), c) for f, some in enumerate(frames) for k, (b, c) in enumerate(some)]
    return spark.createDataFrame(rows, "s long, f long, id long, x1 double, y1 double, x2 double, y2 double, conf double")


def test_lifecycle(spark):
    box = lambda x: (x, 0, x + 10, 10)
    frames = [[(box(0), 0.9)], [(box(1), 0.9)], [(box(2), 0.3)], [], [(box(3), 0.9), (box(80), 0.9)]]
    got = {(r.f, r.id): r.track for r in stateful.lifecycle_tracks(detections(spark, frames), ["s"], "f", "id", "conf").collect()}
    assert got == {(0, 0): 0, (1, 10): 0, (2, 20): 0, (4, 40): 0, (4, 41): 1}


def test_two_slots(spark):
    box = lambda x: (x, 500, x + 100, 600)
    frames = [[(box(300), 0.9), (box(1500), 0.9)]] * 8 + [[(box(310), 0.9)]] + [[(box(320), 0.9), (box(1520), 0.9)]]
    got = [(r.person1, r.person2) for r in stateful.two_slot_tracks(detections(spark, frames), ["s"], "f", "id", "conf", 5).orderBy("f").collect()]
    assert got[0] == (1, 0) and got[8] == (None, 80) and got[9] == (91, 90)


def test_suppression(spark):
    frames = [[((0, 0, 10, 10), 0.9), ((1, 1, 11, 11), 0.8), ((50, 50, 60, 60), 0.7)]]
    assert sorted(r.id for r in stateful.suppress(detections(spark, frames), ["s"], "id", "conf").collect()) == [0, 2]


def test_filters_hold_still(spark):
    df = spark.createDataFrame([(0, float(k), 5.0, 7.0) for k in range(6)], "s long, t double, x double, y double")
    assert {(r.sx, r.sy) for r in stateful.kalman(df, ["s"], "t", "x", "y").collect()} == {(5.0, 7.0)}
    assert {r.f_x for r in stateful.one_euro(df, ["s"], "t", ["x"]).collect()} == {5.0}


def test_activation_rate_is_held(spark):
    df = spark.createDataFrame([(0, k, 0.65, 0.9, 2) for k in range(200)], "s long, i long, r double, c double, a int")
    rows = stateful.activations(df, ["s"], "i", "r", "c", "a").collect()
    assert 20 <= sum(r.activated for r in rows) <= 40


def test_overlap_and_batches(spark):
    df = spark.createDataFrame([("p", 0, 10), ("p", 5, 15), ("p", 10, 20)], "p string, a int, b int")
    assert telemetry.overlap(df, ["p"], "a", "b").first()["most_open"] == 2
    n = spark.range(1000)
    sizes = telemetry.in_batches(n, ["id"], 64).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in sizes) == [40] + [64] * 15


def test_vectors_edges(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0], None)], "a array<double>, b array<double>, p array<double>")
    r = df.select(V.cosine(F.col("a"), F.col("b")), V.prototype_distance(F.col("b"), F.col("p"))).first()
    assert tuple(r) == (0.0, 1.0)


def test_split_and_hybrid(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "a double, b double")
    s = B.split_widths(F.col("a"), F.col("b"))
    assert df.select(s["ratio"], s["left_width"]).first()[:] == (0.5, 960)
