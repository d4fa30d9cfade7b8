"""Matches and corrections of tracks, the threshold's gate, recovery plans and frame complexity against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from chronovec.operators import frames, identity, recovery

PAIRS = "scene long, track_a long, track_b long, similarity double, confidence double"


def greedy(rows, least, sure):
    used, out = set(), set()
    for s, a, b, x, c in sorted(rows, key=lambda r: (-r[3] * r[4], r[1], r[2])):
        if x >= least and c >= sure and not {(s, a), (s, b)} & used:
            used |= {(s, a), (s, b)}
            out.add((s, a, b))
    return out


def test_corrections_equal_the_sequential_choice(spark):
    rng = random.Random(2)
    rows = [(s, a, b, rng.choice([0.7, 0.8, 0.9, 0.95, 1.0]), rng.choice([0.6, 0.7, 0.9])) for s in range(6) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.7]
    rows += [(9, a, a + 1, 0.8 + a / 1000, 0.9) for a in range(20)]  # each pair waits for the next
    rows += [(10, 0, b, 0.9, 0.9) for b in range(1, 30)]  # one track in all pairs, all alike
    found = identity.corrections(spark.createDataFrame(rows, PAIRS), "track").collect()
    assert {(r.scene, r.track_a, r.track_b) for r in found} == greedy(rows, 0.8, 0.7) and len(found) == len(greedy(rows, 0.8, 0.7))
    assert max(r["round"] for r in found if r.scene == 9) == 10 and [(r.track_a, r.track_b) for r in found if r.scene == 10] == [(0, 1)]
    assert identity.corrections(spark.createDataFrame(rows, PAIRS), "track", 2.0).collect() == []


def test_matches_are_cut_and_ordered_for_both_tracks(spark):
    rows = [(0, 1, 2, 0.9, 0.5), (0, 1, 3, 0.69, 0.5), (0, 2, 3, 0.7, 0.5), (0, 2, 4, 0.9, 0.5), (1, 1, 2, 0.7, 0.5)]
    found = identity.track_matches(spark.createDataFrame(rows, PAIRS), "track").collect()
    got = {(r.scene, r.source): [] for r in found}
    for r in sorted(found, key=lambda r: r.place):
        got[(r.scene, r.source)].append(r.matched)
    assert got == {(0, 1): [2], (0, 2): [1, 4, 3], (0, 3): [2], (0, 4): [2], (1, 1): [2], (1, 2): [1]}


def test_threshold_is_applied_only_when_sure_and_better(spark):
    close, far = [[1.0, 0.01 * k, 0.0] for k in range(4)], [[0.0, 0.01 * k, 1.0] for k in range(4)]
    rows = [(p, k, v) for p, some in enumerate((close, far)) for k, v in enumerate(some)]
    df = spark.createDataFrame(rows, "person long, id long, v array<double>")
    apart = lambda **how: identity.adaptive_threshold(df, "person", "id", "v", least=1, low=0.1, **how).first()
    r = apart()
    assert r.confidence == "high" and r.apply and abs(r.threshold - 0.5) < 0.01
    assert not apart(current=r.threshold * 1.01).apply and apart(current=r.threshold * 1.03).apply  # gains of 1 and 3 percent
    mixed = spark.createDataFrame([(k % 2, k, v) for k, v in enumerate(close + far)], "person long, id long, v array<double>")
    low = identity.adaptive_threshold(mixed, "person", "id", "v", least=1, low=0.1).first()
    assert low.confidence == "low" and not low.apply
    few = identity.adaptive_threshold(df, "person", "id", "v", least=100).first()
    assert few.threshold is None and few.apply is False


def test_recovery_plan_by_hand(spark):
    events = [("cuda", 0)] * 2 + [None] + [("cuda", 0)] * 3 + [None, ("cuda", 0), ("resize", 0), (None, 0), ("cuda", 0), ("gpu_memory", 85), (None, None), ("x", 0), ("cuda", 0)]
    rows = [(1, k, e is not None, e and e[0], e and e[1]) for k, e in enumerate(events)]
    rows += [(2, 0, True, "gpu_memory", 86), (2, 1, False, None, None), (3, 0, None, "cuda", 99), (3, 1, True, "gpu_memory", None)]
    df = spark.createDataFrame(rows, "u long, i long, bad boolean, kind string, used int")
    found = recovery.recovery_plan(df, ["u"], ["i"], F.col("bad"), "kind", "used", most=6).orderBy("u", "i").collect()
    one = [(r.streak, r.action) for r in found if r.u == 1]
    retry, black, prev = "retry_with_cpu", "use_black_frame", "use_previous_frame"
    # the third cuda error in a row hardens its kind for good; streaks of the others harden theirs when they are reached
    assert one == [
        (1, retry), (2, retry), (0, None), (1, retry), (2, retry), (3, black), (0, None), (1, black), (2, "reduce_quality"), (3, black), (4, black), (5, black), (6, black),
    ]
    assert [r.i for r in found if r.stopped] == [12, 0] and prev not in {a for _, a in one}
    assert [(r.i, r.action) for r in found if r.u == 2] == [(0, "reduce_quality")]
    assert [(r.streak, r.action) for r in found if r.u == 3] == [(0, None), (1, "reduce_quality")]


def test_complexity_matches_a_plain_operator(spark):
    rng = np.random.default_rng(3)
    grids = {0: rng.integers(0, 256, (6, 9)), 1: np.full((4, 4), 7), 2: np.arange(25).reshape(5, 5) * 10, 3: rng.integers(0, 2, (1, 7)) * 255, 4: np.array([[9]])}
    rows = [(f, y, x, int(g[y, x])) for f, g in grids.items() for y in range(g.shape[0]) for x in range(g.shape[1])]
    got = {r.f: r for r in frames.complexity(spark.createDataFrame(rows, "f long, y int, x int, g int").repartition(3), ["f"], "y", "x", "g").collect()}
    for f, g in grids.items():
        wide = np.pad(g.astype(float), [(int(s > 1), int(s > 1)) for s in g.shape], mode="reflect")
        wide = np.pad(wide, [(int(s == 1), int(s == 1)) for s in g.shape], mode="edge")
        gx = gy = 0
        for k, w in enumerate((1, 2, 1)):
            gx = gx + w * (wide[k : k + g.shape[0], 2:] - wide[k : k + g.shape[0], :-2])
            gy = gy + w * (wide[2:, k : k + g.shape[1]] - wide[:-2, k : k + g.shape[1]])
        p = np.unique(g, return_counts=True)[1] / g.size
        parts = (np.sqrt(gx**2 + gy**2).mean() / 255, g.var() / 255**2, -(p * np.log2(p)).sum() / 8)
        assert np.allclose([got[f].edge_density, got[f].variance, got[f].entropy], parts)
        assert np.isclose(got[f].complexity, min(1, max(0, 0.3 * parts[0] + 0.3 * parts[1] + 0.4 * parts[2])))
