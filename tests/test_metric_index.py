"""Clusters by the metric index against all pairs, and how many pairs it compares."""

from collections import Counter

import numpy as np
import pytest

from chronovec.operators import identity, metric

KIND = "scene long, id long, v array<double>"


def plain(rows, eps, least):
    """Labels by all pairs: a cluster is named by its smallest core, a border row takes the smallest name near it."""
    out = []
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        ok = [k for k, r in enumerate(own) if r[2] is not None and np.linalg.norm(r[2])]
        near = np.zeros((len(own), len(own)), bool)
        x = np.array([np.array(own[k][2]) / np.linalg.norm(own[k][2]) for k in ok])
        if ok:
            near[np.ix_(ok, ok)] = 1 - x @ x.T <= eps
        core = near.sum(axis=1) >= least
        label = {k: own[k][1] for k in np.flatnonzero(core)}
        while True:
            new = {k: min(label[j] for j in np.flatnonzero(near[k] & core)) for k in label}
            if new == label:
                break
            label = new
        for k in range(len(own)):
            if not core[k] and (near[k] & core).any():
                label[k] = min(new[j] for j in np.flatnonzero(near[k] & core))
        sizes = Counter(label.values())
        top = max(sizes, key=lambda c: (sizes[c], -c), default=None)
        out += [(s, own[k][1], label.get(k), k in label and label[k] == top) for k in range(len(own))]
    return sorted(out, key=str)


@pytest.mark.parametrize("small, block, eps, least", [(1, 7, 0.05, 4), (1, 2048, 0.05, 4), (30, 11, 0.2, 3), (1, 2048, 0.7, 6), (1, 5, 0.0, 2), (1024, 40, 0.02, 30)])
def test_clusters_equal_all_pairs(spark, monkeypatch, small, block, eps, least):
    monkeypatch.setattr(metric, "SMALL", small)
    monkeypatch.setattr(metric, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows, n = [], 0
    for s, size in enumerate((90, 25, 1, 40)):
        middle = rng.normal(size=(5, 6))
        for k in range(size):
            v = middle[rng.integers(5)] + rng.choice([0.1, 0.3, 1.0]) * rng.normal(size=6)
            rows.append((s, (n := n + 7) % 1009, (v * rng.uniform(0.1, 9)).tolist()))
        if s != 2:
            rows += [(s, 2000 + 100 * s + k, rows[-1][2]) for k in range(8)]  # copies
            rows += [(s, 3000 + 10 * s, [0.0] * 6), (s, 3001 + 10 * s, None)]
    # on the line between rounding and not, both may be right: keep away from it
    found = identity.dbscan(spark.createDataFrame(rows, KIND).repartition(3), "scene", "id", "v", eps + 1e-12, least)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, eps + 1e-12, least)


def test_few_pairs_are_compared_and_dense_groups_hardly_any(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(60, 16))
    v = np.concatenate((middle[rng.integers(60, size=3000)] + 0.05 * rng.normal(size=(3000, 16)), middle[0] + 0.001 * rng.normal(size=(1500, 16))))
    df = spark.createDataFrame([(0, k, x) for k, x in enumerate(v.tolist())], KIND)
    _, cells = metric.cells(df, "scene", "id", "v", 0.05, 5)
    r = metric.compared(cells).first()
    assert r.vectors == 4500 and r.pairs == 4500 * 4499 // 2
    print(f"compared {r.compared} of {r.pairs} pairs")
    assert r.compared < r.pairs / 10
    with pytest.raises(ValueError):
        metric.cells(df, "scene", "id", "v", 1.0, 5)
    assert identity.dbscan(df.limit(0), "scene", "id", "v", 0.05).collect() == []
