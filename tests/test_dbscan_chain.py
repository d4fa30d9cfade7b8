"""A cluster that is a long chain of core points."""

import math

import pytest

from chronovec.operators import identity, metric


def chain(n):
    return [(s, k * 7 % n + 1000 * s, [math.cos(0.02 * k), math.sin(0.02 * k)]) for s in range(2) for k in range(n)]


def test_chain_of_core_points_is_one_cluster(spark):
    df = spark.createDataFrame(chain(120), "scene long, id long, v array<double>")
    # neighbours are the two next points, so the ends are more than 30 hops apart
    found = identity.dbscan(df, "scene", "id", "v", 1 - math.cos(0.021), 3).collect()
    assert {(r.scene, r.cluster) for r in found} == {(s, min(r.cluster for r in found if r.scene == s)) for s in range(2)}
    assert len(found) == 240 and all(r.cluster is not None for r in found)


def test_unsettled_clusters_raise(spark, monkeypatch):
    monkeypatch.setattr(metric, "SMALL", 1)  # a chain within one cell is settled there
    df = spark.createDataFrame(chain(120), "scene long, id long, v array<double>")
    with pytest.raises(RuntimeError):
        identity.dbscan(df, "scene", "id", "v", 1 - math.cos(0.021), 3, rounds=1)
