"""Summaries of all pairs in small blocks, repeated keys, bounded histories, and trackers against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronovec.operators import audio, identity, records


@pytest.mark.parametrize("block", [3, 4096])
def test_pair_summaries_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(identity, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 6))
    rows = [(k, f"p{k % 3}", (base[k % 4] + 0.3 * rng.normal(size=6)).tolist()) for k in range(40)] + [(40, "p0", [0.0] * 6), (41, "alone", base[0].tolist()), (42, None, base[1].tolist())]
    rows += [(43 + k, "copies", base[2].tolist()) for k in range(9)]
    df = spark.createDataFrame(rows, "id long, person string, v array<double>")
    got = identity.adaptive_threshold(df, "person", "id", "v", low=-1.0).first().asDict()

    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n else 0.0

    same = [cosine(a[2], b[2]) for a in rows for b in rows if a[1] == b[1] is not None and a[0] < b[0]]
    first = {}
    for i, p, v in rows:
        if p is not None:
            first.setdefault(p, v)
    first = list(first.values())
    other = [cosine(a, b) for k, a in enumerate(first) for b in first[k + 1 :]]
    for name, x in (("same", same), ("other", other)):
        want = {"n": len(x), "mean": np.mean(x), "std": np.std(x), "min": min(x), "max": max(x), "p10": np.percentile(x, 10), "p15": np.percentile(x, 15), "p90": np.percentile(x, 90)}
        for k, v in want.items():
            assert got[f"{name}_{k}"] == pytest.approx(v, abs=2e-8), (name, k)


@pytest.mark.parametrize("parts, most", [(20, 10_000), (20, 1), (100_000, 10_000)])
def test_distribution_is_exact(spark, monkeypatch, parts, most):
    """Coarse brackets, ties, one row, nulls and a null key; keys sent to all tasks or joined."""
    monkeypatch.setattr(identity, "PARTS", parts)
    monkeypatch.setattr(identity, "MOST_KEYS", most)
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(size=997).tolist(), "ties": [1.0] * 400 + [2.0] * 3 + rng.normal(size=50).tolist(), "one": [5.0], "two": [1.0, 3.0], None: rng.integers(0, 5, 60).astype(float).tolist(), "ten": list(map(float, range(10)))}
    rows = [(k, v) for k, some in groups.items() for v in some] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: r for r in identity.distribution(df, ["k"], "x").collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        want = {"n": len(v), "mean": np.mean(v), "std": np.std(v), "min": min(v), "max": max(v), "p10": np.percentile(v, 10), "p15": np.percentile(v, 15), "p90": np.percentile(v, 90)}
        for name, x in want.items():
            assert got[k][name] == pytest.approx(x, abs=1e-12), (k, name)


def test_threshold_of_too_few_rows(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0])], "id long, person string, v array<double>")
    for rows in (df, df.limit(0)):
        got = identity.adaptive_threshold(rows, "person", "id", "v").first()
        assert (got.same_n, got.other_n, got.threshold, got.confidence) == (0, 0, None, "insufficient_samples")


def test_repeated_keys_raise_or_the_last_counts(spark):
    t = spark.createDataFrame([(1, "a", 0), (None, "x", 0), (None, "y", 0)], "k int, v string, at int")
    s = spark.createDataFrame([("1", "b", 1), ("1", "c", 2), ("2", "d", 1)], "k string, v string, at int")
    with pytest.raises(Exception, match="repeated key: 1"):
        records.upsert(t, s, "k").collect()
    found = {(r.k, r.v) for r in records.upsert(t, s, "k", "at").collect()}
    assert found == {("1", "c"), ("2", "d"), (None, "x"), (None, "y")}
    assert {(r.k, r.status) for r in records.change_log(t, s, "k", "at").collect()} == {("1", "changed"), ("2", "new")}


def test_history_of_the_last_turns(spark):
    m = spark.createDataFrame([("t", k, "user", str(k)) for k in range(5)], "thread string, turn int, role string, text string")
    got = {r.turn: [x.content for x in r.history] for r in records.history(m, "thread", "turn", "role", "text", last=2).collect()}
    assert got == {0: ["0"], 1: ["0", "1"], 2: ["1", "2"], 3: ["2", "3"], 4: ["3", "4"]}


def test_mock_turns_fill_a_long_track(spark):
    t = spark.createDataFrame([("long", 20000.0)], "k string, d double")
    last = audio.mock_segments(t, "k", "d").agg(F.max("end_time"), F.count("*")).first()
    assert last[0] > 19980 and last[1] > 2000
