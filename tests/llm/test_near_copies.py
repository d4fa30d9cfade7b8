"""The pipeline's near-copy stage against planted copies and brute force."""

import random

import corpus_pipeline as p
import pytest

from chronovec.llm import near_copies as nc
from chronovec.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").lower().split()


def plain(text):
    w = words(text)
    k = min(5, len(w))
    return frozenset(tuple(w[n : n + k]) for n in range(len(w) - k + 1)) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept(spark, sf_dir, rows):
    docs = spark.createDataFrame([(d, t, "en", "x", len(t or "")) for d, t in rows], SCHEMA)
    return sorted(r.doc_id for r in p.near_duplicates(spark, docs, sf_dir).collect())


def edited(text, rng, changes):
    w = text.split()
    for k in rng.sample(range(len(w)), changes):
        w[k] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def test_planted_near_copies(spark, sf_dir):
    rng = random.Random(5)
    rows, expected = [], []
    for n in range(30):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
        near, far = edited(base, rng, 3), edited(base, rng, 20)
        assert jaccard(plain(base), plain(near)) >= 0.8 > 0.6 > jaccard(plain(base), plain(far))
        rows += [(3 * n, base), (3 * n + 1, near), (3 * n + 2, far)]
        expected += [3 * n, 3 * n + 2]
    assert kept(spark, sf_dir, rows) == expected


def test_group_larger_than_a_cell(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(nc, "CELL", 8)
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    rows = [(n, edited(base, rng, 3)) for n in range(40)]
    assert kept(spark, sf_dir, rows) == [0]


def test_shared_ids_empty_and_short_texts(spark, sf_dir):
    rng = random.Random(7)
    a, b = (" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(2))
    rows = [(3, a), (5, a), (5, b), (7, edited(b, rng, 2)), (8, ""), (9, None), (10, "One two"), (11, "one  two"), (12, "one two three"), (None, a)]
    docs = spark.createDataFrame([(d, t, "en", "x", 0) for d, t in rows], SCHEMA)
    found = sorted((r.doc_id is None, r.doc_id or 0) for r in p.near_duplicates(spark, docs, sf_dir).collect())
    assert found == [(False, 3), (False, 8), (False, 10), (False, 12), (True, 0)]


def test_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    sets = {d: plain(t) for d, t in sorted(rows)}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert kept(spark, sf_dir, rows) == sorted(d for d, r in root.items() if d == r)


@pytest.mark.parametrize("size", [1, 4, 5, 70000])
def test_shingles_are_whole(size):
    text = " ".join(f"w{k % 69999}" for k in range(size))
    assert len(nc.shingles(text)) == len(plain(text))
