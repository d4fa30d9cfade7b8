"""Large groups of equal vectors, in any order of rows and any number of blocks."""

import pytest

from chronovec.operators import identity


@pytest.mark.parametrize("rows", [4096, 7])
def test_ties_go_to_the_smallest_ids(spark, monkeypatch, rows):
    monkeypatch.setattr(identity, "BLOCK_ROWS", rows, raising=False)
    data = [(k, [0.3, 0.1 * (k % 2), 0.7]) for k in range(400)]
    df = spark.createDataFrame(data[::-1], "id long, v array<double>").coalesce(1)
    found = identity.top_similar(df.where("id in (0, 201)"), df, "id", "v", 5, 0.2).collect()
    got = {q: [r.s for r in sorted(found, key=lambda r: r["rank"]) if r.q == q] for q in (0, 201)}
    assert got == {0: [2, 4, 6, 8, 10], 201: [1, 3, 5, 7, 9]}
