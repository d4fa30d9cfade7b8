"""Work that must not grow in one place with the tables."""

import tracemalloc
from collections import deque

import pytest

from chronovec.operators import audio
from chronovec.plans import catalog
from chronovec.sources import excel


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d6_zip_timelines", "d7_lag_correlation"])
def test_timelines_are_not_broadcast(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    df.collect()
    assert "Broadcast" not in plan(df)


def test_lags_of_gaps_copies_and_nulls(spark):
    """Against all pairs, across the ends of stretches."""
    end = audio.STRETCH
    a = [("u", t, float(t * t % 7)) for t in (0, 1, 3, 3, end - 1, end, end + 1, 3 * end)] + [("v", -1, 2.0), ("v", None, 1.0), (None, 0, 3.0)]
    b = [("u", t, float(t % 5)) for t in (0, 0, 2, 4, end - 2, end - 1, end + 2, 3 * end + 2)] + [("u", 1, None), ("v", 1, 4.0), ("v", None, 1.0), (None, 0, 1.0)]
    left, right = spark.createDataFrame(a, "k string, t long, a double"), spark.createDataFrame(b, "k string, t long, b double")
    want = {}
    for k, t, _ in a:
        for m, s, _ in b:
            if k is not None and k == m and t is not None and s is not None and abs(s - t) <= 2:
                want[k, s - t] = want.get((k, s - t), 0) + 1
    got = audio.lag_correlation(left, right, "t", "a", "b", 2, ("k",))
    assert {(r.k, r.lag): r.n for r in got.collect()} == want and dict(got.dtypes)["lag"] == "int"
    pairs = left.join(right.withColumnRenamed("t", "s"), "k").where("s - t = 2 and k = 'u'")
    assert got.where("lag = 2 and k = 'u'").first()["corr"] == pytest.approx(pairs.agg(audio.pearson("a", "b")).first()[0])


def test_a_sheet_is_written_and_read_row_by_row():
    """What is held does not grow with the rows, but for the packed file."""

    def held(n):
        tracemalloc.start()
        content = excel.workbook(["a", "b", "c"], ((k, f"name {k % 9}", None) for k in range(n)))
        deque(excel.rows_of(content), 0)
        peak = tracemalloc.get_traced_memory()[1] - 2 * len(content)
        tracemalloc.stop()
        return peak

    assert held(20_000) < 1.2 * held(5_000) + 200_000


def test_books_of_many_batches(spark):
    """Books that go on from one Arrow batch to the next, whole numbers beside nulls, a book without a name."""
    rows = [(f"b{k % 3}" if k % 4 else None, k, None if k % 5 == 0 else 10**17 + k) for k in range(400)]
    df = spark.createDataFrame(rows, "book string, k long, v long").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    try:
        books = excel.workbooks(df, "book").collect()
        assert sorted(r.book or "" for r in books) == ["", "b0", "b1", "b2"]
        for b in books:
            header, *got = excel.sheet_rows(bytes(b.content))
            assert header == ["k", "v"]
            assert sorted((int(r[0]), r[1] if len(r) > 1 else None) for r in got) == [(k, v and str(v)) for name, k, v in rows if name == b.book]
        assert sorted(int(r.k) for r in excel.parsed(excel.workbooks(df, "book"), ["k", "v"]).collect()) == list(range(400))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
