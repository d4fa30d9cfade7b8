"""State on live streams against the batch operators: files out of order, restarts, late and repeated rows, timers."""

import random

import pytest
from pyspark.sql import functions as F

from chronovec.operators import identity, records, stateful
from chronovec.plans import catalog
from chronovec.streaming import live
from chronovec.streaming import telemetry as streams


def grown(spark, df, operator, parts, path, key):
    """Files one after another, the stream started anew for each; then a last row far ahead."""
    found = None
    for n, part in enumerate([*parts, None]):
        some = df.where(part) if part else df.limit(1).select(*[F.lit(None).cast(t).alias(c) if c == key else F.lit(1e7).cast(t).alias(c) if c == "t" else F.col(c) for c, t in df.dtypes])
        some.coalesce(1).write.mode("append").parquet(f"{path}/in")
        s = operator(streams.read_stream(spark, f"{path}/in", 100))
        with live.rocks(spark):
            found = streams.finish(s, f"{path}/out")
        if n == 2:
            early = found.count()
    return found, early


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State is kept by partition, and each has a store to open."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(4)]
    out = []
    for k in range(120):
        v = [x + rng.gauss(0, 0.4) for x in rng.choice(base)]
        out.append((k % 3, float(k // 6), k, v, rng.uniform(0.2, 1.0), *[float(z) for z in (10 * (k % 2) + 30 * (k // 30), 0, 10 * (k % 2) + 30 * (k // 30) + 9, 9)]))
    return spark.createDataFrame(out, "k long, t double, id long, v array<double>, conf double, x1 double, y1 double, x2 double, y2 double").persist()


# each file starts before the last one has ended, by less than the bound
PARTS = ["id < 40 and id % 7 <> 3", "id < 40 and id % 7 = 3 or id between 40 and 70 and id % 2 = 1", "id between 40 and 70 and id % 2 = 0 or id > 90", "id between 71 and 90"]


@pytest.mark.parametrize("first", [False, True])
def test_identities(spark, vectors, tmp_path, first):
    found, early = grown(spark, vectors, lambda s: live.live_identities(s, "k", F.col("t"), "id", "v", 0.8, first, late="12 seconds"), PARTS, str(tmp_path), "k")
    batch = identity.online_ids(vectors.select("k", "t", "id", "v"), ["k"], ["t", "id"], "v", 0.8, first)
    assert rows(found, "key", "at", "id", "identity") == rows(batch, "k", "t", "id", "identity") and 0 < early < 120


def test_tracks(spark, vectors, tmp_path):
    found, early = grown(spark, vectors, lambda s: live.live_tracks(s, "k", F.col("t"), "id", "conf", 0.6, 0.2, 3, late="12 seconds"), PARTS, str(tmp_path), "k")
    batch = stateful.lifecycle_tracks(vectors, ["k"], "t", "id", "conf", 0.6, 0.2, 3)
    assert rows(found, "key", "at", "id", "track", "state", "hits") == rows(batch, "k", "t", "id", "track", "state", "hits") and early > 0
    assert batch.agg(F.max("track")).first()[0] > 3


@pytest.mark.parametrize("last", [None, 3])
def test_sessions(spark, vectors, tmp_path, last):
    m = vectors.select("k", "t", "id", F.when(F.col("id") % 2 == 0, "user").alias("role"), F.col("id").cast("string").alias("text"))
    found, early = grown(spark, m, lambda s: live.live_sessions(s, "k", F.col("t"), "id", "role", "text", last, late="12 seconds"), PARTS, str(tmp_path), "k")
    batch = records.history(m, "k", "id", "role", "text", last)
    assert rows(found, "key", "id", "history") == rows(batch, "k", "id", "history") and 0 < early < 120


def test_late_and_repeated_rows_and_time_to_live(spark, tmp_path):
    m = spark.createDataFrame([(1, 0.0, 0, "u", "a"), (1, 5.0, 1, "u", "b"), (1, 5.0, 1, "u", "b"), (2, 40.0, 2, "u", "x"), (1, 2.0, 3, "u", "late"), (1, 60.0, 4, "u", "anew"), (2, 61.0, 5, "u", "y"), (2, 200.0, 6, "u", "z")], "k long, t double, id long, role string, text string")
    # id 2 moves the watermark to 30, so id 3 is late; key 1 pauses for 55 s, key 2 for 21 s and then for more
    found, _ = grown(spark, m, lambda s: live.live_sessions(s, "k", F.col("t"), "id", "role", "text", late="10 seconds", ttl=20.0), ["id <= 1", "id = 2", "id = 3", "id in (4, 5)", "id = 6"], str(tmp_path), "k")
    got = {(r.key, r.id): [x.content for x in r.history] for r in found.collect()}
    assert got == {(1, 0): ["a"], (1, 1): ["a", "b"], (2, 2): ["x"], (1, 4): ["anew"], (2, 5): ["y"], (2, 6): ["z"]}


def test_registered_streams_equal_the_tables(spark, sf_dir):
    order = ["scene", "frame", "vec_id", "track", "state", "hits"]
    assert rows(catalog.QUERIES["n3_live_tracks"](spark, sf_dir), *order) == rows(catalog.QUERIES["n3_lifecycle_tracks"](spark, sf_dir), *order)
