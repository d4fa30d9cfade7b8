"""The prefix trie against every node compared with every conversation."""

import random
from collections import Counter

from pyspark.sql import functions as F

from chronovec.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string, n long, depth string"


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], KIND).repartition(parts)
    found = prefix_trie.prefix_trie(df)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, found.collect())) == Counter(prefix_trie.plain_trie(rows))


def test_trie_matches_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for c in [*range(70), *range(-25, 0, 3), 2**63 - 1, -(2**63), 400, 413]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, turn, rng.choice(["user", "user", None]), rng.choice(["a b", "a b", "c", None, "é x y"])))
        if rng.random() < 0.3:
            rows.append((c, rng.choice([None, 0, 1]), "", rng.choice(["tie", "a b"])))
    rows += [rows[k] for k in range(0, len(rows), 17)]  # repeated rows
    rows += [(None, 0, "user", "no conversation")] * 3
    check(spark, rows)


def test_chains_copies_and_a_long_conversation(spark):
    say = lambda d: ("user", f"turn {d} of all")
    rows = [(20 * c, d, *say(d)) for c in range(1, 14) for d in range(c)]  # each goes on from the one before: a chain of ends
    rows += [(20 * c, d, *say(d)) for c in range(20, 40) for d in range(6)]  # copies
    rows += [(4000, d, "user", f"line {d}") for d in range(500)]
    check(spark, rows)


def test_ranges_cut_a_conversation(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(0, d, "user", str(d % 3)) for d in range(400)] + [(1, 0, "user", "x"), (-1, 0, "user", "y")]
        df = spark.createDataFrame([(c, d) for c, d, *_ in rows], "k long, d long")
        got = prefix_trie.running(df, "k", ["d"], {"s": (F.sum("d"), "+"), "x": (F.bit_xor(F.xxhash64("d")), "^")}, "t")
        sums = {(r.k, r.d): r.s for r in got.collect()}
        assert all(s == d * (d + 1) // 2 for (_, d), s in sums.items()) and len(sums) == 402
        assert got.where("k = 0 and d = 399").first().x == df.where("k = 0").agg(F.bit_xor(F.xxhash64("d"))).first()[0]
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_empty_turnless_and_one_text_of_many_words(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], KIND)).collect() == []
    short = [(c, 0, "user", "only") for c in range(1, 20)]  # no head conversation: some lose their only turn
    check(spark, short)
    check(spark, [(0, None, None, None), (20, 0, "r", "w " * 500_000), (40, 0, "r", "w " * 500_000)])
