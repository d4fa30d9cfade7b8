"""The filter audit against every order applied to every document."""

import random
from collections import Counter

from pyspark.sql import functions as F

from chronovec.llm import filter_audit


def texts(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = [None, "", " \t\x0b", "Ünïcode " * 250, "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, " wide space\u0085 " * 120, "|", "a#b", "x" * 200_000]
    for n in (1, 199, 200, 201, 400):
        out.append(" ".join(word() for _ in range(n)))
        out.append(" ".join(rng.choice(["same", "Words"]) for _ in range(n)))
        out.append(" ".join(word() for _ in range(n)) + " $5")
    return out


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_audit_matches_brute_force(spark):
    rng = random.Random(3)
    base = texts(rng)
    docs = [(rng.choice([None, *range(60)]), rng.choice(base), rng.choice([None, "", "en", "de", "größe"]), 7, 8) for _ in range(150)]
    docs += [(i, base[11], "en", 7, 8) for i in (-(2**63), 2**63 - 1, 5, 5)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for _ in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, mask int, first int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string")
    found = filter_audit.audit(df, marks)
    assert rows_of(found) == Counter(filter_audit.plain_audit([d[:3] for d in docs], [x[:3] for x in labels]))
    assert found.dtypes == [("part", "string"), ("filter_order", "string"), ("step", "int"), *[(c, "bigint") for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]]


def test_hot_copies_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT", 4)  # over a quarter of all rows: broadcast
    monkeypatch.setattr(filter_audit, "HELD", 3)  # more parts than a task holds
    docs = [(i, "same text" if i % 2 else f"text {i // 6}", f"part {i % 17}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    marks = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    assert rows_of(filter_audit.audit(df, marks)) == Counter(filter_audit.plain_audit(docs, [tuple(r) for r in marks.collect()]))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(df, marks).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    found = filter_audit.audit(one, marks)
    assert found.count() == 600 and found.agg(F.sum("removed")).first()[0] == 120 and found.select("part").distinct().first()[0] == ""


def test_table_of_first_failures():
    steps = filter_audit.first_failures()
    assert steps.shape == (32, 120) and not steps[0].any() and (steps[31] == 1).all()
    assert steps[0b00100, filter_audit.ORDERS.index("ABCDE")] == 3
