"""Texts of several megabytes: whole results, in time that grows with the text."""

import random
import time

import pytest

from chronovec.llm import decontaminate, quality_knn, quality_rules, toxicity
from chronovec.llm.common import table


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    return " ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(600_000))


@pytest.mark.parametrize("name", ["decontaminate", "quality", "rules", "toxicity"])
def test_a_text_of_four_megabytes(spark, sf_dir, long_text, name):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    end = "one two three four five six seven eight nine ten"
    text = f"{long_text} {end}"
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    if name == "decontaminate":
        bench = spark.createDataFrame([("a", end)], "item_id string, text string")
        run = lambda d: decontaminate.contamination(d, bench)
    elif name == "quality":
        model = quality_knn.learn(docs, labels)
        run = lambda d: quality_knn.score(d, model)
    elif name == "rules":
        run = lambda d: quality_rules.judge(quality_rules.statistics(d), [[("n_words", "<", 3.0)]])
    else:
        model = toxicity.learn(docs, labels)
        run = lambda d: toxicity.score(d, model)
    start = time.monotonic()
    found = {r.doc_id: r for r in run(df).drop("text").collect()}
    took = time.monotonic() - start
    assert set(found) == {1, 2} and took < 120
    if name == "decontaminate":
        assert (found[1].n_hit, found[1].items, found[2].n_hit) == (10, ["a"], 0) and found[1].n_words == len(decontaminate.words(text))
    elif name == "rules":
        assert found[1].n_words == len(text.split()) and not found[1].base_failed
    else:
        assert 0 <= found[1].score <= 1
