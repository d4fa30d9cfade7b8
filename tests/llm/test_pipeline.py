"""The pipeline against its stages' own verdicts."""

from collections import Counter

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

from chronovec.llm import decontaminate, packing, pii, toxicity
from chronovec.llm.common import materialize, table


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output of each stage."""
    docs, out = materialize(table(spark, sf_dir, "documents"), "test"), []
    for name, f in p.STAGES:
        found = materialize(f(spark, docs, sf_dir), f"test-{name}")
        out.append((name, docs, found))
        docs = found
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stages):
    for _, docs, found in stages[:-1]:
        assert found.columns == list(p.COLUMNS) and found.dtypes == docs.select(*p.COLUMNS).dtypes


def first_of_each_group(rows):
    """Brute force: smallest ids of the groups that five-word Jaccard similarity of 0.8 or more makes."""
    sets = {}
    for d, text in rows:
        w = text.lower().split()
        size = min(5, len(w))
        sets[d] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return set(root.values())


def test_each_stage_takes_effect(spark, sf_dir, stages):
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, packed) = stages
    model = toxicity.learn(a, table(spark, sf_dir, "labels"))
    toxic = {r.doc_id for r in toxicity.score(a, model).where("score >= 0.5").collect()}
    assert toxic and ids(b) == ids(a) - toxic
    kept = first_of_each_group([(r.doc_id, r.text) for r in b.collect()])
    assert ids(c) == kept and len(kept) < b.count()
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    leaked = {r.doc_id for r in c.collect() if decontaminate.plain_contamination(r.text, items)[1]}
    assert leaked and ids(d) == ids(c) - leaked
    before = {r.doc_id: r.text for r in d.collect()}
    changed = 0
    for r in e.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        changed += r.text != before[r.doc_id]
    assert changed and ids(e) == ids(d)
    assert ids(packed) == ids(e)


def test_run_equals_the_stages(spark, sf_dir, stages):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    key = lambda df: Counter(tuple(r) for r in df.select(*cols).collect())
    assert key(p.run(spark, sf_dir)) == key(stages[-1][2])


def test_empty_and_null_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "x", "y", 0)], schema)
    for _, f in p.STAGES:
        assert f(spark, empty, sf_dir).count() == 0
        assert f(spark, nulls, sf_dir).count() >= 1
    assert packing.pack(nulls).agg(F.sum("length")).first()[0] == 3
