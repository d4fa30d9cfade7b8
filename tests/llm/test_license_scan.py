"""The license scan against comparisons of every run of words with every place of every template."""

import itertools
import random

from pyspark.sql import functions as F

from chronovec.llm import license_scan, queries
from chronovec.llm.common import table


def same_as_plain(scanner, text, **how):
    n, places, spans, score = scanner.scan((text or "").encode())
    starts = [s for _, s in places]
    got = (n, len(places), min(starts, default=None), max(starts, default=None), sorted({scanner.labels[p] for p, _ in places}))
    *base, plain_spans, plain_score = license_scan.plain_licenses(text, **how)
    assert got == tuple(base), text
    assert abs(score - plain_score) < 1e-12, text
    # the spans that stay are disjoint, are among all, and no other disjoint choice covers more
    assert set(spans) <= set(plain_spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    best = lambda some: sum(s[2] for s in some)
    if len(plain_spans) <= 10:
        for k in range(len(plain_spans) + 1):
            for some in itertools.combinations(plain_spans, k):
                if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(some, 2)):
                    assert best(some) <= best(spans)


def test_scan_matches_brute_force(monkeypatch):
    rng = random.Random(4)
    letters = "a b c d".split()
    for trial in range(150):
        templates = [(f"t{k % 3}", " ".join(rng.choice(letters) for _ in range(rng.randint(3, 14)))) for k in range(rng.randint(1, 4))]
        phrases = {" ".join(rng.choice(letters) for _ in range(rng.randint(1, 3))): f"p{k}" for k in range(3)}
        how = dict(templates=templates, phrases=phrases, min_match=rng.choice([2, 3, 4]), gap=rng.choice([1, 3, 12]), cover=rng.choice([0.4, 0.7, 1.0]))
        monkeypatch.setattr(license_scan, "PIECE", rng.choice([3, 17, 1 << 20]))
        scanner = license_scan.Scanner(**how)
        for _ in range(4):
            text = " ".join(rng.choice([*letters, *letters, "x"]) for _ in range(rng.randint(0, 60)))
            if rng.random() < 0.5:
                t = rng.choice(templates)[1].split()
                t[rng.randrange(len(t))] = "x"
                text += " x " + " ".join(t)
            same_as_plain(scanner, text, **how)


def test_automaton_has_every_place():
    strings = [[1, 2, 1, 2, 3], [2, 1, 2], [3, 3, 3], [1, 2, 1, 2, 3]]
    a = license_scan.SuffixAutomaton(strings)
    for s, i, j in ((s, i, j) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)):
        at = 0
        for x in s[i:j]:
            at = a.next[at][x]
        run = s[i:j]
        assert sorted(a.ends[at]) == sorted((k, e - 1) for k, t in enumerate(strings) for e in range(len(run), len(t) + 1) if t[e - len(run) : e] == run)
    assert len(a.link) <= 2 * sum(map(len, strings)) + 1


def test_query_matches_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    df = queries.QUERIES["op11_licenses"](spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        n, n_base, first, last, base, spans, score = license_scan.plain_licenses(docs[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, n_base, first, last, ",".join(base))
        assert abs(r.score - score) < 1e-12 and set(base) <= set(filter(None, r.labels.split(","))) <= set(base) | {s[4] for s in spans}
    assert any(r.base_labels for r in rows)


def test_edited_templates_awkward_rows_and_kept_columns(spark):
    mit = license_scan.TEMPLATES[0][1]
    edited = mit.replace("free of charge", "without cost").replace("sublicense", "lend")
    lgpl = next(t for x, t in license_scan.TEMPLATES if x == "lgpl")
    texts = [None, "", "Apache  LICENSE apache license", "word " * 50 + edited + " word" * 50, lgpl, "Licensed under CC BY-NC 4.0.", "the license of the work is the work", "cc\nby é-by CC-BY"]
    df = spark.createDataFrame([(k, t, "n", k) for k, t in enumerate(texts)], "doc_id long, text string, spans string, _row int").repartition(3)
    found = license_scan.scan_licenses(df)
    assert set(found.columns) == {"doc_id", "text", "_row", *license_scan.RESULTS}
    rows = {r.doc_id: r for r in found.collect()}
    labels = lambda k: [s["label"] for s in rows[k].spans]
    assert (rows[0].n_words, rows[0].score, rows[0].first_word, rows[1].spans) == (0, 0.0, None, []) and rows[0]._row == 0
    assert (rows[2].n_base, rows[2].first_word, rows[2].last_word) == (2, 0, 2)
    assert labels(3) == ["mit"] and rows[3].n_base == 0 and 0.8 < rows[3].score < 1 and rows[3].spans[0]["start"] == 50
    assert labels(4) == ["lgpl"] and labels(5) == ["cc-by-nc"] and rows[5].base_labels == ["cc-by"]
    assert labels(6) == [] and rows[6].n_base == 0 and rows[7].n_base == 2 and rows[7].last_word == 4
    assert license_scan.scan_licenses(df.where(F.lit(False))).collect() == []


def test_a_text_of_several_megabytes(spark):
    """Dense matches throughout: time grows with the text, not with its square."""
    import time

    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES, 4, 12, 0.7)
    line = "licensed under cc by nc 4 0 of the work the mit license and "
    took = []
    for n in (20_000, 80_000):
        start = time.process_time()
        words, places, spans, score = scanner.scan((line * n).encode())
        took.append(time.process_time() - start)
        assert words == 14 * n and len(places) == 2 * n and len(spans) == n and score == 1.0
    assert took[1] < 10 * took[0] + 2
