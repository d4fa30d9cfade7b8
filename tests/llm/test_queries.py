"""The registered queries as they are, against brute force over their whole tables; clashing names and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronovec.llm import packing, pii, quality_knn, quality_rules, queries, simhash, substring_dedup, toxicity
from chronovec.llm.common import table


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


def rows(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    return df.dtypes, df.collect()


def test_op2(spark, sf_dir, documents):
    types, found = rows(spark, sf_dir, "op2_substring_dedup")
    assert types == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert Counter(map(tuple, found)) == Counter(substring_dedup.plain_dedup(documents))


def test_op6(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    types, found = rows(spark, sf_dir, "op6_packing")
    assert types == [("doc_id", "bigint"), ("piece", "int"), *[(n, "bigint") for n in ("start", "length", "ids_crc32", "sequence_id", "offset")]]
    encoder, expected = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for i, t in documents:
        a = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for n, lo in enumerate(range(0, len(a), 4096)):
            expected[(i, n, lo, len(a[lo : lo + 4096]), zlib.crc32(a[lo : lo + 4096].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in found) == expected
    places = sorted((r.sequence_id, r.offset, r.length) for r in found)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:]):
        assert o + n == o2 if s == s2 else o + n <= 4096 and o2 == 0


def plain_pii(field, text):
    """The labels of all tokens in one piece, and every pair of spans compared."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    base = pii.base_spans(text)
    tokens = [text[a:b] for a, b in words]
    out, n = list(base), len(pii.LABELS)
    if tokens:
        score = []
        for k, w in enumerate(tokens):
            names = pii.features(w, tokens[k - 1] if k else "", tokens[k + 1] if k + 1 < len(tokens) else "")
            own = [sum(field.weights[field.index[f]][x] for f in names if f in field.index) for x in range(n)]
            score.append(own if re.search("[0-9@]", w) else [0.0] + [-math.inf] * (n - 1))
        best, back = [field.pairs[0][x] + score[0][x] for x in range(n)], []
        for k in range(1, len(tokens)):
            step = [max(range(n), key=lambda a, x=x: best[a] + field.pairs[a][x]) for x in range(n)]
            best, _ = [best[a] + field.pairs[a][x] + score[k][x] for x, a in enumerate(step)], back.append(step)
        at = max(range(n), key=lambda x: best[x] + field.pairs[x][0])
        path = [at]
        for step in reversed(back):
            path.append(step[path[-1]])
        path, k = [pii.LABELS[x] for x in reversed(path)], 0
        while k < len(path):
            stop = k + 1
            if path[k][0] == "B":
                while stop < len(path) and path[stop] == "I" + path[k][1:]:
                    stop += 1
                span = text[words[k][0] : words[stop - 1][1]]
                lo = words[k][0] + len(span) - len(span.lstrip(".,;:!?\"'<>[]{}="))
                hi = words[stop - 1][1] - (len(span) - len(span.rstrip(".,;:!?\"'<>[]{}=")))
                if lo < hi and pii._holds(path[k][2:], text[lo:hi]) and not any(a < hi and lo < b for _, a, b in base):
                    out.append((path[k][2:], lo, hi))
            k = stop
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(out, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2])))


def test_op7(spark, sf_dir, documents):
    _, found = rows(spark, sf_dir, "op7_pii")
    field = pii.train([(list(r.tokens), list(r.labels)) for r in pii.training_table(spark).orderBy(F.xxhash64("tokens", "labels")).collect()])
    assert Counter((r.doc_id, r.base_sha256) for r in found) == Counter((i, pii.plain_base_digest(t)) for i, t in documents)
    assert Counter((r.doc_id, r.spans) for r in found) == Counter((i, plain_pii(field, t or "")) for i, t in documents)
    for r in found:
        kinds = Counter(x.split(":")[0] for x in r.spans.split(",") if x)
        assert all(kinds[k] >= r[f"n_{k}"] for k in pii.KINDS)


def test_op7_long_tokens_and_far_neighbours(spark):
    field = pii.train(pii.training_rows())
    texts = [
        "see " + "b" * 90 + "@localhost now", "x" * 60 + " (303) 555-0188 " + "y" * 60 + " 4.5", "a  " + " " * 70 + "(303) 555-0188" + "\n" * 70 + "call", "9" * 300 + "@x " * 3,
        " ".join(f"u{k}@h{k} 1.2.3.{k} (303) 555-{1000 + k} word" for k in range(60)), "(303) 555-0188 Mail",
    ]
    got = [",".join(f"{k}:{a}:{b}" for k, a, b in full) for _, full in pii.all_spans(field, texts)]
    assert got == [plain_pii(field, t) for t in texts]


def test_op8(spark, sf_dir, documents):
    _, found = rows(spark, sf_dir, "op8_simhash")
    prints = {i: simhash.fingerprint(t) for i, t in documents}
    root = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if a < b and root[a] != root[b] and (prints[a] ^ prints[b]).bit_count() <= 3:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert Counter(map(tuple, found)) == Counter((i, f"{prints[i]:016x}", root[i]) for i in prints)


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_op5(spark, sf_dir, documents):
    """One text and one labelled vector at a time."""
    _, found = rows(spark, sf_dir, "op5_quality")
    model = quality_knn.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    assert len(model["labels"]) == table(spark, sf_dir, "labels").where("quality in (0, 1)").select("doc_id").distinct().count() - sum(held(r.doc_id) for r in table(spark, sf_dir, "labels").select("doc_id").distinct().collect())
    score = {}
    for i, t in documents:
        x = np.zeros(len(model["idf"]))
        for k, v in quality_knn.vector(quality_knn.terms(t)).items():
            x[k] = math.log1p(v) * model["idf"][k]
        z = x @ model["space"].astype(float)
        z = z / max(np.linalg.norm(z), 1e-9)
        near = sorted(((float(z @ v), float(y)) for v, y in zip(model["labelled"].astype(float), model["labels"])), reverse=True)[: quality_knn.NEIGHBOURS]
        weights = [max(s, 1e-6) ** 8 for s, _ in near]
        score[i] = sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)
    off = [r for r in found if abs(r.score - score[r.doc_id]) > 1e-3]
    assert len(off) <= len(found) // 50  # near ties at the last neighbour
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.3) for r in found) and len(found) == len(documents)


def test_op10(spark, sf_dir, documents):
    _, found = rows(spark, sf_dir, "op10_toxicity")
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    for r, text in [(r, dict(documents)[r.doc_id]) for r in found]:
        total = model["bias"]
        count: dict[str, int] = {}
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            for f in {w, *(w[:n] + "*" for n in range(3, 9) if n <= len(w))}:
                count[f] = count.get(f, 0) + 1
        for f, n in count.items():
            if f in model["known"]:
                total += model["weights"][model["known"][f]] * math.log1p(n)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-3)
        assert r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.5)
    assert len(found) == len(documents)


def test_op10_gradient():
    """The fit's minimum by the plain objective: no single weight can be moved to better it."""
    rng = np.random.default_rng(4)
    x = (rng.random((120, 5)) < 0.4).astype(np.float32)
    y = ((x[:, 0] + 0.3 * rng.random(120)) > 0.6).astype(np.float32)
    swapped = [([(1, -0.7), (2, 0.7)], 3), ([(2, 0.4), (3, -0.4)], 1), ([(4, 1.0)], 2)]

    def objective(w, b):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
        return loss + 0.0001 / 20 * (w @ w) + 0.0001 * np.abs(w).sum() + 5.0 * sum(n * sum(d * w[k] for k, d in c) ** 2 for c, n in swapped) / 6

    w, b = toxicity.fit(x, y, swapped, rounds=4000)
    w, least = w.astype(float), objective(w.astype(float), b)
    for k in range(5):
        for d in (-0.3, 0.3):
            assert objective(w + d * (np.arange(5) == k), b) > least - 1e-3


def test_swaps_against_whole_sentences():
    known = {f: k for k, f in enumerate(sorted({f for g in toxicity.IDENTITY_TERMS[:2] for t in g for f in toxicity.parts(t)} | {"live", "wom*"}))}
    own = toxicity.Features(known)
    text = "Women live with women here. No term. The muslim man, men live!"
    got = Counter(map(tuple, toxicity.swaps(text, own)))
    expected: Counter = Counter()
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        words = re.findall(r"[^\W\d_]+", sentence)
        for term in dict.fromkeys(words):
            for group in [g for g in toxicity.IDENTITY_TERMS if term in g]:
                for other in group:
                    if other != term:
                        before, after = own.counts(Counter(words)), own.counts(Counter(other if w == term else w for w in words))
                        change = {k: round(math.log1p(after.get(k, 0)) - math.log1p(before.get(k, 0)), 6) for k in before.keys() | after.keys()}
                        expected[tuple(sorted((k, d) for k, d in change.items() if d))] += 1
    assert set(got) == set(expected)


def test_op9(spark, sf_dir, documents):
    _, found = rows(spark, sf_dir, "op9_quality_rules")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn_list(quality_rules.sample(docs, table(spark, sf_dir, "labels")))
    assert rules
    texts = dict(documents)

    def features(t):
        n, chars, symbols, dup, again = quality_rules.plain_statistics(t)
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        count = lambda cs: sum(c in cs for c in t)
        per = lambda a, b: a / max(b, 1)
        return {
            "n_words": n, "symbols_per_word": per(symbols, n), "marks_per_word": per(count("!?"), n), "stops_per_word": per(count(".,;:"), n), "upper_share": per(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars),
            "digit_share": per(count("0123456789"), chars), "dup_line_share": per(dup, len(lines)), "repeat_share": per(again, n), "distinct_share": per(len(set(w)), n), "word_length": per(chars, n), "words_per_line": per(n, len(lines)),
        }

    for r in found:
        own = features(texts[r.doc_id] or "")
        bad = any(all(own[n] >= cut if op == ">=" else own[n] < cut for n, op, cut in rule) for rule in rules)
        assert tuple(r)[:6] == (r.doc_id, *quality_rules.plain_statistics(texts[r.doc_id])) and r.kept == (not r.base_failed and not bad)


CLASHES = ["spans", "rules", "_perhaps", "gram", "pii", "base_pii", "redacted", "score", "n_words", "kept", "base_failed", "_w", "_l", "_id", "y", "fp", "rep", "root", "node", "k", "bits", "h", "g", "bands", "piece", "length", "rank", "task", "block", "value", "_row", "_text", "_hit", "n_hit", "items", "have_0", "_word", "_bits"]


@pytest.mark.parametrize("toxic, expected", [(27, 28 / 30), (0, 1 / 30)])
def test_toxicity_of_one_class(spark, toxic, expected):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:27]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(toxic))) for i in ids], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert all(abs(r.score - expected) < 1e-9 for r in toxicity.score(docs, model).collect())
    none = toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).first().score
    assert abs(none - 1 / 3) < 1e-9


def test_clashing_names_empty_tables_and_nulls(spark, sf_dir):
    """Columns named like what operators use inside change nothing."""
    import corpus_pipeline as p
    from chronovec.llm import decontaminate, near_copies, secrets

    texts = [(1, "token=abcdef123 call +1 269 555 3296"), (2, None), (None, "x"), (2, ""), (3, "a b c " * 40), (3, "a b c " * 40)]
    plain = spark.createDataFrame([(i, t, "l", "s", None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    clash = plain.select("*", *[F.lit(f"{c}?").alias(c) for c in CLASHES])
    labels = table(spark, sf_dir, "labels")
    toxic = toxicity.learn(table(spark, sf_dir, "documents"), labels)
    quality = quality_knn.learn(table(spark, sf_dir, "documents"), labels)
    bench = table(spark, sf_dir, "benchmark")
    operators = {
        "secrets": secrets.scan, "dedup": substring_dedup.dedup_substrings, "decontaminate": lambda d: decontaminate.contamination(d, bench, keep=[c for c in d.columns if c not in ("doc_id", "text")]),
        "quality": lambda d: quality_knn.score(d, quality), "pack": packing.pack, "pii": pii.find_pii, "simhash": simhash.near_duplicates, "near": near_copies.near_copies,
        "rules": lambda d: quality_rules.judge(d, [[("n_words", "<", 3.0)]]), "toxicity": lambda d: toxicity.score(d, toxic),
    }
    for name, f in operators.items():
        want = f(plain)
        got = f(clash)
        assert Counter(map(str, got.select(*want.columns).collect())) == Counter(map(str, want.collect())), name
        assert f(clash.limit(0)).count() == 0, name
        if name in ("quality", "rules", "toxicity", "decontaminate"):
            assert set(CLASHES) - set(want.columns) <= set(got.columns), name  # those that keep other columns keep them all
        for c in set(got.columns) & set(CLASHES) - set(want.columns):
            assert {r[0] for r in got.select(c).collect()} == {f"{c}?"}, (name, c)
    for name, stage in p.STAGES:
        assert stage(spark, clash, sf_dir).count() == stage(spark, plain, sf_dir).count(), name
