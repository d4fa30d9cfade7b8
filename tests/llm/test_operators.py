"""Each training-data operator against brute force, round trips or held-out labels, on small awkward tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from chronovec.llm import decontaminate, graph, packing, pii, quality_knn, quality_rules, queries, secrets, simhash, substring_dedup, toxicity, warc

AWKWARD = [
    None, "", " ", "\n\n", "one", "the same words again and again the same words again", "x" * 3000, "a b " * 900, "é ü ñ 😀   end", "tab\tand\x0bvertical\x0cfeed\r\n",
    "ABC abc ABC", "<|endoftext|> token=abcdef", "1.2.3.4 and 999.1.1.1", "no\nno\nno\nyes",
]


def table(spark, texts, parts=3, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "l", "s", None if t is None else len(t), "clash", 7) for i, t in zip(ids, texts)]
    # rank, key, fp, hit and so on also name columns that the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank string, fp int").repartition(parts)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["the", "of", "and", "to", "in", "is", "that", "ering", "thion", "ándo", "bleth", "ouha"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    base = [text(rng.randint(5, 120)) for _ in range(40)]
    texts = AWKWARD + base + base[:6]
    for t in base[:20]:
        cut = t.split()
        cut[len(cut) // 2] = "CHANGED"
        texts.append(" ".join(cut))
        texts.append(text(20) + " " + t + " " + text(20))
    return texts


def ids_with_gaps(n):
    """Descending ids, a null and a repeated one."""
    ids = [3 * k for k in range(n)][::-1]
    ids[n // 2], ids[n // 3] = None, ids[n // 3 + 1]
    return ids


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), duck.execute(queries.ORACLE_SQL[name]))


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


# ---- 1 ----


def test_secrets(spark):
    rng = random.Random(1)
    bits = ["password", "=", ":", " ", '"', "'", "secret", "TOKEN", "api_key", "AKIA", "ABCDEFGH12345678", "deadbeef0123456789abcdef", "é😀", "x", "\n", "abcde", "abcdef", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----"]
    texts = AWKWARD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["token=abcdefgh " * 1000]
    ids = ids_with_gaps(len(texts))
    df = table(spark, texts, ids=ids)
    got = Counter((r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans)) for r in secrets.scan(df).collect())
    assert got == Counter((i, secrets.plain_spans(t)) for i, t in zip(ids, texts))
    assert secrets.scan(spark.createDataFrame([], EMPTY)).count() == 0


def any_match(nodes, rng):
    """A random string that the parsed pattern matches."""
    import re._parser as regex

    out = []
    for op, arg in nodes:
        if op is regex.LITERAL:
            out.append(rng.choice([chr(arg), chr(arg).upper()]) if arg in range(97, 123) and rng.any_case else chr(arg))
        elif op is regex.IN:
            kind, value = rng.choice(arg)
            out.append(chr(value if kind is regex.LITERAL else rng.randint(*value)))
        elif op is regex.SUBPATTERN:
            out.append(any_match(arg[-1], rng))
        elif op is regex.BRANCH:
            out.append(any_match(rng.choice(arg[1]), rng))
        else:
            least, most, inner = arg
            out += [any_match(inner, rng) for _ in range(rng.randint(least, min(int(most), least + 5)))]
    return "".join(out)


MORE_RULES = (
    secrets.Rule("a", r"sk_(live|test)_[0-9a-zA-Z]{24}"), secrets.Rule("b", r"(ab|cd)+efg?h[0-9]*xyz"), secrets.Rule("c", r"AIza[0-9A-Za-z_-]{35}"),
    secrets.Rule("d", r"a?b?c?d?e?fgh"), secrets.Rule("e", r"[ab][cd][ef][gh][ij]x"), secrets.Rule("f", r"(xy|[0-9]{3,})q"), secrets.Rule("g", r"(abc|abd|xbc)(efg)?tail"),
)


def test_trigram_queries_hold_in_every_match():
    import re
    import re._parser as regex

    rng = random.Random(11)
    for rule in (*secrets.RULES, *MORE_RULES):
        query = secrets.trigram_query(rule)
        assert all(clause and all(len(g) == 3 for g in clause) for clause in query)
        rng.any_case = "(?i" in rule.pattern
        for _ in range(300):
            found = any_match(regex.parse(rule.pattern), rng)
            assert re.search(rule.pattern, found)
            assert not query or any(all(g in found.lower() for g in clause) for clause in query)
    assert secrets.trigram_query(secrets.RULES[2]) == [] and secrets.trigram_query(MORE_RULES[5]) == []
    assert secrets.trigram_query(secrets.RULES[1]) == [["aki", "kia"]]
    assert [["ken", "oke", "tok"]] == [c for c in secrets.trigram_query(secrets.RULES[0]) if "tok" in c]


def test_secrets_of_many_rules(spark):
    rng = random.Random(12)
    import re._parser as regex

    rng.any_case = False
    rules = (*secrets.RULES, *MORE_RULES)
    texts = [" ".join(any_match(regex.parse(rng.choice(rules).pattern), rng) for _ in range(rng.randint(0, 4))) for _ in range(200)]
    got = Counter((r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans)) for r in secrets.scan(table(spark, texts), rules).collect())
    assert got == Counter((i, secrets.plain_spans(t, rules)) for i, t in enumerate(texts))


# ---- 2 ----


def test_substring_dedup(spark, corpus):
    ids = ids_with_gaps(len(corpus))
    texts = [*corpus, "ab" * 700, "xab" * 700, "y" * 49, "y" * 50, "y" * 51]
    ids += [1, 5, 7, 8, 9]
    df = table(spark, texts, ids=ids)
    got = Counter(tuple(r)[:5] for r in substring_dedup.dedup_substrings(df).collect())
    assert got == Counter(substring_dedup.plain_dedup(list(zip(ids, texts))))
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], EMPTY)).count() == 0


def test_substring_dedup_with_hot_minimizers_and_small_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    monkeypatch.setattr(substring_dedup, "RUN", 7)
    monkeypatch.setattr(substring_dedup, "BLOCK", 2000)
    ids = ids_with_gaps(len(corpus))
    got = Counter(tuple(r)[:5] for r in substring_dedup.dedup_substrings(table(spark, corpus, ids=ids), with_text=True).collect())
    assert got == Counter(substring_dedup.plain_dedup(list(zip(ids, corpus))))


@pytest.mark.parametrize("hot", [3, 5000])
def test_substring_dedup_with_blocks_combined_in_parts(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "FAN", 3)
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BLOCK", 1500)
    ids = ids_with_gaps(len(corpus))
    got = Counter(tuple(r)[:5] for r in substring_dedup.dedup_substrings(table(spark, corpus, ids=ids)).collect())
    assert got == Counter(substring_dedup.plain_dedup(list(zip(ids, corpus))))


@pytest.mark.parametrize("fan", [2, 4096])
def test_substring_dedup_with_the_smallest_and_largest_ids(spark, corpus, monkeypatch, fan):
    """Segments that differ and segments that do not, of documents at both ends of the range."""
    monkeypatch.setattr(substring_dedup, "FAN", fan)
    monkeypatch.setattr(substring_dedup, "BLOCK", 900)
    ids = [-(2**63), 2**63 - 1, -(2**63) + 1, 0, None, 2**63 - 2, -(2**63)]
    shared = "a passage of well over fifty bytes that the documents of this test have in common"
    texts = [shared, "x" + shared + corpus[20], corpus[20] + shared[:60], shared + " and more of it " + shared, shared, shared[20:] + corpus[20], corpus[20]]
    for order in (list(range(7)), list(range(7))[::-1]):
        some = [ids[k] for k in order]
        df = table(spark, texts, ids=some)
        got = Counter(tuple(r)[:5] for r in substring_dedup.dedup_substrings(df).collect())
        assert got == Counter(substring_dedup.plain_dedup(list(zip(some, texts))))


@pytest.mark.parametrize("length", [7, 12, 50])
def test_interval_expansion(length):
    rng = random.Random(2)
    segs = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 90))) for _ in range(30)]
    segs += [segs[0][3:60] + b"zz", segs[1][:55] + segs[2][:52]]
    low = np.arange(len(segs))[::-1].copy()
    best = {}
    for s, v in zip(segs, low):
        for k in range(len(s) - length + 1):
            best[s[k : k + length]] = min(best.get(s[k : k + length], 10**9), v)
    for s, m in zip(segs, substring_dedup.window_minima(segs, low, length)):
        assert m.tolist() == [best[s[k : k + length]] for k in range(len(s) - length + 1)]


# ---- 3 ----


def test_warc_round_trip(spark, monkeypatch):
    rng = random.Random(3)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    makers = [lambda: None, lambda: "", lambda: fake * rng.randint(1, 3), lambda: "x" * rng.randint(0, 300) + "WARC/1.1\r\nfoo", lambda: "é" * rng.choice([10, 60, 200]), lambda: "WARC/1.1\r\n" * rng.randint(1, 4)]
    urls = [None, "u\r\n1", "http://a/WARC/1.", "http://a/WARC/1.0", "WARC/1.1WARC/1.1\r\nContent-Length: 3\r\n\r\n", "é" * 40 + "WARC/1.0"]
    rows = [(i if i % 29 else None, rng.choice(urls), rng.choice(makers)()) for i in range(150)]
    rows += [(500, "u", "y" * 200), (500, "u", "y" * 200), (501, "u", "y" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first, expected = {}, Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(first.get(b, p), p)
    for p, _, h in rows:
        b = (h or "").encode()
        again = b in first and p is not None and p > first[b]
        expected[(p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None)] += 1
    assert got == expected
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_archives_of_others(spark, tmp_path, split):
    """Both versions, other ids, magic in payloads, several files and splits."""
    rng = random.Random(13)
    expected = Counter()
    for f in range(3):
        out = b""
        for k in range(40):
            body = rng.choice([b"", b"x" * 300, b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3, b"WARC/1.", b"\r\n\r\nWARC/1.1\r\n"])
            kind, name = rng.choice(["response", "request", "warcinfo"]), f"<urn:uuid:{f}-{k}>"
            fields = [f"WARC-Type: {kind}", f"warc-record-id: {name}", f"Content-Length: {len(body)}"]
            for odd in ("http://a/WARC/1.", "WARC/1.0", "WARC/1.1 WARC/1.0", "x" * 200 + "WARC/1."):
                if rng.random() < 0.25:  # magic in a field, at its end or inside
                    fields.insert(rng.randint(0, len(fields)), f"WARC-Target-URI: {odd}{rng.choice(['', '?q'])}")
            rng.shuffle(fields)
            out += f"WARC/1.{rng.randint(0, 1)}\r\n".encode() + "\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
            expected[(name.strip("<>"), kind, len(body), hashlib.sha256(body).hexdigest())] += 1
        (tmp_path / f"{f}.warc").write_bytes(out)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = Counter((r.record_id, r.type, r.payload_bytes, r.sha) for r in warc.read_archives(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == expected


def test_damaged_archives_raise(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    for n, data in enumerate((record * 3 + b"left over", record + record[:-3], record * 2 + record.replace(b": 4", b": 900"), b"xx" + record, record + record.replace(b"Content-Length: 4\r\n", b""))):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "a.warc").write_bytes(data)
        (tmp_path / str(n) / "b.warc").write_bytes(record)
        with pytest.raises(ValueError, match="1 archives"):
            warc.read_archives(spark, str(tmp_path / str(n)))
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.warc").write_bytes(record * 2)
    (tmp_path / "good" / "empty.warc").write_bytes(b"")
    assert warc.read_archives(spark, str(tmp_path / "good")).count() == 2


# ---- 4 ----


def test_decontamination(spark, corpus, monkeypatch):
    items = [(1, corpus[20]), (2, "the of and"), (3, None), (4, ""), (None, "one"), (5, " ".join(corpus[25].split()[:11])), (2, "bleth")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    ids = ids_with_gaps(len(corpus))
    expected = Counter((i, *decontaminate.plain_contamination(t, items)) for i, t in zip(ids, corpus))

    def run():
        found = decontaminate.contamination(table(spark, corpus, ids=ids), bench)
        return Counter(tuple(r) for r in found.select("doc_id", "n_words", "n_hit", decontaminate._digest(F.col("items"))).collect())

    assert run() == expected
    monkeypatch.setattr(decontaminate, "BLOCK_PAIRS", 20)  # several blocks of windows
    assert run() == expected
    assert decontaminate.contamination(spark.createDataFrame([], EMPTY), bench).count() == 0
    clash = table(spark, corpus[:9]).withColumn("_hit", F.lit(1)).withColumn("_row", F.lit("x")).withColumn("n_hit", F.lit(-1)).withColumn("_text", F.lit(2))
    found = decontaminate.contamination(clash, bench, keep=["_hit", "n_hit", "_row", "_text", "rank"])
    assert found.columns == ["doc_id", "text", "_hit", "_row", "_text", "rank", "n_words", "n_hit", "items"]
    assert {(r._hit, r._row, r._text, r.rank) for r in found.collect()} == {(1, "x", 2, "clash")} and found.where("n_hit < 0").count() == 0
    assert decontaminate.contamination(table(spark, corpus), bench.limit(0)).where("n_hit > 0").count() == 0


# ---- 5, 10 ----


def labelled(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", "and", "to", "house", "river", "green", "slowly", "walks", "under"]
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(words) + str(rng.randint(0, 99)) * (rng.random() < 0.3) for _ in range(rng.randint(30, 120))]
        toxic, bad = k % 7 == 0, k % 5 == 1
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vilex", "vilor", "grumoid"])
        text = " ".join(w)
        if bad:
            text = " ".join(x + rng.choice(["$$$", "***", "&&&"]) for x in w)
        rows.append((k, text))
        labels.append((k, 0 if bad else 1, int(toxic)))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled_tables(spark):
    rows, labels = labelled(600, 4)
    docs = spark.createDataFrame([*rows, (None, "vilex"), (900, None), (901, ""), (5, rows[5][1])], "doc_id long, text string")
    return docs.repartition(3), spark.createDataFrame([*labels, (None, 1, 1), (4000, None, None)], "doc_id long, quality int, toxic int"), labels


def test_quality_votes(spark, labelled_tables):
    docs, lab, labels = labelled_tables
    got = {r.doc_id: r.score for r in quality_knn.score(docs, quality_knn.learn(docs, lab)).collect()}
    out = [(got[i] >= 0.3) == bool(q) for i, q, _ in labels if held(i)]
    assert sum(out) / len(out) > 0.97 and all(0 <= s <= 1 for s in got.values())
    assert got[900] == got[901]
    none = quality_knn.learn(docs, lab.limit(0))
    assert {r.score for r in quality_knn.score(docs, none).collect()} == {0.5}


def test_votes_are_exact():
    rng = np.random.default_rng(6)
    rows = [(list(range(8)), list(rng.random(8) * 9), int(k % 3 > 0)) for k in range(60)]
    model = quality_knn.fit(rows, dims=16, rank=4)
    x = np.zeros((5, 16), np.float32)
    x[:, :8] = np.log1p(rng.random((5, 8)) * 9)
    x *= model["idf"]
    for block in (1, 2, 256):
        got = quality_knn.vote(x, model, 7, block)
        z = x @ model["space"]
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        for n, s in enumerate(z @ model["labelled"].T):
            near = np.argsort(-s)[:7]
            w = np.maximum(s[near], 1e-6) ** 8
            assert got[n] == pytest.approx((w * model["labels"][near]).sum() / w.sum(), rel=1e-4)


def test_toxicity(spark, labelled_tables):
    docs, lab, labels = labelled_tables
    model = toxicity.learn(docs, lab)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    out = [(got[i] >= 0.5) == bool(t) for i, _, t in labels if held(i)]
    assert sum(out) / len(out) > 0.97 and got[901] < 0.5 and got[900] < 0.5
    for group in toxicity.IDENTITY_TERMS:
        own = toxicity.Features(model["known"])
        scores = [toxicity.score_text(f"the {t} walks under the river", own, model["weights"], model["bias"]) for t in group]
        assert max(scores) - min(scores) < 0.02 and max(scores) < 0.5
    flat = toxicity.learn(docs, lab.where("toxic = 0"))
    assert all(s < 0.5 for s in (r.score for r in toxicity.score(docs, flat).collect()))


def test_swap_penalty_holds_scores_together():
    rng = np.random.default_rng(7)
    x = np.zeros((200, 3), np.float32)
    y = (rng.random(200) < 0.5).astype(np.float32)
    x[:, 0] = y  # abuse
    x[:, 1] = (rng.random(200) < 0.2 + 0.6 * y)  # a group term that co-occurs with it
    x[:, 2] = (rng.random(200) < 0.3)
    swapped = [([(1, -1.0), (2, 1.0)], 50)]
    fair, _ = toxicity.fit(x, y, swapped, fairness=5.0)
    free, _ = toxicity.fit(x, y, swapped[:0], fairness=0.0)
    assert abs(fair[1] - fair[2]) < 0.25 * abs(free[1] - free[2]) and fair[0] > 1


# ---- 6 ----


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    texts = [*corpus, "the of and " * 3000, "word " * 4095]
    ids = ids_with_gaps(len(texts))
    rows = packing.pack(table(spark, texts, ids=ids)).collect()
    encoder = Tokenizer.from_file(packing.default_tokenizer())
    expected = Counter()
    for i, t in zip(ids, texts):
        a = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for n, lo in enumerate(range(0, len(a), 4096)):
            expected[(i, n, lo, len(a[lo : lo + 4096]), zlib.crc32(a[lo : lo + 4096].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 4096) + 1
    assert packing.pack(spark.createDataFrame([], EMPTY)).count() == 0


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(8)
    alphabet = [*"क़ñaBcdE eé'  .,\n.,;!…sStTlL9\tß<|>İΣ́ \x1c\x0b", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", " 's", "'ll "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    encoder = Tokenizer.from_file(packing.default_tokenizer())
    for t, ids in zip(texts, packing.WordIds(packing.default_tokenizer()).ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.encode(t, add_special_tokens=False).ids


def test_word_ids_without_spaces_and_with_a_small_memory(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    monkeypatch.setattr(packing, "CACHE_BYTES", 4000)
    monkeypatch.setattr(packing, "CUT", 50)
    monkeypatch.setattr(packing, "CACHE_TEXT", 500)
    texts = ["".join(rng.choice("abcXYZ0123456789+/=é中文。,'sΣ́") for _ in range(rng.randint(0, 2000))) for _ in range(100)]
    texts += [" ".join("".join(rng.choice("abcdefgh.,") for _ in range(rng.randint(1, 9))) for _ in range(200)) for _ in range(50)]
    encoder, words = Tokenizer.from_file(packing.default_tokenizer()), packing.WordIds(packing.default_tokenizer())
    words.known.clear(), words.older.clear()
    words.kept["size"] = 0
    for t, ids in zip(texts, words.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.encode(t, add_special_tokens=False).ids
    assert max(map(len, [*words.known, *words.older])) <= packing.LONG and len(words.known) + len(words.older) < 1000


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6, 1, 4000).astype(int), 1, 4096)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.round_plan(counts, packing.solve(counts, rounds=200))
    used = Counter()
    for held_, times in plan:
        assert sum(k * v for k, v in held_.items()) <= 4096 and times > 0
        for k, v in held_.items():
            used[k] += v * times
    assert used == Counter(counts)
    assert sum(t for _, t in plan) <= 1.01 * -(-sum(k * n for k, n in counts.items()) // 4096) + 1


# ---- 7 ----

PEOPLE = [
    "mail a.b@c.de, x@y, a@b.c_d@e.f @home @@ a@-.x", "1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.3.255 1.2.3", "4532 0151 1283 0366 and 4532-0151-1283-0366 4532015112830367 1" + "0" * 30,
    "+1 (269) 555-3296 +44 20 7946 0958 +1 2 +1234567890123456 +49--- 5", "1" * 6000 + "." + "2" * 5000, "+1" * 500 + " " * 500, "9 " * 2000, "a@" * 500, "(303) 555-0188 call me",
]


def test_pii(spark, corpus):
    texts = [*corpus, *PEOPLE]
    ids = ids_with_gaps(len(texts))
    rows = pii.find_pii(table(spark, texts, ids=ids)).collect()
    digest = lambda spans: hashlib.sha256(",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans).encode()).hexdigest()
    huge = PEOPLE[4]  # the plain form cannot read numbers of 6,000 digits
    got = Counter((r.doc_id, digest(r.base_pii)) for r in rows if r.text != huge)
    assert got == Counter((i, pii.plain_base_digest(t)) for i, t in zip(ids, texts) if t != huge)
    for r in rows:
        assert {tuple(s) for s in r.base_pii} <= {tuple(s) for s in r.pii}
        assert (r.redacted == r.text) == (not r.pii)
    assert any(s.kind == "phone" for r in rows if r.text == PEOPLE[8] for s in r.pii)  # only the field finds it
    assert pii.find_pii(spark.createDataFrame([], EMPTY)).count() == 0


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(9)
    n = len(pii.LABELS)
    field = pii.Field({}, np.zeros((0, n)), rng.standard_normal((n, n)))
    runs = [rng.standard_normal((k, n)) for k in (1, 2, 3)]
    for run, path in zip(runs, field.decode(runs)):
        score = lambda p, run=run: field.pairs[0, p[0]] + sum(run[k, x] for k, x in enumerate(p)) + sum(field.pairs[a, b] for a, b in zip(p, p[1:])) + field.pairs[p[-1], 0]
        assert score(path) == pytest.approx(max(map(score, product(range(n), repeat=len(run)))))


def test_field_on_unseen_sentences():
    field = pii.train(pii.training_rows())
    right = total = 0
    for words, labels in pii.training_rows(seed=123, each=30):
        found = pii.field_spans(field, [" ".join(words)])[0]
        total += 1
        right += [f"B-{k}" for k, *_ in found] == [x for x in labels if x[0] == "B"]
    assert right / total > 0.95


# ---- 8 ----


def test_simhash(spark, corpus):
    ids = ids_with_gaps(len(corpus))
    rows = simhash.near_duplicates(table(spark, corpus, ids=ids)).collect()
    prints = [simhash.fingerprint(t) for t in corpus]
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    # values whose only id is null link to nothing
    known = {p for p, i in zip(prints, ids) if i is not None}
    for a in range(len(prints)):
        for b in range(a):
            if prints[a] == prints[b] or (prints[a] in known and prints[b] in known and (prints[a] ^ prints[b]).bit_count() <= 3):
                root[find(a)] = find(b)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    expected = Counter((i, p, low.get(find(k))) for k, (i, p) in enumerate(zip(ids, prints)))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows) == expected
    assert simhash.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def test_fingerprint_from_its_definition():
    import xxhash

    for t in [None, "", "A b", "a b c d", "Äa B\tc\x0bd e " * 50]:
        w = (t or "").translate({k: k + 32 for k in range(65, 91)})
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
        grams = [" ".join(w[k : k + 3]) for k in range(max(len(w) - 2, 1))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("n", [1, 2, 17, 400])
def test_gray_index(n):
    rng = np.random.default_rng(n)
    x = np.unique(rng.integers(0, 1 << 12, n).astype(np.uint64) * np.uint64(0x9E3779B1) % np.uint64(1 << 20))
    x = x[np.argsort(simhash.gray_rank(x))]
    got = set(zip(*(a.tolist() for a in simhash.index_pairs(x))))
    assert got == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 3}


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(10)
    center = rng.getrandbits(64)
    values = {center}
    while len(values) < 900:  # near copies that share most of their bits
        v = rng.choice(sorted(values)[-50:] if rng.random() < 0.3 else list(values)[:50])
        values.add(v ^ sum(1 << b for b in rng.sample(range(20), rng.randint(1, 3))))
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for k, v in enumerate(values)], "fp long, rep long")
    roots = {r.node: r.root for r in graph.components(simhash.links(df, len(values))).collect()}
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert [roots.get(k, k) for k in range(len(values))] == [find(k) for k in range(len(values))]


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)] + [(2000, 2000 + k) for k in range(1, 50)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(301)) and got[1001] == 1000 and {got[2000 + k] for k in range(50)} == {2000}


# ---- 9 ----


def test_quality_statistics(spark, corpus):
    ids = ids_with_gaps(len(corpus))
    rows = quality_rules.judge(table(spark, corpus, ids=ids), []).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in rows)
    expected = Counter()
    for i, t in zip(ids, corpus):
        s = quality_rules.plain_statistics(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        expected[(i, *s, failed, not failed)] += 1
    assert got == expected
    assert quality_rules.judge(spark.createDataFrame([], EMPTY), []).count() == 0


def test_learned_list(spark, labelled_tables):
    docs, lab, labels = labelled_tables
    rules = quality_rules.learn_list(quality_rules.sample(docs, lab))
    assert rules
    got = {r.doc_id: r.ok for r in quality_rules.statistics(docs).select("doc_id", quality_rules.verdict(rules).alias("ok")).collect()}
    out = [got[i] == bool(q) for i, q, _ in labels if held(i)]
    assert sum(out) / len(out) > 0.97
    assert quality_rules.learn_list([]) == []


def test_native_operators_run_no_python(spark, sf_dir):
    for f in (queries.QUERIES["op1_secrets"], queries.QUERIES["op9_quality_rules"]):
        plan = f(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
