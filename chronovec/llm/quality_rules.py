"""Quality rules (operator 9): a learned decision list, with built-in functions only.

Method. Statistics of each text are Spark expressions. A list of rules for
low quality is learned from labelled rows by sequential covering: a rule grows
by the threshold condition of largest information gain until it covers hardly
any good row, is pruned on rows set aside, and the rows it covers are removed
before the next rule grows. The list is emitted as one ordered conditional
expression (``when ... when ... otherwise``), which anyone can read.

Learning sees the statistics (not the texts) of at most ``SAMPLE_ROWS``
labelled rows, those with the smallest hashes of doc_id; the bound is a
parameter. Every document is judged.

Scale. One pass, no shuffle: all statistics are computed inside the row. Word
windows that repeat are found by sorting (hash, place) pairs of the row, so a
text of n words costs n log n. Windows are told apart by a 64-bit hash.

Defined results: a null or empty text has zero statistics and fails the base
rule. Repeated rows each get a row; null ids pass through. Without usable
labels the list is empty and only the base rule decides; of repeated ids in
``labels`` the lowest label counts, of their texts the first in order. An empty
table gives an empty result. Other columns are kept; those named like a
statistic, base_failed or kept are replaced. Texts are read whole, whatever
their length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out, table

SAMPLE_ROWS = 4000
_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    """Length of the text without some characters."""
    return F.length(F.translate(text, chars, "")).cast("long")


def repeat_words(w: Column, window: int = 3) -> Column:
    """Words that lie in a window found twice or more, from the array of words (a lambda variable or column)."""

    def marked(s: Column) -> Column:
        same = lambda k, by: F.get(s, k)["h"].eqNullSafe(F.get(s, k + by)["h"])
        places = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(same(k, -1) | same(k, 1), F.get(s, k)["i"]))
        return F.sort_array(F.filter(places, lambda p: p.isNotNull()))

    h = lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(window)]).alias("h"), i.alias("i"))
    pairs = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - window), h))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n"))
    return F.when(F.size(w) > window, F.aggregate(_let(pairs, marked), start, step)["n"]).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the counts of each text."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(t, r"\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), repeat_words(w).alias("n_repeat_words")))
    by_line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    length = F.length(t).cast("long")
    w, x = fresh(docs, "_w", "_l")
    out = docs.withColumns({
        w: counted,
        x: by_line,
        "word_chars": _without(t, _SPACE),
        "n_symbols": length - _without(t, _SYMBOLS),
        "n_upper": length - _without(t, _UPPER),
        "n_marks": length - _without(t, "!?"),
        "n_digits": length - _without(t, "0123456789"),
        "n_stops": length - _without(t, ".,;:"),
    })
    names = {"n_words": w, "n_distinct": w, "n_repeat_words": w, "n_lines": x, "n_dup_lines": x}
    return out.withColumns({n: F.col(s)[n] for n, s in names.items()}).drop(w, x)


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: Statistics that conditions may test.
FEATURES = {
    "n_words": F.col,
    "symbols_per_word": lambda _: _share("n_symbols", "n_words"),
    "marks_per_word": lambda _: _share("n_marks", "n_words"),
    "stops_per_word": lambda _: _share("n_stops", "n_words"),
    "upper_share": lambda _: _share("n_upper", "word_chars"),
    "digit_share": lambda _: _share("n_digits", "word_chars"),
    "dup_line_share": lambda _: _share("n_dup_lines", "n_lines"),
    "repeat_share": lambda _: _share("n_repeat_words", "n_words"),
    "distinct_share": lambda _: _share("n_distinct", "n_words"),
    "word_length": lambda _: _share("word_chars", "n_words"),
    "words_per_line": lambda _: _share("n_words", "n_lines"),
}
Condition = tuple[str, str, float]


def feature(name: str) -> Column:
    return FEATURES[name](name).cast("double")


def _holds(row: dict, c: Condition) -> bool:
    return row[c[0]] >= c[2] if c[1] == ">=" else row[c[0]] < c[2]


def _best(rows: list[dict], rule: list[Condition]) -> Condition | None:
    """The condition of largest gain in information about bad rows (y = 1)."""
    p0, n0 = sum(r["y"] for r in rows), len(rows)
    if not p0:
        return None
    base, best = math.log2(p0 / n0), (1e-9, None)
    for name in FEATURES:
        ordered = sorted((r[name], r["y"]) for r in rows)
        p = 0
        for k in range(len(ordered) - 1):
            p += ordered[k][1]
            if ordered[k][0] == ordered[k + 1][0]:
                continue
            cut = (ordered[k][0] + ordered[k + 1][0]) / 2
            for op, good, n in (("<", p, k + 1), (">=", p0 - p, n0 - k - 1)):
                if good:
                    gain = good * (math.log2(good / n) - base)
                    if gain > best[0] and (name, op, cut) not in rule:
                        best = (gain, (name, op, cut))
    return best[1]


def learn_list(rows: list[dict], most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9) -> list[list[Condition]]:
    """Ordered rules for low quality, from rows that hold the features and y (1: bad)."""
    grow = [r for k, r in enumerate(rows) if k % 3]
    prune = [r for k, r in enumerate(rows) if not k % 3]
    rules: list[list[Condition]] = []

    def worth(rule: list[Condition]) -> tuple[float, int]:
        hit = [r["y"] for r in prune if all(_holds(r, c) for c in rule)]
        return (sum(hit) / len(hit) if hit else 0.0), sum(hit)

    while len(rules) < most_rules and sum(r["y"] for r in grow) >= 2:
        rule, left = [], grow
        while len(rule) < most_conditions and any(not r["y"] for r in left):
            c = _best(left, rule)
            if c is None:
                break
            rule.append(c)
            left = [r for r in left if _holds(r, c)]
        while len(rule) > 1:
            shorter = rule[:-1]
            if worth(shorter)[0] < worth(rule)[0]:
                break
            rule = shorter
        share, hits = worth(rule)
        own = [r["y"] for r in grow if all(_holds(r, c) for c in rule)]
        if not rule or not own or sum(own) / len(own) < precision or (hits and share < precision) or (not hits and share == 0 and any(all(_holds(r, c) for c in rule) for r in prune)):
            break
        if sum(own) + hits < 3:
            break
        rules.append(rule)
        grow = [r for r in grow if not all(_holds(r, c) for c in rule)]
        prune = [r for r in prune if not all(_holds(r, c) for c in rule)]
    return rules


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Features and label of a bounded sample of labelled rows."""
    usable = labels.select(F.col(id_col).cast("long").alias("_id"), F.col("quality").cast("int").alias("_q")).where(F.col("_q").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    chosen = usable.groupBy("_id").agg(F.min("_q").alias("_q")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_q").agg(F.min("text").alias("text"))  # a row for each id, so the bound holds
    found = statistics(texts).select("_id", (1 - F.col("_q")).alias("y"), *[feature(n).alias(n) for n in FEATURES])
    return sorted((r.asDict() for r in found.collect()), key=lambda r: r["_id"])


def verdict(rules: list[list[Condition]]) -> Column:
    """True for good texts: the list as one conditional expression."""
    out = None
    for rule in rules:
        hit = F.lit(True)
        for name, op, cut in rule:
            hit = hit & (feature(name) >= cut if op == ">=" else feature(name) < cut)
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the statistics, ``base_failed`` and ``kept``."""
    return statistics(docs, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of each document."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    judged = judge(docs, learn_list(sample(docs, labels)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def plain_statistics(text: str | None) -> tuple:
    """Brute force for tests: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count: dict = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    hit = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in _SYMBOLS for c in t), dup, len(hit)
