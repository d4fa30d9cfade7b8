"""Secret scans (operator 1) through a trigram inverted index, with built-in functions only.

Method. From each rule's pattern a Boolean query over trigrams is derived: the
parsed pattern tells which strings every match must hold, as an OR of ANDs of
lower-case trigrams. The index holds, for each trigram that some query needs,
the documents it occurs in. Postings are intersected per document: bit sets of
the trigrams present decide each query, and only the candidates of a rule are
matched against its pattern. A rule without mandatory trigrams (runs of hex
digits) reads every text.

Scale. The postings hold no text: (trigram number, document). They are combined
by document before they are shuffled, so no trigram, however common, is
gathered in one place. A bit map of bounded size picks out the texts that may
be candidates; only those are joined, all others are never shuffled. Spans
inside a text are placed in blocks, so a text with very many matches stays
near linear.

Defined results: a null or empty text has no spans. Rows with a null doc_id
are scanned for every rule. Repeated rows each get a row; rows that share an id
share their candidates. An empty table gives an empty result. Other columns are
ignored, whatever their names. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import re._parser as regex
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, perhaps_among, table


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # greedy from the start of a run, as with + and a check of the length
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")

#: Strings that are told apart while a pattern is read, characters of a class among them, and clauses of a query.
_STRINGS, _CLASS, _CLAUSES = 64, 12, 64
_Query = frozenset  # of frozensets of trigrams: an OR of ANDs
_TRUE: _Query = frozenset({frozenset()})


def _grams(s: str) -> frozenset:
    return frozenset(s[k : k + 3] for k in range(len(s) - 2))


def _either(clauses) -> _Query:
    """An OR of clauses without those that another one implies; true if there are too many."""
    clauses = set(clauses)
    least = frozenset(c for c in clauses if not any(o < c for o in clauses))
    return least if len(least) <= _CLAUSES else _TRUE


def _both(a: _Query, b: _Query) -> _Query:
    found = {x | y for x, y in product(a, b)}
    return _either(found) if len(found) <= _CLAUSES else min(a, b, key=lambda q: (q == _TRUE, len(q)))


@dataclass(frozen=True)
class _Part:
    """What a part of a pattern matches: all its strings if they are few, else what they begin and end with, and what they must hold."""

    exact: frozenset | None
    begins: frozenset = frozenset({""})
    ends: frozenset = frozenset({""})
    query: _Query = _TRUE

    def loose(self) -> _Part:
        if self.exact is None:
            return self
        return _Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), _either(map(_grams, self.exact)))

    def then(self, other: _Part) -> _Part:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= _STRINGS:
            return _Part(frozenset(a + b for a, b in product(self.exact, other.exact)))
        a, b = self.loose(), other.loose()
        across = _either(_grams(x + y) for x, y in product(a.ends, b.begins))
        begins = frozenset((x + y)[:2] for x, y in product(self.exact, b.begins)) if self.exact is not None else a.begins
        ends = frozenset((x + y)[-2:] for x, y in product(a.ends, other.exact)) if other.exact is not None else b.ends
        return _Part(None, begins, ends, _both(_both(a.query, b.query), across))

    def otherwise(self, other: _Part) -> _Part:
        if self.exact is not None and other.exact is not None and len(self.exact | other.exact) <= _STRINGS:
            return _Part(self.exact | other.exact)
        a, b = self.loose(), other.loose()
        return _Part(None, a.begins | b.begins, a.ends | b.ends, _either(a.query | b.query))


_NOTHING, _ANYTHING = _Part(frozenset({""})), _Part(None)


def _of(node) -> _Part:
    op, arg = node
    if op is regex.LITERAL:
        return _Part(frozenset({chr(arg).lower()}))
    if op is regex.IN:
        chars: set[str] = set()
        for kind, value in arg:
            points = [value] if kind is regex.LITERAL else range(value[0], value[1] + 1) if kind is regex.RANGE else None
            if points is None or len(points) > 2 * _CLASS:
                return _ANYTHING
            chars |= {chr(p).lower() for p in points}
        return _Part(frozenset(chars)) if len(chars) <= _CLASS else _ANYTHING
    if op is regex.SUBPATTERN:
        return _sequence(arg[-1])
    if op is regex.BRANCH:
        return reduce(_Part.otherwise, map(_sequence, arg[1]))
    if op in (regex.MAX_REPEAT, regex.MIN_REPEAT, regex.POSSESSIVE_REPEAT):
        least, most, inner = arg
        part = _sequence(inner)
        if least == 0:
            return part.otherwise(_NOTHING) if most == 1 else _ANYTHING
        return part if (least, most) == (1, 1) else part.loose()
    if op in (regex.AT, regex.ASSERT, regex.ASSERT_NOT):
        return _NOTHING
    return _ANYTHING


def _sequence(nodes) -> _Part:
    return reduce(_Part.then, map(_of, nodes), _NOTHING)


def trigram_query(rule: Rule) -> list[list[str]]:
    """OR of ANDs of lower-case trigrams that any match of the rule's pattern must hold; empty if there is none."""
    query = _sequence(regex.parse(rule.pattern)).loose().query
    return [] if query == _TRUE else sorted(map(sorted, query))


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r) for t in clause})


def postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index ``(gram, doc_id)``, gram as its number in ``grams``."""
    low = F.transform(F.array(F.lower(F.col(text_col))), lambda t: F.array_compact(F.array(*[F.when(t.contains(g), F.lit(k)) for k, g in enumerate(grams)])))  # lower case once
    present = F.element_at(low, 1)
    return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.explode(present).alias("gram"), F.col(id_col).alias("doc_id"))


#: Trigrams in one bit set.
_BITS = 63


def candidates(index: DataFrame, rules: tuple[Rule, ...], grams: list[str]) -> DataFrame:
    """``(doc_id, rules)``: the bits of the rules whose query a document's postings meet."""
    number = {g: k for k, g in enumerate(grams)}
    sets = range(-(-len(grams) // _BITS))
    one = lambda j: F.expr(f"bit_or(if(gram div {_BITS} = {j}, shiftleft(1L, gram % {_BITS}), 0L))").alias(f"have_{j}")
    have = index.groupBy("doc_id").agg(*map(one, sets))
    met = F.lit(0).cast("long")
    for n, rule in enumerate(rules):
        hit = F.lit(False)
        for clause in trigram_query(rule):
            masks = [sum(1 << number[g] % _BITS for g in clause if number[g] // _BITS == j) for j in sets]
            hit = hit | reduce(Column.__and__, [F.col(f"have_{j}").bitwiseAND(F.lit(m)) == F.lit(m) for j, m in zip(sets, masks) if m])
        met = met + F.when(hit, F.lit(1 << n)).otherwise(F.lit(0))
    return have.select("doc_id", met.alias("rules")).where("rules > 0")


_BLOCK = 256
_SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _placed(pieces: Column, found: Column, groups: Column, rule: Rule, rank: int) -> Column:
    """Spans from what lies between matches (n + 1 pieces), the matches and the tested groups.

    Starts are sums over all earlier pieces and matches: first within blocks
    of 256 matches, then over the blocks.
    """

    def span(start: Column, m: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + m["len"]).cast("int").alias("end"))

    rows = F.zip_with(F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"))), groups, lambda x, g: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), F.length(g).alias("test")))

    def block(rows: Column, k: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        step = lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + m["len"]).alias("at"),
            F.when(m["test"] >= rule.least, F.concat(acc["out"], F.array(span(acc["at"] + m["gap"], m)))).otherwise(acc["out"]).alias("out"),
        )
        return F.aggregate(F.slice(rows, k * _BLOCK + 1, F.lit(_BLOCK)), start, step)

    def whole(rows: Column) -> Column:
        rows = F.filter(rows, lambda m: m["len"].isNotNull())
        return _let(rows, lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / _BLOCK).cast("int")), lambda k: block(r, k)))

    def shifted(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
        move = lambda b, by: F.transform(b["out"], lambda s: F.struct((s["start"] + by).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))
        step = lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(move(b, acc["at"]))).alias("out"))
        return F.flatten(F.aggregate(blocks, start, step)["out"])

    return _let(_let(rows, whole), shifted)


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in a text: leftmost, not overlapping, those that fail the length test dropped."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    return _placed(F.split(text, rule.pattern, -1), found, groups, rule, rank)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)``, one row for each row of ``docs``; spans are sorted by start, then rule."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    grams = vocabulary(rules)
    none = F.array().cast(f"array<{_SPAN}>")

    def verified(texts: DataFrame) -> DataFrame:
        parts = []
        for n, rule in enumerate(rules):
            may = F.col("rules").bitwiseAND(F.lit(1 << n)) != 0 if trigram_query(rule) else F.col("text").isNotNull()
            parts.append(F.when(may & F.col("text").rlike(rule.pattern), rule_spans(F.col("text"), rule, n)).otherwise(none))
        return texts.select("doc_id", F.sort_array(F.concat(*parts)).alias("spans"))

    if not grams:
        return verified(docs.withColumn("rules", F.lit(0).cast("long")))
    found = materialize(candidates(postings(docs, grams), rules, grams), "secret-candidates")
    marked = perhaps_among(docs, "doc_id", found.select("doc_id"))
    rest = marked.where("not _perhaps").select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.lit((1 << len(rules)) - 1)).otherwise(F.lit(0)).cast("long").alias("rules"))
    likely = marked.where("_perhaps").join(found, "doc_id", "left").select("doc_id", "text", F.coalesce("rules", F.lit(0).cast("long")).alias("rules"))
    return verified(rest.unionByName(likely))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in each document."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def plain_spans(text: str | None, rules: tuple[Rule, ...] = RULES) -> str:
    """Brute force for tests."""
    import re

    out = []
    for rank, rule in enumerate(rules):
        pattern = r"[0-9a-f]+" if rule.kind == "hex" else rule.pattern
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), rank, rule.kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


_SQL_RULE = """
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, list_sum(lens[1 : 2 * i - 1])::BIGINT AS s, list_sum(lens[1 : 2 * i])::BIGINT AS e
FROM (SELECT doc_id, g, lens, unnest(range(1, len(g) + 1)) AS i FROM (
  SELECT doc_id, g, flatten(list_transform(range(1, len(m) + 1), lambda k: [length(p[k]), length(m[k])])) AS lens FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, regexp_split_to_array(t, '{pattern}') AS p FROM d)))
WHERE length(g[i]) >= {least}
"""
ORACLE_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join(
        _SQL_RULE.format(rank=n, kind=r.kind, pattern=r.pattern.replace("'", "''").replace(r"\"", '"'), group=r.group, least=r.least) for n, r in enumerate(RULES)
    )
    + """), j AS (
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS a
FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN j USING (doc_id)"""
)
