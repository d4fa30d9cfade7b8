"""Personal data (operator 7): fixed patterns, and a linear-chain conditional random field that adds to them.

Method. The field labels white-space tokens with O or the begin or inside of
email, ip, card, phone. Its features are word shapes (letters and digits
folded to classes), lengths, digit counts, punctuation and the neighbouring
words. It is trained on a small labelled table (``training_table``; any table
of the same form may be given) by gradient ascent on the regularised
log-likelihood, with the forward-backward sums of all sentences taken at once
in numpy. Decoding is Viterbi over padded batches. A token without a digit
or @ is held to be O, so a text falls into independent runs of the other
tokens, which gives the same labels as decoding it in one piece.

Field spans that touch a pattern's span, or that do not hold what the kind
needs (digits, Luhn sum, an @), are left out; pattern spans always stay.

Scale. One pass over the documents, no shuffle; the model is a few kilobytes.
All scans are linear in the text, whatever it holds.

Defined results: a null or empty text has no spans. Repeated rows each get a
row; null ids pass through. Offsets count code points, ends exclusive. Of field
spans that overlap, the first stays. An empty table gives an empty result. Other
columns are kept; any named base_pii, pii or redacted is replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans by kind, then start."""
    if not _ANY.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# ---- the field ----

_SHAPES = [(re.compile(r"[A-ZÀ-ÖØ-Þ]"), "A"), (re.compile(r"[^\W\d_A-Z]"), "a"), (re.compile(r"[0-9]"), "9")]
_SAME = re.compile(r"(.)\1+", re.DOTALL)


class _Classes(dict):
    """Code point to its class, worked out when first met."""

    def __missing__(self, point: int) -> str:
        found = next((to for pattern, to in _SHAPES if pattern.match(chr(point))), chr(point))
        return self.setdefault(point, found)


_CLASSES = _Classes()


def _shape(token: str) -> str:
    return token.translate(_CLASSES)


def features(token: str, before: str, after: str) -> list[str]:
    """Names of the features that hold for a token between two others."""
    shape = _shape(token)
    short = _SAME.sub(r"\1", shape)
    n = shape.count("9")
    core = token.strip(".,;:!?\"'")
    parts = core.split(".")
    return [
        "bias",
        f"short={short}",
        f"shape={shape}" if len(shape) <= 20 else f"long={len(shape) // 10}",
        f"digits={n if n < 20 else 20}",
        f"at={'@' in token}|dots={min(core.count('.'), 4)}|letters={'a' in shape or 'A' in shape}",
        f"octets={len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts)}",
        f"plus={token[:1] == '+'}|paren={token[:1] == '('}|dash={'-' in token}",
        f"before={_shape(before)[:6]}|{short[:4]}",
        f"after={_shape(after)[:6]}|{short[:4]}",
        f"word={before.lower().strip(':.,')[:12]}",
    ]


class Field:
    """Weights of the features and of the label pairs."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, pairs: np.ndarray) -> None:
        self.index, self.weights, self.pairs = index, weights, pairs

    def scores(self, sentences: list[list[str]]) -> list[np.ndarray]:
        """Scores of the labels of each token but the first and last, which are neighbours only."""
        rows = np.vstack((self.weights, np.zeros(len(LABELS))))
        number, none, out = self.index.get, len(self.weights), []
        at = 0
        while at < len(sentences):
            stop, hot, sizes = at, [], []
            while stop < len(sentences) and len(hot) < 4096:
                s = sentences[stop]
                hot += [[number(f, none) for f in features(s[t], s[t - 1], s[t + 1])] for t in range(1, len(s) - 1)]
                sizes.append(len(s) - 2)
                stop += 1
            out += np.split(rows[hot].sum(axis=1), np.cumsum(sizes)[:-1])
            at = stop
        return out

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each run, between tokens that are O: Viterbi over all runs at once."""
        order = sorted(range(len(runs)), key=lambda r: len(runs[r]))
        out: list = [None] * len(runs)
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            width = max(len(runs[r]) for r in some)
            sizes = np.array([len(runs[r]) for r in some])
            emit = np.zeros((len(some), width, len(LABELS)))
            for k, r in enumerate(some):
                emit[k, : sizes[k]] = runs[r]
            best = self.pairs[0] + emit[:, 0]
            back = np.zeros(emit.shape, np.int8)
            last = best.copy()
            for t in range(1, width):
                step = best[:, :, None] + self.pairs
                back[:, t] = step.argmax(axis=1)
                best = step.max(axis=1) + emit[:, t]
                last = np.where((sizes == t + 1)[:, None], best, last)
            now = (last + self.pairs[:, 0]).argmax(axis=1)
            path = np.zeros((len(some), width), np.int8)
            for t in range(width - 1, -1, -1):
                path[:, t] = np.where(t < sizes, now, 0)
                now = np.where((t < sizes) & (t > 0), back[np.arange(len(some)), t, now], now)
            for k, r in enumerate(some):
                out[r] = path[k, : sizes[k]]
        return out


def training_rows(seed: int = 7, each: int = 40) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: sentences as tokens with a label for each, drawn from fixed templates."""
    rng = random.Random(seed)
    filler = ["the", "and", "von", "der", "les", "pour", "que", "una", "in", "mail", "office", "Thion", "eren.", "is", "at"]
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def four(s: str, sep: str) -> str:
        return sep.join(s[k : k + 4] for k in range(0, len(s), 4))

    makers = {
        "email": [lambda: [f"{name()}.{digits(2)}@{name()}.example.com"], lambda: [f"{name()}@{name()}.org,"], lambda: [f"<{name()}_{name()}@{name()}.net>"], lambda: [f"{name()}@{name()}"]],
        "ip": [lambda: [".".join(str(rng.randint(1, 255)) for _ in range(4))], lambda: [".".join(str(rng.randint(1, 255)) for _ in range(4)) + rng.choice(".,;")]],
        "card": [lambda: [card()], lambda: four(card(), " ").split(" "), lambda: [four(card(), "-")], lambda: [four(card(), ".")]],
        "phone": [
            lambda: ["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
            lambda: [f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
            lambda: [f"+{rng.choice(['44', '49', '33', '34'])}", digits(3), digits(3), digits(4)],
            lambda: [f"{digits(3)}-{digits(3)}-{digits(4)}"],
            lambda: [f"({digits(3)}){digits(3)}-{digits(4)}"],
        ],
        None: [
            lambda: ["Version", "2.0."], lambda: ["CC", "BY-NC", "4.0."], lambda: [f"{rng.randint(1990, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}"],
            lambda: [digits(rng.randint(1, 6))], lambda: [digits(rng.randint(1, 3)) + "."], lambda: [f"${digits(2)}.{digits(2)}"],
            lambda: [f"AKIA{name().upper()}{digits(3)}{name().upper()}"], lambda: ["token", "=", f'"{digits(3)}ab{digits(4)}cf{digits(9)}e{digits(6)}"'],
            lambda: [f"password={digits(2)}c{digits(4)}fe{digits(5)}"], lambda: [f"{digits(2)}:{digits(2)}"], lambda: [f"v{digits(1)}.{digits(1)}.{digits(2)}"],
            lambda: [f"{digits(3)},{digits(3)},{digits(3)}"], lambda: [digits(10)], lambda: [f"{digits(3)}.{digits(1)}.{digits(2)}"], lambda: [f"{digits(4)}-{digits(4)}"],
            lambda: [digits(4), digits(4)], lambda: [digits(rng.randint(20, 30))], lambda: ["@" + name()], lambda: [f"{name()}{digits(2)}"], lambda: [f"{digits(2)}%"], lambda: [f"({digits(4)})"],
            lambda: [f"{digits(3)}-{digits(2)}"], lambda: [f"{digits(1)}/{digits(2)}/{digits(4)}"],
        ],
    }
    rows = []
    for kind, ways in makers.items():
        for _ in range(each * (3 if kind is None else 1)):
            made = rng.choice(ways)()
            left = [rng.choice(filler) for _ in range(rng.randint(1, 3))]
            right = [rng.choice(filler) for _ in range(rng.randint(1, 3))]
            own = ["O"] * len(made) if kind is None else [f"B-{kind}", *[f"I-{kind}"] * (len(made) - 1)]
            rows.append(([*left, *made, *right], ["O"] * len(left) + own + ["O"] * len(right)))
    return rows


def training_table(spark: SparkSession) -> DataFrame:
    """``(tokens, labels)``: the built-in labelled sentences as a table."""
    return spark.createDataFrame(training_rows(), "tokens array<string>, labels array<string>")


#: Most labelled sentences that are read: those with the smallest hashes.
TRAINING_ROWS = 5000


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 150, decay: float = 0.02) -> Field:
    """Gradient ascent (AdaGrad) on the log-likelihood of the labelled sentences."""
    index: dict[str, int] = {}
    hot = [[[index.setdefault(f, len(index)) for f in features(t, s[k - 1] if k else "", s[k + 1] if k + 1 < len(s) else "")] for k, t in enumerate(s)] for s, _ in rows]
    n, width, labels, fs = len(rows), max(len(s) for s, _ in rows), len(LABELS), len(hot[0][0])
    active = np.full((n, width, fs), len(index))
    gold = np.zeros((n, width), np.int64)
    sizes = np.array([len(s) for s, _ in rows])
    for k, (s, own) in enumerate(rows):
        active[k, : len(s)] = hot[k]
        gold[k, : len(s)] = [LABELS.index(x) for x in own]
    there = np.arange(width) < sizes[:, None]
    weights, pairs = np.zeros((len(index) + 1, labels)), np.zeros((labels, labels))
    for k, own in enumerate(LABELS):  # an inside follows a begin or inside of its kind only
        if own[0] == "I":
            pairs[[j for j, x in enumerate(LABELS) if x[1:] != own[1:]], k] = -30
    fixed = pairs < 0
    sums = [np.full_like(weights, 1e-3), np.full_like(pairs, 1e-3)]
    eye = np.eye(labels)
    for _ in range(rounds):
        emit = weights[active].sum(axis=2)
        fore, backw = np.zeros((n, width, labels)), np.zeros((n, width, labels))
        fore[:, 0] = pairs[0] + emit[:, 0]
        for t in range(1, width):
            fore[:, t] = np.logaddexp.reduce(fore[:, t - 1, :, None] + pairs, axis=1) + emit[:, t]
        for t in range(width - 1, -1, -1):
            end = t + 1 >= sizes
            after = pairs[:, 0][None] if t + 1 >= width else np.where(end[:, None], pairs[:, 0], np.logaddexp.reduce(pairs[None] + (emit[:, t + 1] + backw[:, t + 1])[:, None, :], axis=2))
            backw[:, t] = after
        total = np.logaddexp.reduce(fore[:, 0] + backw[:, 0], axis=1)
        share = np.exp(fore + backw - total[:, None, None]) * there[..., None]
        residual = eye[gold] * there[..., None] - share
        grad = np.zeros_like(weights)
        np.add.at(grad, active.reshape(-1, fs), residual.reshape(-1, 1, labels))
        grad[:-1] -= decay * weights[:-1]
        grad[-1] = 0
        pair_grad = -decay * pairs
        for t in range(1, width):
            joint = np.exp(fore[:, t - 1, :, None] + pairs + (emit[:, t] + backw[:, t])[:, None, :] - total[:, None, None])
            on = there[:, t]
            pair_grad -= joint[on].sum(axis=0)
            np.add.at(pair_grad, (gold[on, t - 1], gold[on, t]), 1)
        for value, g, s in ((weights, grad, sums[0]), (pairs, np.where(fixed, 0, pair_grad), sums[1])):
            s += g * g
            value += 0.3 * g / np.sqrt(s)
    return Field(index, weights[:-1], pairs)


def _trim(text: str, lo: int, hi: int) -> tuple[int, int]:
    while lo < hi and text[lo] in ".,;:!?\"'<>[]{}=":
        lo += 1
    while hi > lo and text[hi - 1] in ".,;:!?\"'<>[]{}=":
        hi -= 1
    return lo, hi


def _holds(kind: str, found: str) -> bool:
    d = _digits(found)
    if kind == "email":
        return 0 < found.find("@") < len(found) - 1
    if kind == "ip":
        return found.count(".") == 3 and 4 <= len(d) <= 12
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15


def _word_before(text: str, end: int) -> str:
    """The whole word that ends last before ``end``."""
    width = 40
    while True:
        lo = max(0, end - width)
        words = text[lo:end].split()
        if words and (lo == 0 or len(words) > 1 or text[lo].isspace()) or lo == 0:
            return words[-1] if words else ""
        width *= 4


def _word_after(text: str, start: int) -> str:
    """The whole word that begins first from ``start`` on."""
    width = 40
    while True:
        hi = min(len(text), start + width)
        words = text[start:hi].split()
        if words and (hi == len(text) or len(words) > 1 or text[hi - 1].isspace()) or hi == len(text):
            return words[0] if words else ""
        width *= 4


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds in each text."""
    runs, places = [], []
    for n, text in enumerate(texts):
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)] if _ANY.search(text) else []
        at = 0
        while at < len(tokens):
            stop = at + 1
            while stop < len(tokens) and text[tokens[stop - 1][1] : tokens[stop][0]].isspace():
                stop += 1
            sentence = [_word_before(text, tokens[at][0]), *[text[a:b] for a, b in tokens[at:stop]], _word_after(text, tokens[stop - 1][1])]
            runs.append(sentence)
            places.append((n, tokens[at:stop]))
            at = stop
    out: list = [[] for _ in texts]
    for (n, tokens), path in zip(places, field.decode(field.scores(runs))):
        k = 0
        while k < len(path):
            if path[k] and LABELS[path[k]][0] == "B":
                kind, stop = LABELS[path[k]][2:], k + 1
                while stop < len(path) and LABELS[path[stop]] == f"I-{kind}":
                    stop += 1
                lo, hi = _trim(texts[n], tokens[k][0], tokens[stop - 1][1])
                if _holds(kind, texts[n][lo:hi]):
                    out[n].append((kind, lo, hi))
                k = stop
            else:
                k += 1
    return out


def all_spans(field: Field, texts: list[str]) -> Iterator[tuple[list, list]]:
    """(pattern spans, those with the field's additions) of each text, by kind, then start."""
    rank = {k: n for n, k in enumerate(KINDS)}
    base = [base_spans(t) for t in texts]
    for own, more in zip(base, field_spans(field, texts)):
        taken = sorted((a, b) for _, a, b in own)
        starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        added = []
        for kind, a, b in more:
            k = bisect_left(starts, b)  # the spans that start before the end of this one
            if not k or reach[k - 1] <= a:
                added.append((kind, a, b))
        yield own, sorted(own + added, key=lambda s: (rank[s[0]], s[1], s[2]))


def _learned(spark: SparkSession, labelled: DataFrame | None) -> Field:
    rows = (labelled or training_table(spark)).select("tokens", "labels").orderBy(F.xxhash64("tokens", "labels"), "tokens", "labels").limit(TRAINING_ROWS).collect()
    return train([(list(r["tokens"]), list(r["labels"])) for r in rows if r["tokens"]])


_SPANS = "array<struct<kind: string, start: int, end: int>>"
_SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_pii(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` with ``base_pii`` and ``pii`` (arrays of kind, start, end) and ``redacted``.

    ``redacted`` is the text with every span replaced by its kind in angle brackets.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    field = _learned(spark, labelled)
    model = spark.sparkContext.broadcast((field.index, field.weights, field.pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*model.value)
        for b in batches:
            texts = b.column(text_col).to_pylist()
            base, full, clean = [], [], []
            for text, (a, f) in zip(texts, all_spans(own, [t or "" for t in texts])):
                base.append([{"kind": k, "start": x, "end": y} for k, x, y in a])
                full.append([{"kind": k, "start": x, "end": y} for k, x, y in f])
                clean.append(_redact(text, f) if f else text)
            cols = [*b.columns, pa.array(base, _SPANS_TYPE), pa.array(full, _SPANS_TYPE), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "base_pii", "pii", "redacted"])

    src = docs.drop("base_pii", "pii", "redacted")
    src = src.withColumn(text_col, F.col(text_col).cast("string"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in src.dtypes), f"base_pii {_SPANS}", f"pii {_SPANS}", "redacted string"])
    return src.mapInArrow(run, schema)


def _redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in each document."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_pii", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base_pii")).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def plain_base_digest(text: str | None) -> str:
    """Brute force for tests, straight from the patterns."""
    text, out = text or "", []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            d = _digits(m.group())
            ok = kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")))
            ok = ok or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return hashlib.sha256(",".join(out).encode()).hexdigest()
