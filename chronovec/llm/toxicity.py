"""Toxicity (operator 10) by a counterfactual-regularised classifier.

Method. A logistic model over words and word beginnings is fitted to labelled
documents. In every sentence of them that names a group, the term is swapped
for each other term of its language and number; the squared change of the
sentence's score under the swap is a penalty of the fit, next to the log-loss
and weight decay. A few neutral sentences that name each term are added as
non-toxic, so that the terms are represented even where the labelled documents
name none. A term that only co-occurs with abuse thus cannot carry the verdict.

Features are the whole word and its first 3 to 8 letters, with the logarithm
of their count. Candidates are counted by label in Spark over the sample and
the ``FEATURES`` with the strongest association stay; the fit itself sees a
sample of at most ``SAMPLE_ROWS`` labelled documents (a documented bound: the
smallest hashes of doc_id), each as a short list of feature numbers. Swaps
reach the driver as the few features that they change; equal ones are counted
in Spark and held once.

Scale. The documents are read once for scoring, without a shuffle; the model
is a dictionary of at most ``FEATURES`` entries and the group terms.

Defined results: null and empty texts score by the bias alone.
Rows with null ids are scored, never learned from. Null labels are not
learned from. If the sample has labels of one kind only, or none, every score
is (toxic + 1) / (labels + 3): 1/3 without labels. Repeated rows each get a row; of repeated ids in ``labels`` the
highest label counts, of their texts the first in order, and texts that repeat
in the sample are learned from once. Texts are read whole, whatever their length. An empty
table gives an empty result. Other columns are kept; one that is named like
the score is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, materialize, release, table

SAMPLE_ROWS = 8000
FEATURES = 2048
#: Group terms that are swapped for one another, by language and number.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "foreigners", "gays", "lesbians", "blacks", "whites", "asians", "africans", "arabs", "latinos"),
    ("woman", "man", "girl", "boy", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee", "foreigner", "gay", "lesbian", "black", "white", "asian", "african", "arab", "latino", "disabled", "deaf", "blind", "trans"),
    ("frauen", "männer", "mädchen", "jungen", "muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "einwanderer", "flüchtlinge", "ausländer", "schwule", "lesben", "schwarze", "asiaten", "afrikaner", "araber"),
    ("frau", "mann", "muslim", "muslimin", "christ", "christin", "jude", "jüdin", "hindu", "buddhist", "atheist", "einwanderer", "flüchtling", "schwul", "lesbisch", "asiate", "afrikaner", "behindert"),
    ("femmes", "hommes", "filles", "garçons", "musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "immigrés", "réfugiés", "étrangers", "homosexuels", "lesbiennes", "noirs", "blancs", "asiatiques", "africains", "arabes"),
    ("femme", "homme", "fille", "garçon", "musulman", "musulmane", "chrétien", "chrétienne", "juif", "juive", "hindou", "athée", "immigré", "réfugié", "homosexuel", "lesbienne", "asiatique", "africain", "arabe", "handicapé"),
    ("mujeres", "hombres", "chicas", "chicos", "musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "inmigrantes", "refugiados", "extranjeros", "homosexuales", "lesbianas", "negros", "blancos", "asiáticos", "africanos", "árabes"),
    ("mujer", "hombre", "musulmán", "musulmana", "cristiano", "cristiana", "judío", "judía", "hindú", "ateo", "inmigrante", "refugiado", "extranjero", "homosexual", "lesbiana", "asiático", "africano", "árabe", "discapacitado"),
)
NEUTRAL = ("{} live here", "we met some {} today", "{} work in this town")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_OTHERS = {t: tuple(dict.fromkeys(o for g in IDENTITY_TERMS if t in g for o in g if o != t)) for g in IDENTITY_TERMS for t in g}
#: Words whose features a worker remembers.
CACHE_WORDS = 200_000


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def parts(word: str) -> list[str]:
    """The features of a word: its beginnings, with a mark, and itself."""
    return [*(f"{word[:n]}*" for n in range(3, min(len(word), 8) + 1)), word]


class Features:
    """Numbers of the known features of words, remembered for short words."""

    def __init__(self, known: dict[str, int]) -> None:
        self.known, self.seen = known, {}

    def of(self, word: str) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            found = tuple(k for f in parts(word) if (k := self.known.get(f)) is not None)
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            if len(word) <= 64:
                self.seen[word] = found
        return found

    def counts(self, words: Counter) -> dict[int, int]:
        out: dict[int, int] = {}
        for w, n in words.items():
            for k in self.of(w):
                out[k] = out.get(k, 0) + n
        return out


def swaps(text: str, features: Features) -> Iterator[list[tuple[int, float]]]:
    """The changes of the features of each sentence when one of its group terms is swapped for another."""
    if not any(w in _OTHERS for w in _WORD.findall(text.lower())):
        return
    for sentence in _SENTENCE.split(text):
        words = word_counts(sentence)
        own = features.counts(words)
        for term in [w for w in words if w in _OTHERS]:
            for other in _OTHERS[term]:
                change: dict[int, int] = {}
                for word, sign in ((term, -1), (other, 1)):
                    for k in features.of(word):
                        change[k] = change.get(k, 0) + sign * words[term]
                yield sorted((k, round(math.log1p(own.get(k, 0) + n) - math.log1p(own.get(k, 0)), 6)) for k, n in change.items() if n)


def sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(text, y)``: a bounded sample of the labelled rows that may be learned from, distinct texts only."""
    usable = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("_id").isNotNull())
    chosen = usable.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "_id").where("text is not null").groupBy("_id", "y").agg(F.min("text").alias("text"))  # a row for each id, so the bound holds
    return joined.groupBy(F.xxhash64("text").alias("_h"), F.length("text").alias("_l")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y")


def _associated(labelled: DataFrame, features: int) -> list[str]:
    """Features by the strength of their association with the label (document counts), strongest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y].update({f for w in set(_WORD.findall(text.lower())) for f in parts(w)})
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[0][f] for f in names], pa.int64()), pa.array([seen[1][f] for f in names], pa.int64())], names=["f", "clean", "toxic"])

    counts = labelled.mapInArrow(run, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = labelled.agg(F.sum(1 - F.col("y")), F.sum("y")).first()
    n0, n1 = (total[0] or 0), (total[1] or 0)
    if not n0 or not n1:
        return []
    a, c = F.col("toxic"), F.col("clean")
    b, d = F.lit(n1) - a, F.lit(n0) - c
    chi = (n0 + n1) * F.pow(a * d - b * c, F.lit(2)) / ((a + b) * (c + d) * (a + c) * F.greatest(b + d, F.lit(1))).cast("double")
    top = counts.where(F.col("toxic") >= 2).select("f", chi.alias("chi"), F.length("f").alias("l")).orderBy(F.desc("chi"), "l", "f").limit(features)
    return [r["f"] for r in top.collect()]


def fit(x: np.ndarray, y: np.ndarray, swapped: list[tuple[list[tuple[int, float]], int]], fairness: float = 5.0, decay: float = 0.0001, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias: log-loss + decay + fairness * mean squared score change under swaps, by Adam.

    ``swapped`` holds the changed features of each swap and how often it occurs.
    """
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    at = np.repeat(np.arange(len(swapped)), [len(c) for c, _ in swapped])
    keys = np.array([k for c, _ in swapped for k, _ in c], np.int64)
    change = np.array([d for c, _ in swapped for _, d in c])
    share = np.array([n for _, n in swapped], float) / max(1, sum(n for _, n in swapped))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = (p - y) / len(y)
        g = x.T @ e + decay / 10 * w + decay * np.sign(w) * (np.abs(w) > 0)
        if len(keys):
            moved = share * np.bincount(at, change * w[keys], len(swapped))
            g = g + 2 * fairness * np.bincount(keys, change * moved[at], len(w))
        g = np.append(g, e.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = SAMPLE_ROWS, features: int = FEATURES) -> dict:
    """The model as a plain dictionary: words, weights, bias."""
    bounded_batches(docs.sparkSession)
    labelled = materialize(sample(docs, labels, label_col, rows), "toxicity-sample")
    names = list(dict.fromkeys([*_associated(labelled, features), *(t for g in IDENTITY_TERMS for t in g)]))
    known = {f: k for k, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(known)
        for b in batches:
            found: list[tuple] = []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = own.counts(word_counts(text))
                found.append((list(counts), [math.log1p(n) for n in counts.values()], y, 1))
                for change, n in Counter(map(tuple, swaps(text, own))).items():
                    found.append(([k for k, _ in change], [d for _, d in change], None, n))
            kinds = [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 4, kinds)], names=["keys", "amounts", "y", "n"])

    rows_ = materialize(labelled.mapInArrow(run, "keys array<int>, amounts array<double>, y int, n long"), "toxicity-rows")
    plain = rows_.where("y is not null").select("keys", "amounts", "y").collect()
    swapped = [(list(zip(r["keys"], r["amounts"])), r["n"]) for r in rows_.where("y is null").groupBy("keys", "amounts").agg(F.sum("n").alias("n")).collect()]
    release(labelled, rows_)
    total, toxic = len(plain), sum(r["y"] for r in plain)
    if not 0 < toxic < total:
        return {"known": {}, "weights": [], "bias": math.log((toxic + 1) / (total - toxic + 2))}
    own = Features(known)
    neutral = list(dict.fromkeys(n.format(t) for g in IDENTITY_TERMS for t in g for n in NEUTRAL))
    x = np.zeros((total + len(neutral), len(names)), np.float32)
    y = np.zeros(len(x), np.float32)
    for k, r in enumerate(plain):
        x[k, r["keys"]] = r["amounts"]
        y[k] = r["y"]
    for k, text in enumerate(neutral, total):
        for f, n in own.counts(word_counts(text)).items():
            x[k, f] = math.log1p(n)
    swapped += [(list(c), n) for c, n in Counter(tuple(c) for text in neutral for c in swaps(text, own)).items()]
    w, bias = fit(x, y, swapped)
    return {"known": known, "weights": w.tolist(), "bias": bias}


def score_text(text: str | None, features: Features, weights: list[float], bias: float) -> float:
    z = bias + sum(weights[k] * math.log1p(n) for k, n in features.counts(word_counts(text)).items())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score, 0 to 1."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model["known"], model["weights"], model["bias"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, bias = shared.value
        features = Features(known)
        for b in batches:
            scores = [score_text(t, features, weights, bias) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, score_col])

    src = docs.drop(score_col).withColumn(text_col, F.col(text_col).cast("string"))
    return src.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in src.dtypes), f"`{score_col}` double"]))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of each document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
