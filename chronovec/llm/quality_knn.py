"""Quality classifier (operator 5): nearest-neighbour voting in a latent-semantic space.

Method. A text becomes counts of hashed terms: its words, their forms (case,
length, trailing marks), and bands of its repetition, line and length
statistics. Labelled texts give inverse document frequencies and, by a
truncated singular value decomposition of the weighted term matrix, the latent
space. The labelled vectors are broadcast; every document is projected, its
cosine with all labelled vectors is computed exactly, a block of documents at
a time, and the labels of the ``NEIGHBOURS`` nearest vote, weighted by
similarity.

Scale. Labelled vectors come from at most ``SAMPLE_ROWS`` rows (a documented
bound: the smallest hashes of doc_id), so the broadcast is at most
``(SAMPLE_ROWS + TERMS) * RANK`` floats, about 1 MB. Documents are read once
and never shuffled.

Defined results: a null or empty text is scored like any other. Null labels
and ids are not learned from. Without any usable label every score is 0.5.
Repeated rows each get a row; of repeated ids in ``labels`` the lowest label
counts, of their texts the first in order. All labelled vectors that are as
near as the last of the ``NEIGHBOURS`` vote too. An empty table gives an empty
result. Other columns are kept; one that is named like the score is replaced.
Texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, materialize, table

SAMPLE_ROWS = 4000
TERMS = 4096
#: What an occurrence of a word counts beside one of its form.
WORD_WEIGHT = 0.3
RANK = 32
NEIGHBOURS = 25
_MARKS = re.compile(r"[^\w\s]")
_BANDS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def _form(word: str) -> str:
    core = word.rstrip("!?.,;:#*$%&|<>…")
    tail = word[len(core) :]
    case = "mark" if not core else "low" if core.islower() else "up" if core.isupper() and len(core) > 1 else "title" if core.istitle() else "digit" if any(c.isdigit() for c in core) else "mixed"
    return f"{case}{min(len(core), 24) // 6}{tail[:3] if len(tail) > 1 else '.' if tail else ''}"


def _band(name: str, share: float) -> str:
    return f"{name}={sum(share >= b for b in _BANDS)}"


def terms(text: str | None) -> Counter:
    """Counts of the terms of a text, weighted so that a text-wide statistic counts like many words."""
    t = text or ""
    words = t.split()
    n, out = len(words), Counter()
    seen = Counter(words)
    for w, c in seen.items():
        out[_form(w)] += c
    scale = 100.0 / max(n, 1)
    for k in out:
        out[k] *= scale
    for w, c in seen.items():
        out[f"w:{w.lower()}"] += WORD_WEIGHT * c * scale
    lines = [x for x in t.split("\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    common = seen.most_common(1)[0][1] if seen else 0
    grams = Counter(zip(words, words[1:], words[2:]))
    again = sum(c for c in grams.values() if c > 1)
    marks = len(_MARKS.findall(t))
    for k in (
        _band("distinct", len(seen) / max(n, 1)),
        _band("again", again / max(n - 2, 1)),
        _band("dup", 1 - len(set(lines)) / max(len(lines), 1)),
        _band("same", same / max(n, 1)),
        _band("common", common / max(n, 1)),
        _band("marks", marks / max(n, 1)),
        f"size={min(n.bit_length(), 12)}",
        f"line={min((n // max(len(lines), 1)).bit_length(), 8)}",
    ):
        out[k] += 25.0
    return out


def vector(counts: Counter, dims: int = TERMS) -> dict[int, float]:
    out: dict[int, float] = {}
    for k, v in counts.items():
        h = zlib.crc32(k.encode("utf-8", "surrogatepass")) % dims
        out[h] = out.get(h, 0.0) + v
    return out


def _vectors(docs: DataFrame, extra: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [vector(terms(t)) for t in b.column("text").to_pylist()]
            cols = [b.column(n) for n in extra]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([list(v) for v in found], pa.list_(pa.int32())), pa.array([list(v.values()) for v in found], pa.list_(pa.float64()))], names=[*extra, "keys", "counts"]
            )

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"{n} {kinds[n]}" for n in extra), "keys array<int>", "counts array<double>"]))


def fit(rows: list[tuple[list[int], list[float], int]], dims: int = TERMS, rank: int = RANK, seed: int = 5) -> dict:
    """Inverse frequencies, projection, unit vectors and labels, as plain arrays."""
    x = np.zeros((len(rows), dims), np.float32)
    for k, (keys, counts, _) in enumerate(rows):
        x[k, keys] = np.log1p(counts)
    idf = np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x *= idf
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(x @ rng.standard_normal((dims, min(rank + 10, len(rows)))).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    space = np.ascontiguousarray(vt[:rank].T)
    return {"idf": idf, "space": space, "labelled": _unit(x @ space), "labels": np.array([y for *_, y in rows], np.float32)}


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def vote(x: np.ndarray, model: dict, neighbours: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
    """Scores of weighted count rows: exact cosines against all labelled vectors, in blocks."""
    labels, out = model["labels"], np.full(len(x), 0.5)
    k = min(neighbours, len(labels))
    if not k:
        return out
    for lo in range(0, len(x), block):
        sims = _unit(x[lo : lo + block] @ model["space"]) @ model["labelled"].T
        kth = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k, None]
        weight = np.where(sims >= kth, np.square(np.square(np.square(np.maximum(sims, 1e-6).astype(float)))), 0)
        out[lo : lo + block] = weight @ labels / weight.sum(axis=1)
    return np.clip(out, 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model from a bounded sample of labelled rows outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    usable = labels.select(F.col(id_col).cast("long").alias("_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    chosen = usable.groupBy("_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "y").agg(F.min("text").alias("text"))  # a row for each id, so the bound holds
    found = materialize(_vectors(texts, ["_id", "y"]), "quality-sample").orderBy("_id", "keys").collect()
    return fit([(r["keys"], r["counts"], r["y"]) for r in found]) if found else {"idf": np.ones(TERMS, np.float32), "space": np.zeros((TERMS, 1), np.float32), "labelled": np.zeros((0, 1)), "labels": np.zeros(0)}


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score, 0 to 1."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts, scores = b.column(text_col).to_pylist(), []
            for lo in range(0, len(texts), 256):
                x = np.zeros((len(texts[lo : lo + 256]), len(own["idf"])), np.float32)
                for k, t in enumerate(texts[lo : lo + 256]):
                    v = vector(terms(t))
                    x[k, list(v)] = np.log1p(list(v.values()))
                scores.append(vote(x * own["idf"], own))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*b.schema.names, score_col])

    src = docs.drop(score_col).withColumn(text_col, F.col(text_col).cast("string"))
    return src.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in src.dtypes), f"`{score_col}` double"]))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of each document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
