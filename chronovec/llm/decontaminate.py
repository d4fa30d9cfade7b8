"""Benchmark decontamination (operator 4) by Wu-Manber search over words.

Method. A benchmark item gives its windows of ten consecutive words (one
shorter window if it has fewer). For each window length a shift table holds,
for every two-word block of the windows, how far the search may move on when
that block ends at the current word; a block that no window has lets it jump
almost a whole window. Where the shift is zero, the bucket of that suffix
block is opened, filtered by the first two words, and its windows are compared
word by word.

Scale. Documents are read once and never shuffled. The pairs of a window and
an item that has it are dealt into blocks of about ``BLOCK_PAIRS``; the tables
of one block are broadcast, so what is broadcast has a fixed bound, even where
many items share a window. Larger benchmarks take more passes, each over the
table that the pass before it wrote.

Defined results: a null or empty text has no words. Repeated rows each get a
row. An item with a null id counts under the id "". Empty tables of documents
or items give no rows or no hits. Texts are searched whole, whatever their
length. Of the columns to keep, those named like a result (n_words, n_hit,
items) are replaced by it; other names never clash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, release, table

WINDOW = 10
RESULTS = ("n_words", "n_hit", "items")
#: Pairs of window and item whose tables are broadcast at a time (about 100 MB at the very most).
BLOCK_PAIRS = 200_000
#: Maps A-Z to a-z, keeps digits, letters and all bytes of non-ASCII characters, blanks the rest.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class WordSearch:
    """Shift tables and suffix buckets of windows of one length."""

    def __init__(self, patterns: dict[tuple[int, ...], list[str]], base: int) -> None:
        self.size = len(next(iter(patterns)))
        self.block = min(2, self.size)
        self.base = base
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[tuple[int, ...], list]] = defaultdict(lambda: defaultdict(list))
        for p, items in patterns.items():
            for end in range(self.block - 1, self.size):
                k = self._key(p[end - 1] if self.block == 2 else 0, p[end])
                self.shift[k] = min(self.shift.get(k, self.size), self.size - 1 - end)
            self.buckets[k][p[: self.block]].append((p, items))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def _key(self, a: int, b: int) -> int:
        return a * self.base + b

    def run(self, ids: list[int]) -> Iterator[tuple[int, list[str]]]:
        """(position of the first word, items) of every occurrence."""
        size, base, far, two = self.size, self.base, self.size - self.block + 1, self.block == 2
        shift, n, i = self.shift.get, len(ids), self.size - 1
        while i < n:
            last = ids[i]
            if not last:  # no window has this word
                i += size
                continue
            key = ids[i - 1] * base + last if two else last
            move = shift(key, far)
            if move:
                i += move
                continue
            lo = i - size + 1
            for pattern, items in self.buckets[key].get(tuple(ids[lo : lo + self.block]), ()):
                if tuple(ids[lo : i + 1]) == pattern:
                    yield lo, items
            i += 1


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``(window, item)``: the words of each window, space-joined, with each item that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, found = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(text)
                size = min(window, len(w))
                for lo in range(len(w) - size + 1 if w else 0):
                    items.append(item or "")
                    found.append(b" ".join(w[lo : lo + size]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(items, pa.string())], names=["window", "item"])

    chosen = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "window binary, item string").distinct()


def searches(rows: list[tuple[bytes, str]]) -> tuple[dict[bytes, int], list[WordSearch]]:
    """Word numbers and one search for each window length."""
    vocab: dict[bytes, int] = {}
    by_size: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for window, item in rows:
        p = tuple(vocab.setdefault(w, len(vocab) + 1) for w in window.split(b" "))
        by_size[len(p)][p].append(item)
    return vocab, [WordSearch(p, len(vocab) + 1) for p in by_size.values()]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
) -> DataFrame:
    """All rows of ``docs`` with ``n_words, n_hit, items``; ``keep`` names further columns of ``docs`` to pass on."""
    spark = docs.sparkSession
    bounded_batches(spark)
    pairs = materialize(item_windows(benchmark, item_id_col, item_text_col, window), "windows")
    parts = max(1, -(-pairs.count() // BLOCK_PAIRS))
    kept = [c for c in dict.fromkeys([id_col, text_col, *(keep or [])]) if c not in RESULTS]
    start = {"_n": F.lit(0).cast("long"), "_hits": F.lit(0).cast("long"), "_hit": F.lit(None).cast("binary"), "_items": F.array().cast("array<string>")}
    row = F.struct(*[F.col(text_col).cast("string").alias(c) if c == text_col else F.col(c) for c in kept])
    out, last = docs.select(row.alias("_row"), F.col(text_col).cast("string").alias("_text"), *[c.alias(n) for n, c in start.items()]), None
    for k in range(parts):
        rows = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == k).collect()
        tables = spark.sparkContext.broadcast([(bytes(r["window"]), r["item"]) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            vocab, by_size = searches(tables.value)
            number = vocab.get
            for b in batches:
                ns, counts, hits, found = [], [], [], []
                old = zip(b.column("_hit").to_pylist(), b.column("_items").to_pylist())
                for text, (hit, items) in zip(b.column("_text").to_pylist(), old):
                    ids = [number(w, 0) for w in words(text)]
                    marks = np.unpackbits(np.frombuffer(hit, np.uint8)) if hit else None
                    items = set(items)
                    for search in by_size:
                        for lo, names in search.run(ids):
                            if marks is None:
                                marks = np.zeros(-(-len(ids) // 8) * 8, np.uint8)
                            marks[lo : lo + search.size] = 1
                            items.update(names)
                    ns.append(len(ids))
                    counts.append(0 if marks is None else int(marks.sum()))
                    hits.append(None if marks is None else np.packbits(marks).tobytes())
                    found.append(sorted(items))
                new = {"_n": pa.array(ns, pa.int64()), "_hits": pa.array(counts, pa.int64()), "_hit": pa.array(hits, pa.binary()), "_items": pa.array(found, pa.list_(pa.string()))}
                names = b.schema.names
                yield pa.RecordBatch.from_arrays([new.get(n, b.column(n)) for n in names], names=names)

        out = out.mapInArrow(run, out.schema)
        if k + 1 < parts:
            out = materialize(out, "decontaminate")
            if last is not None:
                release(last)
            last = out

    release(pairs)
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], F.col("_n").alias("n_words"), F.col("_hits").alias("n_hit"), F.col("_items").alias("items"))


def _digest(items: F.Column) -> F.Column:
    return F.sha2(F.concat_ws(",", F.array_sort(items)).cast("binary"), 256)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words of each document that lie in benchmark windows."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), _digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def plain_contamination(text: str | None, items: list[tuple], window: int = WINDOW) -> tuple[int, int, str]:
    """Brute force for tests: words, hit words, digest."""
    w, hit, names = words(text), set(), set()
    for item, other in items:
        o = words(other)
        size = min(window, len(o))
        grams = {tuple(o[k : k + size]) for k in range(len(o) - size + 1)} if o else set()
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in grams:
                hit.update(range(k, k + size))
                names.add("" if item is None else str(item))
    return len(w), len(hit), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT size FROM grams
), dgrams AS (
  SELECT doc_id, size, i, array_to_string(ws[i : i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, sizes)
), occ AS (SELECT d.doc_id, d.i, d.size, g.item_id FROM dgrams d JOIN grams g USING (size, gram)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
