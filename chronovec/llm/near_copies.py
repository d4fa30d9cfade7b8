"""Near copies at a stated Jaccard similarity of word shingles: SimHash in the setting of the pipeline.

Method. It is the search of ``simhash`` with five-word shingles and a radius
that reaches a similarity of 0.8: a pair there differs in about ten of 64
bits, and all but one in a thousand in ``RADIUS`` or fewer. Blocks of equal
bits cannot deal values at such a radius, so buckets are agreements in a whole
band of minimum hashes (at 0.8 all but four pairs in ten thousand share one);
in a bucket the Gray-order index finds the fingerprints within the radius.
Fingerprints only choose: all sets of a component that they link are then
compared by their shingles, and only pairs at ``least`` or above link.

Scale. Only the sketches of all documents are shuffled; texts are read again
for candidates alone, which a bit map of bounded size picks out. A component
of more than ``CELL`` sets or ``CELL_HASHES`` shingles is split into pairs of
chunks, so every pair of its sets still meets in one task. Each task emits a
forest, never all pairs.

Defined results: words are lower-cased and split at white space; a text of
fewer words than a shingle is one shingle. Null and empty texts are copies of
one another and of nothing else. Rows that share a doc_id are one document.
Rows with a null doc_id link nothing. An empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, perhaps_among, release
from .graph import components
from .simhash import BUCKET_ROWS, SEED, bucket_links, gram_hashes, majority

BANDS, ROWS = 20, 5
#: Differing bits of 64 up to which fingerprints are candidates.
RADIUS = 18
#: Most sets and shingles of a component that one task compares; larger ones are split.
CELL, CELL_HASHES = 512, 1 << 20
_BINS = BANDS * ROWS
_EDGES = np.array([(k << 64) // _BINS for k in range(_BINS)], np.uint64)
_RANDOM = np.random.default_rng(SEED)
_PROBES = _RANDOM.integers(0, _BINS, (32, _BINS))
_MIX = _RANDOM.integers(1, 1 << 64, _BINS, np.uint64) | np.uint64(1)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    found = list(gram_hashes(text, size))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of minimum hashes; none for an empty set.

    The hashes are dealt to bins by value, so one sort gives all minima; an
    empty bin takes the minimum of another, looked up in a fixed random order
    and then from left to right.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    at = np.searchsorted(hashes, _EDGES)
    full = at < np.append(at[1:], len(hashes))
    low, have = hashes[np.minimum(at, len(hashes) - 1)], full.copy()
    for probe in _PROBES:
        gaps = np.flatnonzero(~have)
        if not len(gaps):
            break
        taken = full[probe[gaps]]
        low[gaps[taken]] = low[probe[gaps[taken]]]
        have[gaps[taken]] = True
    gaps, there = np.flatnonzero(~have), np.flatnonzero(full)
    low[gaps] = low[there[np.searchsorted(there, gaps) % len(there)]]
    mixed = (low ^ (low >> np.uint64(29))) * _MIX
    return mixed.reshape(ROWS, BANDS).sum(axis=0, dtype=np.uint64).view(np.int64)


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed halves."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes(), SEED), np.int64).tolist())


def sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, h, g, size, fp, bands`` of every row of ``docs``; (h, g) names its set of shingles."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                found = shingles(text.as_py(), size)
                rows.append((*digest(found), len(found), majority([found]), bands(found)))
            cols = [np.array([r[k] for r in rows], t) for k, t in ((0, np.int64), (1, np.int64), (2, np.int64), (3, np.uint64))]
            keys = pa.array([r[4] for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c.view(np.int64)) for c in cols], keys], names=["doc_id", "h", "g", "size", "fp", "bands"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, h long, g long, size long, fp long, bands array<long>")


def forest(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set the position of the first one that it links to, directly or through others."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    marks, root = np.zeros(len(ids), bool), np.arange(n)
    for k in range(n - 1):
        open_ = root[k + 1 :] != root[k]
        if not open_.any():
            continue
        own = ids[starts[k] : starts[k] + sizes[k]]
        marks[own] = True
        common = np.add.reduceat(marks[ids[starts[k + 1] :]], starts[k + 1 :] - starts[k + 1], dtype=np.int32)
        marks[own] = False
        near = open_ & (common / (sizes[k + 1 :] + sizes[k] - common) >= least)
        if near.any():
            joined = np.unique(np.append(root[k + 1 :][near], root[k]))
            root[np.isin(root, joined)] = joined[0]
    return root


def verified(docs: DataFrame, chosen: DataFrame, size: int, least: float) -> DataFrame:
    """Edges ``(u, v)`` that join all sets at ``least`` or above within a candidate component.

    ``chosen`` holds ``rep, h, g, root, parts``: a document of each set, the
    component and the number of chunks that it is split into.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    texts = perhaps_among(texts, "rep", chosen.select("rep")).where("_perhaps").select("rep", "text")
    texts = texts.join(chosen, "rep").select("text", "h", "g", "rep", "root", "parts")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine, sets = [], []
            for k, name in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                found = shingles(b.column(0)[k].as_py(), size)
                if digest(found) == name:  # a doc_id may have several texts
                    mine.append(k)
                    sets.append(found.tobytes())
            rest = b.select(["rep", "root", "parts"]).take(pa.array(mine, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sets, pa.binary())], names=["rep", "root", "parts", "set"])

    sets = texts.mapInArrow(read, "rep long, root long, parts int, set binary")
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts").cast("long")).cast("int")
    cells = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("rep", "set", "root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            reps = np.array([r for r, _ in held], np.int64)
            root = forest([np.frombuffer(s, np.uint64) for _, s in held], least)
            off = root != np.arange(len(root))
            if off.any():
                yield pa.RecordBatch.from_arrays([pa.array(reps[off]), pa.array(reps[root[off]])], names=["u", "v"])

        held, at = [], None
        for b in batches:
            for k, (rep, *cell) in enumerate(zip(*[b.column(n).to_pylist() for n in ("rep", "root", "a", "b")])):
                if cell != at:
                    if len(held) > 1:
                        yield from emit(held)
                    held, at = [], cell
                held.append((rep, b.column(1)[k].as_py()))
        if len(held) > 1:
            yield from emit(held)

    ready = cells.repartition(F.xxhash64("root", "a", "b")).sortWithinPartitions("root", "a", "b")
    return ready.mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """``(node, root)``: each document that has a near copy, and the smallest doc_id of its group."""
    rows = materialize(sketches(docs, size).where("doc_id is not null"), "copies")
    values = rows.groupBy("h", "g").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("size", "fp", "bands")])
    values = materialize(values, "copies-values")
    keys = values.select("fp", "rep", F.lit(0).alias("k"), F.explode("bands").alias("bits"))
    shared = materialize(keys.groupBy("k", "bits").agg(F.count("*").alias("n")).where("n > 1"), "copies-keys")
    met = keys.join(shared.select("k", "bits"), ["k", "bits"])
    found = materialize(components(bucket_links(met, shared.where(F.col("n") > BUCKET_ROWS), RADIUS)), "copies-found")
    near = values.select("rep", "h", "g", "size").join(found.withColumnRenamed("node", "rep"), "rep")
    wanted = F.greatest(F.ceil(F.count("*") / (CELL // 2)), F.ceil(F.sum("size") / (CELL_HASHES // 2)))
    parts = near.groupBy("root").agg(F.when((F.count("*") > CELL) | (F.sum("size") > CELL_HASHES), wanted).otherwise(1).cast("int").alias("parts"))
    chosen = materialize(near.join(parts, "root").select("rep", "h", "g", "root", "parts"), "copies-chosen")
    exact = rows.select("doc_id", "h", "g").join(values.select("h", "g", "rep"), ["h", "g"]).where("doc_id <> rep")
    links = verified(docs, chosen, size, least)
    out = components(links.unionByName(exact.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))))
    release(rows, values, shared, found, chosen)
    return out
