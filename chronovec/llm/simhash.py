"""SimHash near-duplicates (operator 8), found with a Gray-order hierarchical index.

Method. Fingerprints are reduced to distinct values. Values at three or fewer
differing bits agree in all but three of ``m`` bit blocks, so each value is
dealt to one bucket for every choice of ``m - 3`` blocks. Within a bucket the
values are sorted by Gray rank, which puts values with long shared bit
patterns next to each other; runs of 16 form a node that holds the bits on
which all its members agree, 16 nodes form a node above, and so on. A search
walks down from the top, adds only the differences in bits that the parent did
not already count, and drops a whole group once it has more than three.

Scale. Nothing but (value, smallest doc_id) is shuffled after the fingerprint
pass. ``m`` follows the number of distinct values, so that an average bucket
holds a few hundred; a bucket that is larger all the same (many near copies)
is split into pairs of chunks, so every pair of its values still meets in one
task. Values of a bucket beyond ``HOT`` are dealt again by more, smaller
blocks, in which they fall apart. Each bucket emits a forest, never all pairs.

Defined results: a null or empty text has fingerprint zero, which links like
any other. Repeated rows each get a row back. Rows with a null doc_id get the
component of the texts they link to; where a fingerprint occurs with null ids
only, component_id is null. An empty table gives an empty result; other columns
are ignored, whatever their names. Texts are hashed in steps, so their length
is not bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table
from .graph import components

SEED = 42
#: Most values of a bucket that one task compares; larger ones are split.
BUCKET_ROWS = 256
#: Values or nodes under one node of the index.
FAN = 16
#: Values of a bucket beyond which its values are dealt by more blocks instead of being split.
HOT = 4096
#: Blocks are no more than this; what is left in large buckets then is split.
MOST_BLOCKS = 13
_STEP = 1 << 16


def gram_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, repeats included, in bounded steps; nothing for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    size = min(size, n)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n - size + 1 if n else 0, _STEP):
        part = words[lo : lo + _STEP + size - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(part) - size + 1].tolist()
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """64 bits, each 1 if set in over half of the hashes."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits((ones * 2 > total).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, as an unsigned integer."""
    return majority(gram_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``, one row for each row of ``docs``; fp is the signed form of the 64 bits."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected binary order."""
    out = values.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def index_pairs(values: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j in Gray order, of values at ``most`` or fewer differing bits, via the index.

    ``values`` must be sorted by Gray rank.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [(values, values, np.full(len(values), full))]  # AND, OR, agreed bits
    while len(levels[-1][0]) > FAN:
        cuts = np.arange(0, len(levels[-1][0]), FAN)
        low, high = np.bitwise_and.reduceat(levels[-1][0], cuts), np.bitwise_or.reduceat(levels[-1][1], cuts)
        levels.append((low, high, ~(low ^ high)))
    top = len(levels[-1][0])
    q = np.repeat(np.arange(len(values)), top)
    node = np.tile(np.arange(top), len(values))
    seen = np.zeros(len(q), np.int64)
    above = np.zeros(len(q), np.uint64)
    for depth in range(len(levels) - 1, -1, -1):
        low, _, agreed = levels[depth]
        mask = agreed[node]
        seen = seen + np.bitwise_count((values[q] ^ low[node]) & mask & ~above)
        # j > i suffices: a node whose last member is not past q has nothing new
        live = (seen <= most) & ((node + 1) * FAN**depth > q)
        q, node, seen, above = q[live], node[live], seen[live], mask[live]
        if depth:
            wide = len(levels[depth - 1][0])
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            q, seen, above = np.repeat(q, FAN), np.repeat(seen, FAN), np.repeat(above, FAN)
            there = child < wide
            q, node, seen, above = q[there], child[there], seen[there], above[there]
    keep = node > q
    return q[keep], node[keep]


def _forest(fp: np.ndarray, rep: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rep, smallest rep of its local component) of one bucket."""
    values = fp.view(np.uint64)
    order = np.argsort(gray_rank(values), kind="stable")
    values, rep = values[order], rep[order]
    i, j = index_pairs(values, most)
    if not len(i):
        return rep[:0], rep[:0]
    root = rep.copy()
    while True:
        new = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            break
        root = new
    off = root != rep
    return rep[off], root[off]


def dealt(values: DataFrame, blocks: int, most: int) -> DataFrame:
    """``fp, rep, k, bits``: each value once for every choice of all but ``most`` of the bit blocks."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    ones = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(blocks)]
    masks = [sum(ones[k] for k in c) for c in combinations(range(blocks), blocks - most)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(signed)]))
    return values.select("fp", "rep", each.alias("x")).select("fp", "rep", "x.k", "x.bits")


def links(values: DataFrame, distinct_values: int, most: int = 3) -> DataFrame:
    """``values(fp, rep)`` of distinct fingerprints -> edges ``(u, v)`` that join all that link.

    Values that share a hot bucket and link also share a bucket of more
    blocks, so dealing them again loses nothing.
    """
    blocks = next(m for m in range(most + 1, 17) if m == 16 or distinct_values <= (BUCKET_ROWS // 4) << (64 * (m - most) // m))
    values, found = values.where("rep is not null").select("fp", "rep"), []
    while True:
        now = dealt(values, blocks, most)
        large = now.groupBy("k", "bits").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS)
        large = materialize(large, "simhash-large")
        hot = large.where(F.col("n") > HOT).select("k", "bits")
        if blocks + 3 > MOST_BLOCKS or hot.isEmpty():
            found.append(bucket_links(now, large, most))
            return reduce(DataFrame.unionByName, found)
        found.append(bucket_links(now.join(hot, ["k", "bits"], "left_anti"), large, most))
        values = materialize(now.join(hot, ["k", "bits"]).select("fp", "rep").distinct(), "simhash-hot")
        blocks += 3


def bucket_links(rows: DataFrame, large: DataFrame, most: int) -> DataFrame:
    """Edges ``(u, v)`` that join all of ``rows(fp, rep, k, bits)`` at ``most`` or fewer bits within a bucket.

    ``large(k, bits, n)`` names the buckets over ``BUCKET_ROWS``.
    """
    large = large.select("k", "bits", F.ceil(F.col("n") / (BUCKET_ROWS // 2)).cast("int").alias("parts"))
    split = rows.join(large, ["k", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", "rep", F.lit(7)), F.col("parts").cast("long")).cast("int")
    split = split.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.select("fp", "rep", "k", "bits", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    key = F.xxhash64("k", "bits", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(fp: np.ndarray, rep: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            cut = np.concatenate(([0], cut, [len(fp)]))
            us, vs = [], []
            for g in np.flatnonzero(np.diff(cut) > 1):
                u, v = _forest(fp[cut[g] : cut[g + 1]], rep[cut[g] : cut[g + 1]], most)
                if len(u):
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(n).to_numpy(zero_copy_only=False) for n in ("fp", "rep")]
            ids = np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("k", "bits", "a", "b")], axis=1)
            if rest:
                cols = [np.concatenate(x) for x in zip(rest[:2], cols)]
                ids = np.concatenate((rest[2], ids))
            last = np.flatnonzero((ids != ids[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from emit(cols[0][:cut], cols[1][:cut], ids[:cut])
            rest = (cols[0][cut:].copy(), cols[1][cut:].copy(), ids[cut:].copy())
        if rest:
            yield from emit(*rest)

    return split.repartition(key).sortWithinPartitions("k", "bits", "a", "b").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row for each row of ``docs``."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    values = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-values")
    roots = components(links(values, values.count(), most))
    named = values.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id")
    )
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
