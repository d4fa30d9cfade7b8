"""Exact substring dedup (operator 2): interval expansion on a Burrows-Wheeler transform.

Contract. Texts are UTF-8 bytes. A byte goes if it lies in a string of
``LENGTH`` bytes that also starts in a document with a smaller doc_id.

Method. Strings that share their first ``LENGTH`` bytes are the intervals of a
sorted suffix list whose common prefixes reach ``LENGTH``. The common prefixes
are derived from the Burrows-Wheeler transform alone: intervals of prefix
length l are extended backwards by one symbol to those of length l + 1,
breadth first, so values come in increasing order; intervals of one suffix are
dropped, and at ``LENGTH`` the expansion stops. What is left are the groups of
equal strings, and the smallest doc_id of each group decides.

Spreading the work. Every window of ``LENGTH`` bytes has a minimizer, the
26-byte string inside it with the smallest hash, so equal windows have equal
minimizers. (1) Blocks of whole documents emit the hashes of their minimizers,
each once, and get back one bit each: does another document have it? (2) Runs
of windows whose minimizer is shared are cut out as segments, equal segments
of a block are combined, and they meet by minimizer, where the transform of
those that differ is built, a bounded piece at a time. (3) The smallest
doc_id of each window goes back to the block, which cuts its texts.

Skew. A passage that very many documents share is sent once by each block, and
once by each ``FAN`` blocks where there are more. A minimizer with more than
``HOT`` occurrences is not kept together: its windows are dealt singly, by
their whole content.

Defined results: a null or empty text has no bytes. Rows that share a doc_id
are one document to the others and never dedup each other. Rows with a null
doc_id neither lose bytes nor cause others to. An empty table gives an empty
result; other columns are ignored, whatever their names. A text longer than a
block is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table

LENGTH = 50
KMER = 26
SPAN = LENGTH - KMER + 1
#: Bytes of text in a block; a longer document is a block of its own.
BLOCK = 4 << 20
#: Bytes of text for each bucket of minimizers.
BUCKET = 8 << 20
LEAST_BUCKETS = 64
#: Occurrences beyond which the windows of a minimizer are dealt singly.
HOT = 5000
#: Blocks beyond which those that share a bucket are combined in parts, each of so many or so.
FAN = 4096
#: Windows of a segment at most, and bytes of segments whose transform is built at a time.
RUN = 1024
PIECE = 2 << 20
_STEP = 1 << 16
#: Symbols that fit one sort key.
START = 7
_MULT = 0x9E3779B97F4A7C15
_WORDS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# ---- minimizers ----


def minimizers(buf: np.ndarray) -> np.ndarray:
    """For each window of ``LENGTH`` bytes the smallest hash of its ``KMER``-byte strings."""
    out = np.zeros(max(len(buf) - LENGTH + 1, 0), np.uint64)
    power = lambda k: np.uint64(pow(_MULT, k, 1 << 64))
    for lo in range(0, len(out), _STEP):
        part = buf[lo : lo + _STEP + LENGTH - 1]
        h1 = _WORDS[part]
        h2 = h1[:-1] * power(1) + h1[1:]
        h4 = h2[:-2] * power(2) + h2[2:]
        h8 = h4[:-4] * power(4) + h4[4:]
        n = len(part) - KMER + 1
        x = h8[:n] * power(8) + h8[8 : 8 + n]
        x = x * power(8) + h8[16 : 16 + n]
        x = x * power(2) + h2[24 : 24 + n]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        for k in (1, 2, 4, 8):
            x = np.minimum(x[:-k], x[k:])
        out[lo : lo + _STEP] = np.minimum(x[: len(x) - SPAN + 16], x[SPAN - 16 :])
    return out


class Block:
    """Whole documents, one after the other."""

    def __init__(self, ids: list, sizes: list[int], data: bytes) -> None:
        self.ids, self.sizes, self.data = ids, np.array(sizes, np.int64), data
        self.buf = np.frombuffer(data, np.uint8)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        own = minimizers(self.buf)
        windows = np.zeros(len(own) + 1, np.int32)
        use = (self.sizes >= LENGTH) & np.array([i is not None for i in ids], bool)
        np.add.at(windows, self.starts[use], 1)
        np.add.at(windows, self.starts[use] + self.sizes[use] - LENGTH + 1, -1)
        valid = np.cumsum(windows[:-1]) > 0
        before = np.concatenate(([False], valid[:-1]))
        change = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
        first = np.flatnonzero(valid & (~before | change))
        last = np.flatnonzero(valid & np.concatenate((~valid[1:] | change[1:], [True]))) if len(own) else first
        size = last - first + 1
        if len(size) and size.max() > RUN:
            times = -(-size // RUN)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            first, size = np.repeat(first, times) + nth * RUN, np.minimum(np.repeat(size, times) - nth * RUN, RUN)
        #: Runs of windows with one minimizer: first window, windows, hash, document.
        self.first, self.size, self.hash = first, size, own[first]
        self.doc = np.searchsorted(self.starts, first, "right") - 1
        while len(self.doc) and (empty := self.sizes[self.doc] == 0).any():
            self.doc[empty] -= 1
        self.numbers = np.array([i if i is not None else 0 for i in ids], np.int64)

    def distinct(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes by bucket, their buckets, and the place of each run's hash among them."""
        values, back = np.unique(self.hash, return_inverse=True)
        bucket = ((values >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return values[order], bucket[order], place[back.ravel()]

    def segments(self, shared: np.ndarray, hot: np.ndarray, buckets: int) -> tuple:
        """Distinct segments by bucket, with key, bucket and smallest doc_id; for each run of windows its segment.

        ``shared`` and ``hot`` are by run. Returns (texts, keys, buckets, low), (segment, first, windows, document).
        """
        some = np.flatnonzero(shared)
        single = some[hot[some]]
        whole = some[~hot[some]]
        each = self.size[single]
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        first = np.concatenate((self.first[whole], np.repeat(self.first[single], each) + nth))
        size = np.concatenate((self.size[whole], np.ones(len(nth), np.int64)))
        doc = np.concatenate((self.doc[whole], np.repeat(self.doc[single], each)))
        data, known = self.data, {}
        cut = [data[a:b] for a, b in zip(first.tolist(), (first + size + LENGTH - 1).tolist())]
        seg = np.fromiter((known.setdefault(s, len(known)) for s in cut), np.int64, len(cut))
        texts = list(known)
        key = np.zeros(len(texts), np.uint64)
        key[seg[: len(whole)]] = self.hash[whole]
        alone = np.unique(seg[len(whole) :])
        key[alone] = [xxhash.xxh64_intdigest(texts[k]) for k in alone.tolist()]
        low = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(low, seg, self.numbers[doc])
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return ([texts[k] for k in order.tolist()], key[order], bucket[order], low[order]), (place[seg], first, size, doc)


# ---- the transform ----


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols at least (symbols under 512), and their first ``START`` symbols."""
    n = len(codes)
    padded = np.concatenate((codes.astype(np.int64), np.zeros(8, np.int64)))
    start = np.zeros(n, np.int64)
    for k in range(START):
        start = (start << 9) | padded[k : k + n]
    key, done = start, START
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if done >= depth or rank[order[-1]] == n - 1:
            return order, start[order]
        after = np.concatenate((rank[done:] + 1, np.zeros(min(done, n), np.int64)))[:n]
        key = rank * (n + 2) + after
        done *= 2


def expand(bwt: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """True where a suffix shares fewer than ``length`` symbols with the one before it.

    Breadth-first backward extension: an interval of prefix length l + 1 is
    the image, under one more symbol in front, of part of one of length l.
    Level l + 1 thus splits what lies in one interval of level l wherever the
    rows it comes from lie in different ones. Rows alone in their interval
    take no further part. The first ``START`` levels are read off the first
    symbols (``start``, in suffix order) at once.
    """
    n = len(bwt)
    source = np.argsort(bwt, kind="stable").astype(np.int32)  # row of each sorted suffix's rest
    split = np.concatenate(([True], start[1:] != start[:-1]))
    low = np.maximum.accumulate(np.where(split, np.arange(n, dtype=np.int32), 0))  # interval of each row, by its first row
    live = np.flatnonzero(~split)
    before, here = source[live - 1], source[live]
    for _ in range(START, length):
        if not len(live):
            break
        apart = low[before] != low[here]
        found = live[apart]
        split[found] = True
        keep = ~apart
        live, before, here = live[keep], before[keep], here[keep]
        low[found] = found
        first = np.concatenate(([True], live[1:] != live[:-1] + 1)) if len(live) else np.zeros(0, bool)
        low[live] = np.maximum.accumulate(np.where(first, live - 1, 0))
    return split


def window_minima(texts: list[bytes], low: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each segment the smallest ``low`` of the segments that hold the same window."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes + 1)
    codes = np.zeros(ends[-1], np.uint16)  # zero ends a segment
    place = np.ones(len(codes), bool)
    place[ends - 1] = False
    codes[place] = data.astype(np.uint16) + 1
    order, start = suffix_order(codes, length + 1)
    split = expand(codes[order - 1], start, length)
    heads = np.flatnonzero(split)
    owner = np.repeat(low, sizes + 1)
    best = np.empty(len(codes), np.int64)
    best[order] = np.repeat(np.minimum.reduceat(owner[order], heads), np.diff(np.append(heads, len(codes))))
    return [best[e - 1 - s : e - length] for e, s in zip(ends.tolist(), sizes.tolist())]


# ---- the tasks ----


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        ids, parts, size = [], [], 0

        def emit() -> pa.RecordBatch:
            sizes = [len(p) for p in parts]
            return pa.RecordBatch.from_arrays(
                [pa.array([base + n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([_pack(b"".join(parts))], pa.binary())],
                names=["block", "ids", "sizes", "data"],
            )

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = (t or "").encode("utf-8", "surrogatepass")
                if parts and max(size, len(data)) >= BLOCK:
                    yield emit()
                    n += 1
                    ids, parts, size = [], [], 0
                ids.append(i)
                parts.append(data)
                size += len(data)
        if parts:
            yield emit()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "block long, ids array<long>, sizes array<long>, data binary")


def _read(b: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    for k in range(b.num_rows):
        yield b.column("block")[k].as_py(), Block(b.column("ids")[k].as_py(), b.column("sizes")[k].as_py(), _unpack(b.column("data")[k].as_py()))


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array of buckets."""
    cut = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b > a:
            yield int(bucket[a]), a, b


def _emit_hashes(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, docs in _read(b):
            values, bucket, place = docs.distinct(buckets)
            times = np.minimum(np.bincount(place, minlength=len(values)), 65535).astype("<u2")
            ids = docs.numbers[docs.doc]
            least, most = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), np.iinfo(np.int64).min)
            np.minimum.at(least, place, ids)
            np.maximum.at(most, place, ids)
            several = least < most
            rows = [(k, block, values[x:y].astype("<u4").tobytes(), _pack(times[x:y].tobytes() + np.packbits(several[x:y]).tobytes())) for k, x, y in _slices(bucket)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["bucket", "block", "hashes", "more"])


def _summed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of some blocks in order, the place of each row's hashes among them, which occur in another document, and how often."""
    hashes = [np.frombuffer(x, "<u4") for x in rows.column("hashes").to_pylist()]
    more = [_unpack(x) for x in rows.column("more").to_pylist()]
    sizes = [len(h) for h in hashes]
    times = np.concatenate([np.frombuffer(m[: 2 * n], "<u2") for m, n in zip(more, sizes)]).astype(np.int64)
    several = np.concatenate([np.unpackbits(np.frombuffer(m[2 * n :], np.uint8))[:n] for m, n in zip(more, sizes)]).astype(bool)
    found, back, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    back = back.ravel()
    shared = count > 1
    np.logical_or.at(shared, back, several)
    return found, back, shared, np.bincount(back, weights=times)


def _answers(rows: pa.Table, shared: np.ndarray, hot: np.ndarray) -> pa.Table:
    """Bits for the hashes of each block, which follow one another in ``shared`` and ``hot``."""
    sizes = [len(x) // 4 for x in rows.column("hashes").to_pylist()]
    cut = np.cumsum([0, *sizes])
    masks = [(np.packbits(shared[a:b]).tobytes(), np.packbits(hot[a:b]).tobytes() if hot[a:b].any() else b"") if shared[a:b].any() else (b"", b"") for a, b in zip(cut[:-1], cut[1:])]
    return pa.table({"bucket": rows.column("bucket"), "block": rows.column("block"), "n": pa.array(sizes, pa.int64()), "shared": pa.array([m[0] for m in masks], pa.binary()), "hot": pa.array([m[1] for m in masks], pa.binary())})


def _share(rows: pa.Table) -> pa.Table:
    """Which hashes of each block occur in another document, and which occur very often."""
    _, back, shared, times = _summed(rows)
    return _answers(rows, shared[back], (shared & (times > HOT))[back])


def _combine_hashes(rows: pa.Table) -> pa.Table:
    """The blocks of a part as one."""
    found, _, shared, times = _summed(rows)
    more = _pack(np.minimum(times, 65535).astype("<u2").tobytes() + np.packbits(shared).tobytes())
    return pa.table({"bucket": rows.column("bucket")[:1], "block": rows.column("part")[:1], "hashes": pa.array([found.astype("<u4").tobytes()], pa.binary()), "more": pa.array([more], pa.binary())})


def _spread_shared(rows: pa.Table, found: pa.Table) -> pa.Table:
    """The answer to a part, for each of its blocks."""
    _, back, _, _ = _summed(rows)
    shared, hot = _masks(found.to_pylist())
    return _answers(rows, shared[back], hot[back])


def _masks(found: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Shared and hot, by distinct hash of the block in bucket order."""
    shared, hot = [np.zeros(0, bool)], [np.zeros(0, bool)]
    for m in sorted(found or [], key=lambda m: m["bucket"]):
        for out, bits in ((shared, m["shared"]), (hot, m["hot"])):
            out.append(np.unpackbits(np.frombuffer(bits, np.uint8))[: m["n"]].astype(bool) if bits else np.zeros(m["n"], bool))
    return np.concatenate(shared), np.concatenate(hot)


def _cut(docs: Block, masks: list | None, buckets: int) -> tuple:
    _, _, place = docs.distinct(buckets)
    shared, hot = _masks(masks)
    return docs.segments(shared[place], hot[place], buckets)


def _emit_segments(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        masks = b.column("masks").to_pylist()
        for k, (block, docs) in enumerate(_read(b)):
            (texts, key, bucket, low), _ = _cut(docs, masks[k], buckets)
            rows = []
            for at, x, y in _slices(bucket):
                sizes = np.array([len(t) for t in texts[x:y]], "<u4")
                rows.append((at, block, _pack(b"".join(texts[x:y])), _pack(sizes.tobytes()), key[x:y].astype("<u4").tobytes(), _pack(low[x:y].astype("<i8").tobytes())))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["bucket", "block", "texts", "sizes", "keys", "low"])


def _distinct_segments(rows: pa.Table) -> tuple[list[bytes], list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct segments of some blocks, the places of each block's among them, their keys and smallest doc_ids."""
    known: dict[bytes, int] = {}
    keys, lows, segs = [], [], []
    for texts, sizes, key, low in zip(*(rows.column(n).to_pylist() for n in ("texts", "sizes", "keys", "low"))):
        data = _unpack(texts)
        ends = np.cumsum(np.frombuffer(_unpack(sizes), "<u4")).tolist()
        segs.append(np.fromiter((known.setdefault(data[a:e], len(known)) for a, e in zip([0, *ends[:-1]], ends)), np.int64, len(ends)))
        keys.append(np.frombuffer(key, "<u4"))
        lows.append(np.frombuffer(_unpack(low), "<i8"))
    texts = list(known)
    seg = np.concatenate(segs)
    low = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(low, seg, np.concatenate(lows))
    key = np.zeros(len(texts), np.uint32)
    key[seg] = np.concatenate(keys)
    return texts, segs, key, low


def _minima(rows: pa.Table, segs: list[np.ndarray], low: np.ndarray, windows: dict[int, np.ndarray]) -> pa.Table:
    """For each block a bit for each of its segments whose windows differ, the smallest doc_id of each, and then those of the windows that differ."""
    varied, out = np.zeros(len(low), bool), []
    varied[np.fromiter(windows, np.int64, len(windows))] = True
    for own in segs:
        values = np.concatenate([low[own], *[windows[k] for k in own[varied[own]].tolist()]])
        out.append(_pack(np.packbits(varied[own]).tobytes() + values.astype("<i8").tobytes()))
    return pa.table({"bucket": rows.column("bucket"), "block": rows.column("block"), "minima": pa.array(out, pa.binary())})


def _read_minima(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_minima`` says of ``n`` segments: which differ, the smallest doc_ids, those of the windows."""
    data = _unpack(data)
    bits = -(-n // 8)
    values = np.frombuffer(data, "<i8", offset=bits)
    return np.unpackbits(np.frombuffer(data, np.uint8, bits))[:n].astype(bool), values[:n], values[n:]


def _combine_segments(rows: pa.Table) -> pa.Table:
    """The blocks of a part as one; segments in order."""
    texts, _, key, low = _distinct_segments(rows)
    order = sorted(range(len(texts)), key=texts.__getitem__)
    sizes = np.array([len(texts[k]) for k in order], "<u4")
    cols = [_pack(b"".join(texts[k] for k in order)), _pack(sizes.tobytes()), key[order].astype("<u4").tobytes(), _pack(low[order].astype("<i8").tobytes())]
    named = {n: pa.array([c], pa.binary()) for n, c in zip(("texts", "sizes", "keys", "low"), cols)}
    return pa.table({"bucket": rows.column("bucket")[:1], "block": rows.column("part")[:1], **named})


def _spread_minima(rows: pa.Table, found: pa.Table) -> pa.Table:
    """The answer to a part, for each of its blocks."""
    texts, segs, _, _ = _distinct_segments(rows)
    order = sorted(range(len(texts)), key=texts.__getitem__)
    varied, even, answer = _read_minima(found.column("minima")[0].as_py(), len(texts))
    low, at, windows = np.empty(len(texts), np.int64), 0, {}
    low[order] = even
    for k, differs in zip(order, varied.tolist()):
        if differs:
            width = len(texts[k]) - LENGTH + 1
            windows[k] = answer[at : at + width]
            at += width
    return _minima(rows, segs, low, windows)


def _meet(rows: pa.Table) -> pa.Table:
    """Smallest doc_id for the windows of all segments of a bucket.

    Segments that no other of their minimizer differs from need no transform:
    equal segments have been combined.
    """
    texts, segs, key, low = _distinct_segments(rows)
    order = np.argsort(key, kind="stable")
    cut = np.concatenate(([0], np.flatnonzero(key[order][1:] != key[order][:-1]) + 1, [len(order)]))
    windows: dict[int, np.ndarray] = {}
    some: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal some, size
        if some:
            for k, m in zip(some, window_minima([texts[k] for k in some], low[some])):
                if (m != low[k]).any():
                    windows[k] = m
        some, size = [], 0

    for g in np.flatnonzero(np.diff(cut) > 1).tolist():
        own = order[cut[g] : cut[g + 1]].tolist()
        some += own
        size += sum(len(texts[k]) for k in own)
        if size >= PIECE:
            flush()
    flush()
    return _minima(rows, segs, low, windows)


def _answered(rows: DataFrame, parts: int, meet: Callable, combine: Callable, spread: Callable, answer: str) -> DataFrame:
    """``meet`` over the rows of each bucket, of which a block has one.

    With several parts, the blocks of a part are first combined to one row, in
    which what they share is held once, and its answer goes back to them: no
    group holds more than ``FAN`` rows or so, however many blocks share a passage.
    """
    if parts == 1:
        return rows.groupBy("bucket").applyInArrow(meet, answer)
    dealt = materialize(rows.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts))), "dedup-parts")
    met = dealt.groupBy("bucket", "part").applyInArrow(combine, rows.schema).groupBy("bucket").applyInArrow(meet, answer)
    return dealt.groupBy("bucket", "part").cogroup(met.withColumnRenamed("block", "part").groupBy("bucket", "part")).applyInArrow(spread, answer)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _finish(batches: Iterator[pa.RecordBatch], buckets: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        masks, minima = b.column("masks").to_pylist(), b.column("minima").to_pylist()
        for k, (_, docs) in enumerate(_read(b)):
            cover = np.zeros(len(docs.buf) + 1, np.int32)
            if minima[k]:
                (texts, _, bucket, _), (seg, first, size, doc) = _cut(docs, masks[k], buckets)
                found = {m["bucket"]: m["minima"] for m in minima[k]}
                width = np.array([len(t) - LENGTH + 1 for t in texts], np.int64)
                even, varied, flat = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool), []
                for at, x, y in _slices(bucket):
                    varied[x:y], even[x:y], windows = _read_minima(found[at], y - x)
                    flat.append(windows)
                flat = np.concatenate(flat)
                offset = np.zeros(len(texts), np.int64)
                offset[varied] = np.concatenate(([0], np.cumsum(width[varied])[:-1])) if varied.any() else []
                own = docs.numbers[doc]
                gone = ~varied[seg] & (even[seg] < own)
                np.add.at(cover, first[gone], 1)
                np.add.at(cover, first[gone] + size[gone] + LENGTH - 1, -1)
                rest = np.flatnonzero(varied[seg])
                if len(rest):
                    n = size[rest]
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    hit = flat[np.repeat(offset[seg[rest]], n) + nth] < np.repeat(own[rest], n)
                    at = (np.repeat(first[rest], n) + nth)[hit]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + LENGTH, -1)
            removed = np.cumsum(cover[:-1]) > 0
            rows = []
            for i, lo, n in zip(docs.ids, docs.starts.tolist(), docs.sizes.tolist()):
                r = removed[lo : lo + n]
                count = int(r.sum())
                kept = docs.data[lo : lo + n] if not count else docs.buf[lo : lo + n][~r].tobytes()
                spans = int(r[0]) + int((r[1:] & ~r[:-1]).sum()) if count else 0
                rows.append((i, n, count, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for each row; ``kept`` is null unless asked for."""
    blocks = materialize(_blocks(docs, id_col, text_col), "dedup-blocks")
    total, count = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.count("*")).first()
    buckets, parts = max(LEAST_BUCKETS, -(-(total or 0) // BUCKET)), max(1, -(-count // FAN))
    hashes = blocks.mapInArrow(lambda it: _emit_hashes(it, buckets), "bucket long, block long, hashes binary, more binary")
    shared = _answered(hashes, parts, _share, _combine_hashes, _spread_shared, "bucket long, block long, n long, shared binary, hot binary")
    masks = materialize(shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "shared", "hot")).alias("masks")), "dedup-masks")
    marked = blocks.join(masks, "block")
    segments = marked.mapInArrow(lambda it: _emit_segments(it, buckets), "bucket long, block long, texts binary, sizes binary, keys binary, low binary")
    met = _answered(segments, parts, _meet, _combine_segments, _spread_minima, "bucket long, block long, minima binary")
    minima = materialize(met.groupBy("block").agg(F.collect_list(F.struct("bucket", "minima")).alias("minima")), "dedup-minima")
    full = blocks.join(masks, "block", "left").join(minima, "block", "left")
    return full.mapInArrow(lambda it: _finish(it, buckets, with_text), _RESULT)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What each document loses to documents with smaller ids."""
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def plain_dedup(rows: list[tuple], length: int = LENGTH) -> list[tuple]:
    """Brute force for tests: (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows."""
    first: dict[bytes, int] = {}
    data = [(i, (t or "").encode("utf-8", "surrogatepass")) for i, t in rows]
    for i, t in data:
        if i is not None:
            for k in range(len(t) - length + 1):
                s = t[k : k + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1) if i is not None else ():
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
