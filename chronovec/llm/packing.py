"""Packing into fixed-length sequences (operator 6) by a configuration linear program.

Method. The program has a variable for every way to fill a sequence
(a configuration) and asks that the configurations cover the length histogram
with as few sequences as possible. It is solved by multiplicative weights:
each round prices the lengths by how little of their demand is covered yet, a
knapsack dynamic program finds the configuration worth most at those prices,
and the covered lengths lose weight. The fractional solution is rounded down,
and what is left, with the room in the chosen sequences, is filled best-fit:
always the longest piece that still fits.

Scale. Only the histogram (at most ``CAPACITY`` rows) reaches the driver, and
only a plan over lengths goes back, with at most a few entries for each
configuration and length. Pieces get their number within their length from
counts by (task, length), so no length, however common, is ranked in one task.

Defined results: a null or empty text is one piece that holds the end id
alone. Repeated rows are packed one by one. Null ids pass through. An empty
table gives an empty result; other columns are ignored, whatever their names.
Long texts are cut into pieces; words of any length are tokenized whole, or in
parts where no token can cross the cut, and only short ones are remembered.
"""

from __future__ import annotations

import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table

CAPACITY = 4096
END_ID = 1
#: Lengths are rounded up to a multiple of this for the program; the rounding reads the true lengths.
UNIT = 16
#: Rounds of the program at most, and the gap to its lower bound at which it stops.
ROUNDS, GAP = 1200, 0.005
#: When a configuration is rounded, pieces of up to so many units go where they fit best.
SHORT_UNITS = 8
#: Bytes of words, ids and table entries that a worker remembers; when full, words not used lately go.
CACHE_BYTES = 192 << 20
#: Bytes that a table entry takes besides the word and its ids.
ENTRY_BYTES = 150
#: Longer words (bytes) are not remembered.
LONG = 64
#: Longer ones still are cut next to digits, where no token goes on.
CUT = 1 << 14
#: Characters of text that are looked up, and words that are tokenized, at a time.
CACHE_TEXT = 1 << 20
ENCODE_WORDS = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_DIGIT = re.compile("[0-9]")


def _worker_memory(name: str) -> dict:
    """A dictionary that lives as long as this Python worker, over all its tasks."""
    holder = sys.modules.setdefault("_chronovec_worker", types.ModuleType("_chronovec_worker"))
    return holder.__dict__.setdefault(name, {})


def _letters(s: str) -> bool:
    """Whether the tokenizer's normal form of a string is letters only."""
    return s.isalpha() and (s.isascii() or (unicodedata.is_normalized("NFC", s) and s.lower().isalpha()))


def _gaps(found: list) -> list[int]:
    """Places of None."""
    out, k = [], -1
    try:
        while True:
            k = found.index(None, k + 1)
            out.append(k)
    except ValueError:
        return out


class WordIds:
    """The ids of texts, by way of the ids of their words.

    The tokenizer never joins or changes words across ASCII white space, nor
    between a letter and a single full stop or comma at a word's end, and it
    folds case in all but its special tokens. So a text falls into words whose
    ids follow one another, and each distinct word is tokenized once, many at
    a time. Texts in which lower case would make a special token keep their case.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        kept = _worker_memory(path)
        if not kept:
            encoder = Tokenizer.from_file(path)
            vocab = encoder.get_vocab()
            ends = np.zeros(max(vocab.values()) + 1, bool)
            ends[[k for w, k in vocab.items() if w.endswith("</w>")]] = True
            stops = {c: np.array(encoder.encode(c.decode(), add_special_tokens=False).ids, "<u4").tobytes() for c in (b".", b",")}
            special = [t.content.encode() for t in encoder.get_added_tokens_decoder().values()]
            kept |= {"encoder": encoder, "ends": ends, "known": {}, "older": {}, "stops": stops, "special": special, "size": 0}
        self.kept = kept
        self.encoder, self.ends, self.known, self.older, self.stops = (kept[k] for k in ("encoder", "ends", "known", "older", "stops"))

    def _words(self, text: str | None) -> list[bytes]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        low = raw.lower()
        if b"|" in raw and any(low.count(t.lower()) != raw.count(t) or t != t.lower() for t in self.kept["special"]):
            low = raw
        return low.split()

    def _encode(self, s: str) -> bytes:
        """The ids of one word; a very long one in parts that begin or end at a digit, which is a token of its own."""
        if len(s) <= CUT:
            return np.array(self.encoder.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        out, lo = [], 0
        while lo < len(s):
            m = _DIGIT.search(s, lo + CUT)
            hi = m.start() if m else len(s)
            out.append(np.array(self.encoder.encode(s[lo:hi], add_special_tokens=False).ids, "<u4").tobytes())
            lo = hi
        return b"".join(out)

    def _learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Remember short words; the ids of long ones are returned."""
        if self.kept["size"] + sum(map(len, new)) + len(new) * ENTRY_BYTES > CACHE_BYTES // 2:  # words in use move on from the older half
            self.older.clear()
            self.older |= self.known
            self.known.clear()
            self.kept["size"] = 0
        known, older = self.known, self.older
        plain, texts, other, stopped, long = [], [], [], [], {}
        for w in new:
            if w in older:
                known[w] = older[w]
                continue
            s = w.decode("utf-8", "surrogatepass")
            if len(w) > LONG:
                long[w] = self._encode(s)
                continue
            if s[-1] in ".," and _letters(s[:-1]):  # letters, then one stop, which has an id of its own
                stopped.append(w)
                w, s = w[:-1], s[:-1]
                if w in known or w in older:
                    continue
            if _letters(s):
                plain.append(w)
                texts.append(s)
            else:
                other.append((w, s))
        for at in range(0, len(plain), ENCODE_WORDS):
            words, some = plain[at : at + ENCODE_WORDS], texts[at : at + ENCODE_WORDS]
            # each is one run of letters, so it ends with the one token that ends a word
            ids = np.array(self.encoder.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts, raw, lo = (np.flatnonzero(self.ends[ids]) + 1) * 4, ids.tobytes(), 0
            if len(cuts) != len(some):
                other += zip(words, some)
                continue
            for w, hi in zip(words, cuts.tolist()):
                known[w] = raw[lo:hi]
                lo = hi
        for w, s in other:
            known[w] = self._encode(s)
        for w in stopped:
            stem = w[:-1]
            known[w] = (known[stem] if stem in known else older[stem]) + self.stops[w[-1:]]
        self.kept["size"] += sum(2 * len(w) + ENTRY_BYTES for w in new if len(w) <= LONG)
        return long

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and size < CACHE_TEXT:
                size += len(texts[hi] or "")
                hi += 1
            parts = [self._words(t) for t in texts[lo:hi]]
            found = [list(map(self.known.get, p)) for p in parts]
            gaps = [_gaps(f) for f in found]
            new = {p[k] for p, g in zip(parts, gaps) for k in g}
            long = self._learn(new) if new else {}
            for p, f, g in zip(parts, found, gaps):
                for k in g:
                    f[k] = self.known[p[k]] if len(p[k]) <= LONG else long[p[k]]
                yield b"".join(f)
            lo = hi


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, rank, task)``; rank counts the pieces of a length within a task."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        end = np.uint32(end_id).astype("<u4").tobytes()
        task, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows = []
            for k, ids in enumerate(words.ids(b.column(1).to_pylist())):
                ids += end
                for n, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    size = len(part) // 4
                    rows.append((k, n, lo // 4, size, zlib.crc32(part), ranks[size]))
                    ranks[size] += 1
            k, *cols = zip(*rows) if rows else [()] * 6
            out = [pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(k, pa.int64())), *out, pa.array(np.full(len(k), task, np.int64))], names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"]
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, task long")


def solve(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Configurations over rounded lengths with the (fractional) times each is used.

    The prices of a round, over the worth of its best configuration, bound the
    program from below; rounds end once the covering is within ``GAP`` of that.
    """
    room = capacity // UNIT
    demand = np.zeros(room + 1)
    for length, n in counts.items():
        demand[-(-length // UNIT)] += n
    kinds = np.flatnonzero(demand)
    if not len(kinds):
        return []
    need = demand[kinds]
    weight, covered = np.ones(len(kinds)), np.zeros(len(kinds))
    used: dict[tuple, float] = {}
    spent, bound = 0.0, 0.0
    for _ in range(rounds):
        price, total = weight / need, weight.sum()
        best, pick = np.zeros(room + 1), np.full(room + 1, -1)
        for c in range(int(kinds[0]), room + 1):
            fits = np.searchsorted(kinds, c, "right")
            values = price[:fits] + best[c - kinds[:fits]]
            k = int(values.argmax())
            best[c], pick[c] = (values[k], k) if values[k] > best[c - 1] else (best[c - 1], -2)
        take, c = np.zeros(len(kinds)), room
        while c > 0 and pick[c] != -1:
            if pick[c] == -2:
                c -= 1
            else:
                take[pick[c]] += 1
                c -= int(kinds[pick[c]])
        some = take > 0
        step = (need[some] / take[some]).min()
        gain = take * step / need
        covered += gain
        weight *= np.exp(-0.5 * gain)
        weight /= weight.max()
        key = tuple((int(kinds[k]), int(take[k])) for k in np.flatnonzero(some))
        used[key] = used.get(key, 0.0) + step
        spent, bound = spent + step, max(bound, total / best[room])
        if covered.min() > 0 and spent / covered.min() <= (1 + GAP) * bound:
            break
    scale = 1 / max(np.average(covered, weights=need * kinds), 1e-9)
    return [(dict(k), v * scale) for k, v in sorted(used.items(), key=lambda x: -x[1])]


def round_plan(counts: dict[int, int], configurations: list, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of sequences for true lengths: ``[({length: pieces}, sequences)]`` that use up ``counts``."""
    left = np.zeros(capacity + 2, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[dict[int, int], int]] = []

    def longest(most: int) -> int:
        found = np.flatnonzero(left[1 : most + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def fill(start: dict[int, int], times: int) -> None:
        """Best-fit what is left into ``times`` sequences that hold ``start`` already."""
        stack = [(start, times)]
        while stack:
            held, times = stack.pop()
            room = capacity - sum(k * v for k, v in held.items())
            while room and (length := longest(room)):
                fit = min(room // length, max(1, int(left[length]) // times))
                now = times if left[length] >= times else int(left[length])
                if now < times:
                    stack.append((dict(held), times - now))
                    times, fit = now, 1
                held[length] = held.get(length, 0) + fit
                left[length] -= fit * times
                room -= fit * length
            plan.append((held, times))

    for config, often in configurations:
        times = int(often)
        while times > 0:
            held: dict[int, int] = {}
            most = times
            # short pieces, and one of the shortest kind, are placed by the best fit, which wastes less
            last, long = min(config), max(config) > SHORT_UNITS
            for unit, n in config.items():
                for _ in range(0 if long and unit <= SHORT_UNITS else n - (unit == last)):
                    low, top = (unit - 1) * UNIT + 1, min(unit * UNIT, capacity)
                    spare = [k for k in range(top, low - 1, -1) if left[k] > held.get(k, 0)]
                    if not spare:
                        most = 0
                        break
                    held[spare[0]] = held.get(spare[0], 0) + 1
                if not most:
                    break
            if not most or not held:
                break
            most = min(most, *(int(left[k]) // v for k, v in held.items()))
            for k, v in held.items():
                left[k] -= v * most
            fill(held, most)
            times -= most
    while length := longest(capacity):
        times = int(left[length])
        left[length] = 0
        per = capacity // length
        if times >= per:
            fill({length: per}, times // per)
        if times % per:
            fill({length: times % per}, 1)
    return plan


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, id_col, text_col, tokenizer, capacity, end_id), "pieces")
    by_task = materialize(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = round_plan(counts, solve(counts, capacity), capacity)
    slots: dict[int, list] = {}
    sequence, filled = 0, {}
    for held, times in plan:
        at = 0
        for length, n in held.items():
            first = filled.get(length, 0)
            slots.setdefault(length, []).append((first, n, at, sequence))
            filled[length] = first + n * times
            at += n * length
        sequence += times
    tables = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in slots.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            seq, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                rows, t = np.flatnonzero(length == size), tables.value[int(size)]
                x = t[np.searchsorted(t[:, 0], rank[rows], "right") - 1]
                own = rank[rows] - x[:, 0]
                seq[rows] = x[:, 3] + own // x[:, 1]
                at[rows] = x[:, 2] + own % x[:, 1] * size
            names = b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(seq), pa.array(at)], names=[*names, "sequence_id", "offset"])

    # merged, not broadcast: the counts by task grow with the input
    ranked = cut.join(offsets.hint("merge"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, packed into sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
