"""Filter interaction audit (operator 13) by first-failure lookup.

Method. Five filters give each document a mask of the conditions that it
fails. A table of 32 masks by 120 orders holds the step at which an order
removes a document with that mask, 0 if it keeps it. Tasks index the table in
``mapInArrow`` and count removals by part, order, step and label with
``np.bincount``; their partial arrays are summed by Spark.

Scale. Texts are read once and leave the first pass as a digest and a mask.
Copies are found by digest: the smallest doc_id of each digest that occurs
twice or more. Digests with over a ``HOT``-th of all rows number fewer than
``HOT``, so they are broadcast and their rows are not shuffled; the others are
joined by digest. Partial arrays have 600 cells a part; a task writes them out
whenever it holds ``HELD`` parts, so any number of parts will do.

Defined results: a null text is empty, so all null and empty texts are equal;
a null part (``lang``) is the part "". Rows with a null doc_id are no smaller
and no larger than any other, hence never copies and never labelled. Repeated
rows count as often as they occur; those of one doc_id are not copies of each
other. Labels: a document is good or toxic if any row of ``labels`` with its
id says so. Empty tables give no rows. Only the columns named are read, so
others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Digests with more rows than a HOT-th of all are joined by broadcast; there are fewer than HOT of them.
HOT = 1000
#: Parts whose counts a task holds at a time: 600 cells of 40 bytes each.
HELD = 256
COUNTS = ("removed", "good_lost", "toxic_lost", "fails", "unique_fails", "total")


def first_failures() -> np.ndarray:
    """(32, 120): the step, from 1, at which an order removes a document that fails the filters of a mask; 0: it stays."""
    steps = np.zeros((1 << len(FILTERS), len(ORDERS)), np.int64)
    for mask in range(1 << len(FILTERS)):
        for n, order in enumerate(ORDERS):
            steps[mask, n] = next((k for k, f in enumerate(order, 1) if mask >> FILTERS.index(f) & 1), 0)
    return steps


def text_mask(data: bytes) -> int:
    """Filters A to D on one text in UTF-8 (E needs the other texts)."""
    words = data.split()  # bytes split at \x20 and \x09-\x0D alone
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    points = len(data) if data.isascii() else len(data.translate(None, bytes(range(128, 192))))
    failed = (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * upper > 3 * points,
        len(data.translate(None, b"#$%&*|")) < len(data),
    )
    return sum(f << k for k, f in enumerate(failed))


def _measured(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``(doc, part, digest, mask)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, masks = [], []
            for data in b.column("text"):
                data = data.as_buffer()
                data = data.to_pybytes() if data is not None else b""
                digests.append(hashlib.sha256(data).digest())
                masks.append(text_mask(data))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=["doc", "part", "digest", "mask"])

    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    )
    return chosen.mapInArrow(run, "doc long, part string, digest binary, mask int")


def _with_copies(rows: DataFrame) -> DataFrame:
    """``(doc, part, mask)`` with filter E's bit set."""
    met = materialize(rows.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    most = max(1, rows.count() // HOT)
    far = (F.col("doc") > F.col("first")).cast("int") * (1 << FILTERS.index("E"))
    mask = (F.col("mask") + F.coalesce(far, F.lit(0))).alias("mask")
    hot = F.broadcast(met.where(F.col("n") > most).select("digest", F.col("first"), F.lit(True).alias("is_hot")))
    near = rows.join(hot, "digest", "left")
    done = near.where("is_hot").select("doc", "part", mask)
    rest = near.where("is_hot is null").drop("first", "is_hot").join(met.where(F.col("n") <= most).drop("n"), "digest", "left")
    return done.unionByName(rest.select("doc", "part", mask))


def _counted(rows: DataFrame) -> DataFrame:
    """``(part, place, step)`` with ``COUNTS``: sums of the tasks' partial arrays; place numbers the order."""
    steps = first_failures()
    n_orders, n_steps = len(ORDERS), len(FILTERS)
    letters = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])  # (order, step) -> filter
    names = ["part", "place", "step", *COUNTS]

    def partial(parts: list[str], counts: np.ndarray) -> pa.RecordBatch:
        """counts: (part, mask, label) -> documents."""
        p, m, label = np.nonzero(counts)
        weight = counts[p, m, label]
        where = (p[:, None] * n_orders + np.arange(n_orders)) * (n_steps + 1) + steps[m]  # (seen, order)
        cell = lambda w: np.bincount(where.ravel(), np.repeat(w, n_orders), len(parts) * n_orders * (n_steps + 1)).astype(np.int64).reshape(len(parts), n_orders, n_steps + 1)[:, :, 1:]
        per_mask = counts.sum(axis=2)
        has = (np.arange(1 << n_steps)[:, None] >> np.arange(n_steps)) & 1  # (mask, filter)
        fails, unique = per_mask @ has, per_mask[:, 1 << np.arange(n_steps)]
        spread = [cell(weight), cell(weight * (label & 1)), cell(weight * (label >> 1)), fails[:, letters], unique[:, letters], np.broadcast_to(per_mask.sum(axis=1)[:, None, None], (len(parts), n_orders, n_steps))]
        cells = n_orders * n_steps
        out = [
            pa.array(parts, pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), cells))),
            pa.array(np.tile(np.repeat(np.arange(n_orders, dtype=np.int32), n_steps), len(parts))),
            pa.array(np.tile(np.arange(1, n_steps + 1, dtype=np.int32), n_orders * len(parts))),
            *[pa.array(np.ascontiguousarray(x, np.int64).ravel()) for x in spread],
        ]
        return pa.RecordBatch.from_arrays(out, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        counts = np.zeros((HELD, 1 << n_steps, 4), np.int64)
        for b in batches:
            found = b.column("part").dictionary_encode()
            own, codes = found.dictionary.to_pylist(), found.indices.to_numpy()
            mask, label = b.column("mask").to_numpy(), b.column("label").to_numpy()
            for lo in range(0, len(own), HELD):
                some = own[lo : lo + HELD]
                if len(held.keys() | set(some)) > HELD:
                    yield partial(list(held), counts[: len(held)])
                    held, counts[:] = {}, 0
                place = np.array([held.setdefault(p, len(held)) for p in some])
                here = (codes >= lo) & (codes < lo + HELD)
                cells = (place[codes[here] - lo] * (1 << n_steps) + mask[here]) * 4 + label[here]
                counts += np.bincount(cells, minlength=counts.size).reshape(counts.shape)
        if held:
            yield partial(list(held), counts[: len(held)])

    seen = rows.mapInArrow(run, "part string, place int, step int, " + ", ".join(f"{c} long" for c in COUNTS))
    return seen.groupBy("part", "place", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """What each step of each order of the five filters removes, by part: 600 rows a part."""
    bounded_batches(docs.sparkSession)
    rows = _with_copies(materialize(_measured(docs, id_col, text_col, part_col), "masks"))
    marked = labels.groupBy(F.col(id_col).cast("long").alias("doc")).agg((F.max(F.when(F.col(good_col) == 1, 1).otherwise(0)) + F.max(F.when(F.col(toxic_col) == 1, 2).otherwise(0))).alias("label"))
    rows = rows.join(marked, "doc", "left").select("part", "mask", F.coalesce("label", F.lit(0)).cast("int").alias("label"))
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("place") + 1)
    found = _counted(rows).select("part", order.alias("filter_order"), "step", *COUNTS)
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    letter = F.expr("substring(filter_order, step, 1)")
    return found.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("removed").over(so_far)).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", letter)).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all their orders over ``documents``, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def plain_audit(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    """Brute force for tests: (doc_id, text, lang) and (doc_id, quality, toxic) -> rows, every order applied to every document."""
    import re

    texts = [(i, t or "", p or "") for i, t, p in docs]
    fails = []
    for i, t, _ in texts:
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in texts),
        })
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = []
    for part in sorted({p for *_, p in texts}):
        own = [k for k, (*_, p) in enumerate(texts) if p == part]
        rows, shapley = [], dict.fromkeys(FILTERS, 0)
        for order in ORDERS:
            left = own
            for step, f in enumerate(order, 1):
                gone = [k for k in left if fails[k][f]]
                before = [k for k in own if fails[k][f] and k not in left]
                left = [k for k in left if not fails[k][f]]
                shapley[f] += len(gone)
                unique = sum(fails[k][f] and sum(fails[k].values()) == 1 for k in own)
                rows.append((part, order, step, len(left), len(gone), len(before), unique, sum(texts[k][0] in good for k in gone), sum(texts[k][0] in toxic for k in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return out


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
    'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS fails
  FROM d LEFT JOIN l USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), masks AS (
  SELECT part, good, toxic, map(['A', 'B', 'C', 'D', 'E'], [fails['A'], fails['B'], fails['C'], fails['D'], fails['E']]) AS fails, count(*) AS n FROM f GROUP BY ALL
), steps AS (
  SELECT part, filter_order, step::INTEGER AS step, filter_order[step] AS letter, good, toxic, n, fails[filter_order[step]] AS failed,
    len(list_filter(range(1, step), lambda k: fails[filter_order[k]])) > 0 AS gone,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) = 1 AS alone
  FROM masks, orders, range(1, 6) r(step)
), counts AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failed AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failed AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed AND alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (failed AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (failed AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counts
"""
