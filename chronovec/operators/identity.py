"""Operators on embeddings: pairs, top-k, thresholds, matching, online ids, merging, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..storage import cleared, written
from . import metric


def pairs(df: DataFrame, keys: list[str], id_: str, cols: list[str]) -> DataFrame:
    """Unordered pairs of rows that share the keys, as columns with _a and _b.

    The keys are the equality part of the join, so pairs form within a key
    only; a key should hold few rows (a frame, a track).
    """
    side = lambda s: df.select(*keys, *[F.col(c).alias(f"{c}{s}") for c in dict.fromkeys([id_, *cols])])
    return side("_a").join(side("_b"), keys).where(F.col(f"{id_}_a") < F.col(f"{id_}_b"))


#: Most rows of one side, on average, that a task multiplies in ``top_similar``.
BLOCK_ROWS = 4096


def top_similar(queries: DataFrame, store: DataFrame, id_: str, v: str, k: int, least: float, blocks: int | None = None) -> DataFrame:
    """For each query the ``k`` most similar of the store, itself left out (G1): exact, by blocks; ties by id.

    Both sides are dealt into blocks of ``BLOCK_ROWS`` rows or so (``blocks``
    sets the store's number), and each pair of blocks is one matrix product.
    Products of equal vectors may differ in the last bits with their place, so
    all rows that may be among the best are measured again one by one.
    """
    many = lambda df: max(1, -(-df.count() // BLOCK_ROWS))
    parts, blocks = many(queries), blocks or many(store)
    deal = lambda n: F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col(id_).cast("long").alias("q"), F.col(v).alias("qv"), deal(parts).alias("part"), each(blocks).alias("block"))
    s = store.select(F.col(id_).cast("long").alias("s"), F.col(v).alias("sv"), each(parts).alias("part"), deal(blocks).alias("block"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            a, b = np.array(left.qv.tolist()), np.array(right.sv.tolist())
            a, b = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12), b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
            ids = right.s.to_numpy()
            for lo in range(0, len(a), 512):
                sims = a[lo : lo + 512] @ b.T
                sims[left.q.to_numpy()[lo : lo + 512, None] == ids[None]] = -2
                for n, row in enumerate(sims):
                    kth = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -2
                    near = np.flatnonzero((row >= max(kth, least) - 1e-9) & (row > -1.5))
                    exact = (b[near] * a[lo + n]).sum(axis=1)
                    near, exact = near[exact >= least], exact[exact >= least]
                    first = np.lexsort((ids[near], -exact))[:k]
                    out += [(left.q.iloc[lo + n], ids[j], x) for j, x in zip(near[first], exact[first])]
        return pd.DataFrame(out, columns=["q", "s", "similarity"])

    found = q.groupBy("part", "block").cogroup(s.groupBy("part", "block")).applyInPandas(best, "q long, s long, similarity double")
    r = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "s"))
    return found.withColumn("rank", r).where(F.col("rank") <= k)


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


#: Keys whose brackets of percentiles are sent to all tasks; where there are more, they are joined.
MOST_KEYS = 10_000
#: Percentiles are bracketed to within a few of so many parts of the rows.
PARTS = 100_000


def distribution(df: DataFrame, keys: list[str], x: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Count, mean, deviation, ends and exact percentiles of a column by key (E10); nulls do not count.

    A sketch first brackets each percentile between two values with few ranks
    between them. A second pass counts what lies below and groups the values
    inside, so ties are one row however many they are, and no task sorts a
    key. Percentiles between two ranks are interpolated.
    """
    quantiles = quantiles or {"p10": 0.10, "p15": 0.15, "p90": 0.90}
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"))
    spread = 3 / PARTS
    ends = [F.struct(*[F.percentile_approx("_x", F.lit(min(1.0, max(0.0, q + d))), F.lit(PARTS)).alias(n) for n, d in (("lo", -spread), ("hi", spread))]).alias(f"_{name}") for name, q in quantiles.items()]
    whole = written(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"), *ends), "distribution")
    cuts = whole.select(*keys, *[f"_{n}" for n in quantiles])
    small = whole.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    same = [rows[k].eqNullSafe(cuts[k]) for k in keys]
    met = rows.join(F.broadcast(cuts) if small else cuts, same if keys else None, "inner").select(*[rows[k] for k in keys], "_x", *[f"_{n}" for n in quantiles])
    found = whole
    for name, q in quantiles.items():
        lo, hi, v = F.col(f"_{name}")["lo"], F.col(f"_{name}")["hi"], F.col("_x")
        # values inside the bracket one by one; below it only how many and the last, above it only the first
        side = F.when(v < lo, -1).when(v > hi, 1).otherwise(0)
        cells = met.groupBy(*keys, side.alias("_side"), F.when(side == 0, v).alias("_v")).agg(F.count("*").alias("_n"), F.min("_x").alias("_first"), F.max("_x").alias("_last"))
        order = Window.partitionBy(*keys).orderBy("_side", "_v")
        ranked = cells.withColumns({"_to": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
        at = (F.col("_all") - 1) * q
        holds = lambda r: (r >= F.col("_to") - F.col("_n")) & (r < F.col("_to"))
        known = lambda r: (F.col("_side") == 0) | ((F.col("_side") < 0) & (r == F.col("_to") - 1)) | ((F.col("_side") > 0) & (r == F.col("_to") - F.col("_n")))
        value = lambda r: F.when(~known(r), F.raise_error(F.lit("a percentile lies outside its bracket"))).when(F.col("_side") < 0, F.col("_last")).otherwise(F.col("_first"))
        both = ranked.groupBy(*keys).agg(F.max(F.when(holds(F.floor(at)), value(F.floor(at)))).alias("_a"), F.max(F.when(holds(F.ceil(at)), value(F.ceil(at)))).alias("_b"), F.max(at - F.floor(at)).alias("_f"))
        part = both.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias(name))
        found = found.join(part, [found[k].eqNullSafe(part[f"_k{i}"]) for i, k in enumerate(keys)] if keys else None, "inner").drop(*[f"_k{i}" for i in range(len(keys))])
    return found.select(*keys, "n", "mean", "std", "min", "max", *quantiles)


#: Parts of the range of similarities, and then of such a part, that percentiles are looked up in.
BINS = 1 << 15
_QUANTILES = {"p10": 0.10, "p15": 0.15, "p90": 0.90}
_HISTOGRAM = "kind int, bin long, n long, total double, squares double, least double, most double"


def _cells(rows: DataFrame) -> DataFrame:
    """``rows(kind, key, id, v)`` dealt to pairs of chunks of their key: any two rows of a key meet in one cell, and no cell is large."""
    parts = rows.groupBy("kind", "key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int")
    dealt = rows.join(parts, ["kind", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("kind", "key", "id", "v", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def _similarities(cell: pd.DataFrame) -> Iterator[np.ndarray]:
    """Cosines of every two rows of a cell, in steps; 0 for a zero vector."""
    x, own = np.array(cell.v.tolist(), float), cell.own.to_numpy()
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    a, b = cell.a.iloc[0], cell.b.iloc[0]
    left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
    for lo in range(0, len(left), 512):
        rows = left[lo : lo + 512]
        sims = np.clip(x[rows] @ x[right].T, -1, 1)
        yield sims[rows[:, None] < right[None]] if a == b else sims.ravel()


def _histogram(cells: DataFrame, within: dict[int, list[int]] | None = None) -> pd.DataFrame:
    """Counts, sums and ends of the similarities by bin, at most ``BINS`` for each kind; or by the parts of the few bins ``within``."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        kind, out = int(cell.kind.iloc[0]), []
        for s in _similarities(cell):
            place = (s + 1) * (BINS / 2)
            at = np.minimum(place.astype(np.int64), BINS - 1)
            if within is not None:
                some = np.isin(at, within[kind])
                s, place, at = s[some], place[some], at[some]
                at = at * BINS + np.minimum(((place - at) * BINS).astype(np.int64), BINS - 1)
            if len(s):
                order = np.argsort(at, kind="stable")
                s, at = s[order], at[order]
                heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                sums = [np.add.reduceat(s, heads), np.add.reduceat(s * s, heads), np.minimum.reduceat(s, heads), np.maximum.reduceat(s, heads)]
                out.append(pd.DataFrame(dict(zip(names, [kind, at[heads], np.diff(np.append(heads, len(s))), *sums]))))
        return pd.concat(out) if out else pd.DataFrame([], columns=names)

    names = [c.split()[0] for c in _HISTOGRAM.split(", ")]
    found = cells.groupBy("kind", "key", "a", "b").applyInPandas(run, _HISTOGRAM).groupBy("kind", "bin")
    sums = [F.sum(c).alias(c) for c in ("n", "total", "squares")]
    return found.agg(*sums, F.min("least").alias("least"), F.max("most").alias("most")).toPandas().sort_values(["kind", "bin"])


def pair_summaries(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """The ``summary`` of the cosines of all pairs that share a key, for each kind: one row, columns by kind.

    ``rows`` hold ``kind`` (place in ``kinds``), ``key``, ``id`` and ``v``. Pairs
    are formed as blocks of matrix products and leave their task as a
    histogram of bounded size. Percentiles come from a second, finer one of
    the bins that hold them: exact where a part of a bin has one value, within
    1e-9 otherwise.
    """
    cells, found, spots = _cells(rows), {}, {}
    coarse = {int(k): h for k, h in _histogram(cells).groupby("kind")}
    for k, h in coarse.items():
        n, mean = int(h.n.sum()), h.total.sum() / h.n.sum()
        found[k] = {"n": n, "mean": mean, "std": max(0.0, h.squares.sum() / n - mean * mean) ** 0.5, "min": h.least.min(), "max": h.most.max()}
        spots[k] = {r: int(np.searchsorted(h.n.cumsum(), r, "right")) for q in _QUANTILES.values() for r in (int((n - 1) * q), min(int((n - 1) * q) + 1, n - 1))}
    fine = _histogram(cells, {k: [int(h.bin.iloc[j]) for j in set(spots[k].values())] for k, h in coarse.items()}) if coarse else None

    def ranked(k: int, r: int) -> float:
        h, j = coarse[k], spots[k][r]
        part = fine[(fine.kind == k) & (fine.bin // BINS == h.bin.iloc[j])]
        at = min(int(np.searchsorted(part.n.cumsum(), r - int(h.n.iloc[:j].sum()), "right")), len(part) - 1)
        return float(part.least.iloc[at] + part.most.iloc[at]) / 2

    for k, s in found.items():
        for name, q in _QUANTILES.items():
            x = (s["n"] - 1) * q
            low, high = ranked(k, int(x)), ranked(k, min(int(x) + 1, s["n"] - 1))
            s[name] = low + (x - int(x)) * (high - low)
    names = ("n", "mean", "std", "min", "max", *_QUANTILES)
    row = [s.get(n, 0 if n == "n" else None) for s in (found.get(k, {}) for k in range(len(kinds))) for n in names]
    schema = ", ".join(f"{kind}_{n} {'long' if n == 'n' else 'double'}" for kind in kinds for n in names)
    return rows.sparkSession.createDataFrame([tuple(x if x is None or isinstance(x, int) else float(x) for x in row)], schema)


def adaptive_threshold(df: DataFrame, person: str, order: str, v: str, least: int = 5, low: float = 0.6, high: float = 0.95, current: float = 0.7, gain: float = 2.0) -> DataFrame:
    """Threshold between same-person and different-person similarities.

    Same: all pairs within a person. Different: the first vectors of persons.
    ``apply`` tells whether to take it: confidence is medium or high, and it
    differs from the ``current`` one by at least ``gain`` percent of that.
    """
    same = df.select(F.lit(0).alias("kind"), F.col(person).cast("string").alias("key"), F.col(order).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"))
    first = df.where(F.col(person).isNotNull()).groupBy(person).agg(F.min(order).cast("long").alias("id"), F.min_by(v, order).cast("array<double>").alias("v"))
    both = pair_summaries(same.unionByName(first.select(F.lit(1).alias("kind"), F.lit("").alias("key"), "id", "v")), ["same", "other"])
    apart = F.col("same_min") > F.col("other_max")
    partly = F.col("same_mean") - F.col("same_std") > F.col("other_mean") + F.col("other_std")
    enough = (F.col("same_n") >= least) & (F.col("other_n") >= least)
    t = F.when(apart, (F.col("same_min") + F.col("other_max")) / 2).when(partly, (F.col("same_mean") - F.col("same_std") + F.col("other_mean") + F.col("other_std")) / 2).otherwise(F.col("same_p15"))
    found = both.withColumn("threshold", F.when(enough, F.greatest(F.lit(low), F.least(F.lit(high), t)))).withColumn(
        "confidence", F.when(~enough, "insufficient_samples").when(apart, "high").when(partly, "medium").otherwise("low")
    )
    better = F.abs(F.col("threshold") - current) / current * 100 >= gain
    return found.withColumn("apply", F.coalesce(F.col("confidence").isin("medium", "high") & better, F.lit(False)))


def track_similarity(records: DataFrame, track: str, seq: str, ts: str, v: str, quality: str) -> DataFrame:
    """Similarity of every two tracks: best record, five oldest as an ensemble, last three by recency; with its confidence.

    Records carry ``scene``; tracks are compared within one.
    """
    keys = ["scene", track]
    best = records.groupBy(*keys).agg(F.max_by(v, F.struct(F.col(quality), -F.col(seq))).alias("best"), F.count("*").alias("n"), F.avg(quality).alias("quality"))
    oldest = V.weighted_prototype(last_n(records, keys, [F.asc(seq)], 5), keys, v, quality).withColumnRenamed("proto", "ensemble")
    p = pairs(best.join(oldest, keys), ["scene"], track, ["best", "ensemble", "n", "quality"])
    single, ensemble = V.cosine01(F.col("best_a"), F.col("best_b")), V.cosine01(F.col("ensemble_a"), F.col("ensemble_b"))
    late = last_n(records, keys, [F.desc(seq)], 3).select("scene", track, seq, v, quality, F.exp((F.col(ts) - F.max(ts).over(Window.partitionBy("scene"))) / 10).alias("w"))
    a, b = (late.select("scene", *[F.col(c).alias(f"{c}_{s}") for c in (track, seq, v, quality, "w")]) for s in "ab")
    cross = a.join(b, "scene").where(F.col(f"{track}_a") < F.col(f"{track}_b"))
    weight = (F.col("w_a") + F.col("w_b")) / 2 * (F.col(f"{quality}_a") + F.col(f"{quality}_b")) / 2
    recent = cross.groupBy("scene", f"{track}_a", f"{track}_b").agg(F.coalesce(F.try_divide(F.sum(V.cosine01(F.col(f"{v}_a"), F.col(f"{v}_b")) * weight), F.sum(weight)), F.lit(0.0)).alias("recent"))
    found = p.join(recent, ["scene", f"{track}_a", f"{track}_b"]).withColumn("similarity", 0.4 * single + 0.4 * ensemble + 0.2 * F.col("recent"))
    n = F.col("n_a") + F.col("n_b")
    sure = V.matching_confidence(n, F.col("quality_a"), F.col("quality_b"), F.col("similarity"))
    return found.select("scene", f"{track}_a", f"{track}_b", "similarity", sure.alias("confidence"), n.alias("records"))


def track_matches(found: DataFrame, track: str, least: float = 0.7) -> DataFrame:
    """For each track the tracks that match it, ``least`` similar at least, the most similar first (N13); ties by track.

    ``found`` is what ``track_similarity`` gives, each pair once; here a pair
    counts for both its tracks.
    """
    a, b = f"{track}_a", f"{track}_b"
    rest = [c for c in found.columns if c not in (a, b)]
    some = found.where(F.col("similarity") >= least)
    ways = [some.select(*rest, F.col(x).alias("source"), F.col(y).alias("matched")) for x, y in ((a, b), (b, a))]
    place = F.row_number().over(Window.partitionBy("scene", "source").orderBy(F.desc("similarity"), "matched"))
    return ways[0].unionByName(ways[1]).withColumn("place", place)


def corrections(found: DataFrame, track: str, least: float = 0.8, sure: float = 0.7, rounds: int = 1000) -> DataFrame:
    """Pairs of tracks to take for one, by greedy matching on similarity x confidence within a scene.

    The strongest pair of at least ``least`` similarity and ``sure``
    confidence takes its two tracks, then the strongest of those left, and so
    on; ties go to the smaller tracks. Each round takes every pair that is the
    strongest of both its tracks, which gives the same matching without an
    order over all pairs; ``round`` tells when. Tracks are spread by id, so no
    scene is held by one task.
    """
    a, b = f"{track}_a", f"{track}_b"
    strength = F.struct((F.col("similarity") * F.col("confidence")).alias("s"), (-F.col(a)).alias("a"), (-F.col(b)).alias("b"))
    left = written(found.where((F.col("similarity") >= least) & (F.col("confidence") >= sure)).select("scene", a, b, "similarity", "confidence", strength.alias("strength")), "matches")
    taken: list[DataFrame] = []
    for n in range(1, rounds + 1):
        if left.isEmpty():
            break
        ends = left.select("scene", F.col(a).alias("t"), "strength").unionByName(left.select("scene", F.col(b).alias("t"), "strength"))
        top = ends.groupBy("scene", "t").agg(F.max("strength").alias("top"))
        best = left
        for c in (a, b):
            best = best.join(top.select("scene", F.col("t").alias(c), F.col("top").alias("strength")), ["scene", c, "strength"], "left_semi")
        taken.append(written(best.select("scene", a, b, "similarity", "confidence", F.lit(n).alias("round")), "taken"))
        used = taken[-1].select("scene", F.col(a).alias("t")).unionByName(taken[-1].select("scene", F.col(b).alias("t")))
        rest = left
        for c in (a, b):
            rest = rest.join(used.withColumnRenamed("t", c), ["scene", c], "left_anti")
        last, left = left, written(rest.select(*left.columns), "matches")
        cleared(last)
    else:
        raise RuntimeError("the matching did not settle")
    found_all = left.select("scene", a, b, "similarity", "confidence", F.lit(0).alias("round"))
    for t in taken:
        found_all = found_all.unionByName(t)
    return found_all


def identify(store: list[np.ndarray], x, threshold: float, first: bool = False) -> int:
    """The place in ``store`` of the identity of a vector, which is put there."""
    x = np.asarray(x, float)
    x = x / max(np.linalg.norm(x), 1e-12)
    sims = np.array(store) @ x if store else np.zeros(0)
    k = int((sims > threshold if first else sims).argmax()) if len(sims) else -1
    if k >= 0 and sims[k] > threshold:
        store[k] = x
        return k
    store.append(x)
    return len(store) - 1


def online_ids(df: DataFrame, keys: list[str], order: list[str], v: str, threshold: float, first: bool = False) -> DataFrame:
    """Identity of each vector in order: the most similar stored one above the threshold, else a new one.

    With ``first`` it is the first stored one above the threshold. Each decision adds to the store the next one reads, so a key is one pass.
    """

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        store: list[np.ndarray] = []
        ids = [identify(store, x, threshold, first) for x in pdf[v]]
        return pdf.drop(columns=[v]).assign(identity=ids)

    schema = df.drop(v).select("*", F.lit(None).cast("long").alias("identity")).schema
    return df.groupBy(*keys).applyInPandas(assign, schema)


def greedy_merge(df: DataFrame, keys: list[str], id_: str, v: str, threshold: float) -> DataFrame:
    """Each id with the earliest id that stands for it (N2): greedy to representatives, not transitive."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_)
        x = np.array(pdf[v].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rep = np.full(len(x), -1)
        for k in range(len(x)):
            if rep[k] < 0:
                rep[k] = k
                near = (x[k + 1 :] @ x[k] >= threshold) & (rep[k + 1 :] < 0)
                rep[k + 1 :][near] = k
        return pdf.drop(columns=[v]).assign(representative=pdf[id_].to_numpy()[rep])

    schema = df.select(*keys, id_, F.col(id_).alias("representative")).schema
    return df.select(*keys, id_, v).groupBy(*keys).applyInPandas(merge, schema)


def _stars(links: DataFrame, scene: str, rounds: int) -> DataFrame:
    """``scene, i, root`` of every point with a link ``ia, ib``, by alternating star contraction; raises if it does not settle."""

    def down(df: DataFrame) -> DataFrame:
        return written(df.where("u <> v").select(scene, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")

    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64(scene, "u", "v").cast("decimal(38,0)"))).first())
    e = down(links.select(scene, F.col("ia").alias("u"), F.col("ib").alias("v")))
    before = state(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(scene, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(scene, "u").agg(F.min("v").alias("m")).select(scene, "u", F.least("u", "m").alias("m"))
        large = both.join(low, [scene, "u"]).where("v > u").select(scene, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(scene, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [scene, "u"]).where("v <> m").select(scene, F.col("v").alias("u"), F.col("m").alias("v"))
        new = down(small.unionByName(low.select(scene, "u", F.col("m").alias("v"))))
        after = state(new)
        cleared(e)
        e = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("clusters did not settle")
    found = written(e.groupBy(scene, F.col("u").alias("i")).agg(F.min("v").alias("root")), "roots")
    cleared(e)
    return found


def dbscan(df: DataFrame, scene: str, id_: str, v: str, eps: float = 0.25, least: int = 5, rounds: int = 30) -> DataFrame:
    """``scene, id_, cluster, largest``: clusters by cosine distance within a scene; noise has none.

    Neighbours come from an exact metric index (``metric``), not from all
    pairs of a scene. Core points are contracted to stars around the smallest
    core id, in rounds that follow the logarithm of the longest chain. A border
    point joins the neighbouring core with the smallest label. ``largest``
    marks the cluster with most members of a scene, the smaller label on ties.
    """
    copies, cells = metric.cells(df, scene, id_, v, eps, least)
    blocks = written(metric.dealt(cells), "blocks")
    counts = metric.neighbours(blocks, eps).unionByName(cells.where("home and not ball").select("scene", "id", "n")).groupBy("scene", "id").agg(F.sum("n").alias("n"))
    balls = cells.where("ball").select("scene", "id", "cell")
    core = written(counts.where(F.col("n") >= least).select("scene", "id").unionByName(balls.select("scene", "id")).distinct(), "core")
    middle = balls.groupBy("scene", "cell").agg(F.min("id").alias("ib"))
    met = written(metric.links(blocks.join(core.withColumn("core", F.lit(True)), ["scene", "id"], "left"), eps), "links")
    links = met.where("core").select("scene", "ia", "ib").unionByName(balls.join(middle, ["scene", "cell"]).select("scene", F.col("id").alias("ia"), "ib"))
    stars = _stars(links, "scene", rounds)
    label = core.select("scene", F.col("id").alias("i")).join(stars, ["scene", "i"], "left").select("scene", "i", F.coalesce("root", "i").alias("label"))
    border = met.where("not core").join(label.withColumnRenamed("i", "ib"), ["scene", "ib"]).groupBy("scene", F.col("ia").alias("i")).agg(F.min("label").alias("label"))
    named = copies.join(label.unionByName(border), (copies["scene"] == label["scene"]) & (copies["rep"] == label["i"]), "left").select(copies["scene"].alias(scene), copies["id"].alias(id_), F.col("label").alias("cluster"))
    found = written(df.select(scene, id_).distinct().join(named, [scene, id_], "left"), "clusters")
    top = found.where("cluster is not null").groupBy(scene, "cluster").count().groupBy(scene).agg(F.max_by("cluster", F.struct("count", -F.col("cluster"))).alias("_top"))
    cleared(blocks, core, met, cells, stars)
    return found.join(top, scene, "left").select(scene, id_, "cluster", F.coalesce(F.col("cluster") == F.col("_top"), F.lit(False)).alias("largest"))


def importance(df: DataFrame, keys: list[str], weights: dict[str, float], duration: float) -> DataFrame:
    """Importance of a cluster of detections (E16): size, place, span, motion, evenness, confidence.

    Rows hold cx, cy, area, ts, conf and are in order of ts.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    dx, dy = F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)
    d = df.withColumns({
        "_move": F.sqrt(dx * dx + dy * dy),
        "_mid": F.greatest(F.lit(0.0), 1 - F.sqrt((F.col("cx") - 960) * (F.col("cx") - 960) + (F.col("cy") - 540) * (F.col("cy") - 540)) / 800),
    })
    n, one = F.count("*"), F.lit(1.0)
    parts = {
        "frequency": F.least(n / 100, one),
        "size": F.least(F.sum("area") / 1000000, one),
        "center": F.avg("_mid"),
        "time_distribution": F.when(n > 1, F.least((F.max("ts") - F.min("ts")) / duration, one)).otherwise(0.0),
        "motion": F.coalesce(F.least(F.avg("_move") / 50, one), F.lit(0.0)),
        "consistency": F.when(n > 1, F.greatest(F.lit(0.0), 1 - F.stddev_pop("area") / (F.avg("area") + 1e-6))).otherwise(1.0),
        "confidence": F.avg("conf"),
    }
    return d.groupBy(*keys).agg(n.alias("n"), sum((parts[k] * F.lit(x) for k, x in weights.items()), F.lit(0.0)).alias("importance"))


def retained(df: DataFrame, key: str, ts: str, now: Column, most: int = 15, ttl: float = 30.0) -> DataFrame:
    """Keys that a bounded store still holds: touched within ``ttl`` of now, the ``most`` latest."""
    last = df.groupBy(key).agg(F.max(ts).alias("last"), F.max(now).alias("_now")).where(F.col("_now") - F.col("last") <= ttl).drop("_now")
    return last.orderBy(F.desc("last"), key).limit(most)
