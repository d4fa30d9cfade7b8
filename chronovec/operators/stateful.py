"""Operators whose every step needs the one before: trackers, filters, assignment, suppression.

Each runs per key (a stream, a frame) in one ordered pass inside
``applyInPandas``; rows are sorted there, as grouped input has no order. Keys
are dealt over the cluster, and a pass holds one key's rows and a few tracks.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

BOX = ["x1", "y1", "x2", "y2"]


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap over union of every two boxes."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.prod(np.maximum(high - low, 0), axis=2)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest one-to-one assignment of the smaller side (shortest augmenting paths)."""
    if not cost.size:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    if n <= 2 and m <= 8:
        best = min(permutations(range(m), n), key=lambda p: (sum(c[k, j] for k, j in enumerate(p)), p))
        found = list(enumerate(best))
    else:
        u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
        for k in range(1, n + 1):
            match[0], at = k, 0
            least, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
            while match[at]:
                done[at] = True
                row = match[at]
                slack = c[row - 1] - u[row] - v[1:]
                better = ~done[1:] & (slack < least[1:])
                least[1:][better], way[1:][better] = slack[better], at
                free = np.flatnonzero(~done[1:]) + 1
                to = free[least[free].argmin()]
                step = least[to]
                u[match[done]] += step
                v[done] -= step
                least[~done] -= step
                at = to
            while at:
                match[at] = match[way[at]]
                at = way[at]
        found = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((j, k) if flip else (k, j) for k, j in found)


def matched(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Assignment without pairs that cost more than ``most``."""
    return [(i, j) for i, j in assign(cost) if cost[i, j] <= most]


def frame_assignment(df: DataFrame, keys: list[str], row: str, col: str, cost: str, most: float = 0.7) -> DataFrame:
    """Best matches of each frame from long-form costs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.sort(pdf[row].unique()), np.sort(pdf[col].unique())
        c = np.full((len(rows), len(cols)), 1e6)
        c[np.searchsorted(rows, pdf[row]), np.searchsorted(cols, pdf[col])] = pdf[cost]
        out = pd.DataFrame([(rows[i], cols[j], c[i, j]) for i, j in matched(c, most)], columns=[row, col, cost])
        return pd.concat([pd.concat([pdf[keys].head(1)] * len(out), ignore_index=True), out], axis=1) if len(out) else pdf.head(0)[[*keys, row, col, cost]]

    return df.select(*keys, row, col, cost).groupBy(*keys).applyInPandas(run, df.select(*keys, row, col, cost).schema)


def suppress(df: DataFrame, keys: list[str], id_: str, score: str, most: float = 0.45) -> DataFrame:
    """Boxes left after greedy suppression of overlapping, lower-scored ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, id_], ascending=[False, True])
        b, kept = pdf[BOX].to_numpy(float), []
        for k in range(len(b)):
            if not kept or overlaps(b[k : k + 1], b[kept]).max() <= most:
                kept.append(k)
        return pdf.iloc[kept][[*keys, id_]]

    return df.select(*keys, id_, score, *BOX).groupBy(*keys).applyInPandas(run, df.select(*keys, id_).schema)


class Track:
    """A track's box, state and counters."""

    def __init__(self, number: int, box: np.ndarray, score: float) -> None:
        self.number, self.box, self.score = number, box, score
        self.state, self.age, self.hits, self.missed = "tracked", 0, 1, 0

    def predict(self) -> None:
        self.age += 1
        self.missed += 1
        if self.missed > 30:
            self.state = "removed"
        elif self.missed > 5:
            self.state = "lost"

    def update(self, box: np.ndarray, score: float) -> None:
        self.box, self.score, self.missed, self.state = box, score, 0, "tracked"
        self.hits += 1


def track_frame(tracks: list[Track], number: int, boxes: np.ndarray, scores: np.ndarray, ids: np.ndarray, high: float, least_iou: float, lost: int) -> tuple[list[Track], int, list[tuple]]:
    """One frame of N3: the tracks after it, the next number, and ``(id, track, state, hits)`` of the detections taken."""
    for t in tracks:
        t.predict()
    out: list[tuple] = []
    rest = set(range(len(ids)))
    active = [t for t in tracks if t.state == "tracked"]
    strong, weak = np.flatnonzero(scores >= high), np.flatnonzero(scores < high)

    def meet(dets: np.ndarray, some: list[Track], bar: float) -> set[int]:
        used = set()
        if len(dets) and some:
            cost = 1 - overlaps(boxes[dets], np.array([t.box for t in some]))
            for i, j in matched(cost, 1 - bar):
                d, t = int(dets[i]), some[j]
                t.update(boxes[d], scores[d])
                out.append((ids[d], t.number, t.state, t.hits))
                rest.discard(d)
                used.add(j)
        return used

    used = meet(strong, active, least_iou)
    meet(weak, [t for t in tracks if t.state == "lost"] + [t for j, t in enumerate(active) if j not in used], max(0.1, least_iou - 0.1))
    for d in strong:
        if int(d) in rest:
            tracks.append(Track(number, boxes[d], scores[d]))
            out.append((ids[d], number, "tracked", 1))
            number += 1
    return [t for t in tracks if t.missed < lost and t.state != "removed"], number, out


def lifecycle_tracks(df: DataFrame, keys: list[str], frame: str, id_: str, conf: str, high: float = 0.6, least_iou: float = 0.3, lost: int = 30) -> DataFrame:
    """Track of each detection, with its state and hits.

    Confident detections meet active tracks first; the others meet lost and
    still unmatched ones at a lower bar; unmatched confident ones start tracks.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tracks: list[Track] = []
        out, number = [], 0
        for f, g in pdf.sort_values([frame, id_]).groupby(frame, sort=True):
            tracks, number, rows = track_frame(tracks, number, g[BOX].to_numpy(float), g[conf].to_numpy(float), g[id_].to_numpy(), high, least_iou, lost)
            out += [(f, *r) for r in rows]
        found = pd.DataFrame(out, columns=[frame, id_, "track", "state", "hits"])
        for k in keys:
            found[k] = pdf[k].iloc[0]
        return found[[*keys, frame, id_, "track", "state", "hits"]]

    schema = df.select(*keys, frame, id_, F.lit(0).cast("long").alias("track"), F.lit("").alias("state"), F.lit(0).cast("long").alias("hits")).schema
    return df.select(*keys, frame, id_, conf, *BOX).groupBy(*keys).applyInPandas(run, schema)


def predicted_place(history: list[tuple[float, float]]) -> np.ndarray:
    """Next place from the last three, blended with the velocity from five on."""
    h = np.array(history[-5:])
    near = 0.2 * h[-3] + 0.3 * h[-2] + 0.5 * h[-1] if len(h) >= 3 else 0.4 * h[-2] + 0.6 * h[-1] if len(h) == 2 else h[-1]
    return 0.5 * near + 0.5 * (h[-1] + 1.5 * (h[-1] - h[-4]) / 3) if len(history) >= 5 else near


def opening_references(df: DataFrame, keys: list[str], frame: str, id_: str, conf: str, v: str, frames: int = 5, least: float = 0.3) -> DataFrame:
    """``keys, ref1, ref2``: unit mean vectors of the most and the second most important face of the opening frames.

    Importance weighs nearness to the middle, size and confidence. A person
    who is in none of the opening frames has a null vector.
    """
    seen = df.withColumn("_frame", F.dense_rank().over(Window.partitionBy(*keys).orderBy(frame))).where((F.col("_frame") <= frames) & (F.col(conf) >= least))
    middle = F.sqrt(((F.col("x1") + F.col("x2")) / 2 - 960) ** 2 + ((F.col("y1") + F.col("y2")) / 2 - 540) ** 2)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    worth = 0.5 * F.greatest(F.lit(0.0), 1 - middle / 800) + 0.3 * F.least(area / 50000, F.lit(1.0)) + 0.2 * F.col(conf)
    place = F.row_number().over(Window.partitionBy(*keys, "_frame").orderBy(worth.desc(), id_))
    proto = V.mean_prototype(seen.withColumn("_person", place).where("_person <= 2"), [*keys, "_person"], v)
    return proto.groupBy(*keys).agg(*[F.max(F.when(F.col("_person") == n, F.col("proto"))).alias(f"ref{n}") for n in (1, 2)])


def _unit(x) -> np.ndarray | None:
    """A vector at length 1; a zero vector stays."""
    if x is None:
        return None
    x = np.asarray(x, float)
    size = np.linalg.norm(x)
    return x / size if size > 1e-8 else x


def two_slot_tracks(
    df: DataFrame, keys: list[str], frame: str, id_: str, conf: str, start: int = 30, most: float = 200.0, least: float = 0.3, v: str | None = None, references: DataFrame | None = None, least_similarity: float = 0.4,
) -> DataFrame:
    """The faces of persons 1 and 2 in each frame.

    At first the two most important faces are taken, the more important one as
    person 1; with ``references`` (``keys, ref1, ref2``) the faces whose
    vectors ``v`` are nearest to them, wherever they stand, and a face that is
    nearest to both goes to the more similar. Once there is a history, the
    nearest to each predicted place. A single face may move to the other
    person, and the largest face left over stands in for person 2.
    """
    named = references is not None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        past: list[list] = [[], []]
        out, seen = [], 0
        refs = [_unit(pdf[c].iloc[0]) for c in ("ref1", "ref2")] if named else [None, None]
        for f, g in pdf.sort_values([frame, id_]).groupby(frame, sort=True):
            b = g[BOX].to_numpy(float)
            c, area, score, ids = (b[:, :2] + b[:, 2:]) / 2, np.prod(b[:, 2:] - b[:, :2], axis=1), g[conf].to_numpy(float), g[id_].to_numpy()
            got: list = [None, None]
            if seen < start and not (len(past[0]) >= 5 and past[1]):
                if refs[0] is not None and refs[1] is not None:
                    near = [(_unit(x) @ np.array(refs).T + 1) / 2 if x is not None and score[k] >= least else np.full(2, -1.0) for k, x in enumerate(g[v])]
                    near = np.array(near)
                    for p in (0, 1):
                        k = int(near[:, p].argmax())
                        got[p] = k if near[k, p] > least_similarity else None
                    if got[0] is not None and got[0] == got[1]:
                        got[1 if near[got[0], 0] > near[got[0], 1] else 0] = None
                else:
                    worth = 0.5 * np.maximum(0, 1 - np.hypot(c[:, 0] - 960, c[:, 1] - 540) / 800) + 0.3 * np.minimum(area / 50000, 1) + 0.2 * score
                    pick = [k for k in np.argsort(-worth, kind="stable").tolist() if score[k] >= least][:2]
                    got[: len(pick)] = pick
            else:
                used: set[int] = set()
                for p in (0, 1):
                    if past[p]:
                        d = np.hypot(*(c - predicted_place(past[p])).T)
                        d[[k for k in range(len(d)) if k in used or score[k] < least]] = np.inf
                        k = int(d.argmin())
                        if d[k] <= (most if seen >= start else np.inf) and np.isfinite(d[k]):
                            got[p] = k
                            used.add(k)
                if len(ids) == 1 and got[0] is not None and got[1] is None and past[1] and seen >= start:
                    if np.hypot(*(c[0] - predicted_place(past[1]))) < np.hypot(*(c[0] - predicted_place(past[0]))):
                        got = [None, 0]
                if got[0] is not None and got[1] is None and len(ids) >= 2 and seen >= start:
                    free = [k for k in range(len(ids)) if k not in used and score[k] >= least]
                    if free:
                        got[1] = max(free, key=lambda k: area[k])
            for p in (0, 1):
                if got[p] is not None:
                    past[p] = [*past[p], tuple(c[got[p]])][-10:]
            seen += 1
            out.append((f, *[None if k is None else ids[k] for k in got]))
        found = pd.DataFrame(out, columns=[frame, "person1", "person2"]).astype({"person1": "Int64", "person2": "Int64"})
        for k in keys:
            found[k] = pdf[k].iloc[0]
        return found[[*keys, frame, "person1", "person2"]]

    schema = df.select(*keys, frame, F.lit(None).cast("long").alias("person1"), F.lit(None).cast("long").alias("person2")).schema
    rows = df.select(*keys, frame, id_, conf, *BOX, *([v] if named else []))
    return (rows.join(references.select(*keys, "ref1", "ref2"), keys, "left") if named else rows).groupBy(*keys).applyInPandas(run, schema)


def dual_persons(frames: DataFrame, faces: DataFrame, references: DataFrame, keys: list[str], frame: str, id_: str, v: str, gate: float = 100.0, least: float = 0.7) -> DataFrame:
    """The faces of two known persons in each frame, and how long each has been lost.

    ``frames`` has every frame (``keys, frame``), faces or not; ``references``
    the persons' fixed vectors (``keys, ref1, ref2``). A person's face is the
    one most similar to the vector, above ``least``, among those whose centre
    is nearer than ``gate`` to where the person was last. Both are matched
    on their own, so one face may be both. A person without a place takes the
    first (or second) face. A counter grows in frames without faces and is
    reset by a match; other frames leave it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        refs = [_unit(pdf[c].iloc[0]) for c in ("ref1", "ref2")]
        last: list = [None, None]
        lost, out = [0, 0], []
        for f, g in pdf.sort_values([frame, id_]).groupby(frame, sort=True):
            g = g[g[id_].notna()]
            got: list = [None, None]
            if len(g):
                b = g[BOX].to_numpy(float)
                centre = b[:, :2] + (b[:, 2:] - b[:, :2]) // 2
                vectors, ids = [_unit(x) for x in g[v]], g[id_].to_numpy()
                for p in (0, 1):
                    if last[p] is None:
                        if len(g) > p:
                            got[p], last[p] = ids[p], centre[p]
                    elif refs[p] is not None:
                        away = np.hypot(*(centre - last[p]).T)
                        fit = np.array([-np.inf if x is None or not away[k] < gate else refs[p] @ x for k, x in enumerate(vectors)])
                        k = int(fit.argmax())
                        if fit[k] > least:
                            got[p], last[p], lost[p] = ids[k], centre[k], 0
            else:
                lost = [n + 1 for n in lost]
            out.append((f, *got, *lost))
        found = pd.DataFrame(out, columns=[frame, "person1", "person2", "lost1", "lost2"]).astype({"person1": "Int64", "person2": "Int64"})
        for k in keys:
            found[k] = pdf[k].iloc[0]
        return found[[*keys, frame, "person1", "person2", "lost1", "lost2"]]

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    schema = frames.select(*keys, frame, none.alias("person1"), none.alias("person2"), zero.alias("lost1"), zero.alias("lost2")).schema
    rows = frames.select(*keys, frame).distinct().join(faces.select(*keys, frame, id_, v, *BOX), [*keys, frame], "left")
    return rows.join(references.select(*keys, "ref1", "ref2"), keys, "left").groupBy(*keys).applyInPandas(run, schema)


def opening_profiles(df: DataFrame, keys: list[str], frame: str, v: str, middle: float, frames: int = 5) -> DataFrame:
    """``keys, side, ref, size, px, py``: what the faces of each half of the opening frames are like on average."""
    seen = df.withColumn("_frame", F.dense_rank().over(Window.partitionBy(*keys).orderBy(frame))).where(F.col("_frame") <= frames)
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    halves = seen.withColumn("side", F.when(cx < middle, "L").otherwise("R"))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    places = halves.groupBy(*keys, "side").agg(F.avg(area).alias("size"), F.avg(cx).alias("px"), F.avg(cy).alias("py"))
    return places.join(V.mean_prototype(halves, [*keys, "side"], v).withColumnRenamed("proto", "ref"), [*keys, "side"], "left")


def side_profiles(df: DataFrame, profiles: DataFrame, keys: list[str], frame: str, id_: str, v: str, middle: float, least: float = 0.35, bank: int = 64, reach: float = 200.0) -> DataFrame:
    """The face of each half of a frame that fits the half's profile best, else its largest.

    ``profiles`` has ``keys, side, ref, size, px, py``; any may be null. A score
    is the mean of what the profile has: similarity to the bank's median,
    from 0 to 1 (weight 0.6), size (0.2) and place (0.2). It must exceed
    ``least``. The state is the bank, which starts with ``ref`` and takes the
    vectors of matched faces, the last ``bank`` of them; size and place stay.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        held = [] if first["ref"] is None else [_unit(first["ref"])]
        size, place = first["size"], (first["px"], first["py"])
        out = []
        for f, g in pdf.sort_values([frame, id_]).groupby(frame, sort=True):
            b = g[BOX].to_numpy(float)
            centre, area = (b[:, :2] + b[:, 2:]) / 2, np.prod(b[:, 2:] - b[:, :2], axis=1)
            vectors = [_unit(x) for x in g[v]]
            total, weight = np.zeros(len(g)), np.zeros(len(g))
            if held:
                proto = _unit(np.median(np.array(held), axis=0)) if len(held) > 1 else held[0]
                has = np.array([x is not None for x in vectors])
                total += [0.6 * (x @ proto + 1) / 2 if x is not None else 0.0 for x in vectors]
                weight += 0.6 * has
            if pd.notna(size) and size:
                total += 0.2 * np.maximum(0, 1 - np.abs(area - size) / size)
                weight += 0.2
            if pd.notna(place[0]) and pd.notna(place[1]):
                total += 0.2 * np.maximum(0, 1 - np.hypot(*(centre - place).T) / reach)
                weight += 0.2
            fit = np.divide(total, weight, out=np.zeros(len(g)), where=weight > 0)
            k = int(fit.argmax())
            how = "profile" if fit[k] > max(least, 0) else "largest"
            if how == "largest":
                k = int(area.argmax())
            elif held and vectors[k] is not None:
                held = [*held, vectors[k]][-bank:]
            out.append((f, g[id_].iloc[k], how, float(fit[k])))
        found = pd.DataFrame(out, columns=[frame, id_, "how", "score"]).assign(side=first["side"])
        for c in keys:
            found[c] = first[c]
        return found[[*keys, frame, "side", id_, "how", "score"]]

    side = F.when((F.col("x1") + F.col("x2")) / 2 < middle, "L").otherwise("R").alias("side")
    rows = df.select(*keys, side, frame, id_, v, *BOX).join(profiles.select(*keys, "side", "ref", "size", "px", "py"), [*keys, "side"], "left")
    schema = df.select(*keys, frame, side, id_, F.lit("").alias("how"), F.lit(0.0).alias("score")).schema
    return rows.groupBy(*keys, "side").applyInPandas(run, schema)


def kalman(df: DataFrame, keys: list[str], order: str, x: str, y: str, gain: float = 0.3) -> DataFrame:
    """Smoothed place, velocity and confidence by a fixed gain.

    Each step first moves on by the velocity, which then becomes the correction
    that the measured place made. Confidence weighs the share of measured among
    all steps (one half after the first) and the evenness of the last three
    velocities, of which a step holds two: the one it moved by and the new one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        p, speed, out = None, np.zeros(2), []
        for n, z in enumerate(pdf[[x, y]].to_numpy(float)):
            sure = 0.0
            if p is None:
                p = z.copy()
            else:
                guess, before = p + speed, speed
                p = (1 - gain) * guess + gain * z
                speed = p - guess
                even = max(0.0, 1 - np.std([before, before, speed], axis=0).sum() / 50) if n >= 2 else 1.0
                sure = min(1.0, 0.7 * 0.5 + 0.3 * even)
            out.append((*p, *speed, sure))
        return pd.concat([pdf[[*keys, order]].reset_index(drop=True), pd.DataFrame(out, columns=["sx", "sy", "vx", "vy", "confidence"])], axis=1)

    schema = df.select(*keys, order, *[F.lit(0.0).alias(c) for c in ("sx", "sy", "vx", "vy", "confidence")]).schema
    return df.select(*keys, order, x, y).groupBy(*keys).applyInPandas(run, schema)


def kalman_boxes(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Predicted and corrected boxes of a constant-velocity filter over centre and size.

    Columns p_x1 to p_y2 hold the box expected before a row is seen, f_x1 to
    f_y2 the one after, and vx, vy the velocity of the centre.
    """
    # fixed values: noise of the measured centre and size, of the motion, and at the start
    measured, motion, start = np.diag([10.0, 10.0, 25.0, 25.0]), 5.0 * np.array([[0.25, 0.5], [0.5, 1.0]]), 100.0
    step = np.eye(8) + np.eye(8, k=4)
    noise = np.kron(np.diag([1, 1, 0.01, 0.01]), motion)

    def corners(s: np.ndarray) -> tuple:
        return s[0] - s[2] / 2, s[1] - s[3] / 2, s[0] + s[2] / 2, s[1] + s[3] / 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        b, state, spread, out = pdf[BOX].to_numpy(float), None, start * np.eye(8), []
        for z in np.column_stack(((b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2, b[:, 2] - b[:, 0], b[:, 3] - b[:, 1])):
            if state is None:
                state = np.append(z, np.zeros(4))
                guess = state
            else:
                guess, spread = step @ state, step @ spread @ step.T + noise
                gain = np.linalg.solve(spread[:4, :4] + measured, spread[:4]).T
                state, spread = guess + gain @ (z - guess[:4]), spread - gain @ spread[:4]
            out.append((*corners(guess), *corners(state), *state[4:6]))
        return pd.concat([pdf[[*keys, order]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    names = [*(f"{p}_{c}" for p in "pf" for c in BOX), "vx", "vy"]
    schema = df.select(*keys, order, *[F.lit(0.0).alias(c) for c in names]).schema
    return df.select(*keys, order, *BOX).groupBy(*keys).applyInPandas(run, schema)


def one_euro(df: DataFrame, keys: list[str], t: str, values: list[str], freq: float = 30.0, least: float = 1.0, beta: float = 0.007, d_cut: float = 1.0) -> DataFrame:
    """Low-pass filter whose cut-off follows the speed (N10); steps are of event time."""

    def alpha(cut: float, rate: float) -> float:
        return 1 / (1 + rate / (2 * np.pi * cut))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        rate, last, slope, before, out = freq, None, np.zeros(len(values)), 0.0, []
        for at, z in zip(pdf[t].to_numpy(float), pdf[values].to_numpy(float)):
            if last is None:
                last = z
            else:
                if at > before:
                    rate = 0.9 * rate + 0.1 / (at - before)
                raw = (z - last) * rate if at > before else np.zeros(len(values))
                a = alpha(d_cut, rate)
                slope = a * raw + (1 - a) * slope
                a = alpha(float((least + beta * np.abs(slope)).mean()), rate)
                last = a * z + (1 - a) * last
            before = at
            out.append(last)
        return pd.concat([pdf[[*keys, t]].reset_index(drop=True), pd.DataFrame(out, columns=[f"f_{c}" for c in values])], axis=1)

    schema = df.select(*keys, t, *[F.lit(0.0).alias(f"f_{c}") for c in values]).schema
    return df.select(*keys, t, *values).groupBy(*keys).applyInPandas(run, schema)


def activations(df: DataFrame, keys: list[str], order: str, risk: str, confidence: str, affected: str, start: float = 0.6, target: float = 0.1, swap: float = 0.6) -> DataFrame:
    """When to re-identify (N14): the bar moves to hold the rate of activations near a target.

    A swap must be likely, its risk must reach the bar, its confidence one
    half; many affected tracks need a clearly larger risk.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        on, out = 0, []
        for n, (r, sure, many) in enumerate(zip(pdf[risk], pdf[confidence], pdf[affected])):
            rate = on / n if n else 0.0
            go = bool(r > swap and r >= start)
            if go and rate > target * 1.5:
                go = r >= start + 0.1
            if go and rate >= target * 0.5:
                go = bool(sure >= 0.5 and (many <= 5 or r > start + 0.1))
            on += go
            out.append((rate, go))
        return pd.concat([pdf[[*keys, order]].reset_index(drop=True), pd.DataFrame(out, columns=["rate", "activated"])], axis=1)

    schema = df.select(*keys, order, F.lit(0.0).alias("rate"), F.lit(True).alias("activated")).schema
    return df.select(*keys, order, risk, confidence, affected).groupBy(*keys).applyInPandas(run, schema)
