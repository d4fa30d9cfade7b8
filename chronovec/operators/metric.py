"""Exact range search on unit vectors by pivots and the triangle inequality (for N11).

Equal vectors are one entry with a weight. A small scene is one cell; a larger
one draws about the square root of its size of pivots, the rows with the
smallest hashes of ids, none within half the range of another. A vector lives
in the cell of its nearest pivot, its home, and is a guest in those later
cells in which a neighbour may live: where neither the cell's radius nor the
plane between the two pivots rules it out. So two neighbours meet in exactly
one cell. Where the vectors within half the range of a pivot make a core by
themselves, they are all neighbours of each other, and no two of them are
compared.

Cells are cut into blocks of at most ``BLOCK`` rows or so; pairs of blocks are
matrix products. What leaves a block is a count or a link a row, not a row a
pair, so a dense cell costs time but no space.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Rows of a block, on average.
BLOCK = 2048
MOST_PIVOTS = 1024
#: Scenes of at most so many vectors are one cell: comparing them all is cheaper than an index.
SMALL = 1024
#: Bounds are widened by this, against rounding.
SLACK = 1e-7
_CELL = "scene {}, cell long, id {}, n long, v array<double>, home boolean, d double"


def _units(v: pd.Series) -> np.ndarray:
    x = np.array(v.tolist(), float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _away(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of every two unit vectors."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


def cells(df: DataFrame, scene: str, id_: str, v: str, eps: float, least: int) -> tuple[DataFrame, DataFrame]:
    """Who stands for each row, ``(scene, id, rep)``, and the index: ``scene, cell, id, n, v, home, d, ball``.

    ``n`` counts the copies of a vector, ``d`` is its distance to its own
    pivot, ``ball`` marks rows that are cores without comparisons. Null and
    zero vectors are in neither; they have no neighbours at ``eps`` below 1.
    """
    if not 0 <= eps < 1:
        raise ValueError("eps lies from 0 to below 1")
    reach = float(np.sqrt(2 * eps))
    some = df.select(F.col(scene).alias("scene"), F.col(id_).alias("id"), F.col(v).cast("array<double>").alias("v")).where("v is not null and exists(v, x -> x <> 0)")
    groups = written(some.groupBy("scene", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vectors")
    copies = some.join(groups, ["scene", "v"]).select("scene", "id", "rep")
    sizes = groups.groupBy("scene").agg(F.count("*").alias("size"))
    rows = groups.join(sizes, "scene").withColumnRenamed("rep", "id").withColumns({"part": F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("size") / BLOCK)), "hash": F.xxhash64("id")})
    pivots = F.when(F.col("size") <= SMALL, F.lit(1).cast("long")).otherwise(F.least(F.lit(MOST_PIVOTS), F.ceil(F.sqrt("size"))))
    drawn = rows.groupBy("scene", F.pmod("hash", pivots).alias("cell")).agg(F.min_by("v", F.struct("hash", "id")).alias("pivot"), F.first("size").alias("size"))
    drawn = written(drawn, "pivots")
    kinds = dict(rows.dtypes)
    schema = _CELL.format(kinds["scene"], kinds["id"])
    columns = [c.split()[0] for c in schema.split(", ")]

    def everywhere(pivots: DataFrame) -> DataFrame:
        return pivots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK) - 1)))

    def apart(pivots: pd.DataFrame) -> pd.DataFrame:
        """Pivots in order, without those within half the range of one before: a dense group keeps one."""
        pivots = pivots.sort_values("cell")
        close = np.triu(_away(p := _units(pivots["pivot"]), p) <= reach / 2, 1)
        keep = np.ones(len(pivots), bool)
        for k in range(len(pivots)):
            if keep[k]:
                keep[close[k]] = False
        return pivots[keep]

    def reached(own: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame([], columns=["scene", "cell", "radius"])
        pivots = apart(pivots)
        d = _away(_units(own.v), _units(pivots["pivot"]))
        home = d.argmin(axis=1)
        found = pd.DataFrame({"scene": own.scene.iloc[0], "cell": pivots.cell.to_numpy()[home], "radius": d.min(axis=1)})
        return found.groupby(["scene", "cell"], as_index=False).max()

    def placed(own: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame([], columns=columns)
        pivots = apart(pivots)
        p, number, radius = _units(pivots["pivot"]), pivots.cell.to_numpy(), pivots.radius.to_numpy()
        d = _away(_units(own.v), p)
        home = d.argmin(axis=1)
        near, between = d[np.arange(len(d)), home], _away(p, p)[home]
        plane = np.divide(d**2 - near[:, None] ** 2, 2 * between, out=np.zeros_like(d), where=between > 0)
        guest = (d <= radius + reach + SLACK) & (plane <= reach + SLACK) & (np.arange(len(p)) > home[:, None])
        at, cell = np.nonzero(guest)
        take, cell = np.concatenate((np.arange(len(own)), at)), np.concatenate((home, cell))
        out = own.iloc[take][["scene", "id", "n", "v"]].reset_index(drop=True)
        return out.assign(cell=number[cell], home=np.arange(len(take)) < len(own), d=near[take])[columns]

    pairs = lambda pivots: rows.groupBy("scene", "part").cogroup(everywhere(pivots).groupBy("scene", "part"))
    # as both passes compute the same distances, every home has a radius
    radii = pairs(drawn).applyInPandas(reached, f"scene {kinds['scene']}, cell long, radius double").groupBy("scene", "cell").agg(F.max("radius").alias("radius"))
    found = pairs(written(drawn.join(radii, ["scene", "cell"]), "radii")).applyInPandas(placed, schema)
    found = written(found, "placed")
    inside = F.col("home") & (F.col("d") <= reach / 2 - SLACK)
    balls = found.where(inside).groupBy("scene", "cell").agg(F.sum("n").alias("_weight"))
    whole = found.join(balls, ["scene", "cell"], "left").withColumn("ball", inside & F.coalesce(F.col("_weight") >= least, F.lit(False))).drop("_weight")
    return copies, written(whole, "cells")


def _parts(found: DataFrame) -> DataFrame:
    n = lambda x: F.count_if(x)
    homes, guests, balls = n(F.col("home") & ~F.col("ball")), n(~F.col("home")), n("ball")
    return found.groupBy("scene", "cell").agg(homes.alias("homes"), guests.alias("guests"), balls.alias("balls"))


def compared(found: DataFrame) -> DataFrame:
    """``scene, vectors, pairs, compared`` of an index: all pairs of different vectors, and those that share a cell and are compared."""
    by_cell = _parts(found).withColumn("compared", F.col("homes") * (F.col("homes") - 1) / 2 + F.col("homes") * F.col("guests") + F.col("balls") * (F.col("homes") + F.col("guests")))
    total = by_cell.groupBy("scene").agg(F.sum(F.col("homes") + F.col("balls")).alias("vectors"), F.sum("compared").cast("long").alias("compared"))
    return total.select("scene", "vectors", (F.col("vectors") * (F.col("vectors") - 1) / 2).cast("long").alias("pairs"), "compared")


def dealt(found: DataFrame) -> DataFrame:
    """The rows of each cell for each pair of blocks in which they are compared; balls meet the others only."""
    parts = _parts(found).select("scene", "cell", F.ceil((F.col("homes") + F.col("guests")) / BLOCK).alias("others"), F.ceil(F.col("balls") / BLOCK).alias("parts"))
    rows = found.join(parts, ["scene", "cell"]).where("others > 0")
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(2)), F.greatest(n, F.lit(1)))
    own = F.when(F.col("ball"), F.col("others") + deal(F.col("parts"))).otherwise(deal(F.col("others")))
    last = F.when(F.col("ball"), F.col("others")).otherwise(F.col("others") + F.col("parts")) - 1
    each = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return each.select("scene", "cell", "id", "n", "v", "home", "ball", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def _near(x: pd.DataFrame, y: pd.DataFrame, same: bool, eps: float) -> np.ndarray:
    near = 1 - _units(x.v) @ _units(y.v).T <= eps
    near &= x.home.to_numpy()[:, None] | y.home.to_numpy()[None]  # two guests meet elsewhere
    return np.triu(near, 1) if same else near


def _sides(block: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    block = block.sort_values("id")
    a, b = block.a.iloc[0], block.b.iloc[0]
    return block[block.own == a], block[block.own == b], a == b


def neighbours(blocks: DataFrame, eps: float) -> DataFrame:
    """``scene, id, n``: parts of the numbers of neighbours of the rows that are no balls."""
    kinds = dict(blocks.dtypes)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        x, y, same = _sides(block)
        if not len(x) or not len(y):
            return pd.DataFrame([], columns=["scene", "id", "n"])
        near = _near(x, y, same, eps)
        out = pd.DataFrame({"id": np.concatenate((x.id, y.id)), "n": np.concatenate((near @ y.n.to_numpy(), x.n.to_numpy() @ near)), "ball": np.concatenate((x.ball, y.ball))})
        out = out[(out.n > 0) & ~out.ball.astype(bool)]
        return out.assign(scene=block.scene.iloc[0])[["scene", "id", "n"]]

    return blocks.groupBy("scene", "cell", "a", "b").applyInPandas(run, f"scene {kinds['scene']}, id {kinds['id']}, n long")


def links(blocks: DataFrame, eps: float) -> DataFrame:
    """``scene, ia, ib, core``: links that join the cores of a block as their neighbourhood does, and of each other row one core of each such group.

    ``blocks`` have ``core``, null for those that are none.
    """
    kinds = dict(blocks.dtypes)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        x, y, same = _sides(block)
        columns = ["scene", "ia", "ib", "core"]
        if not len(x) or not len(y):
            return pd.DataFrame([], columns=columns)
        near = _near(x, y, same, eps)
        if same:
            near = near | near.T
        sure = [s.core.notna().to_numpy() for s in (x, y)]
        left, right = np.flatnonzero(sure[0]), np.flatnonzero(sure[1])
        inner, ids = near[np.ix_(left, right)], (x.id.to_numpy()[left], y.id.to_numpy()[right])
        seen, group = (np.zeros(len(left), bool), np.zeros(len(right), bool)), (np.zeros(len(left), np.int64), np.zeros(len(right), np.int64))
        first, out = [], []
        for k in range(len(left)):  # groups of cores, breadth first; each row of the product is looked at once
            if seen[0][k]:
                continue
            name = len(first)
            members, edge = [], np.array([k])
            seen[0][k] = True
            while len(edge):
                group[0][edge] = name
                members += ids[0][edge].tolist()
                over = np.flatnonzero(inner[edge].any(axis=0) & ~seen[1])
                seen[1][over] = True
                group[1][over] = name
                members += ids[1][over].tolist()
                edge = np.flatnonzero(inner[:, over].any(axis=1) & ~seen[0])
                seen[0][edge] = True
            first.append(min(members))
            out += [(m, first[-1], True) for m in set(members) if m != first[-1]]
        names = np.array(first, dtype=ids[0].dtype if len(first) else np.int64)
        stands = (names[group[0]] if len(left) else ids[0], np.where(seen[1], names[group[1]], ids[1]) if len(first) else ids[1])
        for far, own, core in ((near[~sure[0]][:, right], x.id.to_numpy()[~sure[0]], stands[1]), (near[left][:, ~sure[1]].T, y.id.to_numpy()[~sure[1]], stands[0])):
            i, k = np.nonzero(far)
            out += [(m, c, False) for m, c in set(zip(own[i].tolist(), core[k].tolist()))]
        return pd.DataFrame(out, columns=columns[1:]).assign(scene=block.scene.iloc[0])[columns]

    return blocks.groupBy("scene", "cell", "a", "b").applyInPandas(run, f"scene {kinds['scene']}, ia {kinds['id']}, ib {kinds['id']}, core boolean")
