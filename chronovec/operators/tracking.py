"""Operators on detections and tracks, in Spark expressions: previous frames, swap risk, slot assignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B


def band(confidence: Column, high: float = 0.6) -> Column:
    """High or low confidence."""
    return F.when(confidence >= high, "high").otherwise("low")


def top_faces(df: DataFrame, keys: list[str], id_: str, least: float, n: int = 2) -> DataFrame:
    """The most confident detections of a frame that are large enough."""
    big = df.where((F.col("w") >= least) & (F.col("h") >= least))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("conf"), id_))
    return big.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def with_previous(df: DataFrame, keys: list[str], frame: str, track: str, cols: list[str]) -> DataFrame:
    """Each track with its values in exactly the frame before."""
    before = df.select(*keys, track, (F.col(frame) + 1).alias(frame), *[F.col(c).alias(f"prev_{c}") for c in cols])
    return df.join(before, [*keys, track, frame])


def _aged(age: Column) -> Column:
    return F.least(age / 10.0, F.lit(1.0))


def position_jumps(df: DataFrame, most: float = 100.0) -> DataFrame:
    """Jumps of a track's centre (F5): risk grows to 1 at twice ``most``. Rows hold cx, cy, prev_cx, prev_cy, age, score."""
    dx, dy = F.col("cx") - F.col("prev_cx"), F.col("cy") - F.col("prev_cy")
    d = df.withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") > most)
    sure = _aged(F.col("age")) * 0.3 + F.col("score") * 0.4 + F.least(F.col("distance") / (most * 3), F.lit(1.0)) * 0.3
    return d.withColumns({"type": F.lit("position"), "risk": F.least(F.col("distance") / (most * 2), F.lit(1.0)), "confidence": sure})


def size_changes(df: DataFrame, most: float = 0.5) -> DataFrame:
    """Changes of a track's area (F6): risk grows to 1 at one and a half times ``most``."""
    r = F.abs(F.col("area") - F.col("prev_area")) / F.greatest("area", "prev_area")
    d = df.where((F.col("area") > 0) & (F.col("prev_area") > 0)).withColumn("ratio", r).where(F.col("ratio") > most)
    sure = _aged(F.col("age")) * 0.3 + F.col("score") * 0.3 + F.least(F.col("ratio") / (most * 2), F.lit(1.0)) * 0.4
    return d.withColumns({"type": F.lit("size"), "risk": F.least(F.col("ratio") / (most * 1.5), F.lit(1.0)), "confidence": sure})


def _turn(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> Column:
    c = F.col
    return (c(cy) - c(ay)) * (c(bx) - c(ax)) > (c(by) - c(ay)) * (c(cx) - c(ax))


def paths_cross(s: str, t: str) -> Column:
    """Whether the moves of two tracks cross; touching or collinear moves do not."""
    a, b = [(f"prev_cx_{x}", f"prev_cy_{x}") for x in (s, t)], [(f"cx_{x}", f"cy_{x}") for x in (s, t)]
    one = _turn(*a[0], *a[1], *b[1]) != _turn(*b[0], *a[1], *b[1])
    two = _turn(*a[0], *b[0], *a[1]) != _turn(*a[0], *b[0], *b[1])
    return one & two


def crossings(df: DataFrame, keys: list[str], track: str, near: float = 20.0, least: float = 0.5) -> DataFrame:
    """Pairs of tracks whose paths cross, or that are close and closing in.

    Pairs three times ``near`` apart, or whose distance hardly changed, do not count.
    """
    cols = ["cx", "cy", "prev_cx", "prev_cy", "age", "score"]
    side = lambda s: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in (track, *cols)])
    p = side("a").join(side("b"), keys).where(F.col(f"{track}_a") < F.col(f"{track}_b"))
    gap = lambda q: F.sqrt((F.col(f"{q}cx_a") - F.col(f"{q}cx_b")) ** 2 + (F.col(f"{q}cy_a") - F.col(f"{q}cy_b")) ** 2)
    p = p.withColumns({"now": gap(""), "was": gap("prev_")})
    now, was = F.col("now"), F.col("was")
    score = (
        F.when((now > near * 3) | (F.abs(now - was) < 5.0), 0.0)
        .when(paths_cross("a", "b"), 0.8 + 0.2 * F.greatest(F.lit(0.0), 1 - now / (near * 2)))
        .when((now < near) & (now < was), 0.3 + 0.3 * (1 - now / near))
        .otherwise(0.0)
    )
    out = p.withColumn("risk", score).where(F.col("risk") > least)
    sure = _aged((F.col("age_a") + F.col("age_b")) / 2) * 0.5 + (F.col("score_a") + F.col("score_b")) / 2 * 0.5
    return out.withColumns({"type": F.lit("crossing"), "confidence": sure})


WEIGHTS = {"position": 0.4, "size": 0.3, "crossing": 0.3}


def overall_risk(frames: DataFrame, keys: list[str], indicators: list[DataFrame], bar: float = 0.6) -> DataFrame:
    """Weighted risk of each frame, with a recommendation (F8); frames without indicators have none."""
    all_ = reduce(DataFrame.unionByName, [i.select(*keys, "type", "risk", "confidence") for i in indicators])
    w = F.when(F.col("type") == "position", WEIGHTS["position"]).when(F.col("type") == "size", WEIGHTS["size"]).otherwise(WEIGHTS["crossing"])
    r = all_.withColumn("_w", w).groupBy(*keys).agg((F.sum(F.col("risk") * F.col("confidence") * F.col("_w")) / F.sum("_w")).alias("risk"), F.avg("confidence").alias("confidence"))
    out = frames.join(r, keys, "left").select(*keys, F.coalesce("risk", F.lit(0.0)).alias("risk"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    label = F.when(F.col("risk") < 0.3, "continue").when(F.col("risk") < 0.6, "monitor").when(F.col("risk") < 0.8, "re-identify").otherwise("re-identify at once")
    return out.withColumns({"label": label, "swap": F.col("risk") > bar})


def best_pairs(frames: DataFrame, keys: list[str], id_: str, cost_a: str, cost_b: str) -> DataFrame:
    """The two different detections of a frame that cost least for slots A and B together.

    Two slots leave few ordered pairs in a frame, so all are compared; a
    single detection goes to its cheaper slot.
    """
    side = lambda s, c: frames.select(*keys, F.col(id_).alias(f"id_{s}"), F.col(c).alias(f"cost_{s}"))
    p = side("a", cost_a).join(side("b", cost_b), keys).where("id_a <> id_b")
    two = p.groupBy(*keys).agg(F.min(F.struct((F.col("cost_a") + F.col("cost_b")).alias("cost"), "id_a", "id_b")).alias("x")).select(*keys, "x.id_a", "x.id_b", "x.cost")
    alone = frames.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1")
    first = F.col(cost_a) <= F.col(cost_b)
    one = alone.select(*keys, F.when(first, F.col(id_)).alias("id_a"), F.when(~first, F.col(id_)).alias("id_b"), F.least(cost_a, cost_b).alias("cost"))
    return two.unionByName(one)


def slot_cost(similarity: Column, overlap: Column, far: float = 0.45, penalty: float = 10.0) -> Column:
    """Cost of a detection for a slot, with a penalty for unlike vectors."""
    d = 1 - similarity
    return 0.45 * d + 0.45 * (1 - overlap) + F.when(d > far, penalty).otherwise(0.0)


def unmatched(all_: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no match uses."""
    return all_.join(matched, keys, "left_anti")


def nearest(points: DataFrame, faces: DataFrame, keys: list[str], most: float = 200.0, least: float = 0.3) -> DataFrame:
    """Nearest confident face to each predicted point of a frame (D10). Points hold px, py; faces cx, cy, conf, det."""
    d = F.sqrt((F.col("cx") - F.col("px")) ** 2 + (F.col("cy") - F.col("py")) ** 2)
    j = points.join(faces.where(F.col("conf") >= least), keys).withColumn("distance", d).where(F.col("distance") <= most)
    return j.groupBy(*keys, "px", "py").agg(F.min(F.struct("distance", "det")).alias("x")).select(*keys, "px", "py", "x.det", "x.distance")


def box_of(prefix: str = "") -> B.Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))
