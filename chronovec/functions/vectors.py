"""Vector expressions on arrays of doubles: norms, cosines, distances, prototypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine from -1 to 1; 0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine01(a: Column, b: Column) -> Column:
    """Cosine of unit vectors moved to 0 to 1."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))) + 1) / 2


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x))


def prototype_distance(v: Column, proto: Column, use_cosine: bool = True) -> Column:
    """Distance to a prototype; 1 where there is none."""
    return F.coalesce(1 - cosine(v, proto) if use_cosine else euclidean(v, proto), F.lit(1.0))


def l2norm(v: Column, eps: float = 1e-8) -> Column:
    """Unit vector; ``eps`` is added to the norm."""
    n = norm(v) + eps
    return F.transform(v, lambda x: x / n)


def same_person(v: Column, other: Column, distance: Column, similar: float, near: float) -> Column:
    """By similarity, or by distance where there is no vector."""
    return F.when(v.isNull() | other.isNull(), distance <= near).otherwise(cosine(v, other) >= similar)


def _combined(df: DataFrame, keys: list[str], v: str, agg, extra: list[str]) -> DataFrame:
    long = df.where(F.col(v).isNotNull()).select(*keys, *extra, F.posexplode(v).alias("_pos", "_x"))
    cells = long.groupBy(*keys, "_pos").agg(agg(F.col("_x").cast("double")).alias("_x"))
    return cells.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_x"))), lambda c: c["_x"]).alias("proto"))


def mean_prototype(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Unit mean vector of each group."""
    return _combined(df, keys, v, F.avg, []).withColumn("proto", l2norm(F.col("proto"), 0.0))


def median_prototype(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Unit median vector of each group; the middle two are averaged."""
    return _combined(df, keys, v, F.median, []).withColumn("proto", l2norm(F.col("proto")))


def weighted_prototype(df: DataFrame, keys: list[str], v: str, weight: str) -> DataFrame:
    """Unit mean vector, weighted."""
    return _combined(df, keys, v, lambda x: F.try_divide(F.sum(x * F.col(weight)), F.sum(weight)), [weight]).withColumn("proto", l2norm(F.col("proto"), 0.0))


def embedding_quality(v: Column, score: Column, age: Column, streak: Column, image: Column | None = None) -> Column:
    """Mean of the scores for norm, variance, track score, stability and, if given, the image."""
    n = norm(v)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    variance = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(v)
    parts = [
        F.when(n.between(0.8, 1.2), 1.0).otherwise(F.greatest(F.lit(0.3), 1 - F.abs(1 - n))),
        F.when(variance > 0.01, 1.0).otherwise(F.greatest(F.lit(0.3), variance * 100)),
        score,
        (F.least(age / 10.0, F.lit(1.0)) + F.least(streak / 5.0, F.lit(1.0))) / 2,
    ]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    return total / 4 if image is None else F.when(image.isNull(), total / 4).otherwise((total + image) / 5)


def matching_confidence(records: Column, quality_a: Column, quality_b: Column, similarity: Column) -> Column:
    """Confidence of a match from the number of records, their quality and the similarity."""
    return F.least(records / 10.0, F.lit(1.0)) * 0.3 + (quality_a + quality_b) / 2 * 0.4 + similarity * 0.3
