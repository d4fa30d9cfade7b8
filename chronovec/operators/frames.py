"""Frames as tables of pixels: edges, variance and entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audio import entropy


def _beside(c: str, w) -> tuple[Column, Column]:
    """The values before and after in a line; at an end the one across, as if the line were mirrored there."""
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return F.coalesce(before, after, F.col(c)), F.coalesce(after, before, F.col(c))


def edges(pixels: DataFrame, keys: list[str], y: str, x: str, value: str) -> DataFrame:
    """``pixels`` with ``edge``: the length of the gradient by the 3 x 3 operator with weights 1, 2, 1.

    The operator is applied along rows and then along columns, so a frame is
    never in one task: a line of it is.
    """
    row, column = Window.partitionBy(*keys, y).orderBy(x), Window.partitionBy(*keys, x).orderBy(y)
    left, right = _beside(value, row)
    lines = pixels.withColumns({"_dx": (right - left).cast("double"), "_sx": (left + 2 * F.col(value) + right).cast("double")})
    (dx_up, dx_down), (sx_up, sx_down) = _beside("_dx", column), _beside("_sx", column)
    gx, gy = dx_up + 2 * F.col("_dx") + dx_down, sx_down - sx_up
    return lines.withColumn("edge", F.sqrt(gx * gx + gy * gy)).drop("_dx", "_sx")


def complexity(pixels: DataFrame, keys: list[str], y: str, x: str, value: str) -> DataFrame:
    """``keys, edge_density, variance, entropy, complexity`` of each frame of values from 0 to 255.

    Complexity weighs edges and variance, both over their full scale, by 0.3
    and entropy by 0.4, and lies within 0 and 1.
    """
    found = edges(pixels, keys, y, x, value).groupBy(*keys).agg((F.avg("edge") / 255).alias("edge_density"), (F.var_pop(value) / 255.0**2).alias("variance"))
    both = found.join(entropy(pixels, keys, value, 8), keys)
    total = 0.3 * F.col("edge_density") + 0.3 * F.col("variance") + 0.4 * F.col("entropy")
    return both.withColumn("complexity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
