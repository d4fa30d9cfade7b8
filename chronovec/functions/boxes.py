"""Box expressions: derived columns, overlap, distances, costs, crops and fits.

Boxes are given as four columns x1, y1, x2, y2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def derived(b: Box) -> dict[str, Column]:
    """Width, height, area, centre and aspect."""
    w, h = b[2] - b[0], b[3] - b[1]
    return {"width": w, "height": h, "area": w * h, "center_x": (b[0] + b[2]) / 2, "center_y": (b[1] + b[3]) / 2, "aspect": F.try_divide(w, h)}


def good_quality(b: Box, frame_w: int, frame_h: int, least: float = 30, low: float = 0.5, high: float = 2.0) -> Column:
    """Large enough, inside the frame and not too flat or thin."""
    w, h = b[2] - b[0], b[3] - b[1]
    inside = (b[0] >= 0) & (b[1] >= 0) & (b[2] <= frame_w) & (b[3] <= frame_h)
    return (w >= least) & (h >= least) & inside & F.coalesce(F.try_divide(w, h).between(low, high), F.lit(False))


def iou(a: Box, b: Box, eps: float = 0.0) -> Column:
    """Overlap over union, 0 where the union is empty; ``eps`` is the least union."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / F.greatest(union, F.lit(eps)) if eps else F.when(union > 0, w * h / union).otherwise(0.0)


def center_distance(a: Box, b: Box) -> Column:
    dx, dy = (a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2
    return F.sqrt(dx * dx + dy * dy)


def size_similarity(a: Box, b: Box) -> Column:
    """Smaller area over larger."""
    x, y = (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
    return F.coalesce(F.try_divide(F.least(x, y), F.greatest(x, y)), F.lit(0.0))


def combined_cost(a: Box, b: Box, iou_weight: float = 0.7, distance_weight: float = 0.2, size_weight: float = 0.1) -> Column:
    """Weighted overlap, distance and size cost."""
    return iou_weight * (1 - iou(a, b)) + distance_weight * F.least(center_distance(a, b) / 1000, F.lit(1.0)) + size_weight * (1 - size_similarity(a, b))


def hybrid_inverse(similarity: Column, distance: Column) -> Column:
    return 0.7 * similarity + 0.3 * (1 / (1 + distance / 100))


def hybrid_linear(similarity: Column, distance: Column) -> Column:
    return 0.9 * similarity + 0.1 * F.greatest(F.lit(0.0), 1 - distance / 200)


def hybrid_profile(similarity: Column, position: Column, size: Column) -> Column:
    """Weighted by those of the three that are there."""
    total, weights = F.lit(0.0), F.lit(0.0)
    for c, w in ((similarity, 0.6), (position, 0.2), (size, 0.2)):
        total, weights = total + F.coalesce(c * w, F.lit(0.0)), weights + F.when(c.isNotNull(), w).otherwise(0.0)
    return F.coalesce(F.try_divide(total, weights), F.lit(0.0))


def crop_window(cx: Column, cy: Column, size: Column, frame_w: int, frame_h: int) -> dict[str, Column]:
    """Square window around a centre, moved into the frame (C11)."""
    half = F.floor(size / 2)
    x1 = F.greatest(F.lit(0), F.least(F.floor(cx) - half, F.lit(frame_w) - size))
    y1 = F.greatest(F.lit(0), F.least(F.floor(cy) - half, F.lit(frame_h) - size))
    return {"crop_x1": x1, "crop_y1": y1, "crop_x2": F.least(x1 + size, F.lit(frame_w)), "crop_y2": F.least(y1 + size, F.lit(frame_h))}


def clamped_crop(cx: Column, cy: Column, w: int, h: int, frame_w: int, frame_h: int) -> dict[str, Column]:
    """Window whose sides are clamped one by one (C11, the older rule)."""
    x, y = F.floor(cx), F.floor(cy)
    return {
        "crop_x1": F.greatest(F.lit(0), x - w // 2), "crop_y1": F.greatest(F.lit(0), y - h // 2),
        "crop_x2": F.least(F.lit(frame_w), x + w // 2), "crop_y2": F.least(F.lit(frame_h), y + h // 2),
    }


def adaptive_crop_size(area: Column, w: Column, h: Column, frame_w: int, frame_h: int) -> Column:
    """Wider margins for smaller faces, between 100 and the frame's short side."""
    margin = F.when(area < 5000, 3.5).when(area < 15000, 2.5).otherwise(2.0)
    return F.greatest(F.lit(100), F.least(F.floor(F.greatest(w, h) * margin), F.lit(min(frame_w, frame_h))))


def split_widths(a: Column, b: Column, total: int = 1920) -> dict[str, Column]:
    """Widths of a screen split by size, each side at least three tenths."""
    r = F.when(a + b > 0, F.least(F.greatest(F.try_divide(a, a + b), F.lit(0.3)), F.lit(0.7))).otherwise(0.5)  # greatest and least skip nulls
    left = F.floor(total * r)
    return {"ratio": r, "left_width": left, "right_width": total - left}


def fit(w: Column, h: Column, tw: int, th: int, cover: bool = False) -> dict[str, Column]:
    """Scale, size and offset that fit a picture in a target, or cover it."""
    scale = (F.greatest if cover else F.least)(F.lit(float(tw)) / w, F.lit(float(th)) / h)
    nw, nh = F.floor(w * scale), F.floor(h * scale)
    return {"scale": scale, "new_w": nw, "new_h": nh, "off_x": F.floor((tw - nw) / 2), "off_y": F.floor((th - nh) / 2)}


def detection(scores: Column, cx: Column, cy: Column, w: Column, h: Column, scale: float, pad_x: float, pad_y: float, frame_w: int, frame_h: int) -> dict[str, Column]:
    """Class and box of a raw detector row: best class, box corners, padding undone, clipped."""
    clip = lambda v, most: F.greatest(F.lit(0.0), F.least(v, F.lit(float(most))))
    return {
        "confidence": F.array_max(scores), "class_id": (F.array_position(scores, F.array_max(scores)) - 1).cast("int"),
        "x1": clip((cx - w / 2 - pad_x) / scale, frame_w), "y1": clip((cy - h / 2 - pad_y) / scale, frame_h),
        "x2": clip((cx + w / 2 - pad_x) / scale, frame_w), "y2": clip((cy + h / 2 - pad_y) / scale, frame_h),
    }


def mouth_aspect(points: Column, upper: list[int], lower: list[int], left: int, right: int) -> Column:
    """Mean opening over width of a mouth, from an array of (x, y) points."""
    d = lambda a, b: F.sqrt((points[a]["x"] - points[b]["x"]) ** 2 + (points[a]["y"] - points[b]["y"]) ** 2)
    height = sum((d(u, v) for u, v in zip(upper, lower)), F.lit(0.0)) / len(upper)
    return F.coalesce(F.try_divide(height, d(left, right)), F.lit(0.0))
