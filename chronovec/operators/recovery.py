"""Error recovery along a timeline (N17): strategies that harden with a streak of errors, and the rule that stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import streaks

#: The first action for each kind of error.
ACTIONS = {
    "gpu_memory": "reduce_quality",
    "frame_processing": "use_previous_frame",
    "single_face_missing": "use_single_frame",
    "dual_face_missing": "use_fallback_frame",
    "resize": "reduce_quality",
    "composition": "use_previous_frame",
    "cuda": "retry_with_cpu",
    "unknown": "use_previous_frame",
}
SAFEST = "use_black_frame"
#: Actions that are not replaced by the safest one.
KEPT = (SAFEST, "emergency_stop")


def recovery_plan(
    df: DataFrame, keys: list[str], order: list[str], failed: Column, kind: str, memory: str, most: int = 10, most_memory: float = 85.0, actions: dict[str, str] | None = None,
) -> DataFrame:
    """Rows of each timeline up to the one that stops it, with ``streak``, ``action`` and ``stopped``.

    From half of ``most`` errors in a row on, the action of an error's kind
    becomes the safest one and stays so for that kind, also after the streak
    has ended; actions in ``KEPT`` stay. A timeline stops at the ``most``-th
    error in a row, or at a ``gpu_memory`` error with more than
    ``most_memory`` in use; what comes after is not in the result. Kinds
    without an action (null ones too) are ``unknown``. Rows without an error
    have no action and streak 0.
    """
    actions = ACTIONS if actions is None else actions
    known = F.when(F.col(kind).isin(*actions), F.col(kind)).otherwise("unknown")
    first = F.create_map(*[F.lit(x) for pair in {"unknown": ACTIONS["unknown"], **actions}.items() for x in pair])
    rows = streaks(df.withColumns({"_failed": F.coalesce(failed, F.lit(False)), "_kind": known}), keys, order, F.col("_failed"))
    so_far = lambda *by: Window.partitionBy(*keys, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hard = F.max(F.col("_failed") & (F.col("streak") >= most // 2)).over(so_far("_kind"))
    usual = first[F.col("_kind")]
    stop = F.col("_failed") & ((F.col("streak") >= most) | ((F.col("_kind") == "gpu_memory") & F.coalesce(F.col(memory) > most_memory, F.lit(False))))
    rows = rows.withColumns({"action": F.when(F.col("_failed"), F.when(hard & ~usual.isin(*KEPT), SAFEST).otherwise(usual)), "stopped": stop})
    stops = F.count_if("stopped").over(so_far())
    return rows.withColumn("_stops", stops - F.col("stopped").cast("int")).where("_stops = 0").drop("_stops", "_failed", "_kind")
