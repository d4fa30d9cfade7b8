"""Scalar expressions: scores, labels, policies, text and time helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_mean(value: Column) -> Column:
    """Mean of doubles, the same in any order of rows, so that a mean at a threshold is found to be there.

    Values of at most 12 decimals are added up as decimals. If a group holds
    others (longer or not finite ones), its mean is that of doubles.
    """
    d = value.try_cast("decimal(38,12)")
    held = F.bool_and(value.isNull() | F.coalesce(d.cast("double") == value, F.lit(False)))
    return F.coalesce(F.when(held, F.try_divide(F.try_sum(d).cast("double"), F.count(value))), F.avg(value))


def gpu_score(util: Column) -> Column:
    """100 in the band from 70 to 90, less outside it."""
    return F.when(util.between(70, 90), 100.0).when(util < 70, util / 70 * 100).otherwise(F.greatest(F.lit(0.0), 100 - (util - 90) * 2))


def performance_score(fps: Column, gpu: Column, memory_mb: Column, latency: Column, error_rate: Column, total_mb: float = 32000) -> Column:
    """Weighted score of a sample, 0 to 100."""
    zero, m = F.lit(0.0), memory_mb / total_mb * 100
    return (
        F.least(F.lit(100.0), fps / 30 * 100) * 0.3
        + gpu_score(gpu) * 0.25
        + F.when(m <= 80, 100.0).otherwise(F.greatest(zero, 100 - (m - 80) * 5)) * 0.2
        + F.when(latency <= 50, 100.0).otherwise(F.greatest(zero, 100 - (latency - 50))) * 0.15
        + F.greatest(zero, 100 - error_rate * 100) * 0.1
    )


def scenario_score(success: Column, expected_s: Column, took_s: Column, gpu: Column, errors: Column) -> Column:
    """Weighted score of a scenario, 40/30/20/10."""
    speed = F.when(took_s > 0, F.least(F.lit(100.0), expected_s / took_s * 20)).otherwise(0.0)
    return success * 0.4 + speed * 0.3 + gpu_score(gpu) * 0.2 + F.greatest(F.lit(0.0), 100.0 - errors * 10) * 0.1


def tuning_actions(fps: Column, gpu: Column, memory_mb: Column, latency: Column, mode: str = "balanced", total_mb: float = 32000) -> Column:
    """Parameters to turn up or down, by rule, as an array of structs."""
    m = memory_mb / total_mb * 100
    rules = [
        ((fps < 20) & (gpu < 70), "batch_size", "increase"), ((fps < 20) & (gpu < 70), "cuda_streams", "increase"),
        ((fps < 20) & (gpu >= 70), "encoding_crf", "increase"), ((fps < 20) & (gpu >= 70), "frame_skip_ratio", "increase"),
        (m > 85, "batch_size", "decrease"), (m > 85, "memory_pool_mb", "decrease"),
        (latency > 100, "batch_size", "decrease"), (latency > 100, "frame_skip_ratio", "increase"),
        (gpu < 50, "batch_size", "increase"), (gpu < 50, "cuda_streams", "increase"),
    ]
    if mode == "aggressive":
        rules.append((fps > 40, "encoding_crf", "decrease"))
    elif mode == "conservative":
        rules.append((m > 70, "batch_size", "decrease"))
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(p).alias("parameter"), F.lit(a).alias("action"))) for c, p, a in rules]))


def batch_for_queue(depth: Column) -> Column:
    """Larger batches for longer queues."""
    return F.when(depth > 512, 256).when(depth > 256, 128).when(depth > 128, 64).otherwise(32)


def batch_for_memory(batch: Column, ratio: Column, low: int = 1, high: int = 128) -> Column:
    """One step down when memory is short, one up when it is free."""
    return F.when(ratio > 0.8, F.greatest(F.lit(low), batch - 1)).when(ratio < 0.4, F.least(F.lit(high), batch + 1)).otherwise(batch)


def batch_for_free(free_mb: Column, item_mb: float, share: float = 0.8, most: int | None = None) -> Column:
    """What fits into free memory, one at least and the base size at most."""
    n = F.floor(free_mb * share / item_mb)
    return F.greatest(F.lit(1), n if most is None else F.least(F.lit(most), n)).cast("long")


def halved(batch: Column, errors: Column) -> Column:
    """Batch halved for each error, one at least."""
    return F.greatest(F.lit(1), F.floor(batch / F.pow(F.lit(2), errors))).cast("long")


def duration_text(s: Column) -> Column:
    """Seconds as 12.3s, 1m 2.0s or 1h 2m 3.0s."""
    minute = F.floor(s / 60)
    return (
        F.when(s < 60, F.format_string("%.1fs", s))
        .when(s < 3600, F.format_string("%dm %.1fs", minute, s - minute * 60))
        .otherwise(F.format_string("%dh %dm %.1fs", F.floor(s / 3600), F.floor((s - F.floor(s / 3600) * 3600) / 60), s - minute * 60))
    )


def scaled_bitrate(base: int, pixels: Column, per: float) -> Column:
    """Bit rate in proportion to the pixels."""
    return F.floor(base * pixels / per).cast("long")


def adapted_bitrate(base: int, complexity: Column, high: float, low: float, least: int, most: int) -> Column:
    """Bit rate a tenth up or down by complexity, clamped; changes under a twentieth are not made."""
    t = F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), base * F.when(complexity > high, 1.1).when(complexity < low, 0.9).otherwise(1.0)))
    return F.when(F.abs(t - base) / base < 0.05, F.lit(base)).otherwise(F.floor(t)).cast("long")


def chunks(text: Column, size: int = 4000) -> Column:
    """A text in pieces of a fixed number of characters."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def classify(message: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """First rule whose text the message holds, in order."""
    low = F.lower(message)
    out = reduce(lambda acc, r: acc.when(low.contains(r[0]), r[1]), rules[1:], F.when(low.contains(rules[0][0]), rules[0][1]))
    return out.otherwise(default)


def flat_content(content: Column) -> Column:
    """Parts of a message as (type, text); other parts keep their JSON."""
    return F.transform(content, lambda c: F.struct(c["type"].alias("type"), F.coalesce(c["text"]["value"], F.to_json(c)).alias("text")))


def local_time(seconds: Column, zone: str = "Asia/Seoul") -> Column:
    """Epoch seconds as local date and time."""
    utc = F.timestamp_seconds(seconds)
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(utc, F.current_timezone()), "yyyy-MM-dd HH:mm:ss"))), "yyyy-MM-dd HH:mm:ss")


def split_label(rate: Column, balance: Column) -> Column:
    """Quality of a split screen from its detection rate and balance."""
    return F.when((rate >= 80) & (balance <= 30), "excellent").when((rate >= 60) & (balance <= 50), "good").otherwise("poor")
