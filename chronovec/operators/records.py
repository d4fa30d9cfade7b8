"""Operators on keyed records and conversations: upserts with a change log, layered settings, threads, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import chunks


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    """Needed columns that are not there; looks at the schema only."""
    return [c for c in needed if c not in df.columns]


def renamed(source: DataFrame, mapping: dict[str, str], target_columns: list[str]) -> DataFrame:
    """Columns under their target names, in the target's order; absent ones are null."""
    out = source.withColumnsRenamed(mapping)
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).alias(c) for c in target_columns])


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key (T11: later source rows win)."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_x")).select(key, *[F.col(f"_x.{c}").alias(c) for c in cols])


def _merged(target: DataFrame, source: DataFrame, key: str, order: str | None = None) -> DataFrame:
    cols = [c for c in target.columns if c != key]
    source = last_by_key(source.withColumn(key, F.col(key).cast("string")), key, order) if order else source

    def side(df: DataFrame, p: str) -> DataFrame:
        own = df.select(F.col(key).cast("string").alias(key), F.lit(True).alias(f"{p}here"), *[F.col(c).alias(f"{p}{c}") for c in cols])
        # the window's shuffle and sort by key are the join's own
        n = F.count("*").over(Window.partitionBy(key))
        again = F.when((F.col("_n") > 1) & F.col(key).isNotNull(), F.raise_error(F.concat(F.lit("repeated key: "), F.col(key)))).otherwise(F.lit(True))
        return own.withColumn("_n", n).where(again).drop("_n")

    return side(target, "t_").join(side(source, "s_"), key, "full_outer")


def upsert(target: DataFrame, source: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Target rows with the source's values where keys meet, and the source's new rows.

    One join on the key; keys compare as strings (C3). Of source rows with one
    key the last in ``order`` counts; other repeated keys raise an error.
    """
    cols = [c for c in target.columns if c != key]
    return _merged(target, source, key, order).select(key, *[F.when(F.col("s_here"), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c) for c in cols])


def change_log(target: DataFrame, source: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """What an upsert does to each source key: ``status`` new, changed or same, ``changes`` as text."""
    cols = [c for c in target.columns if c != key]
    j = _merged(target, source, key, order).where("s_here")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    diffs = F.array_compact(F.array(*[F.when(~F.col(f"t_{c}").cast("string").eqNullSafe(F.col(f"s_{c}").cast("string")), F.concat(F.lit(f"{c}: "), text(f"t_{c}"), F.lit(" -> "), text(f"s_{c}"))) for c in cols]))
    status = F.when(F.col("t_here").isNull(), "new").when(F.size(diffs) > 0, "changed").otherwise("same")
    return j.select(key, status.alias("status"), F.when(F.col("t_here").isNotNull(), F.concat_ws(", ", diffs)).otherwise("").alias("changes"))


def notifications(log: DataFrame, key: str, most: int = 4000) -> DataFrame:
    """Messages for new and changed keys, in pieces that a channel takes."""
    text = F.concat(F.col("status"), F.lit(" "), F.col(key), F.when(F.col("changes") != "", F.concat(F.lit(": "), F.col("changes"))).otherwise(""))
    return log.where("status <> 'same'").select(key, F.posexplode(chunks(text, most)).alias("part", "message"))


def layered(keys: DataFrame, layers: list[DataFrame], on: list[str], value: str) -> DataFrame:
    """The first layer's value that is there, for each setting (A10)."""
    out, names = keys.select(*on).distinct(), []
    for n, layer in enumerate(layers):
        out = out.join(layer.select(*on, F.col(value).alias(f"_v{n}")), on, "left")
        names.append(f"_v{n}")
    return out.select(*on, F.coalesce(*names).alias(value), reduce(lambda acc, n: acc.when(F.col(names[n]).isNotNull(), n), range(1, len(names)), F.when(F.col(names[0]).isNotNull(), 0)).alias("layer"))


def json_list(c: Column) -> Column:
    """A JSON list of strings; ["*"] where it is missing or malformed."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array(F.lit("*")))


def latest_by_role(messages: DataFrame, thread: str, turn: str, role: str, wanted: str, cols: list[str]) -> DataFrame:
    """The last message of a role in each thread."""
    return messages.where(F.col(role) == wanted).groupBy(thread).agg(F.max_by(F.struct(turn, *cols), turn).alias("_x")).select(thread, "_x.*")


def page(messages: DataFrame, thread: str, turn: str, limit: int) -> DataFrame:
    """First page of each thread in ascending order, with its envelope."""
    r = messages.withColumn("_r", F.row_number().over(Window.partitionBy(thread).orderBy(turn)))
    return r.groupBy(thread).agg(F.min(turn).alias("first_id"), F.max(F.when(F.col("_r") <= limit, F.col(turn))).alias("last_id"), F.least(F.count("*"), F.lit(limit)).alias("n"), (F.count("*") > limit).alias("has_more"))


def history(messages: DataFrame, thread: str, turn: str, role: str, text: str, last: int | None = None) -> DataFrame:
    """Each message with the conversation so far (N19), or its ``last`` messages.

    The whole of it grows with the square of a thread's length; long threads
    need ``last``.
    """
    w = Window.partitionBy(thread).orderBy(turn).rowsBetween(Window.unboundedPreceding if last is None else 1 - last, 0)
    return messages.select(thread, turn, F.collect_list(F.struct(F.col(role).alias("role"), F.col(text).alias("content"))).over(w).alias("history"))


def reply_or_notice(message: Column, reply: Column, notice: str) -> Column:
    """A fixed notice for an empty message (C14)."""
    return F.when(F.coalesce(F.trim(message), F.lit("")) == "", F.lit(notice)).otherwise(reply)


def terminal_status(polls: DataFrame, run: str, order: str, status: str, ended: list[str]) -> DataFrame:
    """First status of each run that ends it."""
    return polls.where(F.col(status).isin(*ended)).groupBy(run).agg(F.min_by(F.struct(order, status), order).alias("_x")).select(run, "_x.*")


def attempts(records: DataFrame, job: str, attempt: str, ok: str, most: int) -> DataFrame:
    """Attempts of each job, whether one succeeded, and whether it gave up."""
    return records.groupBy(job).agg(F.max(attempt).alias("attempts"), F.bool_or(ok).alias("success"), (~F.bool_or(ok) & (F.max(attempt) >= most)).alias("gave_up"))


def tally(df: DataFrame, url: str, ok: Column) -> DataFrame:
    """Total, success and failure; blank links count in the total only (C4)."""
    there = F.col(url).isNotNull() & (F.trim(F.col(url)) != "")
    return df.agg(F.count("*").alias("total"), F.count_if(there & ok).alias("success"), F.count_if(there & ~ok).alias("failed"))
