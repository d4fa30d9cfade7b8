"""Stateful operators on live streams: identities (N1), tracks (N3) and sessions.

A stream's rows come in any order within a bound (``late``). Each key keeps
the rows that the watermark has not passed yet, by (time, id), so a row that
is sent again counts once; a timer at the earliest one wakes the key. The rows
that the watermark has passed are then taken in order, by the same step
functions as the batch operators use, on state that holds what the step needs
and no more. A restart goes on from the checkpoint. Results come when the
watermark has passed; ``drained`` sends one last row far ahead to end a
finished stream.

The state store must be RocksDB (``rocks`` sets it for a while).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.identity import identify
from ..operators.stateful import BOX, Track, track_frame

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times start so many seconds after 1970, as rows at the time where watermarks start would count as late.
START = 86400


@contextmanager
def rocks(spark: SparkSession):
    """Streams started within keep their state in RocksDB; the session's own choice comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class InOrder(StatefulProcessor):
    """Rows of a key by (time, id) once the watermark has passed them; subclasses say what a step is.

    ``columns``: name and type of each value that is kept of a waiting row.
    ``ttl_ms``: a key that pauses for longer, in event time, starts anew, and
    its state is dropped by then; None keeps it.
    """

    def __init__(self, columns: list[tuple[str, str]], ttl_ms: int | None) -> None:
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, id long", ", ".join(f"{n} {t}" for n, t in self.columns))
        self.newest = handle.getValueState("newest", "at long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def steps(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        """Results of rows ``(at in microseconds, id, *columns)``, which are in order."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for at, i, *values in zip(pdf["row_us"], pdf["row_id"], *[pdf[n] for n, _ in self.columns]):
                self.waiting.updateValue((int(at), int(i)), tuple(v.item() if isinstance(v, np.generic) else v for v in values))
        self._wake()
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= passed)
        for k, _ in ready:
            self.waiting.removeKey(k)
        last = self.newest.get()[0] if self.newest.exists() else None
        rows = [(*k, *v) for k, v in ready]
        while rows:  # up to the next pause that is longer than the time to live
            n = 1
            if self._over(last, rows[0][0]):
                self.forget()
            while n < len(rows) and not self._over(rows[n - 1][0], rows[n][0]):
                n += 1
            yield self.steps(key, rows[:n])
            last, rows = rows[n - 1][0], rows[n:]
        if last is not None and self._over(last, passed):
            self.forget()
            self.newest.clear()
        elif ready:
            self.newest.update((last,))
        self._wake()

    def _over(self, before: int | None, at: int) -> bool:
        return self.ttl_ms is not None and before is not None and at - before > self.ttl_ms * 1000

    def _wake(self) -> None:
        """One timer: at the first waiting row, or at the end of the time to live."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        first = min((k[0] for k in self.waiting.keys()), default=None)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        elif self.ttl_ms is not None and self.newest.exists():
            self.handle.registerTimer(-(-self.newest.get()[0] // 1000) + self.ttl_ms + 1)

    def close(self) -> None:
        pass


class Identities(InOrder):
    """The stored vectors of a key, by identity."""

    def __init__(self, threshold: float, first: bool, ttl_ms: int | None) -> None:
        super().__init__([("v", "binary")], ttl_ms)
        self.threshold, self.first = threshold, first

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getMapState("store", "identity long", "v binary")

    def steps(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        known = {k[0]: np.frombuffer(v[0]) for k, v in self.store.iterator()}
        store, changed, out = [known[k] for k in range(len(known))], set(), []
        for at, i, v in rows:
            k = identify(store, np.frombuffer(v), self.threshold, self.first)
            changed.add(k)
            out.append((key[0], at, i, k))
        for k in changed:
            self.store.updateValue((k,), (store[k].tobytes(),))
        return pd.DataFrame(out, columns=["key", "at", "id", "identity"])

    def forget(self) -> None:
        self.store.clear()


class Tracks(InOrder):
    """The tracks of a key, by number, and the next number."""

    def __init__(self, high: float, least_iou: float, lost: int, ttl_ms: int | None) -> None:
        super().__init__([("conf", "double"), *[(c, "double") for c in BOX]], ttl_ms)
        self.how = (high, least_iou, lost)

    def open(self, handle: StatefulProcessorHandle) -> None:
        kinds = [*[f"{c} double" for c in BOX], "score double", "state string", "age long", "hits long", "missed long"]
        self.tracks = handle.getMapState("tracks", "number long", ", ".join(kinds))
        self.next = handle.getValueState("next", "number long")

    def steps(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        tracks, had = [], set()
        for (number,), (*box, score, state, age, hits, missed) in sorted((tuple(k), tuple(v)) for k, v in self.tracks.iterator()):
            t = Track(number, np.array(box), score)
            t.state, t.age, t.hits, t.missed = state, age, hits, missed
            tracks.append(t)
            had.add(number)
        number = self.next.get()[0] if self.next.exists() else 0
        out, lo = [], 0
        for hi in range(1, len(rows) + 1):
            if hi == len(rows) or rows[hi][0] != rows[lo][0]:  # all rows of one time are a frame
                frame = rows[lo:hi]
                boxes, scores, ids = np.array([r[3:] for r in frame], float), np.array([r[2] for r in frame], float), np.array([r[1] for r in frame])
                tracks, number, found = track_frame(tracks, number, boxes, scores, ids, *self.how)
                out += [(key[0], frame[0][0], *r) for r in found]
                lo = hi
        for t in tracks:
            self.tracks.updateValue((t.number,), (*map(float, t.box), float(t.score), t.state, t.age, t.hits, t.missed))
        for gone in had - {t.number for t in tracks}:
            self.tracks.removeKey((gone,))
        self.next.update((number,))
        return pd.DataFrame(out, columns=["key", "at", "id", "track", "state", "hits"])

    def forget(self) -> None:
        self.tracks.clear()
        self.next.clear()


class Session(InOrder):
    """The turns of a session so far, or the last of them."""

    def __init__(self, last: int | None, ttl_ms: int | None) -> None:
        super().__init__([("role", "string"), ("text", "string")], ttl_ms)
        self.last = last

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "role string, text string")

    def steps(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        turns = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        had, out = len(turns), []
        for at, i, role, text in rows:
            turns.append((role, text))
            seen = turns if self.last is None else turns[-self.last :]
            out.append((key[0], at, i, [r for r, _ in seen], [t for _, t in seen]))
        if self.last is None:
            self.turns.appendList(turns[had:])
        else:
            self.turns.put(turns[-self.last :])
        return pd.DataFrame(out, columns=["key", "at", "id", "roles", "texts"])

    def forget(self) -> None:
        self.turns.clear()


def _run(stream: DataFrame, processor: InOrder, key: str, t: Column, id_: str, values: dict[str, Column], out: str, late: str) -> DataFrame:
    kind = dict(stream.dtypes)[key]
    at = F.timestamp_micros(((t + START) * 1_000_000).cast("long"))
    rows = stream.select(F.col(key).alias("key"), at.alias("row_at"), F.col(id_).cast("long").alias("row_id"), *[c.alias(n) for n, c in values.items()])
    rows = rows.withWatermark("row_at", late).withColumn("row_us", F.unix_micros("row_at"))  # names without a leading underscore, which pandas batches lose
    found = rows.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, at long, id long, {out}", "Append", "EventTime")
    return found.withColumn("at", F.col("at") / 1e6 - START).where(F.col("key").isNotNull())


def _ms(ttl: float | None) -> int | None:
    return None if ttl is None else int(ttl * 1000)


def live_identities(stream: DataFrame, key: str, t: Column, id_: str, v: str, threshold: float, first: bool = False, late: str = "0 seconds", ttl: float | None = None) -> DataFrame:
    """``key, at, id, identity`` of a stream's vectors, as ``online_ids`` gives them for a table in order of (t, id); t is in seconds from 0 on."""
    packed = F.udf(lambda x: None if x is None else np.asarray(x, float).tobytes(), "binary", useArrow=True)
    return _run(stream, Identities(threshold, first, _ms(ttl)), key, t, id_, {"v": packed(v)}, "identity long", late)


def live_tracks(
    stream: DataFrame, key: str, t: Column, id_: str, conf: str, high: float = 0.6, least_iou: float = 0.3, lost: int = 30, late: str = "0 seconds", ttl: float | None = None,
) -> DataFrame:
    """``key, at, id, track, state, hits`` of a stream's detections, as ``lifecycle_tracks``; rows of one time are a frame."""
    values = {"conf": F.col(conf).cast("double"), **{c: F.col(c).cast("double") for c in BOX}}
    return _run(stream, Tracks(high, least_iou, lost, _ms(ttl)), key, t, id_, values, "track long, state string, hits long", late)


def live_sessions(stream: DataFrame, key: str, t: Column, id_: str, role: str, text: str, last: int | None = None, late: str = "0 seconds", ttl: float | None = None) -> DataFrame:
    """``key, at, id, history`` of a stream's messages, as ``records.history``; a session that is idle for ``ttl`` seconds starts anew."""
    found = _run(stream, Session(last, _ms(ttl)), key, t, id_, {"role": F.col(role), "text": F.col(text)}, "roles array<string>, texts array<string>", late)
    history = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.struct(x["roles"].alias("role"), x["texts"].alias("content")))
    return found.select("key", "at", "id", history.alias("history"))


def drained(source: DataFrame, key: str, id_: str, t: str, operator, path: str, far: float) -> DataFrame:
    """The whole result of ``operator(stream)`` over a finished stream, as a table.

    It runs over all that is there, then starts again from its checkpoint with
    one more row, ``far`` ahead in time and of no key, by which the watermark
    passes everything else.
    """
    spark = source.sparkSession
    end = spark.createDataFrame([], source.schema)
    end.write.parquet(f"{path}/end")  # an empty table, so that the folder is there
    both = source.unionByName(spark.readStream.schema(source.schema).parquet(f"{path}/end"))
    found = operator(both)
    once = lambda: found.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/data").trigger(availableNow=True).start().awaitTermination()
    with rocks(spark):
        once()
        last = [F.lit(far).cast(f.dataType).alias(f.name) if f.name == t else F.lit(0).cast(f.dataType).alias(f.name) if f.name == id_ else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema]
        spark.range(1).select(*last).write.mode("append").parquet(f"{path}/end")
        once()
    return spark.read.schema(found.schema).parquet(f"{path}/data")
