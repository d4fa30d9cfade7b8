"""A polled feed with a numeric offset as a streaming source.

A service hands out updates by id. The driver only asks for the latest offset
and cuts what is new into ranges of ids; executors fetch the ranges. The
offset, the last id plus one, is kept in the stream's checkpoint and told to
the service once a batch is done, so a restart reads no update twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Ranges of a batch at most; where ids are far apart, ranges are wider than a page.
MOST_RANGES = 10_000


class Service(Protocol):
    """What a feed needs; it is sent to the executors, so it should hold addresses and not connections."""

    def latest(self) -> int:
        """The last id that there is, plus one; 0 without updates."""

    def fetch(self, start: int, end: int) -> Iterator[dict]:
        """Updates with ``start <= update_id < end``."""

    def acknowledge(self, offset: int) -> None:
        """All updates before ``offset`` have been taken."""


class Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


def ranges(start: int, end: int, page: int) -> list[Range]:
    """``start`` to ``end`` cut at multiples of ``page``, or of more where that gives too many."""
    step = page * max(1, -(-(end - start) // (page * MOST_RANGES)))
    cuts = [start, *range((start // step + 1) * step, end, step), end]
    return [Range(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def register(spark: SparkSession, name: str, service: Service, page: int = 100) -> None:
    """Register the feed as ``spark.readStream.format(name)``."""

    class Reader(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"offset": 0}

        def latestOffset(self) -> dict:
            return {"offset": service.latest()}

        def partitions(self, start: dict, end: dict) -> list[Range]:
            return ranges(start["offset"], end["offset"], page)

        def read(self, partition: Range) -> Iterator[tuple]:
            for r in service.fetch(partition.start, partition.end):
                yield r["update_id"], json.dumps(r)

        def commit(self, end: dict) -> None:
            service.acknowledge(end["offset"])

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "update_id bigint, payload string"

        def streamReader(self, schema) -> Reader:
            return Reader()

    spark.dataSource.register(Feed)


class Folder:
    """A service whose updates are files of a folder, one sub-folder for each page of ids; any file system that Arrow reaches will do."""

    def __init__(self, path: str, page: int) -> None:
        self.path, self.page = path, page

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def _page(self, n: int) -> list[dict]:
        from pyarrow import fs, parquet

        store, root = self._files()
        some = store.get_file_info(fs.FileSelector(f"{root}/page={n}", allow_not_found=True))
        return [r for f in sorted(x.path for x in some if x.path.endswith(".parquet")) for r in parquet.ParquetFile(store.open_input_file(f)).read().to_pylist()]

    def latest(self) -> int:
        from pyarrow import fs

        store, root = self._files()
        some = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        last = max((int(x.base_name[5:]) for x in some if x.base_name.startswith("page=")), default=None)
        return 0 if last is None else max(r["update_id"] for r in self._page(last)) + 1

    def fetch(self, start: int, end: int) -> Iterator[dict]:
        for n in range(start // self.page, (end - 1) // self.page + 1):
            yield from (r for r in self._page(n) if start <= r["update_id"] < end)

    def acknowledge(self, offset: int) -> None:
        store, root = self._files()
        with store.open_output_stream(f"{root}/_offset") as out:
            out.write(str(offset).encode())


def publish(updates: DataFrame, id_: str, path: str, page: int) -> Folder:
    """Write ``updates`` to where a ``Folder`` hands them out; ids are not negative and not null, and a page that is there grows."""
    rows = updates.withColumnRenamed(id_, "update_id").withColumn("page", F.expr(f"update_id div {page}"))
    rows.repartition("page").write.mode("append").partitionBy("page").parquet(path)
    return Folder(path, page)
