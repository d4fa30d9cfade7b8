"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

#: Rows of an Arrow batch: bounds what a Python worker holds of long texts at once.
BATCH_ROWS = 512
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for texts of any length.

    Plans run later than they are made, so the two options stay set in the
    session; smaller values of the user's own are left alone.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        found = "".join(c for c in spark.conf.get(name) if c.isdigit())
        if not 0 < int(found or 0) <= most:
            spark.conf.set(name, str(most))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts lineage and survives the loss of any executor; a failed task
    rewrites only its own file.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``materialize`` that no later result reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the map of ``perhaps_among``: at most 2^18 rows of 64 bits are broadcast, whatever the table.
MAP_BITS = 24


def perhaps_among(df: DataFrame, key: str, some: DataFrame) -> DataFrame:
    """``df`` with ``_perhaps``: false only where ``key`` is null or none of the one column of ``some``.

    A bit map of hashes of bounded size is broadcast, so that only rows that
    may match need a shuffle to be joined.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MAP_BITS))
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), (s % 64).cast("int"))
    own = spot(F.col(some.columns[0]))
    marks = some.select(F.floor(own / 64).cast("int").alias("_word"), bit(own).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    mine = spot(F.col(key))
    found = df.withColumn("_word", F.floor(mine / 64).cast("int")).join(F.broadcast(marks), "_word", "left")
    return found.select(*df.columns, F.coalesce(F.col(key).isNotNull() & (F.col("_bits").bitwiseAND(bit(mine)) != 0), F.lit(False)).alias("_perhaps"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer where a column of ``df`` is named so."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """True for rows that no classifier may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
