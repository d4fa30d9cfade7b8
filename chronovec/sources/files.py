"""Directory scans (A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...], recursive: bool = True) -> DataFrame:
    """``path, modificationTime, length`` of files by extension, in either case; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.where(F.lower("path").rlike(rf"\.({'|'.join(extensions)})$")).select("path", "modificationTime", "length")
