"""Report and file sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows as CSV with a header in each file."""
    df.write.mode("append").option("header", True).csv(path)


def json_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON object for each row, beside its keys."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("report"))


def write_report(df: DataFrame, path: str, text: bool = False) -> None:
    """Write rows as JSON lines, or a single text column as text."""
    (df.write.mode("overwrite").text if text else df.write.mode("overwrite").json)(path)


def segment_name(start: Column, end: Column, person: Column | None = None) -> Column:
    """File name of a segment, with the person where there are several."""
    name = F.format_string("segment_%d_%d.mp4", start, F.floor(end).cast("int"))
    return name if person is None else F.concat(F.format_string("person_%d_", person), name)


def filter_graph(segments: DataFrame, keys: list[str], order: str, start: str, end: str) -> DataFrame:
    """Trim and concatenation graph over the ordered segments of each key."""
    s = F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"), F.col(start).alias("a"), F.col(end).alias("b"))))
    g = segments.groupBy(*keys).agg(s.alias("s"))
    trim = lambda x, tail: F.format_string(f"[0:v]trim=start=%.3f:end=%.3f,setpts=PTS-STARTPTS[v{tail}]", *([x["a"], x["b"], x["i"]] if tail else [x["a"], x["b"]]))
    many = F.concat(
        F.array_join(F.transform("s", lambda x: trim(x, "%d")), ";"), F.lit(";"), F.array_join(F.transform("s", lambda x: F.format_string("[v%d]", x["i"])), ""), F.format_string("concat=n=%d:v=1[v]", F.size("s"))
    )
    return g.select(*keys, F.when(F.size("s") == 1, trim(F.col("s")[0], "")).otherwise(many).alias("graph"))
