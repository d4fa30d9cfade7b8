"""WARC archives (operator 3): writing, and reading by boundary-chain verification.

Method. A record starts with a line ``WARC/1.0`` or ``WARC/1.1``, but so may a
line inside a payload. Reading tasks therefore split archives at every such
magic, whatever it belongs to, and emit for each candidate record its offset
and the offset of its successor, which follows from its Content-Length.
Pointer jumping from the start of each file (hops double every round) keeps the
candidates that the chain reaches; magic inside payloads is never reached. The
pointers are jumped inside each split first, which gives where a chain leaves
it; only files of several splits then take rounds of joins, over splits.
Payloads that hold magic are put together from their pieces afterwards, and so
are headers, before the chains are followed: a stretch that starts like a
record and has no blank line is joined with what follows it, up to
``MOST_HEADER`` bytes. Our own archives write the magic in an address with its
slash as %2F. A chain has to end where its file does; if one does not, the
archive is damaged, and reading raises.

Scale. Archives are plain text files that Spark writes and splits; a reading
task holds one record at a time, and hashes payloads where they are read. Only
offsets take part in the jumping: those of one split in a task, and
log2(splits of a file) rounds of merge joins. Equal payloads are grouped by
digest with partial minima; a page joins them by digest, which Spark splits
where one digest is common.

Defined results: a null html is an empty payload. Equal payloads of at least
100 bytes: the rows with the smallest page_id are responses (all of them, if
rows repeat), the others are revisits. Rows with a null page_id are responses.
A revisit's length and digest are those of the response it refers to. Magic in
an address or in any header field is a part of that field. An empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, release, shared_dir, table

#: Every record starts with this, the minor version and a line end.
MAGIC = "WARC/1."
VERSIONS = (b"0\r\n", b"1\r\n")
END = "\r\n\r\n"
#: Shorter payloads are always stored in full.
LEAST_REVISIT = 100
_ID = "urn:page:"
#: Offsets are dealt by this many bytes when pieces of a payload look for their record.
_SPAN = 1 << 20
#: A header that holds magic is read up to so many bytes.
MOST_HEADER = 1 << 16


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(record)``: one WARC record for each page, without the closing blank lines."""
    p = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", "%20"), r"WARC/1\.", "WARC%2F1.").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    shared = p.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # a table of its own, so that its size is known: where it is small, payloads are not shuffled
    p = p.join(materialize(shared.select("digest", "first"), "warc-shared"), "digest", "left")
    again = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit(MAGIC + "1\r\n"),
        F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.concat(F.lit(f"\r\nWARC-Record-ID: <{_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <" + _ID), F.col("first").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END),
    )
    return p.select(F.concat(head, body).alias("record"))


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    """Archives under ``path``, one for each partition of ``pages``."""
    records(pages, **columns).write.option("lineSep", END).text(path)


def _parse(value: bytes) -> tuple | None:
    """(header length, content length, type, record id, digest, id referred to) of what follows the magic."""
    at = value.find(b"\r\n\r\n")
    if at < 0 or value[:3] not in VERSIONS:
        return None
    fields = {}
    for line in value[3:at].split(b"\r\n"):
        k, sep, v = line.partition(b":")
        if sep:
            fields.setdefault(k.strip().lower(), v.strip())
    size = fields.get(b"content-length", b"")
    if not size.isdigit() or b"warc-type" not in fields:
        return None
    text = lambda k: fields.get(k, b"").decode("utf-8", "replace").strip("<>")
    return at + 4, int(size), text(b"warc-type"), text(b"warc-record-id"), text(b"warc-payload-digest").removeprefix("sha256:"), text(b"warc-refers-to") or None


_HEADER = "head long, size long, type string, record_id string, digest string, refers_to string"
_CANDIDATE = f"f long, block long, seq long, rel long, len long, {_HEADER}, sha string, open boolean, value binary"


def candidates(spark: SparkSession, path: str, with_value: bool = False) -> DataFrame:
    """A row for each stretch of an archive between two magic lines, placed within its split."""
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple, list[int]] = {}
        for b in batches:
            rows = []
            for value, f, block in zip(*(c.to_pylist() for c in b.columns)):
                at = place.setdefault((f, block), [0, 0])
                head = size = kind = name = digest = refers = sha = None
                if found := _parse(value):
                    head, size, kind, name, digest, refers = found
                    if head + size <= len(value):
                        sha = hashlib.sha256(value[head : head + size]).hexdigest()
                open_header = value[:3] in VERSIONS and value.find(b"\r\n\r\n") < 0
                rows.append((f, block, at[1], at[0], len(value), head, size, kind, name, digest, refers, sha, open_header, value if with_value else None))
                at[0] += len(value) + len(MAGIC)
                at[1] += 1
            kinds = [pa.int64()] * 7 + [pa.string()] * 5 + [pa.bool_(), pa.binary()]
            names = ["f", "block", "seq", "rel", "len", "head", "size", "type", "record_id", "digest", "refers_to", "sha", "open", "value"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 14, kinds)], names=names)

    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(F.col("value").cast("binary"), F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("block")).mapInArrow(run, _CANDIDATE)


def _next(off: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Place of each candidate's successor among sorted offsets; -1 where it is not among them."""
    at = np.searchsorted(off, to)
    return np.where(off[np.minimum(at, len(off) - 1)] == to, at, -1)


def _sorted_split(split: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    split = split.sort_by("off")
    to = split.column("to").fill_null(-1)
    return split, split.column("off").to_numpy(), to.to_numpy()


def leaves(split: pa.Table) -> pa.Table:
    """Where the chain from each candidate of a split goes when no candidate of the split follows."""
    split, off, to = _sorted_split(split)
    on = _next(off, to)
    while (on >= 0).any():
        to, on = np.where(on >= 0, to[on], to), np.where(on >= 0, on[on], -1)
    return pa.table({"f": split.column("f"), "off": off, "to": to})


def followed(split: pa.Table) -> pa.Table:
    """The candidates of a split that the chain from its entries reaches."""
    split, off, to = _sorted_split(split)
    on, kept = _next(off, to), split.column("entry").to_numpy(zero_copy_only=False).copy()
    while (on >= 0).any():
        new = on[kept]
        kept[new[new >= 0]] = True
        on = np.where(on >= 0, on[on], -1)
    return split.filter(pa.array(kept)).drop_columns("entry")


def reachable(chain: DataFrame, starts: DataFrame) -> DataFrame:
    """``starts(f, off)`` and all ``(f, off)`` that ``chain(f, off, to)`` reaches from them, by pointer jumping.

    The joins are merged: their sides grow with the archives.
    """
    chain = materialize(chain, "warc-chain")
    known, jump, reached = chain.select("f", "off"), chain, materialize(starts, "warc-reached")
    while not jump.isEmpty():
        more = reached.hint("merge").join(jump, ["f", "off"]).select("f", F.col("to").alias("off"))
        old, reached = reached, materialize(reached.unionByName(more.hint("merge").join(known, ["f", "off"], "left_semi")).distinct(), "warc-reached")
        onward = jump.select("f", F.col("off").alias("to"), F.col("to").alias("next"))
        last, jump = jump, materialize(jump.hint("merge").join(onward, ["f", "to"]).select("f", "off", F.col("next").alias("to")), "warc-jump")
        release(old)
        if last is not chain:
            release(last)
    return reached


def _pieces(spark: SparkSession, path: str, placed: DataFrame, owners: DataFrame, most: int | None = None) -> DataFrame:
    """``f, off, joined``: for each of ``owners(f, off, to)`` what its archive has from its magic to ``to``, the magic left out; of a piece ``most`` bytes at most."""
    spans = owners.withColumn("span", F.explode(F.sequence(F.floor(F.col("off") / _SPAN), F.floor(F.col("to") / _SPAN)))).select("f", "span", F.col("off").alias("own"), "to")
    parts = placed.withColumn("span", F.floor(F.col("off") / _SPAN)).select("f", "span", "off", "block", "seq").join(spans, ["f", "span"]).where("off >= own and off < to")
    value = F.col("value") if most is None else F.substring("value", 1, most)
    values = candidates(spark, path, with_value=True).select("f", "block", "seq", value.alias("value"))
    held = parts.select("f", "block", "seq", "off", "own").join(values, ["f", "block", "seq"])
    held = held.groupBy("f", F.col("own").alias("off")).agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("parts"))
    magic = F.lit(MAGIC).cast("binary")
    joined = F.aggregate(F.slice(F.col("parts"), F.lit(2), F.size("parts") - 1), F.element_at("parts", 1)["value"], lambda acc, x: F.concat(acc, magic, x["value"]))
    return held.select("f", "off", joined.alias("joined"))


def _with_whole_headers(spark: SparkSession, path: str, placed: DataFrame) -> DataFrame:
    """``placed`` with the headers read that the magic in one of their fields cut short."""
    cut = placed.where("open")
    if cut.isEmpty():
        return placed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*[_parse(v) or (None,) * 6 for v in b.column("joined").to_pylist()])) or [()] * 6
            kinds = [pa.int64()] * 2 + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([b.column("f"), b.column("off"), *[pa.array(c, t) for c, t in zip(found, kinds)]], names=["f", "off", *[c.split()[0] for c in _HEADER.split(", ")]])

    joined = _pieces(spark, path, placed, cut.select("f", "off", (F.col("off") + MOST_HEADER).alias("to")), MOST_HEADER)
    read = joined.mapInArrow(run, f"f long, off long, {_HEADER}").where("head is not null")
    names = [c.split()[0] for c in _HEADER.split(", ")]
    new = read.select("f", "off", *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_read"))
    both = placed.join(new, ["f", "off"], "left")
    to = F.when(F.col("_read"), F.col("off") + len(MAGIC) + F.col("_head") + F.col("_size") + len(END)).otherwise(F.col("to"))
    changed = both.select(*[to.alias(c) if c == "to" else F.when(F.col("_read"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in placed.columns])
    whole = materialize(changed, "warc-headers")
    release(placed)
    return whole


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, type, payload_bytes, sha, digest, refers_to)`` of the records that the chains reach."""
    found = materialize(candidates(spark, path).drop("value"), "warc-candidates")
    blocks = found.groupBy("f", "block").agg(F.sum(F.col("len") + len(MAGIC)).alias("bytes"))
    file = Window.partitionBy("f")
    base = F.coalesce(F.sum("bytes").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = blocks.select("f", "block", base.alias("base"), F.count("*").over(file).alias("splits"), (F.sum("bytes").over(file) - len(MAGIC)).alias("file_bytes"))
    placed = found.join(splits.hint("merge"), ["f", "block"]).withColumn("off", F.col("base") + F.col("rel") - len(MAGIC))
    ends = materialize(splits.select("f", "file_bytes").distinct(), "warc-files")
    placed = placed.where("off >= 0").withColumn("to", F.col("off") + len(MAGIC) + F.col("head") + F.col("size") + len(END)).drop("rel", "len", "base", "file_bytes")
    placed = _with_whole_headers(spark, path, materialize(placed, "warc-placed"))
    release(found)
    several = placed.where("splits > 1").select("f", "block", "off", "to")
    entries = reachable(several.groupBy("f", "block").applyInArrow(leaves, "f long, off long, to long"), placed.where("off = 0").select("f", "off"))
    flagged = placed.join(entries.hint("merge").withColumn("entry", F.lit(True)), ["f", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    schema = ", ".join(f"{n} {t}" for n, t in flagged.drop("entry").dtypes)
    true = materialize(flagged.groupBy("f", "block").applyInArrow(followed, schema), "warc-true")
    reached = true.groupBy("f").agg(F.max(F.coalesce("to", F.lit(-1))).alias("reached"))
    early = ends.join(reached, "f", "left").where("file_bytes > 0 and coalesce(reached, 0) <> file_bytes").count()
    if early:
        raise ValueError(f"{early} archives under {path} have a record that does not end where the next one starts")
    whole = true.where("sha is not null").select("record_id", "type", F.col("size").alias("payload_bytes"), "sha", "digest", "refers_to")
    broken = materialize(true.where("sha is null and head is not null").select("f", "off", "to", "head", "size", "record_id", "type", "digest", "refers_to"), "warc-broken")
    if broken.isEmpty():
        return whole
    payload = F.expr("substring(joined, int(head) + 1, int(size))")
    put = _pieces(spark, path, placed, broken.select("f", "off", "to")).join(broken, ["f", "off"]).withColumn("payload", payload)
    return whole.unionByName(put.select("record_id", "type", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("sha"), "digest", "refers_to"))


def round_trip(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write ``pages`` as archives and read them: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    path = path or os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    write_archives(pages, path, **columns)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^{_ID}(-?[0-9]+)$', 1) as long)")
    read = read_archives(spark, path).withColumn("page_id", number("record_id")).withColumn("refers_to", number("refers_to"))
    read = materialize(read, "warc-records")
    full = read.where("type = 'response'")
    known = full.groupBy("page_id", "sha").agg(F.min("payload_bytes").alias("bytes")).alias("k").hint("merge")
    again = read.where("type = 'revisit'").alias("r").join(known, (F.col("r.refers_to") == F.col("k.page_id")) & (F.col("r.digest") == F.col("k.sha")), "left")
    again = again.select("r.page_id", F.col("k.bytes").alias("payload_bytes"), F.col("k.sha").alias("payload_digest"), F.col("r.type").alias("record_type"), "r.refers_to")
    return full.select("page_id", "payload_bytes", F.col("sha").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(again)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """All of ``pages`` written as WARC archives and read back."""
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
