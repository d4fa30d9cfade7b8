"""Spreadsheet scans (A1) and write-back (B1), with the standard library only.

A spreadsheet is read or written by one task, row by row: a task holds the
packed file and a few thousand rows, whatever the rows of a sheet; many are
handled side by side. What the format cannot hold is refused before
rows are gathered: more than ``MOST_ROWS`` rows or ``MOST_COLUMNS`` columns a
sheet, more than ``MOST_CHARACTERS`` characters a cell. Characters that XML
cannot hold are written, and read, as the format's ``_xHHHH_``.
"""

from __future__ import annotations

import io
import math
import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

#: Fixed values of the format; the header is one of the rows.
MOST_ROWS, MOST_COLUMNS, MOST_CHARACTERS = 1_048_576, 16_384, 32_767
#: Rows that a task hands on at a time.
CHUNK = 4096
_UNFIT = re.compile("[\x00-\x08\x0b-\x0d\x0e-\x1f\ud800-\udfff\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def _fit(text: str) -> str:
    """Text as the format holds it."""
    if len(text) > MOST_CHARACTERS:
        raise ValueError(f"a cell holds at most {MOST_CHARACTERS} characters, not {len(text)}")
    return escape(_UNFIT.sub(lambda m: f"_x{ord(m.group()):04X}_", text))


def _plain(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), text)


def _said(item: ElementTree.Element) -> str:
    """The text of a string item: its own and that of its runs, without notes on pronunciation."""
    runs = [item, *item.findall(f"{_MAIN}r")]
    return _plain("".join(t.text or "" for r in runs for t in r.findall(f"{_MAIN}t")))


def _place(ref: str) -> int:
    """Number of a cell's column, from 0."""
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(n: int) -> str:
    return (_letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)


def _each(file, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a kind as they are read; each is let go before the next."""
    above: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(file, ("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if e.tag == f"{_MAIN}{tag}":
            yield e
            if above:
                above[-1].clear()


def rows_of(content: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """Cells of a sheet, by name or number, as strings, row by row; blanks are None."""
    book = zipfile.ZipFile(io.BytesIO(content))
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{_MAIN}sheets/{_MAIN}sheet")
    found = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s.get("name") == sheet)
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[found.get(_LINK)]
    path = target[1:] if target[0] == "/" else f"xl/{target}"
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            shared = [_said(s) for s in _each(f, "si")]
    with book.open(path) as f:
        for row in _each(f, "row"):
            cells: list[str | None] = []
            for c in row:
                at = _place(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value = c.find(f"{_MAIN}v")
                text = "".join(_said(i) for i in c.findall(f"{_MAIN}is")) if c.get("t") == "inlineStr" else None if value is None else value.text
                cells[at] = shared[int(text)] if c.get("t") == "s" and text else text or None
            yield cells


def sheet_rows(content: bytes, sheet: str | int = 0) -> list[list[str | None]]:
    """All rows of ``rows_of`` at once."""
    return list(rows_of(content, sheet))


def workbook(header: list[str], rows: Iterable[tuple], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet; numbers stay numbers, all else is text. Raises where the format cannot hold it.

    Rows are taken one by one; the sheet grows in a file until it is packed,
    as a packer that is not told the size marks it in a way that not all read.
    """
    if len(header) > MOST_COLUMNS:
        raise ValueError(f"a sheet holds at most {MOST_COLUMNS} columns, not {len(header)}")

    def cell(value, ref: str) -> str:
        if value is None or value != value:
            return ""
        if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value):
            return f'<c r="{ref}"><v>{value!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{_fit(str(value))}</t></is></c>'

    def line(n: int, row: tuple) -> str:
        if n > MOST_ROWS:
            raise ValueError(f"a sheet holds at most {MOST_ROWS} rows, its header among them; there are more")
        return f'<row r="{n}">' + "".join(cell(v, f"{_letters(k)}{n}") for k, v in enumerate(row)) + "</row>"

    head, office = '<?xml version="1.0" encoding="UTF-8"?>', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    package = "http://schemas.openxmlformats.org/package/2006"
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, tempfile.NamedTemporaryFile("w", encoding="utf-8", newline="") as f:
        for name, text in files.items():
            z.writestr(name, text)
        f.write(f'{head}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>')
        f.writelines(line(n, r) for n, r in enumerate(chain([tuple(header)], rows), 1))
        f.write("</sheetData></worksheet>")
        f.flush()
        z.write(f.name, "xl/worksheets/sheet1.xml")
    return out.getvalue()


def parsed(books: DataFrame, columns: list[str], sheet: str | int = 0, content: str = "content") -> DataFrame:
    """Rows of a sheet of every workbook of ``books``, all as strings, header in the first row; blanks are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for book in b["content"]:
                rows = rows_of(book, sheet)
                at = {n: k for k, n in enumerate(next(rows, []))}
                found = ([r[at[c]] if c in at and at[c] < len(r) else None for c in columns] for r in rows if any(x is not None for x in r))
                while some := list(islice(found, CHUNK)):
                    yield pd.DataFrame(some, columns=columns, dtype=object)

    return books.select(F.col(content).alias("content")).mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def read_sheets(spark: SparkSession, path: str, columns: list[str], sheet: str | int = 0) -> DataFrame:
    """Rows of a sheet of every workbook under ``path``, as strings (A1)."""
    return parsed(spark.read.format("binaryFile").load(path), columns, sheet)


def inferred(df: DataFrame) -> DataFrame:
    """String columns as whole numbers or numbers, where all their values are (A1)."""
    whole = [F.bool_and(F.col(c).isNull() | F.expr(f"try_cast(`{c}` as long)").isNotNull()).alias(f"{k}w") for k, c in enumerate(df.columns)]
    number = [F.bool_and(F.col(c).isNull() | F.expr(f"try_cast(`{c}` as double)").isNotNull()).alias(f"{k}n") for k, c in enumerate(df.columns)]
    found = df.agg(*whole, *number).first()
    kind = lambda k: "long" if found[f"{k}w"] else "double" if found[f"{k}n"] else "string"
    return df.select(*[F.col(c).cast(kind(k)).alias(c) for k, c in enumerate(df.columns)])


def workbooks(df: DataFrame, book: str) -> DataFrame:
    """``(book, content)``: a workbook of the rows of each value of ``book`` (B1); a workbook is written by one task, row by row.

    Rows are counted first, and raise if a book has more than a sheet holds.
    """
    columns = [c for c in df.columns if c != book]
    large = df.groupBy(book).count().where(F.col("count") >= MOST_ROWS).count()
    if large or len(columns) > MOST_COLUMNS:
        raise ValueError(f"a sheet holds at most {MOST_ROWS} rows and {MOST_COLUMNS} columns; {large} books have more rows, and rows have {len(columns)} columns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in islice(batches, 1):
            kind = first.schema.field(0).type
            rows = (r for b in chain([first], batches) for r in zip(*(c.to_pylist() for c in b.columns)))
            for _, own in groupby(rows, lambda r: repr(r[0])):
                head = next(own)
                content = workbook(columns, (r[1:] for r in chain([head], own)))
                yield pa.RecordBatch.from_arrays([pa.array([head[0]], kind), pa.array([content], pa.binary())], names=[book, "content"])

    # times as the session shows them
    local = {c: F.col(f"`{c}`").cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp" and c != book}
    dealt = df.withColumns(local).select(book, *[f"`{c}`" for c in columns]).repartition(book).sortWithinPartitions(book)
    return dealt.mapInArrow(run, df.select(book, F.lit(b"").alias("content")).schema)


def write_merged(merged: DataFrame, path: str) -> None:
    """Upserted rows as CSV (B1); cell styles are not kept."""
    merged.write.mode("overwrite").option("header", True).csv(path)
