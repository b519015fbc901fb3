"""Workbooks inside archives: every sheet's rows as cells by column name, read a row at a time.

``sheets`` takes a table with an archive's name and bytes, as Spark's ``binaryFile`` reader gives it from any store, and gives a row
per sheet row.  Of a workbook only its shared strings are held; sheets are streamed, and a row's cells go to the columns that
the sheet's first row with cells names.  ``money`` turns a column into amounts and keeps apart what is no amount.

A nested archive member that is no workbook is passed over; a broken one gives a row with ``problem``.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "archive string, workbook string, sheet string, row long, cells map<string,string>, problem string"
#: Sheet rows of one Arrow batch.
BATCH_ROWS = 5000
_ARROW = pa.schema([("archive", pa.string()), ("workbook", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.map_(pa.string(), pa.string())), ("problem", pa.string())])
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _strings(e: ET.Element) -> str:
    """The text of all runs below an element, phonetic hints aside."""
    return "".join(x.text or "" for x in e.iter() if _local(x) == "t")


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ET.iterparse(f):
            if _local(e) == "si":
                out.append(_strings(e))
                e.clear()
    return out


def _parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of sheets and their members, in the workbook's order."""
    targets = {e.get("Id"): e.get("Target") for e in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = [(e.get("name"), targets[e.get(_REL)]) for e in ET.fromstring(book.read("xl/workbook.xml")).iter() if _local(e) == "sheet"]
    return [(name, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for name, t in found]


def _value(cell: ET.Element, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return _strings(cell)
    v = next((x.text for x in cell if _local(x) == "v"), None)
    return shared[int(v)] if kind == "s" and v is not None else v


def _column(reference: str | None, at: int) -> int:
    """The number of a cell's column by its reference, or the next one."""
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return at
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def rows(book: zipfile.ZipFile, member: str, shared: list[str]) -> Iterator[tuple[int, dict[int, str]]]:
    """Row numbers and values by column; rows without values are passed over."""
    with book.open(member) as f:
        number = 0
        for _, e in ET.iterparse(f):
            if _local(e) != "row":
                continue
            number = int(e.get("r") or number + 1)
            values, at = {}, 0
            for cell in e:
                at = _column(cell.get("r"), at)
                value = _value(cell, shared)
                if value not in (None, ""):
                    values[at] = value
                at += 1
            e.clear()
            if values:
                yield number, values


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    """Sheet, row number and cells of every row below a sheet's heading."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        for sheet, member in _parts(book):
            names: dict[int, str] | None = None
            for number, values in rows(book, member, shared):
                if names is None:
                    names = {k: v.strip() for k, v in values.items()}
                else:
                    yield sheet, number, {names.get(k, f"column {k + 1}"): v for k, v in values.items()}


def _read(name: str, content: bytes) -> Iterator[tuple]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        yield name, None, None, None, None, str(e)
        return
    with archive:
        members = archive.namelist()
        inner = [m for m in members if m.lower().endswith(".xlsx")]
        for member in ["" if "xl/workbook.xml" in members else None, *inner]:
            if member is None:
                continue
            try:
                for sheet, number, cells in workbook_rows(archive.read(member) if member else content):
                    yield name, member or None, sheet, number, list(cells.items()), None
            except (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError) as e:
                yield name, member or None, None, None, None, f"{type(e).__name__}: {e}"


def _batches(batches):
    for batch in batches:
        held: list[tuple] = []
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for row in _read(name, content or b""):
                held.append(row)
                if len(held) == BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    held = []
        columns = list(zip(*held, strict=True)) or [[]] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def sheets(archives: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    return archives.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).mapInArrow(_batches, SCHEMA)


def money(found: DataFrame, column: str, name: str = "amount") -> DataFrame:
    """``found`` with the amount of a cell (signs, commas and brackets for negative ones are read) and ``bad``: text that is none."""
    raw = F.nullif(F.trim(F.try_element_at("cells", F.lit(column))), F.lit(""))
    plain = F.regexp_replace(raw, r"[$,\s]", "")
    signed = F.when(plain.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_extract(plain, r"^\((.*)\)$", 1))).otherwise(plain)
    value = F.when(signed.rlike(r"^[-+]?[0-9]{1,15}(\.[0-9]+)?$"), signed.cast("decimal(28,4)"))
    return found.withColumn(name, value).withColumn("bad", F.when(raw.isNotNull() & value.isNull(), raw))


def skipped(rows_: DataFrame) -> DataFrame:
    """How many rows of each sheet have a cell that is no amount: ``(archive, workbook, sheet, skipped)``."""
    return rows_.groupBy("archive", "workbook", "sheet").agg(F.count("bad").alias("skipped"))
