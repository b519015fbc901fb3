"""Workbooks made of order lines, and read back row for row: one archive per fifty orders, a sheet per flag."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgraph.sources import workbooks

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
COLUMNS = ("Order", "Line", "Amount")


def workbook(sheets: dict[str, list[tuple]]) -> bytes:
    """A workbook with a heading and rows of text and numbers; texts are shared strings."""
    texts: dict[str, int] = {}
    cell = lambda v: f'<c t="s"><v>{texts.setdefault(v, len(texts))}</v></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {_NS}><sheetData>" + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [COLUMNS, *rows]) + "</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f"<workbook {_NS}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
    return out.getvalue()


def _archive(table: pa.Table) -> pa.Table:
    sheets: dict[str, list[tuple]] = {}
    for flag, order, line, amount in sorted(zip(*(table.column(c).to_pylist() for c in ("flag", "o", "line", "amount")), strict=True)):
        sheets.setdefault(flag, []).append((order, line, amount))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("lines.xlsx", workbook(sheets))
        z.writestr("notes.txt", "no workbook")
    return pa.table({"path": [f"archive-{table.column('k')[0].as_py()}"], "content": pa.array([out.getvalue()], pa.binary())})


def archives(spark, d) -> DataFrame:
    """``(path, content)``; every eleventh line's amount is no number."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    amount = F.when(F.col("l_partkey") % 11 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")))
    rows = li.select(F.floor(F.col("l_orderkey") / 50).alias("k"), F.concat(F.lit("flag "), F.col("l_returnflag")).alias("flag"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("line"), amount.alias("amount"))
    return rows.groupBy("k").applyInArrow(_archive, "path string, content binary")


def workbook_lines(spark, d) -> DataFrame:
    rows = workbooks.money(workbooks.sheets(archives(spark, d)), "Amount")
    cell = lambda c: F.try_element_at("cells", F.lit(c)).cast("long")
    return rows.select("archive", "workbook", "sheet", cell("Order").alias("o"), cell("Line").alias("line"), F.col("amount").cast("decimal(18,2)").alias("amount"), "bad")


def workbook_skipped(spark, d) -> DataFrame:
    return workbooks.skipped(workbooks.money(workbooks.sheets(archives(spark, d)), "Amount"))


_ROWS = "SELECT 'archive-' || CAST(floor(l_orderkey / 50) AS BIGINT) AS archive, 'lines.xlsx' AS workbook, 'flag ' || l_returnflag AS sheet, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount, CASE WHEN l_partkey % 11 = 0 THEN 'n/a' END AS bad FROM lineitem"
QUERIES = {"workbook_lines": workbook_lines, "workbook_skipped": workbook_skipped}
ORACLE_SQL = {"workbook_lines": _ROWS, "workbook_skipped": f"SELECT archive, workbook, sheet, count(bad) AS skipped FROM ({_ROWS}) GROUP BY ALL"}
