"""Workbooks in archives: cells by name, shared and inline texts, gaps, nested archives, broken ones, amounts."""

import io
import zipfile

from polisgraph.plans.workbookq import workbook
from polisgraph.sources import workbooks


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("_", "."), body)
    return out.getvalue()


SHEET = """<worksheet xmlns="x"><sheetData><row r="2"><c r="B2" t="inlineStr"><is><t>Na</t><t>me </t></is></c><c r="D2" t="str"><v>Amount</v></c></row>
<row r="3"/><row r="5"><c r="B5" t="s"><v>1</v></c><c r="D5"><v>1.5</v></c><c r="AA5"><v>9</v></c></row><row><c r="D6"><v></v></c></row><row><c r="D7" t="b"><v>1</v></c></row></sheetData></worksheet>"""


def by_hand(sheet=SHEET, strings="<sst xmlns='x'><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>"):
    rel = '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S 1" r:id="a"/></sheets></workbook>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in (("xl/workbook.xml", rel), ("xl/_rels/workbook.xml.rels", '<R><R Id="a" Target="/xl/s.xml"/></R>'), ("xl/s.xml", sheet), ("xl/sharedStrings.xml", strings)):
            z.writestr(name, body)
    return out.getvalue()


def test_cells_go_to_named_columns():
    assert list(workbooks.workbook_rows(by_hand())) == [("S 1", 5, {"Name": "one", "Amount": "1.5", "column 27": "9"}), ("S 1", 7, {"Amount": "1"})]
    assert list(workbooks.workbook_rows(by_hand("<worksheet><sheetData/></worksheet>"))) == []


def test_archives_of_all_kinds(spark):
    book = workbook({"one": [("a", 1, 2)], "two": [("b", 3, "$4")]})
    rows = [("outer", zipped(a_xlsx=book, b_txt="x", c_xlsx=b"broken")), ("plain", book), ("no", b"no archive"), ("null", None), ("empty", zipped())]
    found = workbooks.sheets(spark.createDataFrame(rows, "path string, content binary")).collect()
    got = sorted(((r["archive"], r["workbook"] or "", r["sheet"] or "", r["row"] or 0, r["cells"] and dict(r["cells"]), bool(r["problem"])) for r in found), key=str)
    one, two = {"Order": "a", "Line": "1", "Amount": "2"}, {"Order": "b", "Line": "3", "Amount": "$4"}
    assert got == sorted([("outer", "a.xlsx", "one", 2, one, False), ("outer", "a.xlsx", "two", 2, two, False), ("outer", "c.xlsx", "", 0, None, True), ("plain", "", "one", 2, one, False), ("plain", "", "two", 2, two, False), ("no", "", "", 0, None, True), ("null", "", "", 0, None, True)], key=str)


def test_amounts_and_what_is_none(spark):
    texts = ["1", "$1,234.50", "(12.5)", "-3", "n/a", "", "1.2.3", "9" * 20]
    archive = workbook({"s": [(k, 0, t) for k, t in enumerate(texts)]})
    rows = workbooks.money(workbooks.sheets(spark.createDataFrame([("x", archive)], "path string, content binary")), "Amount")
    found = {int(r["cells"]["Order"]): (None if r["amount"] is None else float(r["amount"]), r["bad"]) for r in rows.collect()}
    assert [found[k] for k in range(8)] == [(1.0, None), (1234.5, None), (-12.5, None), (-3.0, None), (None, "n/a"), (None, None), (None, "1.2.3"), (None, "9" * 20)]
    assert workbooks.skipped(rows).first()["skipped"] == 3


def test_files_by_sparks_reader(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped(x_xlsx=workbook({"s": [("k", 1, 2)] * 6000})))
    found = workbooks.sheets(spark.read.format("binaryFile").load(str(tmp_path)))
    assert found.count() == 6000 and found.where("problem is not null").count() == 0
