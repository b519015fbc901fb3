"""Filed returns in XML: identity and figures of the filer, and its officers, whatever the schema's namespace and version.

``parse`` takes a table of documents and gives a row per document with the return, the reason for which it was passed over, or what
is wrong with it; ``returns`` raises on the latter.  Elements are told by their local names, and the filer's identity is read within
the filer's element only, since a preparer's firm may stand before it.  Officers are those with a person's name and a mark of
office, without a mark of former office.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The return that is read, those passed over, marks of officers, and what counts as a mark.
READ, PASSED_OVER = "IRS990", ("IRS990EZ", "IRS990PF", "IRS990N")
OFFICER_GROUP, FORMER = "Form990PartVIISectionAGrp", "FormerOfcrDirectorTrusteeInd"
IN_OFFICE = ("OfficerInd", "IndividualTrusteeOrDirectorInd", "IndividualTrusteeInd", "KeyEmployeeInd")
MARKS = ("x", "true", "1")

SCHEMA = (
    "id string, ein string, legal_name string, legal_name_raw string, tax_year string, status string, total_revenue long, gov_grants_amount long, "
    "officers array<struct<name:string,name_raw:string,role:string,role_raw:string>>, skipped string, problem string"
)


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ET.Element, *names: str) -> Iterator[ET.Element]:
    """Descendants by local name in the order of the document."""
    return (x for x in e.iter() if x is not e and _local(x) in names)


def _text(e: ET.Element, *names: str) -> str | None:
    found = next(_all(e, *names), None)
    return (found.text or "").strip() or None if found is not None else None


def _marked(text: str | None) -> bool:
    return (text or "").strip().lower() in MARKS


def display(name: str) -> str:
    """Names in capitals only are shown in title case."""
    return name.title() if name.isupper() else name


def officers(body: ET.Element) -> list[dict[str, str]]:
    out = []
    for group in _all(body, OFFICER_GROUP):
        marks = {_local(e) for e in group.iter() if _marked(e.text)}
        name, role = _text(group, "PersonNm"), _text(group, "TitleTxt") or ""
        if name and FORMER not in marks and marks.intersection(IN_OFFICE):
            out.append({"name": display(name), "name_raw": name, "role": display(role), "role_raw": role})
    return out


def read(document: str) -> dict:
    """The fields of one return, or ``skipped``, or ``problem``."""
    try:
        root = ET.fromstring(document)
    except ET.ParseError as e:
        return {"problem": f"not XML: {e}"}
    top = {_local(e): e for e in reversed(root)}
    if "ReturnHeader" not in top or "ReturnData" not in top:
        return {"problem": "no return"}
    header, kinds = top["ReturnHeader"], {_local(e): e for e in reversed(top["ReturnData"])}
    if READ not in kinds:
        other = next((k for k in PASSED_OVER if k in kinds), None)
        return {"skipped": other} if other else {"problem": f"no known return in {sorted(kinds)}"}
    body, filer = kinds[READ], next(_all(header, "Filer"), None)
    if filer is None:
        return {"problem": "no filer"}
    ein, names = _text(filer, "EIN"), [_text(filer, f"BusinessNameLine{k}Txt", f"BusinessNameLine{k}") for k in (1, 2)]
    year = _text(header, "TaxYr") or "".join(re.findall(r"^\d{4}", _text(header, "TaxPeriodEndDt") or ""))
    for value, what in ((ein, "EIN"), (names[0], "legal name"), (year, "tax year")):
        if not value:
            return {"problem": f"no {what}"}
    legal = " ".join(n for n in names if n)
    number = lambda name: int(v) if (v := _text(body, name)) is not None else None
    try:
        figures = {"total_revenue": number("CYTotalRevenueAmt"), "gov_grants_amount": number("GovernmentGrantsAmt")}
    except ValueError as e:
        return {"problem": str(e)}
    status = "501c3" if _marked(_text(body, "Organization501c3Ind")) else None
    return {"ein": re.sub(r"\D", "", ein), "legal_name": display(legal), "legal_name_raw": legal, "tax_year": year, "status": status, "officers": officers(body), **figures}


_OFFICER = pa.list_(pa.struct([(n, pa.string()) for n in ("name", "name_raw", "role", "role_raw")]))
_NUMBERS = ("total_revenue", "gov_grants_amount")
_ARROW = pa.schema([(f.split()[0], _OFFICER if f.startswith("officers") else pa.int64() if f.split()[0] in _NUMBERS else pa.string()) for f in re.split(r", (?=\w+ )", SCHEMA)])


def _parsed(batches):
    for batch in batches:
        rows = [{"id": i} | ({"problem": "no document"} if x is None else read(x)) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def parse(documents: DataFrame, id_col: str = "id", xml: str = "xml") -> DataFrame:
    return documents.select(F.col(id_col).cast("string").alias("id"), F.col(xml).alias("xml")).mapInArrow(_parsed, SCHEMA)


def returns(documents: DataFrame, id_col: str = "id", xml: str = "xml") -> DataFrame:
    """The returns that were read; a document with a problem raises an error."""
    rows = parse(documents, id_col, xml)
    bad = F.raise_error(F.concat(F.lit("return "), F.coalesce("id", F.lit("?")), F.lit(": "), "problem")).cast("string")
    return rows.withColumn("ein", F.when(F.col("problem").isNotNull(), bad).otherwise(F.col("ein"))).where("ein is not null").drop("skipped", "problem")


def officer_years(found: DataFrame) -> DataFrame:
    """``(membership, ein, name, role, year, record)``: one row per officer and return, for ``feeds.memberships``."""
    rows = found.select("ein", "id", F.col("tax_year").alias("year"), F.explode("officers").alias("o"))
    person = F.regexp_replace(F.lower("o.name"), "[^a-z0-9]+", "-")
    return rows.select(F.concat_ws("|", "ein", person).alias("membership"), "ein", F.col("o.name").alias("name"), F.col("o.role").alias("role"), F.col("year").cast("int").alias("year"), F.col("id").alias("record"))
