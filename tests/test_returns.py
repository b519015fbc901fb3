"""Returns in XML: identity within the filer, kinds, officers, years, and what is wrong with a document."""

import pytest

from polisgraph.sources import returns


def document(kind="IRS990", header="<TaxYr>2021</TaxYr>", filer="<EIN>12-345 6789</EIN><BusinessName><BusinessNameLine1>GOOD WORKS</BusinessNameLine1><BusinessNameLine2>INC</BusinessNameLine2></BusinessName>", body="", ns=' xmlns="urn:x"'):
    return f"<Return{ns}><ReturnHeader><PreparerFirm><EIN>000</EIN><BusinessNameLine1Txt>Firm</BusinessNameLine1Txt></PreparerFirm>{header}<Filer>{filer}</Filer></ReturnHeader><ReturnData><{kind}>{body}</{kind}></ReturnData></Return>"


def person(name, *marks, title="CHAIR"):
    return f"<{returns.OFFICER_GROUP}>{f'<PersonNm>{name}</PersonNm>' if name else ''}<TitleTxt>{title}</TitleTxt>" + "".join(f"<{m}>{v}</{m}>" for m, v in marks) + f"</{returns.OFFICER_GROUP}>"


def test_the_filers_fields():
    for ns in ("", ' xmlns="urn:x"'):
        r = returns.read(document(body="<CYTotalRevenueAmt>12</CYTotalRevenueAmt><Organization501c3Ind>x</Organization501c3Ind>", ns=ns))
        assert (r["ein"], r["legal_name"], r["legal_name_raw"], r["tax_year"], r["status"], r["total_revenue"], r["gov_grants_amount"]) == ("123456789", "Good Works Inc", "GOOD WORKS INC", "2021", "501c3", 12, None)
    assert returns.read(document(header="<TaxPeriodEndDt>2019-06-30</TaxPeriodEndDt>"))["tax_year"] == "2019"


def test_officers():
    body = person("ANN LEE", ("OfficerInd", "X")) + person("Bo Li", ("KeyEmployeeInd", "true"), title="clerk") + person("C", ("HighestCompensatedEmployeeInd", "X"))
    body += person("D", ("OfficerInd", "X"), (returns.FORMER, "1")) + person(None, ("OfficerInd", "X")) + person("E", ("IndividualTrusteeInd", "false")) + person("F", ("IndividualTrusteeInd", "1"))
    found = returns.read(document(body=f"<Part>{body}</Part>"))["officers"]
    assert [(o["name"], o["role"]) for o in found] == [("Ann Lee", "Chair"), ("Bo Li", "clerk"), ("F", "Chair")]
    assert found[0]["name_raw"] == "ANN LEE"


@pytest.mark.parametrize(("xml", "want"), [
    ("<a", {"problem": "not XML"}), ("<a/>", {"problem": "no return"}), (document(kind="IRS990PF"), {"skipped": "IRS990PF"}), (document(kind="Other"), {"problem": "no known return"}),
    (document(filer="<BusinessNameLine1>x</BusinessNameLine1>"), {"problem": "no EIN"}), (document(filer="<EIN>1</EIN>"), {"problem": "no legal name"}), (document(header=""), {"problem": "no tax year"}),
    (document(body="<CYTotalRevenueAmt>1.5</CYTotalRevenueAmt>"), {"problem": "invalid literal"}),
])
def test_what_is_passed_over_or_wrong(xml, want):
    found = returns.read(xml)
    ((key, text),) = want.items()
    assert set(found) == {key} and found[key].startswith(text)


def test_tables_of_documents(spark):
    rows = [("a", document()), ("b", document(kind="IRS990EZ")), ("c", None), ("d", "<x/>")]
    table = spark.createDataFrame([(*r, 0) for r in rows], "id string, xml string, ein int")
    found = {r["id"]: r for r in returns.parse(table).collect()}
    assert found["a"].ein == "123456789" and found["b"].skipped == "IRS990EZ" and found["c"].problem == "no document" and found["d"].problem == "no return"
    assert [r["id"] for r in returns.returns(table.where("id < 'c'")).collect()] == ["a"]
    with pytest.raises(Exception, match="return d: no return"):
        returns.returns(table.where("id = 'd'")).collect()
