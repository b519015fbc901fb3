"""Returns made of suppliers, and read back: every third year's is a kind that is passed over; customers are the officers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgraph.sources import feeds, returns

_YEARS = (2019, 2020, 2021)


def documents(spark, d) -> DataFrame:
    """``(id, xml)``: three years of each supplier, with the officers that its customers' numbers give."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal").withColumn("year", F.explode(F.array(*map(F.lit, _YEARS))))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, year = F.col("s_suppkey"), F.col("year")
    kind = F.when((k + year) % 3 == 0, "IRS990EZ").otherwise("IRS990")
    person = lambda n, mark, title: text("<Form990PartVIISectionAGrp><PersonNm>CHAIR ", k * 10 + n, f"</PersonNm><TitleTxt>{title}</TitleTxt><{mark}>X</{mark}></Form990PartVIISectionAGrp>")
    former = text("<Form990PartVIISectionAGrp><PersonNm>Old Chair</PersonNm><OfficerInd>X</OfficerInd><FormerOfcrDirectorTrusteeInd>X</FormerOfcrDirectorTrusteeInd></Form990PartVIISectionAGrp>")
    head = text("<ReturnHeader><PreparerFirmGrp><PreparerFirmEIN>990000000</PreparerFirmEIN></PreparerFirmGrp><TaxYr>", year, "</TaxYr><Filer><EIN>", F.format_string("%02d-%07d", (k % 90).cast("int"), k), "</EIN><BusinessName><BusinessNameLine1Txt>", F.col("s_name"), "</BusinessNameLine1Txt></BusinessName></Filer></ReturnHeader>")
    body = text("<", kind, "><Organization501c3Ind>X</Organization501c3Ind><CYTotalRevenueAmt>", F.floor(F.col("s_acctbal")).cast("long"), "</CYTotalRevenueAmt>", person(1, "OfficerInd", "PRESIDENT"), F.when(year > 2019, person(2, "KeyEmployeeInd", "Clerk")).otherwise(F.lit("")), person(3, "HighestCompensatedEmployeeInd", "Cook"), former, "</", kind, ">")
    return s.select(F.concat_ws("-", F.lit("return"), k, year).alias("id"), text('<Return xmlns="http://www.irs.gov/efile" returnVersion="2020v1">', head, "<ReturnData>", body, "</ReturnData></Return>").alias("xml"))


def return_filings(spark, d) -> DataFrame:
    return returns.returns(documents(spark, d)).select("id", "ein", "legal_name", "tax_year", "status", "total_revenue", F.size("officers").cast("long").alias("officers"))


def return_members(spark, d) -> DataFrame:
    rows = feeds.memberships(returns.officer_years(returns.returns(documents(spark, d))))
    return rows.select("membership", "year", "ein", "name", "role", F.array_join("records", ",").alias("records"))


_R = "r AS (SELECT s_suppkey AS k, s_name, s_acctbal, y AS year, lpad(CAST(s_suppkey % 90 AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS ein FROM supplier, (VALUES (2019), (2020), (2021)) v(y) WHERE (s_suppkey + y) % 3 <> 0)"
QUERIES = {"return_filings": return_filings, "return_members": return_members}
ORACLE_SQL = {
    "return_filings": f"WITH {_R} SELECT 'return-' || k || '-' || year AS id, ein, s_name AS legal_name, CAST(year AS VARCHAR) AS tax_year, '501c3' AS status, CAST(floor(s_acctbal) AS BIGINT) AS total_revenue, CASE WHEN year > 2019 THEN 2 ELSE 1 END AS officers FROM r",
    "return_members": f"WITH {_R}, o AS (SELECT k, year, ein, 'Chair ' || (k * 10 + 1) AS name, 'President' AS role FROM r UNION ALL SELECT k, year, ein, 'Chair ' || (k * 10 + 2), 'Clerk' FROM r WHERE year > 2019) "
    "SELECT ein || '|' || replace(lower(name), ' ', '-') AS membership, CAST(min(year) AS INTEGER) AS year, ein, name, role, string_agg('return-' || k || '-' || year, ',' ORDER BY 'return-' || k || '-' || year) AS records FROM o GROUP BY k, ein, name, role",
}
