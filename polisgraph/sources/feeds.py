"""Rows of public feeds that were saved as JSON: court cases, building permits, awards; and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisgraph.functions import vocabulary as V

CASE = "docket_id string, docketNumber string, caseName string, case_name_full string, court string, court_id string, dateFiled string, dateTerminated string, cause string, assignedTo string, docket_absolute_url string"
PERMIT = "unique_id string, description string, address string, permit_number string, parcel_number string, city_town string, construction_value string, type_permit string, permit_category string, issued_date string, latitude string, longitude string"
AWARD = "generated_internal_id string, `Recipient Name` string, recipient_id string, `Recipient UEI` string, `Award Amount` double, `Start Date` string, `End Date` string, `Awarding Agency` string, `Awarding Sub Agency` string, `Funding Agency` string, `Funding Sub Agency` string, `Award Type` string, `CFDA Number` string, agency_slug string"
# Fixed value: how ids of awards that stand for several begin.
AGGREGATE = "ASST_AGG_"
# Prefixes of ids in links, and those that they stand for.
ID_ALIAS = {"actor-": "person-", "inst-": "org-", "eid-": "filing-"}


def _blank(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def first_contained(rows: DataFrame, text: str, registry: DataFrame) -> DataFrame:
    """``rows`` with ``org`` and ``place`` of the first registry row (by ``rank``) whose ``token`` the text contains.

    The registry is a list of places, some dozens of rows: it is gathered into one array beside each row.
    """
    listed = registry.agg(F.array_sort(F.collect_list(F.struct("rank", F.lower("token").alias("token"), "org", "place"))).alias("_r"))
    hit = F.get(F.filter("_r", lambda r: F.lower(F.col(text)).contains(r["token"])), F.lit(0))
    return rows.crossJoin(F.broadcast(listed)).withColumn("_h", hit).select(*rows.columns, F.col("_h.org").alias("org"), F.col("_h.place").alias("place"))  # one row


def court_cases(raw: DataFrame, registry: DataFrame, site: str) -> DataFrame:
    """Case nodes of search results: named by docket id, or else by docket number; blanks are missing."""
    number = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce("docketNumber", F.lit(""))), "[:/]", "-")), r"\s+", "-")
    name = F.coalesce(_blank("caseName"), _blank("case_name_full"), F.lit("Unknown"))
    rows = raw.withColumn("case_name", name).withColumn("id", F.concat(F.lit("case-cl-"), F.coalesce(_blank("docket_id"), number)))
    found = first_contained(rows, "case_name", registry)
    return found.select("id", F.lit("Case").alias("node_type"), "case_name", *[_blank(c).alias(a) for c, a in (("docketNumber", "docket_number"), ("court", "court"), ("court_id", "court_id"), ("dateFiled", "date_filed"), ("dateTerminated", "date_terminated"), ("cause", "cause"), ("assignedTo", "assigned_to"))], F.concat(F.lit(site), _blank("docket_absolute_url")).alias("url"), "org", "place")


def permits(raw: DataFrame) -> DataFrame:
    """Project nodes of building permits; numbers that are none are missing, days are the first ten letters."""
    d, a = _blank("description"), _blank("address")
    label = F.when(d.isNotNull() & a.isNotNull(), F.concat(d, F.lit(" at "), a)).when(d.isNotNull(), d).when(a.isNotNull(), F.concat(F.lit("Permit at "), a)).otherwise(F.concat(F.lit("Permit "), F.coalesce("unique_id", F.lit(""))))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return raw.select(F.concat(F.lit("permit-marin-"), F.coalesce("unique_id", F.lit(""))).alias("id"), F.lit("Project").alias("node_type"), label.alias("label"), *[_blank(c).alias(c) for c in ("permit_number", "address", "parcel_number", "city_town", "description", "type_permit", "permit_category")], F.substring(_blank("issued_date"), 1, 10).alias("issued_date"), number("construction_value"), number("latitude"), number("longitude"))


def awards(pages: DataFrame) -> DataFrame:
    """Award rows of saved pages (column ``results``, an array): aggregates and rows without any identity are left out.

    A row without an award id raises an error.
    """
    r = pages.select(F.explode("results").alias("r")).select("r.*")
    key = F.coalesce(_blank("generated_internal_id"), F.raise_error(F.lit("award row without generated_internal_id")).cast("string"))
    rows = r.withColumn("award_id", key).where(~F.col("award_id").startswith(AGGREGATE))
    rows = rows.where(F.coalesce(_blank("Recipient UEI"), _blank("recipient_id")).isNotNull())
    names = {"Recipient Name": "recipient_name", "recipient_id": "recipient_id", "Recipient UEI": "uei", "Award Amount": "amount", "Start Date": "start_date", "End Date": "end_date", "Awarding Agency": "awarding_agency", "Awarding Sub Agency": "awarding_sub_agency", "Funding Agency": "funding_agency", "Funding Sub Agency": "funding_sub_agency", "Award Type": "award_type", "CFDA Number": "cfda_number", "agency_slug": "agency_slug"}
    return rows.select("award_id", *[F.col(f"`{c}`").alias(a) for c, a in names.items()])


def memberships(rows: DataFrame) -> DataFrame:
    """One row per ``membership``: the fields of its earliest ``year`` and the records of all years, sorted.

    Within a year the smallest record's fields count, so that no order of the input matters.
    """
    first = F.struct(F.col("year"), F.col("record"))
    fields = [c for c in rows.columns if c not in ("membership", "year", "record")]
    return rows.groupBy("membership").agg(F.min("year").alias("year"), *[F.min_by(c, first).alias(c) for c in fields], F.array_sort(F.collect_set("record")).alias("records"))


def preferred_url(records: DataFrame, registry: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """``(id, preferred_url)``: a record's own public URL, or its source's, or its jurisdiction's page.

    ``records``: id, url, source_id, jurisdiction_id; ``registry``: source_id, url; ``jurisdictions``: key, url.
    """
    from polisgraph.functions.cleaning import public_url

    own = registry.select("source_id", public_url("url").alias("_s")).dropDuplicates(["source_id"])
    land = jurisdictions.select(F.col("key").alias("_k"), public_url("url").alias("_j")).dropDuplicates(["_k"])
    keyed = records.withColumn("_k", F.regexp_replace("jurisdiction_id", "^place-", ""))
    return keyed.join(own, "source_id", "left").join(land, "_k", "left").select("id", F.coalesce(public_url("url"), "_s", "_j").alias("preferred_url"))


def resolve_alias(node_id: str, context: Column | None = None) -> Column:
    """``struct(id, type)`` of an id in a link with an old prefix replaced; null if its type is unknown or not the context's."""
    c, out = F.col(node_id), F.col(node_id)
    kinds = {p + "-": t for t, p in V.PREFIX.items()}
    for old, new in reversed(ID_ALIAS.items()):
        fits = c.startswith(old) if context is None else c.startswith(old) & (context.isNull() | (context == kinds[new]))
        out = F.when(fits, F.concat(F.lit(new), F.substr(c, F.lit(len(old) + 1)))).otherwise(out)
    kind = F.lit(None).cast("string")
    for p, t in sorted(kinds.items(), key=lambda x: len(x[0])):
        kind = F.when(out.startswith(p), t).otherwise(kind)
    right = kind.isNotNull() if context is None else kind.isNotNull() & (context.isNull() | (context == kind))
    return F.when(right, F.struct(out.alias("id"), kind.alias("type")))


def url_segment(node_type: Column) -> Column:
    """``AgendaItem`` to ``agenda-item``."""
    return F.lower(F.regexp_replace(node_type, "([a-z])([A-Z])", "$1-$2"))
