"""Whether a node cites a primary source, and the day that it happened."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Properties any of which is a citation, and properties that are one together.
CITING = (
    "evidence_record_ids", "record_ids", "filing_id", "fppc_report_id", "form_700_line", "minutes_url", "agenda_url", "meeting_url",
    "docket_number", "permit_id", "source_filing_id", "fppc_id",
)
CITING_TOGETHER = ("source_url", "source_id")
# Types whose nodes have a day of their own, and properties that tell a node's year, the first first.
DATED = ("Meeting", "Decision", "MoneyFlow", "Filing", "Election", "Proceeding", "Agreement", "Amendment", "Case", "AgendaItem", "Record", "SeatService", "Membership")
YEARS = ("meeting_date", "election_date", "posted_at", "filed_at", "signed_at", "started_at")


def is_cited(properties: str = "properties") -> Column:
    """Properties are a map from names to JSON texts; blank texts, empty lists, zero and false cite nothing."""
    value = lambda k: F.trim(F.coalesce(F.try_element_at(properties, F.lit(k)), F.lit("null")))
    told = lambda k: ~value(k).isin("null", "[]", "0", "0.0", "false", "{}") & ~value(k).rlike(r'^"\s*"$')
    return reduce(lambda a, b: a | b, [told(k) for k in CITING], told(CITING_TOGETHER[0]) & told(CITING_TOGETHER[1]))


def effective_date(node_type: str, day: str) -> Column:
    """A node's day where its type has one; durable types have none."""
    return F.when(F.col(node_type).isin(*DATED), F.nullif(F.col(day), F.lit("")))


def node_year(properties: str = "properties") -> Column:
    """The year of the first of six properties that begins with four digits."""
    year = lambda k: F.regexp_extract(F.coalesce(F.try_element_at(properties, F.lit(k)), F.lit("")), '^"([0-9]{4})', 1)
    return F.coalesce(*[F.nullif(year(k), F.lit("")) for k in YEARS]).cast("int")
