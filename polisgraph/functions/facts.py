"""Fact rows and headline figures of an entity's page, per type, from its properties.

A node's properties are a map from names to JSON texts.  A fact is the first of its properties with a text, number or truth
value; a list is joined; a period has one end or both.  Facts without a value keep their row, with null; the id is the last row.
Headline figures show a dash instead.  Types that are not told have the id alone, and no figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of each type: label, then properties of which the first with a value counts; [] is a list, .. a period.
FACTS = {
    "Person": "Name: name; Current seat: current_seat_display; Jurisdiction: jurisdiction_name; Aliases: []aliases",
    "Decision": "Decided: decided_at; Institution: institution_name; Vote: vote_summary; Status: status",
    "Project": "Name: name; Status: status; Address: address; Jurisdiction: jurisdiction_name",
    "Program": "Name: name; Status: status; Type: program_type; Jurisdiction: jurisdiction_name",
    "Case": "Caption: caption, name; Docket: docket_number; Filed: filed_at; Closed: closed_at; Status: status",
    "Meeting": "Title: title; Date: meeting_date; Institution: institution_name; Type: meeting_type",
    "Filing": "Type: filing_type; Signed: signed_at; Period: period_start..period_end; Filer: filed_by_name, filer_name",
    "Committee": "Name: name; FPPC ID: fppc_id; Treasurer: treasurer; Candidate: candidate_name",
    "Organization": "Name: name; Subtype: subtype, []labels; Jurisdiction: jurisdiction_name; Website: website",
    "MoneyFlow": "Amount: amount; Date: flow_date; Type: flow_type; Schedule: source_schedule",
    "Seat": "Title: title, name; Institution: institution_name; Jurisdiction: jurisdiction_name",
    "SeatService": "Seat: seat_title; Person: person_name; Start: start_date; End: end_date",
    "Election": "Title: name, title; Date: election_date; Type: election_type; Jurisdiction: jurisdiction_name",
    "Candidacy": "Candidate: person_name, name; Seat: seat_title; Election: election_name; Outcome: outcome",
    "AgendaItem": "Heading: heading, title; Meeting: meeting_title; Date: meeting_date; Item: item_number",
    "Proceeding": "Title: title, name; Date: proceeding_date, date; Case: case_caption; Type: proceeding_type",
    "Agreement": "Title: title, name; Type: agreement_type; Effective: effective_date; Parties: []parties",
    "Amendment": "Title: title, name; Parent: parent_title, parent_id; Effective: effective_date",
    "Record": "Record type: record_type; Captured: captured_at; Artifact: preferred_display_artifact; Public URL: preferred_public_url",
    "Place": "Name: name; Type: place_type; Parent: parent_name",
    "Issue": "Name: name; Description: description",
    "Membership": "Person: person_name; Organization: organization_name; Role: role; Period: started_at..ended_at; Source: source_basis",
    "EconomicInterest": "Interest type: interest_type; Counterparty: counterparty_name_raw; Amount: amount_band, amount; Position: position; Schedule: schedule",
}
# Headline figures; $ is an amount in whole dollars.
FIGURES = {
    "Project": "money: $total_money; decisions: decisions_count; counterparties: counterparties_count; evidence: records_count, evidence_count",
    "Program": "money: $total_money; decisions: decisions_count; counterparties: counterparties_count; evidence: records_count, evidence_count",
    "Person": "current seat: current_seat_display; service: current_seat_started_at, service_start_date..current_seat_ended_at, service_end_date; filings: filings_count",
    "Decision": "decided: decided_at; vote: vote_summary; agenda item: agenda_item_number, item_number",
    "Case": "filed: filed_at; court: court_name, court; status: status; constrains: constrains_count",
    "Meeting": "date: meeting_date; institution: institution_name; agenda items: agenda_items_count; decisions: decisions_count",
    "Filing": "type: filing_type; signed: signed_at; period: period_start..period_end; actor: filed_by_name, filer_name, candidate_name",
    "Committee": "fppc id: fppc_id; candidate: candidate_name; elections: elections_count; money in: $total_money_in",
}
DASH = "—"


def _json(name: str) -> Column:
    return F.nullif(F.trim(F.try_element_at("properties", F.lit(name))), F.lit("null"))


def _scalar(name: str) -> Column:
    raw = _json(name)
    text = F.nullif(F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"), F.lit(""))
    return F.when(~raw.startswith("[") & ~raw.startswith("{"), text)


def _list(name: str) -> Column:
    values = F.from_json(_json(name), "array<string>")
    return F.when(_json(name).startswith("[") & (F.size(values) > 0), F.array_join(values, ", ", ""))


def _money(name: str) -> Column:
    n = F.expr(f"try_cast({_sql(name)} AS DOUBLE)")
    return F.when(~F.isnan(n) & (n != 0) & (F.abs(n) != float("inf")), F.concat(F.lit("$"), F.format_number(F.floor(n + 0.5), 0)))


def _sql(name: str) -> str:
    return f"get_json_object(concat('{{\"v\":', try_element_at(properties, '{name}'), '}}'), '$.v')"


def _one(spec: str) -> Column:
    return _list(spec[2:]) if spec.startswith("[]") else _money(spec[1:]) if spec.startswith("$") else _scalar(spec)


def _value(spec: str) -> Column:
    first = lambda part: F.coalesce(*[_one(p.strip()) for p in part.split(",")])
    if ".." not in spec:
        return first(spec)
    a, b = map(first, spec.split(".."))
    return F.coalesce(F.concat(a, F.lit(" – "), b), a, b)


def _rows(table: dict[str, str], fallback: Column, last: list[Column]) -> Column:
    out = F.array(*last) if last else F.array().cast("array<struct<key:string,value:string>>")
    for kind, spec in table.items():
        pairs = [x.split(": ", 1) for x in spec.split("; ")]
        own = [F.struct(F.lit(key.strip()).alias("key"), F.coalesce(_value(props), fallback).alias("value")) for key, props in pairs]
        out = F.when(F.col("node_type") == kind, F.array(*own, *last)).otherwise(out)
    return out


def _exploded(nodes: DataFrame, rows: Column) -> DataFrame:
    return nodes.select("id", F.posexplode(rows).alias("position", "r")).select("id", (F.col("position") + 1).alias("position"), "r.key", "r.value")


def facts(nodes: DataFrame) -> DataFrame:
    """``(id, position, key, value)`` of ``nodes (id, node_type, properties)``."""
    none = F.lit(None).cast("string")
    return _exploded(nodes, _rows(FACTS, none, [F.struct(F.lit("ID").alias("key"), F.col("id").alias("value"))]))


def figures(nodes: DataFrame) -> DataFrame:
    """``(id, position, key, value)``: the headline figures of types that have some."""
    return _exploded(nodes, _rows(FIGURES, F.lit(DASH), []))
