"""The ten tabular queries and their parameter layer.

Nulls order as the largest value (T1), so both directions are written out.  A row limit is part of each query's
contract.  Values come in as literals; user text never becomes part of a query's text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polisgraph.graph import Graph
from polisgraph.sources.fixtures import fixture_graph, with_graph

MAX_LENGTH = 200


@dataclass(frozen=True)
class Template:
    build: object
    sql: str
    defaults: dict[str, object] = field(default_factory=dict)
    required: tuple[str, ...] = ()


def down(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def up(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def bind(template: Template, given: dict) -> dict:
    """Blank values fall back to defaults; then required ones are checked, unknown and overlong ones refused."""
    unknown = set(given) - set(template.defaults)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    for k, v in given.items():
        if isinstance(v, str) and len(v) > MAX_LENGTH:
            raise ValueError(f"{k} is longer than {MAX_LENGTH}")
    out = {k: given[k] if given.get(k) not in (None, "") else d for k, d in template.defaults.items()}
    missing = [k for k in template.required if out[k] in (None, "")]
    if missing:
        raise ValueError(f"missing filters: {missing}")
    return out


def query(graph: Graph, slug: str, **filters) -> DataFrame:
    template = TEMPLATES[slug]
    return template.build(graph, **bind(template, filters))


def decisions_since(g: Graph, institution_prefix: str, start: str, end: str | None, institution: str | None) -> DataFrame:
    d = g.of("Decision").where(F.col("ref_id").startswith(institution_prefix) & (F.col("event_date") >= start))
    d = d.where(F.col("event_date") <= end) if end else d
    d = d.where(F.col("ref_id") == institution) if institution else d
    org = g.of("Organization").select(F.col("id").alias("ref_id"), F.col("label").alias("institution"))
    out = d.join(org, "ref_id", "left").select(F.col("id").alias("decision_id"), F.col("event_date").alias("decided_at"), F.col("label").alias("title"), "status", F.col("ref_id").alias("institution_id"), "institution")
    return out.orderBy(down("decided_at"), up("decision_id")).limit(500)


def money_flows(g: Graph, year: str, flow_type: str, minimum: float, source: str | None, target: str | None) -> DataFrame:
    f = g.of("MoneyFlow").where(F.col("event_date").startswith(year) & (F.col("kind") == flow_type) & (F.coalesce("amount", F.lit(0)) >= minimum))
    from_ = g.rel("FROM_SOURCE", source="id", target="source_id")
    to = g.rel("TO_TARGET", source="id", target="target_id")
    out = f.join(from_, "id", "left").join(to, "id", "left")
    out = out.where(F.col("source_id") == source) if source else out
    out = out.where(F.col("target_id") == target) if target else out
    out = out.select(F.col("id").alias("flow_id"), F.col("event_date").alias("flow_date"), "amount", "source_id", "target_id")
    return out.orderBy(down("flow_date"), up("flow_id"), up("source_id"), up("target_id")).limit(500)


def filings_by_filer(g: Graph, filing_type: str, start: str, end: str, filer: str | None) -> DataFrame:
    f = g.of("Filing").where((F.col("kind") == filing_type) & F.col("event_date").between(start, end))
    by = g.rel("FILED_BY", source="id", target="filer_id")
    names = g.of("Person", "Committee").select(F.col("id").alias("filer_id"), F.col("label").alias("filer"))
    out = f.join(by, "id", "left").join(names, "filer_id", "left")
    out = out.where((F.col("filer_id") == filer) | (F.col("ref_id") == filer)) if filer else out
    return out.select(F.col("id").alias("filing_id"), F.col("event_date").alias("signed_at"), F.col("kind").alias("filing_type"), "filer_id", "filer").orderBy(down("signed_at"), up("filing_id")).limit(500)


def is_current(ended: str, as_of: str) -> Column:
    """No end, a blank end, or a day that has not passed (T3)."""
    c = F.col(ended)
    return c.isNull() | (c == "") | (F.try_to_date(c) >= F.to_date(F.lit(as_of)))


def officeholder_coverage(g: Graph, as_of: str, jurisdiction: str | None) -> DataFrame:
    """Current services with the number of their holder's disclosure filings of each form."""
    s = g.of("SeatService").where(is_current("ended_date", as_of)).select(F.col("id").alias("service"), F.col("ref_id").alias("seat_ref"))
    held = g.undirected("HELD_BY").select(F.col("u").alias("service"), F.col("v").alias("id"))
    people = g.of("Person").select("id", F.coalesce("label", "id").alias("person_name"))
    seats = g.of("Seat").select(F.col("id").alias("seat"), F.col("label").alias("seat_name"), F.col("ref_id").alias("seat_place"))
    s = s.join(held, "service").join(people, "id").join(g.rel("FOR_SEAT", source="service", target="seat"), "service", "left").join(seats, "seat", "left")
    s = s.where(F.col("seat_place") == jurisdiction) if jurisdiction else s
    forms = g.of("Filing").where(F.col("kind").isin("form_700", "form_803")).select(F.col("id").alias("f"), "kind").join(g.rel("FILED_BY", source="f", target="id"), "f")
    filed = forms.groupBy("id").agg(*[F.count_distinct(F.when(F.col("kind") == k, F.col("f"))).alias(f"{k}_count") for k in ("form_700", "form_803")])
    counts = [F.coalesce(f"form_{k}_count", F.lit(0)).alias(f"form_{k}_count") for k in (700, 803)]
    out = s.join(filed, "id", "left").select("person_name", F.coalesce("seat_name", "seat_ref", "service").alias("seat_display"), *counts, "id")
    return out.orderBy(up("person_name"), up("id"), up("seat_display")).limit(500)


def agreements_for_project(g: Graph, project: str | None) -> DataFrame:
    """Agreements tied to a project by any edge or by its name, or all without a project."""
    a = g.of("Agreement")
    if project:
        linked = g.undirected().where(F.col("v") == project).select(F.col("u").alias("id")).distinct().withColumn("linked", F.lit(True))
        a = a.join(linked, "id", "left").where(F.col("linked") | (F.col("ref_id") == project))
    amendments = g.rel("AMENDS_AGREEMENT", source="amendment", target="id", source_type="amendment").groupBy("id").agg(F.count("*").alias("n"))
    out = a.join(amendments, "id", "left").select(F.coalesce("label", "id").alias("agreement_name"), F.col("event_date").alias("effective_date"), "amount", F.coalesce("n", F.lit(0)).alias("amendment_count"), "id")
    return out.orderBy(down("effective_date"), up("id")).limit(500)


def legal_proceedings(g: Graph, case: str | None) -> DataFrame:
    """Proceedings of a case, or of all, once for each edge of the case to a program or project."""
    part = g.rel("PART_OF_CASE", "PART_OF", source="id", target="case_id")
    cases = g.of("Case").select(F.col("id").alias("case_id"), F.coalesce("label", "id").alias("case_caption"))
    cases = cases.where(F.col("case_id") == case) if case else cases
    linked = g.undirected().where(F.col("u").startswith("case-") & (F.col("v").startswith("program-") | F.col("v").startswith("project-"))).select(F.col("u").alias("case_id"), F.col("v").alias("linked"))
    names = g.of("Program", "Project").select(F.col("id").alias("linked"), F.coalesce("label", "id").alias("affected_program"))
    out = g.of("Proceeding").join(part, "id").join(cases, "case_id").join(linked.join(names, "linked"), "case_id", "left")
    out = out.select("case_caption", F.col("kind").alias("proceeding_type"), F.col("event_date").alias("occurred_at"), "affected_program", "id")
    return out.orderBy(down("occurred_at"), up("id"), up("affected_program")).limit(500)


def evidence_records(g: Graph, target: str) -> DataFrame:
    e = g.rel("EVIDENCED_BY", source="target_id", target="id").where(F.col("target_id") == target)
    out = g.of("Record").join(e, "id").select(F.col("id").alias("record_id"), F.col("label").alias("title"), F.col("event_date").alias("captured_at"), "url")
    return out.orderBy(down("captured_at"), up("record_id")).limit(500)


def pressure_ranking(g: Graph, place: str) -> DataFrame:
    """Money, proceedings and evidence around a place's projects, programs and cases; parallel links multiply money (T16).

    A thread is of the place by an edge to it, or by an id that names it.
    """
    there = g.rel("IN_JURISDICTION", "PRIMARY_PLACE", source="id", target="place").where(F.col("place") == place).select("id").distinct().withColumn("there", F.lit(True))
    named = F.col("id").contains(place.removeprefix("place-"))
    threads = g.of("Project", "Program", "Case").select("id", "node_type", "label").join(there, "id", "left").where(F.coalesce("there", F.lit(False)) | named).drop("there")
    near = g.undirected().where(F.col("u").startswith("moneyflow-") | F.col("u").startswith("proceeding-")).select(F.col("v").alias("id"), "u").join(threads.select("id"), "id")
    amounts = g.of("MoneyFlow").select(F.col("id").alias("u"), F.coalesce("amount", F.lit(0)).alias("amount"))
    money = near.join(amounts, "u").groupBy("id").agg(F.sum("amount").cast("decimal(18,2)").alias("money"))
    legal = near.where(F.col("u").startswith("proceeding-")).groupBy("id").agg(F.count_distinct("u").alias("legal"))
    records = g.rel("EVIDENCED_BY", source="id", target="record", target_type="record").groupBy("id").agg(F.count_distinct("record").alias("records"))
    out = threads.join(money, "id", "left").join(legal, "id", "left").join(records, "id", "left")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    money = F.coalesce("money", F.lit(0).cast("decimal(18,2)")).cast("decimal(18,2)").alias("money_pressure")
    out = out.select(F.coalesce("label", "id").alias("thread_name"), F.col("node_type").alias("type"), money, zero("legal", "legal_pressure"), zero("records", "evidence_density"), "id")
    return out.orderBy(F.desc("money_pressure"), F.desc("legal_pressure"), F.desc("evidence_density"), "id").limit(100)


def interval_join(left: DataFrame, right: DataFrame, left_day: str, right_day: str, window: int) -> DataFrame:
    """Rows whose days are at most ``window`` apart: an equi-join on day buckets, then the exact test.

    A row of ``right`` is in one bucket of ``window + 1`` days and a row of ``left`` probes it and its neighbours.
    """
    number = lambda c: F.datediff(F.try_to_date(F.col(c)), F.lit("1970-01-01").cast("date"))
    bucket = lambda c: F.floor(number(c) / (window + 1))
    a = left.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: bucket(left_day) + k)))
    out = a.join(right.withColumn("_bucket", bucket(right_day)), "_bucket").withColumn("days_delta", F.datediff(F.try_to_date(F.col(left_day)), F.try_to_date(F.col(right_day))))
    return out.where(F.abs("days_delta") <= window).drop("_bucket")


def money_around_decisions(g: Graph, window: int, jurisdiction: str, most: int = 500) -> DataFrame:
    """Every dated flow near a decision whose institution or id contains the slug: any kind and amount, also none.

    The nearest pairs come first, then the latest decisions.  Counts by day tell which pairs of days those are, so only
    the rows of these days are joined: a table of days and distances, not of rows, is ordered as a whole.
    """
    day = lambda c: F.try_to_date(F.col(c))
    d = g.of("Decision").where(F.col("ref_id").contains(jurisdiction) | F.col("id").contains(jurisdiction)).select(F.col("id").alias("decision_id"), F.col("event_date").alias("decided_at"), day("event_date").alias("day")).where("day is not null")
    f = g.of("MoneyFlow").select(F.col("id").alias("flow_id"), F.col("event_date").alias("flow_date"), "amount", day("event_date").alias("flow_day")).where("flow_day is not null")
    per_day = d.groupBy("day").agg(F.count("*").alias("n")).withColumn("delta", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn("flow_day", F.date_sub("day", F.col("delta")))
    cells = per_day.join(f.groupBy("flow_day").agg(F.count("*").alias("m")), "flow_day").select("day", "flow_day", "delta", (F.col("n") * F.col("m")).alias("pairs"))
    nearest = Window.orderBy(F.abs("delta"), F.desc("day")).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each day and distance
    cells = cells.withColumn("so_far", F.sum("pairs").over(nearest)).groupBy("day", F.abs("delta").alias("gap")).agg(F.collect_list(F.struct("flow_day", "delta")).alias("c"), F.max("so_far").alias("so_far"), F.sum("pairs").alias("pairs"))
    cells = cells.where(F.col("so_far") - F.col("pairs") < most).select("day", F.explode("c").alias("c")).select("day", "c.flow_day", "c.delta")
    # Within a pair of days the order is by flow, then by decision: more than ``most`` of either can't come up.
    few = lambda df, key, own: df.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(own))).where(F.col("k") <= most).drop("k")
    flows = few(f.join(cells.select("flow_day").distinct(), "flow_day", "left_semi"), "flow_day", "flow_id")
    decisions = few(d.join(cells.select("day").distinct(), "day", "left_semi"), "day", "decision_id")
    out = cells.join(decisions, "day").join(flows, "flow_day").select("decision_id", "decided_at", "flow_id", "flow_date", "amount", F.col("delta").alias("days_delta"))
    return out.orderBy(F.abs("days_delta"), down("decided_at"), "flow_id", "decision_id").limit(most)


def validation_gaps(g: Graph) -> DataFrame:
    """Five kinds of gaps, counted; a blank date is a missing one."""
    cited = g.rel("EVIDENCED_BY", source="x", target="id").select("id").distinct()
    undated = F.coalesce("event_date", F.lit("")) == ""
    gaps = [
        ("decisions.missing_decided_at", "Decisions with no decided_at date", g.of("Decision").where(undated)),
        ("money_flows.missing_amount", "Money flows with no amount", g.of("MoneyFlow").where("amount is null")),
        ("filings.missing_signed_at", "Filings with no signed_at date", g.of("Filing").where(undated)),
        ("records.orphan_no_target", "Records not attached to any target", g.of("Record").join(cited, "id", "left_anti")),
        ("agreements.missing_effective_date", "Agreements with no effective_date", g.of("Agreement").where(undated)),
    ]
    out = None
    for name, description, df in gaps:
        row = df.agg(F.count("*").alias("count")).select(F.lit(name).alias("category"), F.lit(description).alias("description"), "count")
        out = row if out is None else out.unionByName(row)
    return out.orderBy("category")


def _sql(body: str) -> str:
    return with_graph(body)


TEMPLATES = {
    "decisions_since": Template(decisions_since, _sql("""
        SELECT d.id AS decision_id, d.event_date AS decided_at, d.label AS title, d.status, d.ref_id AS institution_id, o.label AS institution
        FROM nodes d LEFT JOIN nodes o ON o.node_type = 'Organization' AND o.id = d.ref_id
        WHERE d.node_type = 'Decision' AND d.ref_id LIKE 'org-%' AND d.event_date >= '1999-01-01'
        ORDER BY decided_at DESC NULLS FIRST, decision_id LIMIT 500"""),
        {"institution_prefix": "org-", "start": "1999-01-01", "end": None, "institution": None}),
    "money_flows_by_year": Template(money_flows, _sql("""
        SELECT f.id AS flow_id, f.event_date AS flow_date, f.amount, s.target_id AS source_id, t.target_id
        FROM nodes f LEFT JOIN edges s ON s.rel = 'FROM_SOURCE' AND s.source_id = f.id LEFT JOIN edges t ON t.rel = 'TO_TARGET' AND t.source_id = f.id
        WHERE f.node_type = 'MoneyFlow' AND f.event_date LIKE '1998%' AND f.kind = 'contribution' AND coalesce(f.amount, 0) >= 100
        ORDER BY flow_date DESC NULLS FIRST, flow_id, source_id NULLS LAST, t.target_id NULLS LAST LIMIT 500"""),
        {"year": "1998", "flow_type": "contribution", "minimum": 100, "source": None, "target": None}, ("year",)),
    "filings_by_person_or_committee": Template(filings_by_filer, _sql("""
        SELECT f.id AS filing_id, f.event_date AS signed_at, f.kind AS filing_type, b.target_id AS filer_id, p.label AS filer
        FROM nodes f LEFT JOIN edges b ON b.rel = 'FILED_BY' AND b.source_id = f.id LEFT JOIN nodes p ON p.id = b.target_id AND p.node_type IN ('Person', 'Committee')
        WHERE f.node_type = 'Filing' AND f.kind = 'purchase' AND f.event_date BETWEEN '2024-01-01' AND '2024-12-31'
        ORDER BY signed_at DESC NULLS FIRST, filing_id LIMIT 500"""),
        {"filing_type": "purchase", "start": "2024-01-01", "end": "2024-12-31", "filer": None}),
    "officeholder_form_coverage": Template(officeholder_coverage, _sql("""
        SELECT coalesce(p.label, p.id) AS person_name, coalesce(t.label, s.ref_id, s.id) AS seat_display,
          (SELECT count(DISTINCT f.id) FROM edges b JOIN nodes f ON f.id = b.source_id AND f.node_type = 'Filing' WHERE b.rel = 'FILED_BY' AND b.target_id = p.id AND f.kind = 'form_700') AS form_700_count,
          (SELECT count(DISTINCT f.id) FROM edges b JOIN nodes f ON f.id = b.source_id AND f.node_type = 'Filing' WHERE b.rel = 'FILED_BY' AND b.target_id = p.id AND f.kind = 'form_803') AS form_803_count, p.id
        FROM nodes s JOIN edges h ON h.rel = 'HELD_BY' AND (h.source_id = s.id OR h.target_id = s.id) JOIN nodes p ON p.node_type = 'Person' AND p.id = CASE WHEN h.source_id = s.id THEN h.target_id ELSE h.source_id END
        LEFT JOIN edges e ON e.rel = 'FOR_SEAT' AND e.source_id = s.id LEFT JOIN nodes t ON t.id = e.target_id AND t.node_type = 'Seat'
        WHERE s.node_type = 'SeatService' AND (s.ended_date IS NULL OR s.ended_date = '' OR TRY_CAST(s.ended_date AS DATE) >= DATE '2026-01-01') AND t.ref_id = 'place-nation-23'
        ORDER BY person_name, p.id, seat_display LIMIT 500"""),
        {"as_of": "2026-01-01", "jurisdiction": "place-nation-23"}, ("as_of",)),
    "agreements_for_project": Template(agreements_for_project, _sql("""
        SELECT coalesce(a.label, a.id) AS agreement_name, a.event_date AS effective_date, a.amount, (SELECT count(*) FROM edges m WHERE m.rel = 'AMENDS_AGREEMENT' AND m.target_id = a.id AND m.source_id LIKE 'amendment-%') AS amendment_count, a.id
        FROM nodes a WHERE a.node_type = 'Agreement' ORDER BY effective_date DESC NULLS FIRST, a.id LIMIT 500"""),
        {"project": None}),
    "legal_proceedings": Template(legal_proceedings, _sql("""
        linked AS (SELECT source_id AS c, target_id AS x FROM edges WHERE source_id LIKE 'case-%' AND (target_id LIKE 'program-%' OR target_id LIKE 'project-%')
          UNION ALL SELECT target_id, source_id FROM edges WHERE target_id LIKE 'case-%' AND (source_id LIKE 'program-%' OR source_id LIKE 'project-%'))
        SELECT coalesce(c.label, c.id) AS case_caption, p.kind AS proceeding_type, p.event_date AS occurred_at, coalesce(x.label, x.id) AS affected_program, p.id
        FROM nodes p JOIN edges e ON e.rel IN ('PART_OF_CASE', 'PART_OF') AND e.source_id = p.id JOIN nodes c ON c.id = e.target_id AND c.node_type = 'Case' LEFT JOIN linked l ON l.c = c.id LEFT JOIN nodes x ON x.id = l.x
        WHERE p.node_type = 'Proceeding' ORDER BY occurred_at DESC NULLS FIRST, p.id, affected_program NULLS LAST LIMIT 500"""),
        {"case": None}),
    "evidence_records_supporting": Template(evidence_records, _sql("""
        SELECT r.id AS record_id, r.label AS title, r.event_date AS captured_at, r.url
        FROM edges e JOIN nodes r ON r.id = e.target_id AND r.node_type = 'Record' WHERE e.rel = 'EVIDENCED_BY' AND e.source_id = 'project-35'
        ORDER BY captured_at DESC NULLS FIRST, record_id LIMIT 500"""),
        {"target": "project-35"}, ("target",)),
    "local_pressure_ranking": Template(pressure_ranking, _sql("""
        near AS (SELECT source_id AS u, target_id AS v FROM edges UNION ALL SELECT target_id, source_id FROM edges)
        SELECT coalesce(n.label, n.id) AS thread_name, n.node_type AS type, CAST(coalesce(m.money, 0) AS DECIMAL(18,2)) AS money_pressure, coalesce(l.n, 0) AS legal_pressure, coalesce(r.n, 0) AS evidence_density, n.id
        FROM nodes n
        LEFT JOIN (SELECT v, sum(coalesce(f.amount, 0)) AS money FROM near JOIN nodes f ON f.id = u AND f.node_type = 'MoneyFlow' GROUP BY v) m ON m.v = n.id
        LEFT JOIN (SELECT v, count(DISTINCT u) AS n FROM near WHERE u LIKE 'proceeding-%' GROUP BY v) l ON l.v = n.id
        LEFT JOIN (SELECT source_id, count(DISTINCT target_id) AS n FROM edges WHERE rel = 'EVIDENCED_BY' AND target_id LIKE 'record-%' GROUP BY 1) r ON r.source_id = n.id
        WHERE n.node_type IN ('Project', 'Program', 'Case') AND (contains(n.id, 'nation-3') OR n.id IN (SELECT source_id FROM edges WHERE rel IN ('IN_JURISDICTION', 'PRIMARY_PLACE') AND target_id = 'place-nation-3'))
        ORDER BY money_pressure DESC, legal_pressure DESC, evidence_density DESC, n.id LIMIT 100"""),
        {"place": "place-nation-3"}),
    "campaign_money_near_decisions": Template(money_around_decisions, _sql("""
        d AS (SELECT id, event_date, TRY_CAST(event_date AS DATE) AS day FROM nodes WHERE node_type = 'Decision' AND (contains(ref_id, 'org-1') OR contains(id, 'org-1'))),
        f AS (SELECT id, event_date, amount, TRY_CAST(event_date AS DATE) AS day FROM nodes WHERE node_type = 'MoneyFlow')
        SELECT d.id AS decision_id, d.event_date AS decided_at, f.id AS flow_id, f.event_date AS flow_date, f.amount, CAST(datediff('day', f.day, d.day) AS INTEGER) AS days_delta
        FROM d JOIN f ON f.day BETWEEN d.day - 7 AND d.day + 7
        ORDER BY abs(days_delta), decided_at DESC, flow_id, decision_id LIMIT 500"""),
        {"window": 7, "jurisdiction": "org-1"}),
    "money_around_decisions": Template(money_around_decisions, _sql("""
        d AS (SELECT id, event_date, TRY_CAST(event_date AS DATE) AS day FROM nodes WHERE node_type = 'Decision' AND (contains(ref_id, 'org-3') OR contains(id, 'org-3'))),
        f AS (SELECT id, event_date, amount, TRY_CAST(event_date AS DATE) AS day FROM nodes WHERE node_type = 'MoneyFlow')
        SELECT d.id AS decision_id, d.event_date AS decided_at, f.id AS flow_id, f.event_date AS flow_date, f.amount, CAST(datediff('day', f.day, d.day) AS INTEGER) AS days_delta
        FROM d JOIN f ON f.day BETWEEN d.day - 30 AND d.day + 30
        ORDER BY abs(days_delta), decided_at DESC, flow_id, decision_id LIMIT 500"""),
        {"window": 30, "jurisdiction": "org-3"}),
    "qa_validation_gaps": Template(validation_gaps, _sql("""
        SELECT 'records.orphan_no_target' AS category, 'Records not attached to any target' AS description, count(*) AS count FROM nodes r WHERE r.node_type = 'Record' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.rel = 'EVIDENCED_BY' AND e.target_id = r.id)
        UNION SELECT 'decisions.missing_decided_at', 'Decisions with no decided_at date', count(*) FROM nodes WHERE node_type = 'Decision' AND (event_date IS NULL OR event_date = '')
        UNION SELECT 'money_flows.missing_amount', 'Money flows with no amount', count(*) FROM nodes WHERE node_type = 'MoneyFlow' AND amount IS NULL
        UNION SELECT 'filings.missing_signed_at', 'Filings with no signed_at date', count(*) FROM nodes WHERE node_type = 'Filing' AND (event_date IS NULL OR event_date = '')
        UNION SELECT 'agreements.missing_effective_date', 'Agreements with no effective_date', count(*) FROM nodes WHERE node_type = 'Agreement' AND (event_date IS NULL OR event_date = '')""")),
}

_FOR_ONE = TEMPLATES["agreements_for_project"].sql.replace("WHERE a.node_type = 'Agreement' ORDER", "WHERE a.node_type = 'Agreement' AND (a.ref_id = 'project-35' OR EXISTS (SELECT 1 FROM edges e WHERE e.source_id = a.id AND e.target_id = 'project-35' OR e.target_id = a.id AND e.source_id = 'project-35')) ORDER")
QUERIES = {f"dq_{slug}": (lambda spark, sf_dir, slug=slug: query(fixture_graph(spark, sf_dir), slug)) for slug in TEMPLATES}
ORACLE_SQL = {f"dq_{slug}": t.sql for slug, t in TEMPLATES.items()}
QUERIES["dq_agreements_for_one_project"] = lambda spark, sf_dir: query(fixture_graph(spark, sf_dir), "agreements_for_project", project="project-35")
ORACLE_SQL["dq_agreements_for_one_project"] = _FOR_ONE
