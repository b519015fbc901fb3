"""Read-model views as metric tables: one row per subject, for all subjects at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polisgraph.functions import vocabulary as V
from polisgraph.graph import Graph
from polisgraph.operators.reconcile import reconcile
from polisgraph.sources.fixtures import fixture_graph, with_graph

#: Subject type, and metrics: name, relationship, the subject's end, prefix of the other end's ids.
DOSSIERS = {
    "actor_dossier": ("Person", [("votes", "CAST_VOTE", "source", "decision"), ("filings", "FILED_BY", "target", "filing"), ("services", "HELD_BY", "target", "service"), ("flows", "TO_TARGET", "target", "moneyflow"), ("cases", "PARTY_TO", "source", "case")]),
    "organization_dossier": ("Organization", [("decisions", "DECIDED_BY", "target", "decision"), ("flows", "FROM_SOURCE", "target", "moneyflow"), ("agreements", "COUNTERPARTY_ACTOR", "target", "agreement"), ("seats", "AT_INSTITUTION", "target", "seat")]),
    "decision_dossier": ("Decision", [("votes", "CAST_VOTE", "target", "person"), ("flows", "RELATES_TO_DECISION", "target", "moneyflow"), ("cases", "RELATES_TO_DECISION", "target", "case"), ("projects", "RELATES_TO_PROJECT", "source", "project"), ("records", "EVIDENCED_BY", "source", "record")]),
    "case_dossier": ("Case", [("proceedings", "PART_OF_CASE", "target", "proceeding"), ("parties", "PARTY_TO", "target", "person"), ("records", "EVIDENCED_BY", "source", "record"), ("programs", "RELATES_TO_PROGRAM", "source", "program"), ("decisions", "RELATES_TO_DECISION", "source", "decision")]),
    "program_dossier": ("Program", [("projects", "RELATES_TO_PROGRAM", "target", "project"), ("cases", "RELATES_TO_PROGRAM", "target", "case")]),
    "project_dossier": ("Project", [("decisions", "RELATES_TO_PROJECT", "target", "decision"), ("flows", "RELATES_TO_PROJECT", "target", "moneyflow"), ("agreements", "RELATES_TO_PROJECT", "target", "agreement"), ("records", "EVIDENCED_BY", "source", "record"), ("programs", "RELATES_TO_PROGRAM", "source", "program")]),
}
MONEY = "decimal(18,2)"


def dossier(g: Graph, node_type: str, metrics: list[tuple[str, str, str, str]]) -> DataFrame:
    """Distinct neighbours of every subject by metric: one pass over the edges, one distinct, one aggregation."""
    subject = V.PREFIX[node_type] + "-"
    which = F.lit(None).cast("string")
    for name, rel, end, other in metrics:
        far = "target" if end == "source" else "source"
        which = F.when((F.col("rel") == rel) & F.col(f"{end}_id").startswith(subject) & F.col(f"{far}_id").startswith(other + "-"), name).otherwise(which)
    ends = dict((name, end) for name, _, end, _ in metrics)
    out_ = F.col("metric").isin(*[m for m, end in ends.items() if end == "source"])
    e = g.edges_of(*{r for _, r, _, _ in metrics}).withColumn("metric", which).where("metric is not null")
    e = e.select(F.when(out_, F.col("source_id")).otherwise(F.col("target_id")).alias("id"), "metric", F.when(out_, F.col("target_id")).otherwise(F.col("source_id")).alias("other")).distinct()
    counts = e.groupBy("id").agg(*[F.count(F.when(F.col("metric") == m, 1)).alias(m) for m in ends])
    return g.of(node_type).select("id", "label").join(counts, "id", "left").select("id", "label", *[F.coalesce(m, F.lit(0)).alias(m) for m in ends])


def _dossier_sql(node_type: str, metrics) -> str:
    parts = []
    for name, rel, end, other in metrics:
        far = "target" if end == "source" else "source"
        parts.append(f"(SELECT count(DISTINCT e.{far}_id) FROM edges e WHERE e.rel = '{rel}' AND e.{end}_id = n.id AND e.{far}_id LIKE '{other}-%') AS {name}")
    return with_graph(f"SELECT n.id, n.label, {', '.join(parts)} FROM nodes n WHERE n.node_type = '{node_type}'")


def flows_of(g: Graph) -> DataFrame:
    """``(flow, flow_type, amount)``; a missing amount counts as 0.

    Flows are many, and their files are small for that: they are joined by sorting, and never sent to all tasks.
    """
    return g.of("MoneyFlow").select(F.col("id").alias("flow"), F.col("kind").alias("flow_type"), F.coalesce("amount", F.lit(0)).cast(MONEY).alias("amount")).hint("merge")


def decisions_in_scope(g: Graph, place: str) -> DataFrame:
    """Decisions that relate to a project of the place, or that a program of the place relates to."""
    here = lambda kind: g.rel("IN_JURISDICTION", source=kind, target="place", source_type=kind).where(F.col("place") == place).select(kind)
    by_project = g.rel("RELATES_TO_PROJECT", source="decision", target="project", source_type="decision").join(here("project"), "project", "left_semi").select("decision")
    by_program = g.rel("RELATES_TO_DECISION", source="program", target="decision", source_type="program").join(here("program"), "program", "left_semi").select("decision")
    return by_project.unionByName(by_program).distinct()


def decision_money_rollup(g: Graph, place: str) -> DataFrame:
    links = g.rel("RELATES_TO_DECISION", source="flow", target="decision", source_type="moneyflow").join(decisions_in_scope(g, place), "decision", "left_semi")
    of = links.join(flows_of(g), "flow")
    total = of.groupBy("decision").agg(F.count("*").alias("flow_count"), F.sum("amount").cast(MONEY).alias("total_amount"), *[F.count_if(F.col("flow_type") == k).alias(k) for k in ("contribution", "expenditure", "behest")])
    d = g.of("Decision").select(F.col("id").alias("decision"), "label", F.col("event_date").alias("decided_at"))
    return total.join(d, "decision").orderBy(F.desc("total_amount"), F.desc("flow_count"), "decision")


def counterparties(g: Graph, place: str) -> DataFrame:
    """Each decision's counterparties: totals over links and over distinct flows."""
    links = g.rel("RELATES_TO_DECISION", source="flow", target="decision", source_type="moneyflow").join(decisions_in_scope(g, place), "decision", "left_semi")
    ends = g.rel("FROM_SOURCE", source="flow", target="party").withColumn("role", F.lit("source")).unionByName(g.rel("TO_TARGET", source="flow", target="party").withColumn("role", F.lit("target")))
    rows = links.join(flows_of(g), "flow").join(ends.hint("merge"), "flow")
    per_flow = rows.groupBy("decision", "party", "flow").agg(F.count("*").alias("links"), F.max("amount").alias("amount"), F.max(F.when(F.col("role") == "source", 1).otherwise(0)).alias("s"), F.max(F.when(F.col("role") == "target", 1).otherwise(0)).alias("t"))
    return per_flow.groupBy("decision", "party").agg(F.count("*").alias("flows"), F.sum(F.col("amount") * F.col("links")).cast(MONEY).alias("link_total"), F.sum("amount").cast(MONEY).alias("flow_total"), F.max("s").alias("is_source"), F.max("t").alias("is_target"))


def thread_pressure(g: Graph) -> DataFrame:
    """Money, decisions and cases of each thread (project or program) with its place."""
    project_flows = g.rel("RELATES_TO_PROJECT", source="flow", target="thread", source_type="moneyflow").join(flows_of(g), "flow")
    of_program = g.rel("RELATES_TO_PROGRAM", source="project", target="program", source_type="project")
    own = g.rel("RELATES_TO_DECISION", source="thread", target="decision", source_type="program")
    own_flows = own.join(g.rel("RELATES_TO_DECISION", source="flow", target="decision", source_type="moneyflow"), "decision").join(flows_of(g), "flow").select("thread", "flow", "amount")
    program_flows = project_flows.withColumnRenamed("thread", "project").join(of_program, "project").select(F.col("program").alias("thread"), "flow", "amount").unionByName(own_flows).distinct()
    money = project_flows.select("thread", "flow", "amount").distinct().unionByName(program_flows).groupBy("thread").agg(F.count("*").alias("flows"), F.sum("amount").cast(MONEY).alias("money"))
    decided = g.rel("RELATES_TO_PROJECT", source="decision", target="thread", source_type="decision")
    by_program = decided.withColumnRenamed("thread", "project").join(of_program, "project").select(F.col("program").alias("thread"), "decision")
    decisions = decided.select("thread", "decision").unionByName(by_program).unionByName(own).distinct().groupBy("thread").agg(F.count("*").alias("decisions"))
    cases = g.rel("RELATES_TO_PROGRAM", source="case", target="thread", source_type="case").distinct().groupBy("thread").agg(F.count("*").alias("cases"))
    out = g.of("Project", "Program").select(F.col("id").alias("thread"), "node_type")
    for df in (money, decisions, cases):
        out = out.join(df, "thread", "left")
    return out.select("thread", "node_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("flows", "decisions", "cases")], F.coalesce("money", F.lit(0).cast(MONEY)).cast(MONEY).alias("money"))


def program_pressure(g: Graph) -> DataFrame:
    return thread_pressure(g).where(F.col("node_type") == "Program").drop("node_type")


def jurisdiction_delivery(g: Graph) -> DataFrame:
    """Projects of each place with their agreements, amendments, decisions and money."""
    here = g.rel("IN_JURISDICTION", source="project", target="place", source_type="project")
    agreements = g.rel("RELATES_TO_PROJECT", source="agreement", target="project", source_type="agreement")
    amended = g.rel("AMENDS_AGREEMENT", source="amendment", target="agreement")
    a = here.join(agreements, "project").join(amended, "agreement", "left").groupBy("place").agg(F.countDistinct("agreement").alias("agreements"), F.countDistinct("amendment").alias("amendments"))
    p = here.join(thread_pressure(g).select(F.col("thread").alias("project"), "flows", "money"), "project").groupBy("place").agg(F.count("*").alias("projects"), F.sum("flows").alias("flows"), F.sum("money").cast(MONEY).alias("money"))
    return p.join(a, "place", "left").select("place", "projects", F.coalesce("agreements", F.lit(0)).alias("agreements"), F.coalesce("amendments", F.lit(0)).alias("amendments"), "flows", "money")


def pressure_comparison(g: Graph) -> DataFrame:
    """Threads of each place by rank: money, then decisions, then flows, then id.

    Threads are the place's projects, programs, and general municipal elections that have flows.
    """
    here = g.rel("IN_JURISDICTION", source="thread", target="place").where(F.col("thread").rlike("^(project|program|election)-"))
    general = g.of("Election").where(F.col("kind") == "general_municipal").select(F.col("id").alias("thread"))
    spent = g.rel("RELATED_TO_ELECTION", source="flow", target="thread", source_type="moneyflow").join(general, "thread", "left_semi").join(flows_of(g), "flow").select("thread", "flow", "amount").distinct()
    elections = spent.groupBy("thread").agg(F.count("*").alias("flows"), F.sum("amount").cast(MONEY).alias("money")).withColumn("decisions", F.lit(0))
    order = Window.partitionBy("place").orderBy(F.desc("money"), F.desc("decisions"), F.desc("flows"), "thread")
    threads = thread_pressure(g).select("thread", "flows", "decisions", "money").unionByName(elections)
    return threads.join(here, "thread").withColumn("rank", F.row_number().over(order)).select("place", "rank", "thread", "flows", "decisions", "money")


def pressure_explanation(g: Graph) -> DataFrame:
    """What sets a place's first thread apart: the flags of the largest values and its lead over the second."""
    ranked = pressure_comparison(g)
    most = Window.partitionBy("place")
    nxt = Window.partitionBy("place").orderBy("rank")
    out = ranked.select("*", F.lead("money").over(nxt).alias("next_money"), *[(F.col(c) == F.max(c).over(most)).alias(f"highest_{c}") for c in ("money", "decisions", "flows")])
    return out.where("rank = 1").select("place", "thread", "highest_money", "highest_decisions", "highest_flows", (F.col("money") - F.coalesce("next_money", F.lit(0))).cast(MONEY).alias("lead"))


def legal_scope(g: Graph, place: str) -> DataFrame:
    """Cases of a place by any of three ways: their own place, a program that is there or has a project there, a decision in scope."""
    there = lambda kind: g.rel("IN_JURISDICTION", source="id", target="place", source_type=kind).where(F.col("place") == place).select("id")
    by_place = there("case").select(F.col("id").alias("case"), F.lit("place").alias("why"))
    through = g.rel("RELATES_TO_PROGRAM", source="id", target="program", source_type="project").join(there("project"), "id", "left_semi").select("program")
    programs = through.unionByName(there("program").select(F.col("id").alias("program"))).distinct()
    by_program = g.rel("RELATES_TO_PROGRAM", source="case", target="program", source_type="case").join(programs, "program", "left_semi").select("case", F.lit("program").alias("why"))
    by_decision = g.rel("RELATES_TO_DECISION", source="case", target="decision", source_type="case").join(decisions_in_scope(g, place), "decision", "left_semi").select("case", F.lit("decision").alias("why"))
    hits = by_place.unionByName(by_program).unionByName(by_decision).distinct()
    return hits.groupBy("case").agg(*[F.max(F.when(F.col("why") == w, 1).otherwise(0)).alias(f"by_{w}") for w in ("place", "program", "decision")])


def money_overlap(g: Graph) -> DataFrame:
    """Subjects with two flows or more: every neighbour of a flow but records, filings and checks; the first 25 are the view."""
    flows = g.of("MoneyFlow").select(F.col("id").alias("u"), F.coalesce("kind", F.lit("unknown")).alias("kind"))
    near = g.undirected().where(F.col("u").startswith("moneyflow-")).join(flows, "u")
    out = near.groupBy(F.col("v").alias("subject")).agg(F.count_distinct("u").alias("flow_count"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("rel")).alias("rels")).where("flow_count >= 2")
    types = g.nodes.where(~F.col("node_type").isin("Record", "Filing", "ValidationCheck")).select(F.col("id").alias("subject"), "node_type")
    out = out.join(types, "subject").orderBy(F.desc("flow_count"), F.desc(F.size("kinds")), "node_type", "subject").limit(25)
    return out.select("subject", "node_type", "flow_count", F.array_join("kinds", ",").alias("flow_types"), F.array_join("rels", ",").alias("relationship_types"))


def legal_constraints(g: Graph) -> DataFrame:
    """Every case with its proceedings in time order."""
    p = g.rel("PART_OF_CASE", source="id", target="case").join(g.of("Proceeding").select("id", F.coalesce("event_date", F.lit("9999")).alias("day")), "id")
    lines = p.groupBy("case").agg(F.count("*").alias("proceedings"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "id"))), lambda x: x["id"]), ",").alias("lineage"))
    return g.of("Case").select(F.col("id").alias("case"), "label").join(lines, "case", "left").select("case", "label", F.coalesce("proceedings", F.lit(0)).alias("proceedings"), F.coalesce("lineage", F.lit("")).alias("lineage"))


def election_rollup(g: Graph) -> DataFrame:
    committees = g.rel("FOR_ELECTION", source="c", target="election").groupBy("election").agg(F.countDistinct("c").alias("committees"))
    money = g.rel("RELATED_TO_ELECTION", source="flow", target="election").join(flows_of(g), "flow").groupBy("election").agg(F.count("*").alias("flows"), F.sum("amount").cast(MONEY).alias("money"))
    out = g.of("Election").select(F.col("id").alias("election")).join(committees, "election", "left").join(money, "election", "left")
    return out.select("election", F.coalesce("committees", F.lit(0)).alias("committees"), F.coalesce("flows", F.lit(0)).alias("flows"), F.coalesce("money", F.lit(0).cast(MONEY)).cast(MONEY).alias("money"))


def checks(g: Graph) -> DataFrame:
    """A decision's stated total against the sum of its flows."""
    measured = g.rel("RELATES_TO_DECISION", source="flow", target="subject", source_type="moneyflow").join(flows_of(g), "flow").groupBy("subject").agg(F.sum("amount").cast(MONEY).alias("measured"))
    stated = g.of("Decision").select(F.col("id").alias("subject"), F.col("amount").alias("reference"))
    return reconcile(stated.join(measured, "subject", "left"), "measured", "reference")


def validation_queue(g: Graph) -> DataFrame:
    open_ = checks(g).where(F.col("status") != "reconciled")
    order = Window.partitionBy("status").orderBy(F.desc("absolute_delta"), "subject")
    return open_.withColumn("place", F.row_number().over(order)).where("place <= 50").select("status", "place", "subject", "severity", "delta", "absolute_delta", "direction")


PLACE = "place-nation-3"
_SCOPE = f"scope AS MATERIALIZED (SELECT DISTINCT e.source_id AS decision FROM edges e JOIN edges j ON j.rel = 'IN_JURISDICTION' AND j.source_id = e.target_id AND j.target_id = '{PLACE}' WHERE e.rel = 'RELATES_TO_PROJECT' AND e.source_id LIKE 'decision-%' UNION SELECT e.target_id FROM edges e JOIN edges j ON j.rel = 'IN_JURISDICTION' AND j.source_id = e.source_id AND j.target_id = '{PLACE}' WHERE e.rel = 'RELATES_TO_DECISION' AND e.source_id LIKE 'program-%')"
_FLOWS = "f AS MATERIALIZED (SELECT id AS flow, kind, coalesce(amount, 0) AS amount FROM nodes WHERE node_type = 'MoneyFlow')"
_FD = "fd AS MATERIALIZED (SELECT source_id AS flow, target_id AS decision FROM edges WHERE rel = 'RELATES_TO_DECISION' AND source_id LIKE 'moneyflow-%')"
_THREADS = f"""{_FLOWS}, pp AS (SELECT source_id AS project, target_id AS program FROM edges WHERE rel = 'RELATES_TO_PROGRAM' AND source_id LIKE 'project-%'),
  pf AS MATERIALIZED (SELECT DISTINCT target_id AS thread, source_id AS flow FROM edges WHERE rel = 'RELATES_TO_PROJECT' AND source_id LIKE 'moneyflow-%'),
  od AS (SELECT DISTINCT source_id AS thread, target_id AS decision FROM edges WHERE rel = 'RELATES_TO_DECISION' AND source_id LIKE 'program-%'),
  allf AS (SELECT * FROM pf UNION SELECT program, flow FROM pf JOIN pp ON project = thread UNION SELECT thread, e.source_id FROM od JOIN edges e ON e.rel = 'RELATES_TO_DECISION' AND e.source_id LIKE 'moneyflow-%' AND e.target_id = decision),
  pd AS (SELECT DISTINCT target_id AS thread, source_id AS decision FROM edges WHERE rel = 'RELATES_TO_PROJECT' AND source_id LIKE 'decision-%'),
  alld AS (SELECT * FROM pd UNION SELECT program, decision FROM pd JOIN pp ON project = thread UNION SELECT * FROM od),
  threads AS MATERIALIZED (SELECT n.id AS thread, n.node_type, coalesce(m.flows, 0) AS flows, coalesce(d.n, 0) AS decisions, coalesce(c.n, 0) AS cases, CAST(coalesce(m.money, 0) AS DECIMAL(18,2)) AS money FROM nodes n
    LEFT JOIN (SELECT thread, count(*) AS flows, sum(amount) AS money FROM allf JOIN f USING (flow) GROUP BY 1) m ON m.thread = n.id
    LEFT JOIN (SELECT thread, count(*) AS n FROM alld GROUP BY 1) d ON d.thread = n.id
    LEFT JOIN (SELECT target_id, count(DISTINCT source_id) AS n FROM edges WHERE rel = 'RELATES_TO_PROGRAM' AND source_id LIKE 'case-%' GROUP BY 1) c ON c.target_id = n.id
    WHERE n.node_type IN ('Project', 'Program')),
  here AS (SELECT source_id AS thread, target_id AS place FROM edges WHERE rel = 'IN_JURISDICTION' AND (source_id LIKE 'project-%' OR source_id LIKE 'program-%' OR source_id LIKE 'election-%')),
  spent AS (SELECT DISTINCT e.target_id AS thread, f.flow, f.amount FROM edges e JOIN nodes n ON n.id = e.target_id AND n.node_type = 'Election' AND n.kind = 'general_municipal' JOIN f ON f.flow = e.source_id WHERE e.rel = 'RELATED_TO_ELECTION' AND e.source_id LIKE 'moneyflow-%'),
  contests AS (SELECT thread, flows, decisions, money FROM threads UNION ALL SELECT thread, count(*), 0, CAST(sum(amount) AS DECIMAL(18,2)) FROM spent GROUP BY thread),
  ranked AS (SELECT place, CAST(row_number() OVER (PARTITION BY place ORDER BY money DESC, decisions DESC, flows DESC, thread) AS INTEGER) AS rank, thread, flows, decisions, money FROM contests JOIN here USING (thread))"""
_CHECKS = f"""{_FLOWS}, {_FD}, ck AS (SELECT id AS subject, measured, amount AS reference, CAST(measured - amount AS DECIMAL(18,2)) AS delta FROM nodes LEFT JOIN (SELECT decision, CAST(sum(amount) AS DECIMAL(18,2)) AS measured FROM fd JOIN f USING (flow) GROUP BY 1) m ON m.decision = id WHERE node_type = 'Decision'),
  st AS (SELECT *, CAST(abs(delta) AS DECIMAL(18,2)) AS absolute_delta, CASE WHEN delta > 0 THEN 'measured_gt_reference' WHEN delta < 0 THEN 'reference_gt_measured' WHEN delta = 0 THEN 'equal' END AS direction,
    CASE WHEN delta IS NULL THEN 'needs_review' WHEN delta = 0 THEN 'reconciled' WHEN delta < 0 THEN 'extraction_gap' ELSE 'source_inconsistency' END AS status, CASE WHEN delta IS NULL THEN 'medium' ELSE 'high' END AS confidence FROM ck),
  sv AS (SELECT *, CASE WHEN status = 'reconciled' THEN 'info' ELSE 'warn' END AS severity FROM st)"""


def _view(build):
    return lambda spark, sf_dir: build(fixture_graph(spark, sf_dir))


VIEWS = {
    "decision_money_rollup": (lambda g: decision_money_rollup(g, PLACE), f"{_SCOPE}, {_FLOWS}, {_FD} SELECT d.id AS decision, d.label, d.event_date AS decided_at, count(*) AS flow_count, CAST(sum(f.amount) AS DECIMAL(18,2)) AS total_amount, count(*) FILTER (f.kind = 'contribution') AS contribution, count(*) FILTER (f.kind = 'expenditure') AS expenditure, count(*) FILTER (f.kind = 'behest') AS behest FROM fd JOIN scope USING (decision) JOIN f USING (flow) JOIN nodes d ON d.id = fd.decision GROUP BY 1, 2, 3"),
    "decision_counterparties": (lambda g: counterparties(g, PLACE), f"{_SCOPE}, {_FLOWS}, {_FD}, l AS (SELECT fd.decision, e.target_id AS party, fd.flow, e.rel, f.amount FROM fd JOIN scope USING (decision) JOIN f USING (flow) JOIN edges e ON e.source_id = fd.flow AND e.rel IN ('FROM_SOURCE', 'TO_TARGET')), p AS (SELECT decision, party, flow, count(*) AS n, max(amount) AS amount, max(CAST(rel = 'FROM_SOURCE' AS INTEGER)) AS s, max(CAST(rel = 'TO_TARGET' AS INTEGER)) AS t FROM l GROUP BY 1, 2, 3) SELECT decision, party, count(*) AS flows, CAST(sum(amount * n) AS DECIMAL(18,2)) AS link_total, CAST(sum(amount) AS DECIMAL(18,2)) AS flow_total, max(s) AS is_source, max(t) AS is_target FROM p GROUP BY 1, 2"),
    "program_local_pressure": (program_pressure, f"{_THREADS} SELECT thread, flows, decisions, cases, money FROM threads WHERE node_type = 'Program'"),
    "election_rollup": (election_rollup, f"{_FLOWS} SELECT n.id AS election, (SELECT count(DISTINCT source_id) FROM edges WHERE rel = 'FOR_ELECTION' AND target_id = n.id) AS committees, count(f.flow) AS flows, CAST(coalesce(sum(f.amount), 0) AS DECIMAL(18,2)) AS money FROM nodes n LEFT JOIN edges e ON e.rel = 'RELATED_TO_ELECTION' AND e.target_id = n.id LEFT JOIN f ON f.flow = e.source_id WHERE n.node_type = 'Election' GROUP BY n.id"),
    "jurisdiction_delivery": (jurisdiction_delivery, f"{_THREADS}, ag AS (SELECT h.place, count(DISTINCT a.source_id) AS agreements, count(DISTINCT m.source_id) AS amendments FROM (SELECT * FROM here WHERE thread LIKE 'project-%') h JOIN edges a ON a.rel = 'RELATES_TO_PROJECT' AND a.target_id = h.thread AND a.source_id LIKE 'agreement-%' LEFT JOIN edges m ON m.rel = 'AMENDS_AGREEMENT' AND m.target_id = a.source_id GROUP BY 1) SELECT h.place, count(*) AS projects, coalesce(max(agreements), 0) AS agreements, coalesce(max(amendments), 0) AS amendments, CAST(sum(flows) AS BIGINT) AS flows, CAST(sum(money) AS DECIMAL(18,2)) AS money FROM (SELECT * FROM here WHERE thread LIKE 'project-%') h JOIN threads USING (thread) LEFT JOIN ag USING (place) GROUP BY 1"),
    "pressure_comparison": (pressure_comparison, f"{_THREADS} SELECT * FROM ranked"),
    "pressure_explanation": (pressure_explanation, f"{_THREADS} SELECT place, thread, highest_money, highest_decisions, highest_flows, CAST(money - coalesce(nm, 0) AS DECIMAL(18,2)) AS lead FROM (SELECT *, lead(money) OVER (PARTITION BY place ORDER BY rank) AS nm, money = max(money) OVER (PARTITION BY place) AS highest_money, decisions = max(decisions) OVER (PARTITION BY place) AS highest_decisions, flows = max(flows) OVER (PARTITION BY place) AS highest_flows FROM ranked) WHERE rank = 1"),
    "legal_constraint_summary": (lambda g: legal_scope(g, PLACE), f"{_SCOPE}, hits AS (SELECT source_id AS c, 'place' AS why FROM edges WHERE rel = 'IN_JURISDICTION' AND target_id = '{PLACE}' AND source_id LIKE 'case-%' UNION SELECT e.source_id, 'program' FROM edges e JOIN edges j ON j.rel = 'IN_JURISDICTION' AND j.source_id = e.target_id AND j.target_id = '{PLACE}' WHERE e.rel = 'RELATES_TO_PROGRAM' AND e.source_id LIKE 'case-%' AND e.target_id LIKE 'program-%' UNION SELECT e.source_id, 'program' FROM edges e JOIN edges p ON p.rel = 'RELATES_TO_PROGRAM' AND p.source_id LIKE 'project-%' AND p.target_id = e.target_id JOIN edges j ON j.rel = 'IN_JURISDICTION' AND j.source_id = p.source_id AND j.target_id = '{PLACE}' WHERE e.rel = 'RELATES_TO_PROGRAM' AND e.source_id LIKE 'case-%' UNION SELECT e.source_id, 'decision' FROM edges e JOIN scope ON decision = e.target_id WHERE e.rel = 'RELATES_TO_DECISION' AND e.source_id LIKE 'case-%') SELECT c AS case, max(CAST(why = 'place' AS INTEGER)) AS by_place, max(CAST(why = 'program' AS INTEGER)) AS by_program, max(CAST(why = 'decision' AS INTEGER)) AS by_decision FROM hits GROUP BY c".replace(" AS case", ' AS "case"')),
    "money_overlap": (money_overlap, "b AS (SELECT source_id AS u, rel, target_id AS v FROM edges UNION ALL SELECT target_id, rel, source_id FROM edges) SELECT v AS subject, n.node_type, count(DISTINCT u) AS flow_count, string_agg(DISTINCT coalesce(f.kind, 'unknown'), ',' ORDER BY coalesce(f.kind, 'unknown')) AS flow_types, string_agg(DISTINCT rel, ',' ORDER BY rel) AS relationship_types FROM b JOIN nodes f ON f.id = u AND f.node_type = 'MoneyFlow' JOIN nodes n ON n.id = v AND n.node_type NOT IN ('Record', 'Filing', 'ValidationCheck') GROUP BY 1, 2 HAVING count(DISTINCT u) >= 2 ORDER BY flow_count DESC, count(DISTINCT coalesce(f.kind, 'unknown')) DESC, n.node_type, subject LIMIT 25"),
    "legal_constraints": (legal_constraints, "SELECT n.id AS \"case\", n.label, count(p.id) AS proceedings, coalesce(string_agg(p.id, ',' ORDER BY coalesce(p.event_date, '9999'), p.id), '') AS lineage FROM nodes n LEFT JOIN edges e ON e.rel = 'PART_OF_CASE' AND e.target_id = n.id LEFT JOIN nodes p ON p.id = e.source_id WHERE n.node_type = 'Case' GROUP BY 1, 2"),
    "reconciliation_checks": (checks, f"{_CHECKS} SELECT subject, measured, reference, delta, absolute_delta, direction, status, confidence, severity FROM sv"),
    "validation_queue": (validation_queue, f"{_CHECKS} SELECT status, CAST(place AS INTEGER) AS place, subject, severity, delta, absolute_delta, direction FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY absolute_delta DESC NULLS LAST, subject) AS place FROM sv WHERE status <> 'reconciled') WHERE place <= 50"),
}

QUERIES = {f"view_{name}": _view(lambda g, t=t, m=m: dossier(g, t, m)) for name, (t, m) in DOSSIERS.items()} | {(name if name == "decision_money_rollup" else f"view_{name}"): _view(build) for name, (build, _) in VIEWS.items()}
ORACLE_SQL = {f"view_{name}": _dossier_sql(t, m) for name, (t, m) in DOSSIERS.items()} | {(name if name == "decision_money_rollup" else f"view_{name}"): with_graph(sql) for name, (_, sql) in VIEWS.items()}
