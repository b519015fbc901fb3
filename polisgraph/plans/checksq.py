"""Registered queries of small rules: pages, days, citations, rollups, samples, first occurrences, reachability, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polisgraph.functions import provenance as P
from polisgraph.graph import Graph
from polisgraph.operators import entity, projector, resolve, traverse
from polisgraph.plans import bundleq, cleanq, entityq, extraq, graphq, views
from polisgraph.sources import store
from polisgraph.sources.fixtures import fixture_graph, with_graph

FIRST, LAST = 5, 5


def _page(node_type: str):
    def page(spark, d) -> DataFrame:
        g = fixture_graph(spark, d)
        return entity.page(g, entityq.first_of(g, node_type), node_type)

    return page


def effective_dates(g: Graph) -> DataFrame:
    return g.nodes.where("node_type <> 'MoneyFlow'").select("id", P.effective_date("node_type", "event_date").alias("day"))


def citations(spark, d) -> DataFrame:
    nodes = bundleq._nodes(spark, d)
    return nodes.select("id", P.is_cited().alias("cited"))


def subject_rollup(checks: DataFrame, subject: str) -> DataFrame:
    """Checks of each subject, how many have each status, and the largest difference."""
    per = checks.groupBy(subject, "status").agg(F.count("*").alias("n"), F.max("absolute_delta").alias("most"))
    counts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda x: F.concat_ws(":", x["status"], x["n"].cast("string"))), ",")
    return per.groupBy(subject).agg(F.sum("n").alias("checks"), counts.alias("statuses"), F.coalesce(F.max("most"), F.lit(0)).cast("decimal(18,2)").alias("largest"))


def _rollup(spark, d) -> DataFrame:
    g = fixture_graph(spark, d)
    of = g.of("Decision").select(F.col("id").alias("subject"), F.col("ref_id").alias("institution"))
    return subject_rollup(views.checks(g).join(of, "subject"), "institution")


def first_occurrences(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def ends(rows: DataFrame, order: list[str], first: int = FIRST, last: int = LAST) -> DataFrame:
    """The first and the last rows of an order, numbered; a short table has a row in both."""
    head = rows.orderBy(*order).limit(first).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    tail = rows.orderBy(*[F.col(c).desc() for c in order]).limit(last).withColumn("position", -F.row_number().over(Window.orderBy(*[F.col(c).desc() for c in order])))
    return head.unionByName(tail)


def shared_targets(g: Graph) -> DataFrame:
    """Of the first two cases: programs that both have, and decisions that either has."""
    pair = g.of("Case").select("id").orderBy("id").limit(2)
    links = g.rel("RELATES_TO_PROGRAM", "RELATES_TO_DECISION", source="id", target="target", source_type="case").join(F.broadcast(pair), "id").distinct()  # two rows
    held = links.groupBy("target").agg(F.count("*").alias("n")).crossJoin(pair.agg(F.count("*").alias("cases")))
    return held.select("target", F.when(F.col("target").startswith("program-"), F.when(F.col("n") == F.col("cases"), "shared")).otherwise("linked").alias("why")).where("why is not null")


def reachable(g: Graph, start: str, target: str, hops: int = 4) -> DataFrame:
    """``(start, target, hops)`` of the shortest undirected way over any edges, null without one of so many hops."""
    spark = g.spark
    edges = g.undirected().select("u", "v")
    # Hops are taken from both ends, from the end with fewer nodes at its rim, until the two sides meet.
    sides = [[ids, ids, 1, 1] for ids in (spark.createDataFrame([(x,)], "id string") for x in (start, target))]
    found = 0 if start == target else None
    for k in range(1, hops + 1):
        if found is not None:
            break
        side, other = sorted(sides, key=lambda s: s[2])
        seen, rim, n, n_seen = side
        rim = traverse.next_hop(edges, rim, n, seen, n_seen)
        n = rim.count()
        side[:] = seen.unionByName(rim), rim, n, n_seen + n
        found = k if not traverse.among(rim, other[0], other[3], "id").isEmpty() else None
    return spark.createDataFrame([(start, target, found)], "start string, target string, hops int")


def headline_stats(spark, d) -> DataFrame:
    """Nodes of each type and their money in the subgraph that illustrates a page."""
    g = fixture_graph(spark, d)
    shown = extraq.signature_subgraph(g, graphq.START).select("id")
    return g.nodes.join(shown, "id", "left_semi").groupBy("node_type").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("node_type") == "MoneyFlow", F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias("money"))


def coverage(spark, d) -> DataFrame:
    """One row of counters over all checks."""
    c = views.checks(fixture_graph(spark, d))
    count = lambda name, what: F.count_if(what).alias(name)
    return c.agg(F.count("*").alias("checks"), *[count(s, F.col("status") == s) for s in ("reconciled", "extraction_gap", "source_inconsistency", "needs_review")], count("high_confidence", F.col("confidence") == "high"))


def browse_cursor(g: Graph, node_type: str, after: str = "", size: int = 50) -> DataFrame:
    """A page and, if it is full, the id from which the next one goes on."""
    size = min(200, max(1, size))
    page = cleanq.browse_page(g, node_type, after, size)
    return page.crossJoin(page.agg(F.when(F.count("*") == size, F.max("id")).alias("next_cursor")))


def sorted_rows(rows: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Rows numbered by a column, nulls lowest, then by id."""
    c = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_first()
    return rows.orderBy(c, "id").limit(500).withColumn("position", F.row_number().over(Window.orderBy(c, "id")))


#: Least numbers of nodes of a graph that is fit for use, and types that a settled graph has not.
FLOORS = {"Person": 1, "Organization": 1, "Decision": 1001, "Meeting": 201, "Filing": 201, "Record": 501}
RETIRED = ("CaseParticipation", "Actor", "Institution", "EconomicInterestDisclosure")


def graph_checks(g: Graph, floors: dict[str, int] = FLOORS, retired: tuple[str, ...] = RETIRED) -> DataFrame:
    """``(check, measured, passed)``: enough nodes of each type, none of retired types, no edge without both ends."""
    spark = g.spark
    wanted = spark.createDataFrame([(t, n, -1) for t, n in floors.items()] + [(t, 0, 0) for t in retired], "node_type string, least long, most long")
    counts = g.nodes.groupBy("node_type").agg(F.count("*").alias("n"))
    types = wanted.join(counts, "node_type", "left").select(F.concat(F.lit("nodes of "), "node_type").alias("check"), F.coalesce("n", F.lit(0)).alias("measured"), "least", "most")
    types = types.select("check", "measured", ((F.col("measured") >= F.col("least")) & ((F.col("most") < 0) | (F.col("measured") <= F.col("most")))).alias("passed"))
    loose = resolve.dangling(g.edges.select("source_id", "target_id", "rel"), g.nodes).agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("measured"))
    return types.unionByName(loose.select(F.lit("edges without both ends").alias("check"), "measured", (F.col("measured") == 0).alias("passed")))


def _summaries(spark, d) -> DataFrame:
    nodes = bundleq._nodes(spark, d)
    names = F.array_join(F.array_sort(F.map_keys("properties")), ",")
    return projector.node_summaries(nodes).select("id", "node_type", "label", "year", F.array_join("bundles", ",").alias("bundles"), names.alias("properties"))


PAGES = ("Person", "Decision", "Project")
QUERIES = {f"page_{t.lower()}": _page(t) for t in PAGES} | {
    "effective_dates": lambda s, d: effective_dates(fixture_graph(s, d)),
    "citations": citations,
    "graph_checks": lambda s, d: graph_checks(fixture_graph(s, d)),
    "node_summaries": _summaries,
    "subject_rollup": _rollup,
    "first_meetings": lambda s, d: first_occurrences(fixture_graph(s, d).rel("DECIDED_AT", "AT_MEETING", source="decision", target="meeting"), ["decision"], ["meeting"]),
    "decision_ends": lambda s, d: ends(fixture_graph(s, d).of("Decision").where("event_date is not null").select("id", "event_date"), ["event_date", "id"]),
    "shared_targets": lambda s, d: shared_targets(fixture_graph(s, d)),
    "reachable": lambda s, d: reachable(fixture_graph(s, d), graphq.START, graphq.TARGET),
    "headline_stats": headline_stats,
    "check_coverage": coverage,
    "browse_cursor": lambda s, d: browse_cursor(fixture_graph(s, d), "Decision", "decision-2", 20),
    "sorted_flows": lambda s, d: sorted_rows(fixture_graph(s, d).of("MoneyFlow").select("id", "amount"), "amount"),
    "baseline_digest": lambda s, d: store.baseline_digest(fixture_graph(s, d).of("Place", "Seat", "Election").select("id", "label", "kind", "event_date")),
}

_EFFECTIVE = f"CASE WHEN node_type IN {P.DATED} THEN nullif(event_date, '') END"


def _page_sql(node_type: str) -> str:
    fill = entityq.ORACLE_SQL[f"fill_{node_type.lower()}"]
    # The rank in a type's quota is not among fill's columns: it is its order there.
    ranked = f"SELECT f.*, n.amount, n.event_date AS day, row_number() OVER (PARTITION BY f.node_type ORDER BY CASE WHEN f.node_type = 'MoneyFlow' THEN n.amount END DESC NULLS FIRST, CASE WHEN f.node_type IN ('Person', 'Organization') THEN CAST(f.rank_value AS BIGINT) END DESC, CASE WHEN f.node_type NOT IN ('AgendaItem', 'Candidacy', 'Person', 'Organization') THEN n.event_date END DESC NULLS FIRST, f.id) AS k FROM f JOIN nodes n ON n.id = f.id"
    return with_graph(
        f"{entityq._FOCUS.format(node_type)}, must AS ({entityq._must_show_sql(node_type)}), f AS ({fill}), r AS ({ranked}), "
        "t AS (SELECT *, row_number() OVER (ORDER BY type_priority, k) AS n FROM r), "
        "a AS (SELECT id, any_value(node_type) AS node_type, any_value(label) AS label, min(ring) AS ring, 0 AS type_priority, 0 AS k FROM must WHERE id <> (SELECT id FROM focus) GROUP BY id "
        f"UNION ALL SELECT id, node_type, label, ring, type_priority, k FROM t WHERE n <= {entity.PAGE_CAP} - (SELECT count(*) FROM must)) "
        f"SELECT CAST(row_number() OVER (ORDER BY a.type_priority, a.k, a.ring, a.id) AS INTEGER) AS position, a.id, a.node_type, a.label, a.ring, {_EFFECTIVE.replace('node_type', 'n.node_type').replace('event_date', 'n.event_date')} AS event_date FROM a JOIN nodes n ON n.id = a.id"
    )


_ROW = "concat_ws(chr(31), coalesce(event_date, '∅'), id, coalesce(kind, '∅'), coalesce(label, '∅'))"
ORACLE_SQL = {f"page_{t.lower()}": _page_sql(t) for t in PAGES} | {
    "effective_dates": with_graph(f"SELECT id, {_EFFECTIVE} AS day FROM nodes WHERE node_type <> 'MoneyFlow'"),
    "citations": "SELECT 'decision-' || o_orderkey AS id, true AS cited FROM orders UNION ALL SELECT 'actor-' || c_custkey, false FROM customer",
    "graph_checks": with_graph("w AS (SELECT * FROM (VALUES " + ", ".join([f"('{t}', {n}, -1)" for t, n in FLOORS.items()] + [f"('{t}', 0, 0)" for t in RETIRED]) + ") v(t, least, most)), c AS (SELECT t, least, most, (SELECT count(*) FROM nodes WHERE node_type = t) AS n FROM w), l AS (SELECT count(*) AS n FROM edges WHERE source_id NOT IN (SELECT id FROM nodes) OR target_id NOT IN (SELECT id FROM nodes)) SELECT 'nodes of ' || t AS \"check\", n AS measured, n >= least AND (most < 0 OR n <= most) AS passed FROM c UNION ALL SELECT 'edges without both ends', n, n = 0 FROM l"),
    "node_summaries": f"SELECT 'decision-' || o_orderkey AS id, 'Decision' AS node_type, CASE WHEN {bundleq._LATER} AND o_orderkey % 2 = 0 THEN 'Order no. ' ELSE 'Order ' END || o_orderkey AS label, NULL::INTEGER AS year, CASE WHEN {bundleq._LATER} THEN 'b1,b2' ELSE 'b1' END AS bundles, 'institution_id,meeting_id,' || CASE WHEN {bundleq._LATER} THEN 'name,' ELSE '' END || 'record_ids,status,title' AS properties FROM orders UNION ALL SELECT 'actor-' || c_custkey, 'Actor', 'Actor ' || c_custkey, NULL, 'b1', 'actor_type,name' FROM customer",
    "subject_rollup": with_graph(f"{views._CHECKS}, p AS (SELECT n.ref_id AS institution, sv.status, count(*) AS n, max(absolute_delta) AS most FROM sv JOIN nodes n ON n.id = subject GROUP BY 1, 2) SELECT institution, CAST(sum(n) AS BIGINT) AS checks, string_agg(status || ':' || n, ',' ORDER BY status) AS statuses, CAST(coalesce(max(most), 0) AS DECIMAL(18,2)) AS largest FROM p GROUP BY 1"),
    "first_meetings": with_graph("SELECT source_id AS decision, min(target_id) AS meeting FROM edges WHERE rel IN ('DECIDED_AT', 'AT_MEETING') GROUP BY 1"),
    "decision_ends": with_graph(f"r AS (SELECT id, event_date, row_number() OVER (ORDER BY event_date, id) AS a, row_number() OVER (ORDER BY event_date DESC, id DESC) AS z FROM nodes WHERE node_type = 'Decision' AND event_date IS NOT NULL) SELECT id, event_date, CAST(a AS INTEGER) AS position FROM r WHERE a <= {FIRST} UNION ALL SELECT id, event_date, CAST(-z AS INTEGER) FROM r WHERE z <= {LAST}"),
    "shared_targets": with_graph("p AS (SELECT id FROM nodes WHERE node_type = 'Case' ORDER BY id LIMIT 2), h AS (SELECT target_id AS target, count(DISTINCT source_id) AS n FROM edges JOIN p ON source_id = id WHERE rel IN ('RELATES_TO_PROGRAM', 'RELATES_TO_DECISION') GROUP BY 1) SELECT target, CASE WHEN target LIKE 'program-%' THEN 'shared' ELSE 'linked' END AS why FROM h WHERE target NOT LIKE 'program-%' OR n = (SELECT count(*) FROM p)"),
    "reachable": with_graph(f"b AS MATERIALIZED (SELECT source_id AS u, target_id AS v FROM edges UNION SELECT target_id, source_id FROM edges), d0 AS (SELECT '{graphq.START}' AS id), d1 AS (SELECT DISTINCT v AS id FROM b JOIN d0 ON u = id), d2 AS MATERIALIZED (SELECT DISTINCT v AS id FROM b JOIN d1 ON u = id), d3 AS MATERIALIZED (SELECT DISTINCT v AS id FROM b JOIN d2 ON u = id), d4 AS (SELECT DISTINCT v AS id FROM b JOIN d3 ON u = id) SELECT '{graphq.START}' AS start, '{graphq.TARGET}' AS target, min(hop) AS hops FROM (SELECT id, 0 AS hop FROM d0 UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2 UNION ALL SELECT id, 3 FROM d3 UNION ALL SELECT id, 4 FROM d4) WHERE id = '{graphq.TARGET}'"),
    "headline_stats": f"WITH s AS ({extraq.ORACLE_SQL['signature_subgraph']}), n AS ({with_graph('SELECT id, node_type, amount FROM nodes')}) SELECT n.node_type, count(*) AS n, CAST(coalesce(sum(CASE WHEN n.node_type = 'MoneyFlow' THEN amount END), 0) AS DECIMAL(18,2)) AS money FROM n WHERE id IN (SELECT id FROM s) GROUP BY 1",
    "check_coverage": with_graph(f"{views._CHECKS} SELECT count(*) AS checks, count(*) FILTER (status = 'reconciled') AS reconciled, count(*) FILTER (status = 'extraction_gap') AS extraction_gap, count(*) FILTER (status = 'source_inconsistency') AS source_inconsistency, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (confidence = 'high') AS high_confidence FROM sv"),
    "browse_cursor": with_graph("p AS (SELECT id, label, kind, event_date FROM nodes WHERE node_type = 'Decision' AND id > 'decision-2' ORDER BY id LIMIT 20) SELECT p.*, (SELECT CASE WHEN count(*) = 20 THEN max(id) END FROM p) AS next_cursor FROM p"),
    "sorted_flows": with_graph("SELECT id, amount, CAST(row_number() OVER (ORDER BY amount NULLS FIRST, id) AS INTEGER) AS position FROM nodes WHERE node_type = 'MoneyFlow' QUALIFY position <= 500"),
    "baseline_digest": with_graph(f"r AS (SELECT substr(md5({_ROW}), 1, 2) AS b, sha256({_ROW}) AS h FROM nodes WHERE node_type IN ('Place', 'Seat', 'Election')), p AS (SELECT b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM r GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(b || d, '' ORDER BY b)) AS sha256 FROM p"),
}
