"""Registered traversal queries on the test graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from polisgraph.functions import vocabulary as V
from polisgraph.operators import traverse
from polisgraph.sources.fixtures import fixture_graph, with_graph

START, TARGET = "person-7", "program-brand-3"
_RELS = ", ".join(f"'{r}'" for r in V.TRAVERSED)
_NOT_WALKED = ("CAST_VOTE", "FROM_SOURCE")
_WALKED = ", ".join(f"'{r}'" for r in (*V.TRAVERSED, *V.UNIVERSAL_RELS) if r not in _NOT_WALKED)
_BOTH = f"und AS MATERIALIZED (SELECT source_id AS u, rel, target_id AS v FROM edges WHERE rel IN ({_RELS}) UNION ALL SELECT target_id, rel, source_id FROM edges WHERE rel IN ({_RELS}))"
_BLOCK = " AND ".join(f"v NOT LIKE '{V.PREFIX[t]}-%'" for t in V.UNIVERSAL_TYPES)


def _rounds(hops: int, block: str = _BLOCK) -> str:
    """Sets of nodes at each distance, one CTE a round."""
    out = [f"d0 AS (SELECT '{START}' AS id, 0 AS hop)"]
    for k in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM d{j}" for j in range(k))
        out.append(f"d{k} AS MATERIALIZED (SELECT DISTINCT v AS id, {k} AS hop FROM und JOIN d{k - 1} ON u = id WHERE {block} AND v NOT IN ({seen}))")
    return ", ".join(out)


def _expand_sql(hop: int, both: str = _BOTH, block: str = _BLOCK) -> str:
    quota = "CASE " + " ".join(f"WHEN n.node_type IN ({', '.join(repr(t) for t in types)}) THEN {n * V.EXPAND_STEP[hop]}" for types, n in V.EXPAND_QUOTA) + f" ELSE {2 * V.EXPAND_STEP[hop]} END"
    near = " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(1, hop + 1))
    return with_graph(
        f"{both}, {_rounds(hop, block)}, near AS ({near}), ranked AS (SELECT n.id, n.node_type, n.label, hop, coalesce(n.event_date, '') AS r, {quota} AS q, "
        f"row_number() OVER (PARTITION BY n.node_type ORDER BY hop, coalesce(n.event_date, '') DESC, n.id) AS k FROM nodes n JOIN near ON near.id = n.id) "
        f"SELECT id, node_type, label, hop FROM ranked WHERE k <= q ORDER BY hop, r DESC, id DESC LIMIT {V.EXPAND_CAP[hop]}"
    )


def _path_sql(hops: int, loose: bool = False) -> str:
    weights = V.PATH_WEIGHT | (dict.fromkeys(V.UNIVERSAL_RELS, V.LOOSE_PENALTY) if loose else {})
    weight = "CASE rel " + " ".join(f"WHEN '{r}' THEN {w}" for r, w in weights.items()) + " END"
    hub = " OR ".join(f"id LIKE '{V.PREFIX[t]}-%'" for t in V.PATH_EXCLUDED)
    passed = "" if loose else f" AND (id = '{START}' OR NOT ({hub}))"
    penalty = f" + CASE WHEN id <> '{START}' AND ({hub}) THEN {V.LOOSE_PENALTY} ELSE 0 END" if loose else ""
    steps = [f"s0 AS (SELECT '{START}' AS id, 0 AS weight, 0 AS hops, '{START}' AS path)"]
    for k in range(1, hops + 1):  # all walks of k hops, the best of each end kept by a window
        steps.append(
            f"s{k} AS MATERIALIZED (SELECT id, weight, hops, path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight, hops, path) AS k FROM "
            f"(SELECT v AS id, weight + w{penalty} AS weight, hops + 1 AS hops, path || ' > ' || v AS path FROM s{k - 1} JOIN we ON u = id WHERE id <> '{TARGET}'{passed})) WHERE k = 1)"
        )
    union = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(hops + 1))
    both = "und AS (SELECT source_id AS u, rel, target_id AS v FROM edges UNION ALL SELECT target_id, rel, source_id FROM edges)"
    return with_graph(f"{both}, we AS MATERIALIZED (SELECT u, v, min({weight}) AS w FROM und WHERE {weight} IS NOT NULL GROUP BY u, v), {', '.join(steps)} SELECT path, hops, weight FROM ({union}) WHERE id = '{TARGET}' ORDER BY weight, hops, path LIMIT 1")


PERSON_PATTERN = [(1, ["CAST_VOTE"]), (1, ["HELD_BY"]), (2, ["HELD_BY", "FOR_SEAT"]), (3, ["HELD_BY", "FOR_SEAT", "AT_INSTITUTION"]), (1, ["PARTY_TO"])]


def _style_rows(g):
    style = F.lit("governance")
    for name, rels in V.EDGE_STYLE.items():
        style = F.when(F.col("rel").isin(*rels), name).otherwise(style)
    return g.edges.groupBy(style.alias("style")).agg(F.count("*").alias("edges"))


def _total(spark, d):
    g = fixture_graph(spark, d)
    starts = g.of("SeatService").select("id")
    return traverse.neighbourhood_total(g, starts)


def _among(spark, d):
    g = fixture_graph(spark, d)
    ids = g.of("Case", "Proceeding", "Program", "Person").select("id")
    return traverse.edges_among(g, ids)


def _components(spark, d):
    g = fixture_graph(spark, d)
    return traverse.components(g.rel("PARTY_TO", "PART_OF_CASE", source="a", target="b"))


def _merged_edges(spark, d):
    """Undirected edges, once each whatever their direction and number."""
    key = F.array_sort(F.array("source_id", "target_id"))
    return fixture_graph(spark, d).edges_of("CAST_VOTE", "PARTY_TO", "DECIDED_BY").groupBy(key[0].alias("a"), key[1].alias("b"), "rel").agg(F.count("*").alias("n"))


QUERIES = {
    "expand_h1": lambda s, d: traverse.expand(fixture_graph(s, d), START, 1),
    "expand_h2": lambda s, d: traverse.expand(fixture_graph(s, d), START, 2),
    "expand_h3": lambda s, d: traverse.expand(fixture_graph(s, d), START, 3),
    "expand_h4": lambda s, d: traverse.expand(fixture_graph(s, d), START, 4),
    "expand_universal": lambda s, d: traverse.expand(fixture_graph(s, d), TARGET, 2, excluded_rels=_NOT_WALKED, universal=True),
    "expand_issues": lambda s, d: traverse.expand(fixture_graph(s, d), "issue-2", 2, excluded=("Record", "Place"), universal=True),
    "weighted_path": lambda s, d: traverse.weighted_path(fixture_graph(s, d), START, TARGET, 3),
    "weighted_path_issue": lambda s, d: traverse.weighted_path(fixture_graph(s, d), START, "issue-2", 4, loose=True),
    "weighted_path_h4": lambda s, d: traverse.weighted_path(fixture_graph(s, d), START, TARGET, 4),
    "weighted_path_loose": lambda s, d: traverse.weighted_path(fixture_graph(s, d), START, TARGET, 4, loose=True),
    "must_show": lambda s, d: traverse.must_show(fixture_graph(s, d), "person-20", PERSON_PATTERN),
    "neighbourhood_total": _total,
    "edges_among": _among,
    "components": _components,
    "edge_styles": lambda s, d: _style_rows(fixture_graph(s, d)),
    "merged_edges": _merged_edges,
}

_CHAINS = []
for _ring, _rels in PERSON_PATTERN:
    _from = "(SELECT 'person-20' AS x0)"
    for _k, _rel in enumerate(_rels):
        _from = f"(SELECT DISTINCT c.*, b.v AS x{_k + 1} FROM {_from} c JOIN b ON b.u = c.x{_k} AND b.rel = '{_rel}')"
    _CHAINS.append(f"SELECT x{len(_rels)} AS id, {_ring} AS ring FROM {_from} z{len(_CHAINS)}")

ORACLE_SQL = {
    "expand_h1": _expand_sql(1),
    "expand_h2": _expand_sql(2),
    "expand_h3": _expand_sql(3),
    "expand_h4": _expand_sql(4),
    "expand_universal": _expand_sql(2, _BOTH.replace(_RELS, _WALKED), "true").replace(START, TARGET),
    "expand_issues": _expand_sql(2, _BOTH.replace(_RELS, f"{_RELS}, {', '.join(map(repr, V.UNIVERSAL_RELS))}"), "v NOT LIKE 'record-%' AND v NOT LIKE 'place-%'").replace(START, "issue-2"),
    "weighted_path": _path_sql(3),
    "weighted_path_issue": _path_sql(4, loose=True).replace(TARGET, "issue-2"),
    "weighted_path_h4": _path_sql(4),
    "weighted_path_loose": _path_sql(4, loose=True),
    "must_show": with_graph("b AS (SELECT source_id AS u, rel, target_id AS v FROM edges UNION ALL SELECT target_id, rel, source_id FROM edges) SELECT id, CAST(min(ring) AS INTEGER) AS ring FROM (" + " UNION ALL ".join(_CHAINS) + ") WHERE id <> 'person-20' GROUP BY id"),
    "neighbourhood_total": with_graph(f"{_BOTH}, one AS (SELECT DISTINCT n.id AS s, v FROM nodes n JOIN und ON u = n.id WHERE n.node_type = 'SeatService'), two AS (SELECT s, v FROM one UNION SELECT s, b.v FROM one JOIN und b ON b.u = one.v) SELECT s AS start, count(*) AS total FROM two WHERE v <> s GROUP BY s"),
    "edges_among": with_graph(f"{_BOTH}, ids AS (SELECT id FROM nodes WHERE node_type IN ('Case', 'Proceeding', 'Program', 'Person')) SELECT DISTINCT u, rel, v FROM und WHERE u < v AND u IN (SELECT id FROM ids) AND v IN (SELECT id FROM ids)"),
    "components": with_graph("l AS MATERIALIZED (SELECT source_id AS u, target_id AS v FROM edges WHERE rel IN ('PARTY_TO', 'PART_OF_CASE')), b AS MATERIALIZED (SELECT u, v FROM l UNION SELECT v, u FROM l), r AS (SELECT u AS node, u AS seen FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node", recursive=True),
    "edge_styles": with_graph("SELECT CASE " + " ".join(f"WHEN rel IN ({', '.join(repr(r) for r in rels)}) THEN '{k}'" for k, rels in V.EDGE_STYLE.items() if rels) + " ELSE 'governance' END AS style, count(*) AS edges FROM edges GROUP BY 1"),
    "merged_edges": with_graph("SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, rel, count(*) AS n FROM edges WHERE rel IN ('CAST_VOTE', 'PARTY_TO', 'DECIDED_BY') GROUP BY ALL"),
}
