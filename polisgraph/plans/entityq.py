"""Registered queries for entity pages: each takes the first node of a type as its focus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgraph.functions import vocabulary as V
from polisgraph.graph import Graph
from polisgraph.operators import entity
from polisgraph.sources.fixtures import fixture_graph, with_graph

PLAIN_TYPES = ("Record", "Place", "Election", "Agreement")


def first_of(g: Graph, node_type: str) -> str | None:
    return g.of(node_type).agg(F.min("id").alias("id")).first()["id"]  # one value


def _page(node_type: str):
    def page(spark, d) -> DataFrame:
        g = fixture_graph(spark, d)
        return entity.must_show(g, first_of(g, node_type), node_type)

    return page


def _fill(node_type: str):
    def fill(spark, d) -> DataFrame:
        g = fixture_graph(spark, d)
        focus = first_of(g, node_type)
        return entity.fill(g, focus, entity.must_show(g, focus, node_type))

    return fill


def _plain(node_type: str):
    def plain(spark, d) -> DataFrame:
        g = fixture_graph(spark, d)
        return entity.plain_view(g, first_of(g, node_type), node_type)

    return plain


FILLED = ("Person", "Decision", "Project")
QUERIES = (
    {f"must_show_{t.lower()}": _page(t) for t in entity.MUST_SHOW}
    | {f"fill_{t.lower()}": _fill(t) for t in FILLED}
    | {f"plain_{t.lower()}": _plain(t) for t in PLAIN_TYPES}
)

_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_FOCUS = "focus AS (SELECT min(id) AS id FROM nodes WHERE node_type = '{0}')"


def _must_show_sql(node_type: str) -> str:
    parts = []
    for ring, name, steps in entity.MUST_SHOW[node_type]:
        if any(not rels for _, rels, _ in steps):
            continue
        tables, last = "focus n0", "n0"
        for k, (way, rels, types) in enumerate(steps, 1):
            ends = {">": [("source_id", "target_id")], "<": [("target_id", "source_id")], "-": [("source_id", "target_id"), ("target_id", "source_id")]}[way]
            hop = " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b FROM edges WHERE rel IN {_IN(rels)}" for a, b in ends)
            tables += f" JOIN ({hop}) e{k} ON e{k}.a = {last}.id JOIN nodes n{k} ON n{k}.id = e{k}.b AND n{k}.node_type IN {_IN(types)}"
            last = f"n{k}"
        parts.append(f"SELECT {last}.id, {last}.node_type, coalesce({last}.label, {last}.id) AS label, {ring} AS ring, '{name}' AS relationship FROM {tables}")
    return " UNION ".join(parts)


def _fill_sql(node_type: str) -> str:
    shown = f"shown AS (SELECT DISTINCT id FROM ({_must_show_sql(node_type)}))"
    und = f"und AS MATERIALIZED (SELECT source_id AS u, target_id AS v FROM edges WHERE rel IN {_IN(V.TRAVERSED)} UNION ALL SELECT target_id, source_id FROM edges WHERE rel IN {_IN(V.TRAVERSED)})"
    near = "one AS (SELECT DISTINCT v FROM und JOIN focus f ON u = f.id), two AS (SELECT DISTINCT und.v FROM und JOIN one ON und.u = one.v), ring AS (SELECT v AS id, min(r) AS ring FROM (SELECT v, 1 AS r FROM one UNION ALL SELECT v, 2 FROM two) GROUP BY 1)"
    links = "lk AS (SELECT a AS id, count(*) AS links FROM (SELECT source_id AS a, target_id AS b FROM edges UNION ALL SELECT target_id, source_id FROM edges) WHERE b IN (SELECT id FROM shown) GROUP BY 1)"
    rows = "cand AS (SELECT n.*, ring.ring, coalesce(links, 0) AS links FROM nodes n JOIN ring ON ring.id = n.id LEFT JOIN lk ON lk.id = n.id WHERE n.id NOT IN (SELECT id FROM shown) AND n.id <> (SELECT id FROM focus))"
    parts = []
    for k, (t, most, by) in enumerate(entity.FILL, 1):
        order = {"amount": "amount DESC NULLS FIRST, event_date DESC NULLS FIRST, id", "event_date": "event_date DESC NULLS FIRST, id", "links": "links DESC, id", "kind": "kind NULLS LAST, id", "id": "id"}[by]
        parts.append(f"(SELECT id, node_type, coalesce(label, id) AS label, ring, CAST({by} AS VARCHAR) AS rank_value, {k} AS type_priority FROM cand WHERE node_type = '{t}' ORDER BY {order} LIMIT {most})")
    return with_graph(f"{_FOCUS.format(node_type)}, {shown}, {und}, {near}, {links}, {rows} SELECT * FROM (" + " UNION ALL ".join(parts) + ")")


def _plain_sql(node_type: str) -> str:
    if node_type == "Record":
        edges = "rel = 'EVIDENCED_BY' AND target_id = f.id"
    else:
        edges = f"rel IN {_IN([*V.TRAVERSED, *([entity.PLAIN_EXTRA[node_type]] if node_type in entity.PLAIN_EXTRA else [])])} AND (source_id = f.id OR target_id = f.id)"
    hidden = {"Record": "", "Place": "AND n.node_type <> 'Issue'", "Issue": "AND n.node_type <> 'Place'"}.get(node_type, "AND n.node_type NOT IN ('Place', 'Issue')")
    return with_graph(f"{_FOCUS.format(node_type)} SELECT DISTINCT n.id, n.node_type, coalesce(n.label, n.id) AS label, rel AS relationship, source_id AS start_id, target_id AS end_id FROM focus f JOIN edges ON {edges} JOIN nodes n ON n.id = CASE WHEN source_id = f.id THEN target_id ELSE source_id END WHERE source_id <> target_id {hidden} ORDER BY n.node_type, n.id, relationship, start_id LIMIT {entity.PLAIN_CAP}")


ORACLE_SQL = (
    {f"must_show_{t.lower()}": with_graph(f"{_FOCUS.format(t)} {_must_show_sql(t)}") for t in entity.MUST_SHOW}
    | {f"fill_{t.lower()}": _fill_sql(t) for t in FILLED}
    | {f"plain_{t.lower()}": _plain_sql(t) for t in PLAIN_TYPES}
)
