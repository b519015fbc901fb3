"""The property graph of the test tables: one SELECT per node type and per relationship.

The SELECTs use the SQL that Spark and DuckDB share, so the oracle reads the same mapping.  Each branch has a
literal type, and Catalyst drops the branches of a union that a filter on the type rules out.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from polisgraph.graph import Graph
from polisgraph.session import new_path
from polisgraph.sources.store import EDGE_SCHEMA, NODE_SCHEMA

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

_FLOW = "'moneyflow-' || substr(md5({0}l_orderkey || '|' || {0}l_partkey || '|' || {0}l_suppkey || '|' || {0}l_linenumber || '|' || CAST(CAST({0}l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(40)) || '|' || CAST(CAST({0}l_shipdate AS DATE) AS VARCHAR(10))), 1, 16)"
_BRAND = "'program-' || lower(replace(p_brand, '#', '-'))"
_MONTH = "substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 7)"
_MEETING = f"'meeting-' || (o_custkey % 12) || '-' || {_MONTH}"
_DAY = "CAST(CAST({0} AS DATE) AS VARCHAR(10))"


def _node(id_: str, kind: str, label: str, table: str, where: str = "", sub: str = "NULL", status: str = "NULL", amount: str = "NULL", day: str = "NULL", ended: str = "NULL", ref: str = "NULL", url: str = "NULL") -> str:
    text = lambda x: f"CAST({x} AS VARCHAR(400))"
    return (
        f"SELECT {text(id_)} AS id, '{kind}' AS node_type, {text(label)} AS label, {text(sub)} AS kind, {text(status)} AS status, CAST({amount} AS DECIMAL(18,2)) AS amount, "
        f"{text(day)} AS event_date, {text(ended)} AS ended_date, {text(ref)} AS ref_id, {text(url)} AS url FROM {table}" + (f" WHERE {where}" if where else "")
    )


NODES = [
    _node("'place-region-' || r_regionkey", "Place", "r_name", "{region}", sub="'region'"),
    _node("'place-nation-' || n_nationkey", "Place", "n_name", "{nation}", sub="'nation'"),
    _node("'person-' || c_custkey", "Person", "c_name", "{customer}", sub="c_mktsegment", amount="c_acctbal"),
    _node("'org-' || s_suppkey", "Organization", "s_name", "{supplier}", sub="'institution'", amount="s_acctbal"),
    _node("'project-' || p_partkey", "Project", "p_name", "{part}", sub="p_brand", status="CASE WHEN p_size <= 25 THEN 'active' ELSE 'planned' END", amount="p_retailprice"),
    _node("'issue-' || r_regionkey", "Issue", "'Issue of ' || r_name", "{region}"),
    _node("id", "Program", "label", f"(SELECT DISTINCT {_BRAND} AS id, p_brand AS label FROM {{part}}) p", sub="'brand'"),
    _node("'decision-' || o_orderkey", "Decision", "'Order ' || o_orderkey", "{orders}", sub="o_orderpriority", status="o_orderstatus", amount="o_totalprice", day=f"CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {_DAY.format('o_orderdate')} END", ref="'org-' || (o_custkey % 12)"),
    _node(_FLOW.format(""), "MoneyFlow", "'Flow'", "{lineitem}", sub="CASE l_returnflag WHEN 'A' THEN 'contribution' WHEN 'N' THEN 'expenditure' ELSE 'behest' END", status="l_linestatus", amount=f"CASE WHEN substr({_FLOW.format('')}, 11, 2) = 'ff' THEN NULL ELSE l_extendedprice END", day=_DAY.format("l_shipdate")),
    _node("'filing-' || event_id", "Filing", "event_type", "{events}", sub="CASE event_id % 10 WHEN 3 THEN 'form_700' WHEN 7 THEN 'form_803' ELSE event_type END", amount="value", day=f"CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 97 = 0 THEN '' ELSE {_DAY.format('CAST(ts AS DATE) - CAST(365 * (event_id % 3) AS INTEGER)')} END", ref="'person-' || user_id"),
    _node("'record-doc-' || doc_id", "Record", "'Document ' || doc_id", "{documents}", sub="'document'", status="lang", day="CAST(DATE '2020-01-01' + CAST(doc_id % 365 AS INTEGER) AS VARCHAR(10))", url="CASE doc_id % 3 WHEN 0 THEN 'https://records.example.org/' || doc_id || '.pdf' WHEN 1 THEN '//records.example.org/' || doc_id ELSE NULL END"),
    _node("'record-page-' || page_id", "Record", "'Page ' || page_id", "{pages}", sub="'page'", day="CAST(DATE '2021-01-01' + CAST(page_id % 365 AS INTEGER) AS VARCHAR(10))", url="url"),
    _node("'case-' || o_orderkey", "Case", "'Case ' || o_orderkey", "{orders}", "o_orderstatus = 'P' AND o_orderkey % 7 = 0", sub="o_orderpriority", day=_DAY.format("o_orderdate")),
    _node("'proceeding-' || o_orderkey || '-' || k", "Proceeding", "'Hearing ' || k", "{orders}, (SELECT 1 AS k UNION ALL SELECT 2 AS k) n", "o_orderstatus = 'P' AND o_orderkey % 7 = 0 AND k <= 1 + o_orderkey % 2", sub="CASE k WHEN 1 THEN 'petition' ELSE 'appeal' END", day=f"CASE WHEN k = 2 AND o_orderkey % 3 = 0 THEN NULL ELSE {_DAY.format('o_orderdate')} END"),
    _node("'agreement-' || p_partkey", "Agreement", "'Agreement for ' || p_name", "{part}", "p_size <= 10", sub="p_type", amount="p_retailprice", day="CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(DATE '2015-01-01' + CAST(p_partkey % 900 AS INTEGER) AS VARCHAR(10)) END", ref="'project-' || p_partkey"),
    _node("'amendment-' || p_partkey || '-' || k", "Amendment", "'Amendment ' || k", "{part}, (SELECT 1 AS k UNION ALL SELECT 2 AS k) n", "p_size <= 10 AND k <= p_size % 3"),
    _node("'seat-' || n_nationkey", "Seat", "'Seat of ' || n_name", "{nation}", ref="'place-nation-' || n_nationkey"),
    _node("id", "Meeting", "'Meeting of ' || org || ' in ' || month", f"(SELECT DISTINCT {_MEETING} AS id, 'org-' || (o_custkey % 12) AS org, {_MONTH} AS month FROM {{orders}}) m", sub="'regular'", day="month || '-15'", ref="org"),
    _node("'service-' || c_custkey", "SeatService", "c_name", "{customer}", "c_custkey % 10 = 0", day="'2015-01-01'", ended="CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '2018-12-31' ELSE '2999-12-31' END", ref="'seat-' || c_nationkey"),
    _node("'election-' || y", "Election", "'Election ' || y", "(SELECT DISTINCT year(o_orderdate) AS y FROM {orders}) o", sub="CASE y % 3 WHEN 0 THEN 'general_municipal' ELSE 'primary' END", day="y || '-11-03'"),
    _node("'committee-' || s_suppkey", "Committee", "'Friends of ' || s_name", "{supplier}", "s_suppkey % 5 = 0", ref="'person-' || s_suppkey"),
]


def _edge(source: str, rel: str, target: str, table: str, where: str = "", detail: str = "NULL", distinct: bool = False) -> str:
    text = lambda x: f"CAST({x} AS VARCHAR(400))"
    return f"SELECT {'DISTINCT ' if distinct else ''}{text(source)} AS source_id, '{rel}' AS rel, {text(target)} AS target_id, {text(detail)} AS detail FROM {table}" + (f" WHERE {where}" if where else "")


_LINES = "{lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey"
EDGES = [
    _edge("'person-' || c_custkey", "IN_JURISDICTION", "'place-nation-' || c_nationkey", "{customer}"),
    _edge("'org-' || s_suppkey", "IN_JURISDICTION", "'place-nation-' || s_nationkey", "{supplier}"),
    _edge("'project-' || p_partkey", "IN_JURISDICTION", "'place-nation-' || (p_partkey % 25)", "{part}"),
    _edge("'place-nation-' || n_nationkey", "IN_JURISDICTION", "'place-region-' || n_regionkey", "{nation}"),
    _edge("'case-' || o_orderkey", "IN_JURISDICTION", "'place-nation-' || (o_custkey % 25)", "{orders}", "o_orderstatus = 'P' AND o_orderkey % 7 = 0"),
    _edge(_BRAND, "IN_JURISDICTION", "'place-nation-' || CAST(length(p_brand) + CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 20 AS INTEGER)", "{part}", distinct=True),
    _edge("'decision-' || o_orderkey", "DECIDED_AT", _MEETING, "{orders}", "o_orderkey % 5 <> 0"),
    _edge(_FLOW.format(""), "DISCLOSED_IN_FILING", "'filing-' || (l_orderkey % 50)", "{lineitem}", "l_returnflag = 'A' AND l_linenumber = 1"),
    _edge("'person-' || o_custkey", "CAST_VOTE", "'decision-' || o_orderkey", "{orders}", detail="o_orderstatus"),
    _edge("'decision-' || o_orderkey", "DECIDED_BY", "'org-' || (o_custkey % 10)", "{orders}"),
    _edge(_FLOW.format(""), "FROM_SOURCE", "'org-' || l_suppkey", "{lineitem}"),
    _edge(_FLOW.format("l."), "TO_TARGET", "'person-' || o.o_custkey", _LINES),
    _edge(_FLOW.format(""), "RELATES_TO_DECISION", "'decision-' || l_orderkey", "{lineitem}"),
    _edge(_FLOW.format(""), "RELATES_TO_PROJECT", "'project-' || l_partkey", "{lineitem}"),
    _edge("'decision-' || l_orderkey", "RELATES_TO_PROJECT", "'project-' || l_partkey", "{lineitem}", distinct=True),
    _edge("'project-' || p_partkey", "RELATES_TO_PROGRAM", _BRAND, "{part}"),
    _edge(_BRAND, "RELATES_TO_DECISION", "'decision-' || l_orderkey", "{lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey", "l_orderkey % 11 = 0 AND l_linenumber = 1", distinct=True),
    _edge("'decision-' || l_orderkey", "RELATES_TO_PROGRAM", _BRAND, "{lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey", "l_orderkey % 9 = 0 AND l_linenumber = 1", distinct=True),
    _edge("'election-' || y", "IN_JURISDICTION", "'place-nation-' || (y % 25)", "(SELECT DISTINCT year(o_orderdate) AS y FROM {orders}) o"),
    _edge("'decision-' || o_orderkey", "RELATES_TO_ISSUE", "'issue-' || (o_custkey % 5)", "{orders}", "o_orderkey % 13 = 0"),
    _edge("'filing-' || event_id", "FILED_BY", "'person-' || user_id", "{events}"),
    _edge("'decision-' || o_orderkey", "EVIDENCED_BY", "'record-doc-' || (o_orderkey % 200)", "{orders}"),
    _edge("'project-' || p_partkey", "EVIDENCED_BY", "'record-doc-' || (p_partkey % 150)", "{part}"),
    _edge("'case-' || o_orderkey", "EVIDENCED_BY", "'record-doc-' || ((o_orderkey + 7) % 180)", "{orders}", "o_orderstatus = 'P' AND o_orderkey % 7 = 0"),
    _edge("'person-' || o_custkey", "PARTY_TO", "'case-' || o_orderkey", "{orders}", "o_orderstatus = 'P' AND o_orderkey % 7 = 0", detail="'petitioner'"),
    _edge("'case-' || o_orderkey", "RELATES_TO_DECISION", "'decision-' || o_orderkey", "{orders}", "o_orderstatus = 'P' AND o_orderkey % 7 = 0"),
    _edge("'case-' || l.l_orderkey", "RELATES_TO_PROGRAM", _BRAND, "{lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {orders} o ON o.o_orderkey = l.l_orderkey", "o.o_orderstatus = 'P' AND l.l_orderkey % 7 = 0 AND l.l_linenumber = 1", distinct=True),
    _edge("'proceeding-' || o_orderkey || '-' || k", "PART_OF_CASE", "'case-' || o_orderkey", "{orders}, (SELECT 1 AS k UNION ALL SELECT 2 AS k) n", "o_orderstatus = 'P' AND o_orderkey % 7 = 0 AND k <= 1 + o_orderkey % 2"),
    _edge("'agreement-' || p_partkey", "RELATES_TO_PROJECT", "'project-' || p_partkey", "{part}", "p_size <= 10"),
    _edge("'agreement-' || p_partkey", "COUNTERPARTY_ACTOR", "'org-' || (p_partkey % 10)", "{part}", "p_size <= 10"),
    _edge("'amendment-' || p_partkey || '-' || k", "AMENDS_AGREEMENT", "'agreement-' || p_partkey", "{part}, (SELECT 1 AS k UNION ALL SELECT 2 AS k) n", "p_size <= 10 AND k <= p_size % 3"),
    _edge("'service-' || c_custkey", "HELD_BY", "'person-' || c_custkey", "{customer}", "c_custkey % 10 = 0"),
    _edge("'service-' || c_custkey", "FOR_SEAT", "'seat-' || c_nationkey", "{customer}", "c_custkey % 10 = 0"),
    _edge("'seat-' || n_nationkey", "AT_INSTITUTION", "'org-' || (n_nationkey % 10)", "{nation}"),
    _edge("'filing-' || event_id", "FILED_DURING_SEAT_SERVICE", "'service-' || user_id", "{events}", "user_id % 10 = 0"),
    _edge("'committee-' || s_suppkey", "FOR_ELECTION", "'election-' || (1995 + s_suppkey % 7)", "{supplier}", "s_suppkey % 5 = 0"),
    _edge(_FLOW.format(""), "RELATED_TO_ELECTION", "'election-' || year(l_shipdate)", "{lineitem}", "l_returnflag = 'A' AND year(l_shipdate) <= 2001"),
]


class StoredGraph(Graph):
    """The graph of ``sf_dir`` in the shared folder: a type or a relationship is stored when it is first asked for.

    Each has a folder of its own that is written by itself, so rows are not sorted by type.  Ids made of digests
    take half the space with zstd.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._sf_dir, self._path, self._held = spark, sf_dir, new_path(spark, "property-graph"), set()

    @property
    def spark(self) -> SparkSession:
        return self._spark

    @property
    def nodes(self) -> DataFrame:
        return self.nodes_of(*_types(NODES, "node_type"))

    @property
    def edges(self) -> DataFrame:
        return self.edges_of(*_types(EDGES, "rel"))

    def nodes_of(self, *types: str) -> DataFrame:
        return self._read("nodes", "node_type", NODES, NODE_SCHEMA, types)

    def edges_of(self, *rels: str) -> DataFrame:
        return self._read("edges", "rel", EDGES, EDGE_SCHEMA, rels)

    def _read(self, table: str, by: str, branches: list[str], schema: str, wanted: tuple[str, ...]) -> DataFrame:
        known = _types(branches, by)
        base, names = f"{self._path}/{table}", [n for n in dict.fromkeys(wanted) if n in known]
        for name in names:
            if (table, name) not in self._held:
                rows = projected(self._spark, self._sf_dir, known[name])
                rows.select([c.split()[0] for c in schema.split(", ") if c.split()[0] != by]).write.option("compression", "zstd").parquet(f"{base}/{by}={name}")
                self._held.add((table, name))
        reader = self._spark.read.schema(schema)
        return reader.option("basePath", base).parquet(*[f"{base}/{by}={n}" for n in names]) if names else self._spark.createDataFrame([], schema)


def _types(branches: list[str], by: str) -> dict[str, list[str]]:
    """The SELECTs of each type."""
    out: dict[str, list[str]] = {}
    for b in branches:
        out.setdefault(re.search(rf"'(\w+)' AS {by}\b", b)[1], []).append(b)
    return out


_GRAPHS: dict[tuple[str, str], StoredGraph] = {}


def fixture_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of ``sf_dir``; what is stored of it serves all queries of an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS or _GRAPHS[key].spark is not spark:
        _GRAPHS[key] = StoredGraph(spark, sf_dir)
    return _GRAPHS[key]


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table of ``sf_dir`` that several queries use, written to the shared folder once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = new_path(spark, name)
        make().write.option("compression", "zstd").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def projected(spark: SparkSession, sf_dir: str, branches: list[str]) -> DataFrame:
    held = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if any(f"{{{t}}}" in b for b in branches)}
    return reduce(DataFrame.unionByName, [spark.sql(b, **{t: df for t, df in held.items() if f"{{{t}}}" in b}) for b in branches])


def project(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(projected(spark, sf_dir, NODES), projected(spark, sf_dir, EDGES))


#: The same graph as CTEs for the oracle, and the undirected traversal edges with their weights.
GRAPH_SQL = (
    "nodes AS MATERIALIZED (" + " UNION ALL ".join(b.replace("{", "").replace("}", "") for b in NODES) + "), edges AS MATERIALIZED (" + " UNION ALL ".join(b.replace("{", "").replace("}", "") for b in EDGES) + ")"
)


def with_graph(sql: str, recursive: bool = False) -> str:
    """``sql`` begins with further CTEs, or with SELECT."""
    sql = sql.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{GRAPH_SQL}" + (" " if sql.upper().startswith("SELECT") else ", ") + sql
