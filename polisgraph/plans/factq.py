"""Fact rows and figures of decisions, projects and filings that are made of orders, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgraph.functions import facts


def _nodes(spark, d) -> DataFrame:
    table = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    text = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.lit(500))

    def made(df, kind, key, **props):
        quoted = {n: F.expr("left({0}, length({0}) - 1)".format(f"`{n}`")) for n in props}
        rows = df.select(F.concat_ws("-", F.lit(kind.lower()), key).alias("id"), *[text(c).alias(n) for n, c in props.items()])
        return rows.select("id", F.lit(kind).alias("node_type"), F.create_map(*[x for n, q in quoted.items() for x in (F.lit(n), q)]).alias("properties"))

    day = lambda c: F.substring(F.col(c).cast("string"), 1, 10)
    k, e = F.col("o_orderkey"), F.col("event_id")
    orders = made(table("orders"), "Decision", k, decided_at=day("o_orderdate"), status=F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus")), item_number=k % 50, vote_summary=F.when(k % 2 == 0, "4-1"))
    parts = made(table("part"), "Project", F.col("p_partkey"), name=F.col("p_name"), total_money=F.col("p_size") * 1000 + 0.5, evidence_count=F.col("p_size"))
    events = made(table("events"), "Filing", e, filing_type=F.col("event_type"), period_start=F.when(e % 3 != 0, day("ts")), period_end=F.when(e % 3 != 1, F.lit("2031-12-31")), filer_name=F.concat(F.lit("User "), F.col("user_id").cast("string")), filed_by_name=F.when(e % 5 == 0, "Clerk").otherwise(""))
    return orders.unionByName(parts).unionByName(events)


def entity_facts(spark, d) -> DataFrame:
    return facts.facts(_nodes(spark, d))


def entity_figures(spark, d) -> DataFrame:
    return facts.figures(_nodes(spark, d))


_SOURCE = """
o AS (SELECT 'decision-' || o_orderkey AS id, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS decided, CASE WHEN o_orderkey % 3 <> 0 THEN nullif(o_orderstatus, '') END AS status, CAST(o_orderkey % 50 AS VARCHAR) AS item, CASE WHEN o_orderkey % 2 = 0 THEN '4-1' END AS vote FROM orders),
p AS (SELECT 'project-' || p_partkey AS id, p_name AS name, p_size FROM part),
e AS (SELECT 'filing-' || event_id AS id, event_type AS t, CASE WHEN event_id % 3 <> 0 THEN substr(CAST(ts AS VARCHAR), 1, 10) END AS a, CASE WHEN event_id % 3 <> 1 THEN '2031-12-31' END AS b, CASE WHEN event_id % 5 = 0 THEN 'Clerk' ELSE 'User ' || user_id END AS filer FROM events)"""
_PERIOD = "coalesce(a || ' – ' || b, a, b)"


def _sql(parts: dict[str, list[tuple[str, str]]]) -> str:
    rows = [f"SELECT id, {k} AS position, '{key}' AS key, {value} AS value FROM {t}" for t, own in parts.items() for k, (key, value) in enumerate(own, 1)]
    return f"WITH {_SOURCE} " + " UNION ALL ".join(rows)


QUERIES = {"entity_facts": entity_facts, "entity_figures": entity_figures}
ORACLE_SQL = {
    "entity_facts": _sql({
        "o": [("Decided", "decided"), ("Institution", "NULL"), ("Vote", "vote"), ("Status", "status"), ("ID", "id")],
        "p": [("Name", "name"), ("Status", "NULL"), ("Address", "NULL"), ("Jurisdiction", "NULL"), ("ID", "id")],
        "e": [("Type", "t"), ("Signed", "NULL"), ("Period", _PERIOD), ("Filer", "filer"), ("ID", "id")],
    }),
    "entity_figures": _sql({
        "o": [("decided", "decided"), ("vote", "coalesce(vote, '—')"), ("agenda item", "item")],
        "p": [("money", "'$' || format('{:,}', p_size * 1000 + 1)"), ("decisions", "'—'"), ("counterparties", "'—'"), ("evidence", "CAST(p_size AS VARCHAR)")],
        "e": [("type", "t"), ("signed", "'—'"), ("period", f"coalesce({_PERIOD}, '—')"), ("actor", "filer")],
    }),
}
