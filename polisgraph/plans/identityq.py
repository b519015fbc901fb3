"""Dual roles over the test tables: suppliers are organisations, customers' orders awards, events filings, lines campaign flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgraph.operators import identity

_ORG = "'org-' || CAST({} AS VARCHAR(20))"


def _inputs(spark, d) -> tuple:
    table = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    org = lambda c: F.concat(F.lit("org-"), F.expr(c).cast("string"))
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    orgs = table("supplier").select(org("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    events = table("events").where("event_id % 10 = 3").select(named("filing-", "event_id").alias("id"), F.lit(2020).alias("tax_year"), (F.col("value").cast("decimal(18,2)") - 40).alias("gov_grants_amount"), org("user_id").alias("org"))
    orders = table("orders").where("o_orderkey % 3 = 0").select(named("award-", "o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.lit("obligations").alias("scope"), F.lit("").alias("flow_date"), F.lit("").alias("flow_type"), org("o_custkey").alias("org"))
    lines = table("lineitem").where("l_returnflag = 'R' and l_suppkey % 3 = 0")
    campaign = lines.select(F.concat_ws("-", F.lit("flow"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_shipdate").cast("date"), "l_linestatus").alias("id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), F.lit("exports").alias("scope"), F.col("l_shipdate").cast("date").cast("string").alias("flow_date"), F.col("l_linestatus").alias("flow_type"), org("l_suppkey").alias("org")).distinct()  # equal lines are one flow
    edge = lambda df, rel, s, t: df.select(F.col(s).alias("source_id"), F.lit(rel).alias("rel"), F.col(t).alias("target_id"))
    edges = edge(events, "FILED_BY_ORG", "id", "org").unionByName(edge(orders, "TO_TARGET", "id", "org"))
    parts = identity.legs(events.drop("org"), orders.drop("org"), campaign.drop("org"), orgs, edges, edge(campaign, "FROM_SOURCE", "org", "id"))
    number = table("supplier").select("s_suppkey")
    near = lambda step, every: number.where(f"s_suppkey % {every} = 0").select(org("s_suppkey").alias("a"), org(f"s_suppkey + {step}").alias("b")).join(orgs.select(F.col("id").alias("b")), "b", "left_semi")
    joined = identity.links(near(7, 20).withColumn("basis", F.lit("ein_exact")), near(1, 15).withColumn("status", F.lit("approved")), orgs)
    return parts, joined, near(2, 6).withColumn("status", F.lit("queued")), orgs


def dual_role_table(spark, d) -> DataFrame:
    found = identity.dual_roles(*_inputs(spark, d))
    count = lambda df, name: df.groupBy("subject").agg(F.count("*").alias(name))
    rows = found.table.join(count(found.joined.distinct(), "links"), "subject", "left").join(count(found.dependencies.distinct(), "waits"), "subject", "left")
    return rows.select("subject", "status", "rank", "label", "flow_count", "amount_total", "first_flow_date", "last_flow_date", "flow_types", "grant_count", F.col("grant_total").cast("decimal(38,2)").alias("grant_total"), "award_count", "award_total", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("waits", F.lit(0)).alias("waits"))


_SQL = f"""
WITH RECURSIVE org AS (SELECT {_ORG.format("s_suppkey")} AS id, s_suppkey AS k, s_name AS label FROM supplier),
grants AS (SELECT {_ORG.format("user_id")} AS org, CAST(value AS DECIMAL(18,2)) - 40 AS amount FROM events WHERE event_id % 10 = 3 AND CAST(value AS DECIMAL(18,2)) - 40 > 0),
awards AS (SELECT {_ORG.format("o_custkey")} AS org, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders WHERE o_orderkey % 3 = 0 AND {_ORG.format("o_custkey")} IN (SELECT id FROM org)),
flows AS (SELECT org, amount, day, kind FROM (SELECT DISTINCT {_ORG.format("l_suppkey")} AS org, l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, l_linestatus AS kind FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 3 = 0 AND {_ORG.format("l_suppkey")} IN (SELECT id FROM org))),
linked AS (SELECT a.id AS a, b.id AS b, 'same_as:ein_exact' AS basis FROM org a JOIN org b ON b.k = a.k + 7 WHERE a.k % 20 = 0 UNION ALL SELECT a.id, b.id, 'approved_resolution' FROM org a JOIN org b ON b.k = a.k + 1 WHERE a.k % 15 = 0),
queued AS (SELECT a.id AS a, b.id AS b FROM org a JOIN org b ON b.k = a.k + 2 WHERE a.k % 6 = 0),
party AS (SELECT org, bool_or(f) AS f, bool_or(g) AS g FROM (SELECT org, true AS f, false AS g FROM grants UNION ALL SELECT org, true, false FROM awards UNION ALL SELECT org, false, true FROM flows UNION ALL SELECT unnest([a, b]), false, false FROM linked) GROUP BY org),
both_ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach AS (SELECT org, org AS m FROM party UNION SELECT r.org, l.b FROM reach r JOIN both_ways l ON r.m = l.a),
member AS (SELECT r.org, min(r.m) AS c, any_value(p.f) AS f, any_value(p.g) AS g FROM reach r JOIN party p ON r.org = p.org GROUP BY r.org),
inside AS (SELECT m.org, m.f, m.g, s.subject FROM member m JOIN (SELECT c, min(org) FILTER (g) AS subject FROM member GROUP BY c HAVING bool_or(f) AND bool_or(g)) s ON m.c = s.c),
touched AS (SELECT q.a, q.b, x.subject AS sa, y.subject AS sb FROM queued q LEFT JOIN inside x ON q.a = x.org LEFT JOIN inside y ON q.b = y.org),
open_pairs AS (SELECT a, b FROM touched WHERE sa IS NULL AND sb IS NULL),
free AS (SELECT a, b FROM linked WHERE a NOT IN (SELECT org FROM inside) AND b NOT IN (SELECT org FROM inside) UNION SELECT a, b FROM open_pairs),
party2 AS (SELECT org, bool_or(f) AS f, bool_or(g) AS g FROM (SELECT org, f, g FROM party WHERE (f OR g) AND org NOT IN (SELECT org FROM inside) UNION ALL SELECT unnest([a, b]), false, false FROM free) GROUP BY org),
ways2 AS (SELECT a, b FROM free UNION SELECT b, a FROM free),
reach2 AS (SELECT org, org AS m FROM party2 UNION SELECT r.org, l.b FROM reach2 r JOIN ways2 l ON r.m = l.a),
member2 AS (SELECT r.org, min(r.m) AS c, any_value(p.f) AS f, any_value(p.g) AS g FROM reach2 r JOIN party2 p ON r.org = p.org GROUP BY r.org),
held AS (SELECT m.org, s.subject FROM member2 m JOIN (SELECT c, min(org) FILTER (g) AS subject FROM member2 GROUP BY c HAVING bool_or(f) AND bool_or(g)) s ON m.c = s.c),
waits AS (SELECT subject, count(*) AS n FROM (SELECT sa AS subject, a, b FROM touched WHERE sa IS NOT NULL UNION SELECT sb, a, b FROM touched WHERE sb IS NOT NULL UNION SELECT h.subject, o.a, o.b FROM open_pairs o JOIN held h ON o.a = h.org) GROUP BY subject),
links AS (SELECT subject, count(*) AS n FROM (SELECT i.subject, l.a, l.b, l.basis FROM linked l JOIN inside i ON l.a = i.org UNION SELECT subject, org, org, 'id_exact' FROM inside WHERE f AND g) GROUP BY subject),
o AS (SELECT i.subject, count(*) AS flow_count, sum(amount) AS amount_total, min(day) AS first_flow_date, max(day) AS last_flow_date, array_to_string(list_sort(list(DISTINCT kind)), '|') AS flow_types FROM flows x JOIN inside i ON x.org = i.org GROUP BY i.subject),
gr AS (SELECT i.subject, count(*) AS n, sum(amount) AS s FROM grants x JOIN inside i ON x.org = i.org GROUP BY i.subject),
aw AS (SELECT i.subject, count(*) AS n, sum(amount) AS s FROM awards x JOIN inside i ON x.org = i.org GROUP BY i.subject)
SELECT o.subject, 'candidate' AS status, row_number() OVER (ORDER BY amount_total DESC, o.subject) AS rank, coalesce(org.label, o.subject) AS label, flow_count, CAST(amount_total AS DECIMAL(28,2)) AS amount_total, first_flow_date, last_flow_date, flow_types,
  gr.n AS grant_count, CAST(gr.s AS DECIMAL(38,2)) AS grant_total, aw.n AS award_count, CAST(aw.s AS DECIMAL(28,2)) AS award_total, coalesce(l.n, 0) AS links, coalesce(w.n, 0) AS waits
FROM o LEFT JOIN gr ON o.subject = gr.subject LEFT JOIN aw ON o.subject = aw.subject LEFT JOIN links l ON o.subject = l.subject LEFT JOIN waits w ON o.subject = w.subject LEFT JOIN org ON o.subject = org.id
UNION ALL SELECT h.subject, 'withheld_pending_resolution', NULL, coalesce(org.label, h.subject), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, w.n FROM (SELECT DISTINCT subject FROM held) h JOIN waits w ON h.subject = w.subject LEFT JOIN org ON h.subject = org.id
"""

QUERIES = {"dual_role_table": dual_role_table}
ORACLE_SQL = {"dual_role_table": _SQL}
