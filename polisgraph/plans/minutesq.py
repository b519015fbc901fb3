"""Votes and agenda items read back out of texts that are made from orders: one meeting per customer and year.

The SQL has the rows that were put in, so both the texts' forms and every field must come back as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgraph.functions import minutes

#: Columns of one order's motion, in the SQL that Spark and DuckDB share.
_MOTION = """
SELECT 'meeting-' || CAST(o_custkey AS VARCHAR(20)) || '-' || CAST(year(o_orderdate) AS VARCHAR(4)) AS meeting, o_orderkey, o_custkey % 4 AS form,
  'Smith' || CAST(o_orderkey % 7 AS VARCHAR(2)) AS mover, 'O''Hara' || CAST(o_orderkey % 5 AS VARCHAR(2)) AS seconder, 'approve order ' || CAST(o_orderkey AS VARCHAR(20)) || ' of clerk ' || CAST(o_orderkey % 1000 AS VARCHAR(4)) AS motion, o_orderstatus AS status
FROM {orders}
"""
_TOWN = """CASE WHEN status = 'P' THEN 'COUNCIL MOTION: Upon motion by Councilmember ' || mover || ' there was no\\nsecond and the motion failed.\\n'
  ELSE 'COUNCIL ACTION: Upon motion by Mayor Pro Tem ' || mover || ' and seconded\\nby Councilmember ' || seconder || ', the City Council voted 3-1-1 via roll call to\\n' || replace(motion, ' of ', '\\nof ') || '\\nAYES: ' || mover || ', ' || seconder || ', LEE\\nNOES: WONG\\nRECUSED: NONE\\nABSENT: DIAZ\\nMotion ' || CASE status WHEN 'F' THEN 'carried' ELSE 'failed' END || '.\\n' END"""
_BLOCKS = (
    _TOWN,
    """'MOTION: It was M/S/C (' || mover || '/' || seconder || ') to ' || motion || '\\nROLL CALL VOTE: ' || CASE status WHEN 'F' THEN '5-0' ELSE '4-1 (Wong opposed)' END || ' in favor\\n'""",
    """'Councilmember ' || mover || ' moved, seconded by Vice Mayor ' || seconder || ', and ' || CASE status WHEN 'F' THEN 'unanimously carried' ELSE 'carried 4-1 (Wong dissenting)' END || ', to ' || motion || '.\\n\\n'""",
    """'M/s Supervisor ' || mover || ' - Supervisor ' || seconder || ' to ' || motion || '. AYES: ALL\\n'""",
)


def _case(choices) -> str:
    return "CASE form " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(choices)) + " END"


def minutes_texts(spark, d) -> DataFrame:
    """``(id, text)``: a meeting's motions in the order of their numbers, after a heading."""
    rows = spark.sql(_MOTION, orders=spark.read.parquet(f"{d}/orders.parquet")).withColumn("block", F.expr(_case(_BLOCKS)))
    # A customer's orders of one year are few however large the table.
    held = rows.groupBy("meeting").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "block"))).alias("l"))
    return held.select(F.col("meeting").alias("id"), F.concat(F.lit("MINUTES\nCall to order.\n\n"), F.array_join(F.transform("l", lambda x: x["block"]), "\n")).alias("text"))


def minutes_votes(spark, d) -> DataFrame:
    found = minutes.votes(minutes_texts(spark, d))
    flat = [F.array_join(c, ",").alias(c) for c in ("ayes", "noes", "recused", "absent")]
    return found.select("id", "form", "at", "mover", "seconder", "tally", "motion", *flat, "outcome")


def agenda_texts(spark, d) -> DataFrame:
    """``(id, text)``: agendas with a part for consent and one for hearings, in the five forms."""
    rows = spark.sql(_AGENDA, orders=spark.read.parquet(f"{d}/orders.parquet"))
    held = rows.groupBy("id", "form").agg(F.array_sort(F.collect_list(F.struct("k", "title"))).alias("l"))
    each = lambda make: F.array_join(F.transform("l", make), "\n")
    at = lambda x: x["k"].cast("string")
    letter = lambda x: F.chr(F.lit(64) + x["k"])
    forms = (
        F.concat(F.lit("AGENDA\nG. CONSENT CALENDAR\n"), each(lambda x: F.concat(F.lit("   G."), at(x), F.lit(".  "), x["title"])), F.lit("\nI. PUBLIC HEARINGS\n   I.1.  Hear all\n")),
        F.concat(F.lit("AGENDA\n4. CONSENT CALENDAR\n"), each(lambda x: F.concat(F.lit("   4."), letter(x), F.lit(". "), x["title"])), F.lit("\n5. PUBLIC HEARINGS\n   5.A Hear all\n")),
        F.concat(F.lit("Agenda\nConsent Agenda A\n"), each(lambda x: F.concat(F.lit("CA - "), at(x), F.lit(". "), x["title"])), F.lit("\nPublic Hearing\nRequest to hear all\n")),
        F.concat(F.lit("Call to Order\nCONSENT CALENDAR\n"), each(lambda x: F.concat(at(x), F.lit(". "), x["title"])), F.lit("\nPUBLIC HEARING\n99. Hear all\n100. Adjournment\n")),
        F.concat(F.lit("Agenda\n"), each(lambda x: F.concat(F.lit("CC-"), at(x), F.lit(".\n\n  "), x["title"])), F.lit("\nPH-1. Hear all\n")),
    )
    text = F.lit(None).cast("string")
    for k, f in enumerate(forms):
        text = F.when(F.col("form") == k, f).otherwise(text)
    return held.select("id", text.alias("text"), F.element_at(F.array(*map(F.lit, _AGENDA_FORMS)), (F.col("form") + 1).cast("int")).alias("form"))


#: An agenda has 25 items at most, so that letters can number them: a customer's further orders are on further agendas.
_AGENDA = """
SELECT 'agenda-' || CAST(o_custkey AS VARCHAR(20)) || '-' || CAST(CAST(floor((r - 1) / 25) AS INT) AS VARCHAR(10)) AS id, o_custkey % 5 AS form, CAST(1 + (r - 1) % 25 AS INT) AS k, 'Approve order ' || CAST(o_orderkey AS VARCHAR(20)) AS title
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM {orders}) a
"""
_AGENDA_FORMS = ("granicus", "civicplus", "bos", "fairfax", "tiburon")


def agenda_items(spark, d) -> DataFrame:
    return minutes.agenda_rows(agenda_texts(spark, d), form="form").select("id", "form", "section", "section_name", "number", "title")


_M = _MOTION.replace("{orders}", "orders")
_FORMS = ("'novato'", "'cortemadera'", "'sausalito'", "'bos'")
_VOTES_SQL = f"""
WITH m AS ({_M}), v AS (SELECT *, form = 0 AND status = 'P' AS lost FROM m)
SELECT meeting AS id, {_case(_FORMS)} AS form, CAST(row_number() OVER (PARTITION BY meeting ORDER BY o_orderkey) AS INTEGER) AS at,
  CASE WHEN form = 0 THEN upper(mover) ELSE mover END AS mover, CASE WHEN lost THEN NULL WHEN form = 0 THEN upper(seconder) ELSE seconder END AS seconder,
  CASE WHEN lost OR form = 3 OR (form = 2 AND status = 'F') THEN NULL WHEN form = 0 THEN '3-1-1' WHEN form = 1 AND status = 'F' THEN '5-0' ELSE '4-1' END AS tally,
  CASE WHEN lost THEN '{minutes.UNSECONDED}' ELSE motion END AS motion,
  CASE WHEN lost THEN '' WHEN form = 0 THEN upper(mover) || ',' || upper(seconder) || ',LEE' WHEN form = 3 THEN 'ALL' ELSE '' END AS ayes,
  CASE WHEN lost THEN '' WHEN form = 0 OR (form IN (1, 2) AND status <> 'F') THEN 'WONG' ELSE '' END AS noes, '' AS recused,
  CASE WHEN form = 0 AND NOT lost THEN 'DIAZ' ELSE '' END AS absent,
  CASE WHEN lost OR (form = 0 AND status <> 'F') THEN 'failed' ELSE 'carried' END AS outcome
FROM v
"""
_AGENDA_SQL = f"""
WITH a AS ({_AGENDA.replace("{orders}", "orders")}), t AS (SELECT DISTINCT id, form FROM a),
f(form, name, s, sn, h, hn, hk, ht) AS (VALUES (0, 'granicus', 'G', 'CONSENT CALENDAR', 'I', 'PUBLIC HEARINGS', '1', 'Hear all'), (1, 'civicplus', '4', 'CONSENT CALENDAR', '5', 'PUBLIC HEARINGS', 'A', 'Hear all'),
  (2, 'bos', 'CA', 'Consent Agenda', 'PH', 'Public Hearing', '1', 'to hear all'), (3, 'fairfax', 'CO', 'Consent Calendar', 'PU', 'Public Hearing', '99', 'Hear all'), (4, 'tiburon', 'CC', 'Consent Calendar', 'PH', 'Public Hearings', '1', 'Hear all'))
SELECT id, name AS form, s AS section, sn AS section_name, CASE WHEN a.form = 1 THEN chr(64 + k) ELSE CAST(k AS VARCHAR) END AS number, title FROM a JOIN f ON a.form = f.form
UNION ALL SELECT id, name, h, hn, hk, ht FROM t JOIN f ON t.form = f.form
UNION ALL SELECT id, name, CASE t.form WHEN 2 THEN 'CO' ELSE s END, CASE t.form WHEN 2 THEN 'Consent Agenda A' ELSE sn END, NULL, NULL FROM t JOIN f ON t.form = f.form
UNION ALL SELECT id, name, CASE t.form WHEN 2 THEN 'PU' ELSE h END, hn, NULL, NULL FROM t JOIN f ON t.form = f.form
"""

QUERIES = {"minutes_votes": minutes_votes, "agenda_items": agenda_items}
ORACLE_SQL = {"minutes_votes": _VOTES_SQL, "agenda_items": _AGENDA_SQL}
