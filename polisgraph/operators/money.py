"""Parties on both ends of money: funding that comes in and influence that goes out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgraph.graph import Graph
from polisgraph.operators.traverse import components


def legs(g: Graph, rel: str) -> DataFrame:
    """Totals of each party's flows by one relationship: ``(id, flows, amount, first_day, last_day, types)``."""
    flows = g.of("MoneyFlow").select(F.col("id").alias("flow"), F.coalesce("amount", F.lit(0)).alias("amount"), "event_date", "kind")
    # A flow that is linked to a party twice counts once.
    ends = g.rel(rel, source="flow", target="id").distinct()
    return ends.join(flows, "flow").groupBy("id").agg(F.count("*").alias("flows"), F.sum("amount").alias("amount"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"), F.collect_set("kind").alias("types"))


def dual_roles(g: Graph, same: DataFrame, funding: str = "TO_TARGET", influence: str = "FROM_SOURCE") -> DataFrame:
    """One row per group of identical parties that has both legs; ``same`` holds pairs ``(a, b)`` of one identity.

    Legs are summed by party first and by group after, so a group's flows never meet.  The subject is the smallest
    member that sends money.  Totals of the two legs stay apart.
    """
    group = components(same)
    party = lambda leg: leg.join(group, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    out = party(legs(g, influence)).groupBy("component").agg(F.min("id").alias("subject"), F.sum("flows").alias("flow_count"), F.sum("amount").cast("decimal(28,2)").alias("amount_out"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))), "|").alias("flow_types"))
    paid = party(legs(g, funding)).groupBy("component").agg(F.sum("flows").alias("funding_count"), F.sum("amount").cast("decimal(28,2)").alias("amount_in"))
    return out.join(paid, "component").drop("component")
