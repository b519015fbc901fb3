"""The data model: a table of typed nodes and a table of typed, directed edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Graph:
    """``nodes``: id, node_type, label, kind, status, amount, event_date, ended_date, ref_id, url.

    ``edges``: source_id, rel, target_id, detail.  Parallel edges are kept (T16).  Dates are ISO strings.
    """

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def nodes_of(self, *types: str) -> DataFrame:
        return self.nodes.where(F.col("node_type").isin(*types))

    def edges_of(self, *rels: str) -> DataFrame:
        return self.edges.where(F.col("rel").isin(*rels))

    def of(self, *types: str, prefix: str = "") -> DataFrame:
        """Nodes of the given types; a prefix renames every column."""
        found = self.nodes_of(*types)
        return found.select([F.col(c).alias(prefix + c) for c in found.columns]) if prefix else found

    def rel(self, *rels: str, source: str = "source_id", target: str = "target_id", source_type: str | None = None, target_type: str | None = None) -> DataFrame:
        """``(source, target)`` of edges of the given relationships; ids tell their type by prefix."""
        found = self.edges_of(*rels)
        if source_type:
            found = found.where(F.col("source_id").startswith(source_type + "-"))
        if target_type:
            found = found.where(F.col("target_id").startswith(target_type + "-"))
        return found.select(F.col("source_id").alias(source), F.col("target_id").alias(target))

    def undirected(self, *rels: str) -> DataFrame:
        """Every edge, or those of the given relationships, in both directions: ``(u, rel, v)``."""
        e = self.edges_of(*rels) if rels else self.edges
        return e.select(F.col("source_id").alias("u"), "rel", F.col("target_id").alias("v")).unionByName(e.select(F.col("target_id").alias("u"), "rel", F.col("source_id").alias("v")))
