"""Clusters and maps of the embeddings.  SQL has no form of these: tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgraph.operators import density, projection


def _vectors(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")


def density_clusters(spark, d) -> DataFrame:
    return density.clusters(_vectors(spark, d), "vec_id", "embedding")


def density_clusters_flat(spark, d) -> DataFrame:
    """Clusters over the first two numbers of each vector, as over a map's places."""
    return density.clusters(_vectors(spark, d).withColumn("embedding", F.slice("embedding", 1, 2)), "vec_id", "embedding")


def projection_map(spark, d) -> DataFrame:
    return projection.project(_vectors(spark, d), "vec_id", "embedding", rounds=4)


QUERIES = {"density_clusters": density_clusters, "density_clusters_flat": density_clusters_flat, "projection_map": projection_map}
ORACLE_SQL: dict[str, str] = {}
