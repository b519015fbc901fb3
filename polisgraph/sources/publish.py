"""Published versions of a map: a folder per version, budgets that refuse one, and a manifest that points to the current one.

``publish`` writes a version's frames (canonical and previous places), nodes, edges and clusters beside the others, checks the
budgets, and only then replaces the manifest in one rename.  Whatever fails before leaves the old version as it was, readable.
Frames of a new version hold the old version's canonical places as previous ones; nodes that the new one lacks keep only those.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
#: Compressed bytes of a version, and shifts of a node and of a cluster's centre as shares of the old map's width.
MOST_BYTES, MOST_NODE_SHIFT, MOST_CENTRE_SHIFT = 8 << 20, 0.25, 0.15
_PLACE = ("x", "y", "map_version", "cluster_id", "cluster_label", "distance")


class OverBudget(Exception):
    pass


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str) -> dict | None:
    at, fs = _fs(spark, f"{root}/manifest.json")
    if not fs.exists(at):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{root}/manifest.json").collect()))  # one small file


def _point_to(spark: SparkSession, root: str, content: dict) -> None:
    """Write a manifest under another name and rename it over the old one."""
    at, fs = _fs(spark, f"{root}/manifest-{uuid.uuid4().hex}.tmp")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    to, _ = _fs(spark, f"{root}/manifest.json")
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(at, to, options)


def frames(spark: SparkSession, root: str) -> DataFrame | None:
    """The current version's frames, or None before the first."""
    now = manifest(spark, root)
    return spark.read.parquet(f"{root}/{now['version']}/frames") if now else None


def promoted(pending: DataFrame, old: DataFrame | None) -> DataFrame:
    """Pending places become canonical, the old canonical ones previous; first-time entrants are told, the rest demoted."""
    new = pending.select("id", *_PLACE)
    if old is None:
        empty = [F.lit(None).cast(dict(new.dtypes)[c]).alias(f"previous_{c}") for c in _PLACE]
        return new.select("id", *_PLACE, *empty, F.lit(False).alias("had_canonical_before"))
    before = old.where("x is not null").select("id", *[F.col(c).alias(f"previous_{c}") for c in _PLACE])
    both = new.join(before, "id", "full")
    return both.withColumn("had_canonical_before", F.col("previous_x").isNotNull())


def shifts(rows: DataFrame) -> tuple[float, float]:
    """The largest shift of a node and of a cluster of one id, over the width of the old places of nodes in both."""
    both = rows.where("x is not null and previous_x is not null")
    width = both.agg(F.greatest(F.max("previous_x") - F.min("previous_x"), F.max("previous_y") - F.min("previous_y"), F.lit(1e-12)).alias("w")).first()["w"]
    if width is None:
        return 0.0, 0.0
    node = both.agg(F.max(F.hypot(F.col("x") - F.col("previous_x"), F.col("y") - F.col("previous_y")))).first()[0] or 0.0
    centre = lambda p: rows.where(f"{p}cluster_id is not null and {p}cluster_id >= 0").groupBy(F.col(f"{p}cluster_id").alias("c")).agg(F.avg(f"{p}x").alias(f"{p}cx"), F.avg(f"{p}y").alias(f"{p}cy"))
    moved = centre("").join(centre("previous_"), "c").agg(F.max(F.hypot(F.col("cx") - F.col("previous_cx"), F.col("cy") - F.col("previous_cy")))).first()[0] or 0.0
    return node / width, moved / width


def published_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges between published nodes, once each: ``(s, t, type, weight)``."""
    ids = nodes.select("id")
    inside = edges.select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), F.col("rel").alias("type")).distinct()
    return inside.join(ids.select(F.col("id").alias("s")), "s", "left_semi").join(ids.select(F.col("id").alias("t")), "t", "left_semi").withColumn("weight", F.lit(1))


def publish(root: str, version: str, pending: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, most_bytes: int | None = MOST_BYTES, most_node_shift: float | None = MOST_NODE_SHIFT, most_centre_shift: float | None = MOST_CENTRE_SHIFT) -> dict:
    """Write ``version`` and point the manifest to it; returns the manifest.

    ``pending`` holds the places of the nodes to be shown, ``nodes`` their ``id, type, label, key_fact``.  A budget of None is not
    checked.  A version name that exists raises an error.
    """
    spark = pending.sparkSession
    old = manifest(spark, root)
    folder = f"{root}/{version}"
    at, fs = _fs(spark, folder)
    if fs.exists(at):
        raise FileExistsError(folder)
    promoted(pending, frames(spark, root)).write.parquet(f"{folder}/frames")
    rows = spark.read.parquet(f"{folder}/frames")
    if old:
        node, centre = shifts(rows)
        for found, most, what in ((node, most_node_shift, "a node"), (centre, most_centre_shift, "a cluster's centre")):
            if most is not None and found > most:
                raise OverBudget(f"{what} moved by {found:.1%} of the map, more than {most:.0%}")
    shown = rows.where("x is not null")
    parts = {
        "nodes": shown.join(nodes.select("id", "type", F.coalesce("label", "id").alias("label"), "key_fact"), "id").select("id", "type", "label", "key_fact", "x", "y", "cluster_id"),
        "clusters": shown.where("cluster_id is not null").groupBy(F.col("cluster_id").alias("id")).agg(F.array(F.avg("x"), F.avg("y")).alias("centroid"), F.count("*").alias("member_count"), F.min("cluster_label").alias("label")),
    }
    if edges is not None:
        parts["edges"] = published_edges(edges, shown)
    for name, df in parts.items():
        df.write.option("compression", "gzip").json(f"{folder}/{name}")
    size = sum(int(fs.getContentSummary(_fs(spark, f"{folder}/{name}")[0]).getLength()) for name in parts)
    if most_bytes is not None and size > most_bytes:
        raise OverBudget(f"{size} compressed bytes, more than {most_bytes}")
    count = {f"{name[:-1]}_count": spark.read.json(f"{folder}/{name}").count() if size else 0 for name in parts}
    new = {"schema_version": SCHEMA_VERSION, "version": version, "size_gz": size, "edge_count": 0, **count, "previous_version": old["version"] if old else None}
    _point_to(spark, root, new)
    return new
