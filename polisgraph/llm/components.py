"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the links, checkpointed in the shared folder; nothing
is gathered on the driver but a row count and a checksum.  A hub's links are joined by key, so adaptive
execution splits them.  Null ends and self-links are dropped; an empty table has no components.

A saved table of one partition, ``C.SAVED_ROWS`` links between whole numbers at most, is gone through by the task that
reads it: the rounds' many small jobs would cost the driver more than they give the executors to do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgraph.llm import _common as C


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _both_ways(links: DataFrame) -> DataFrame:
    way = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    return links.select(F.explode(F.array(way("u", "v"), way("v", "u"))).alias("e")).select("e.u", "e.v")


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    both = _both_ways(links)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(C.hinted(least, 2 * rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # A node's links move to its least neighbour, to which the node itself is linked too.
    moved = down.join(C.hinted(least, 2 * rows), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return moved.select("e.u", "e.v").where("u <> v").distinct()


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, ascending, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root != (up := root[root])).any():
            root = up


def _of_partition(batches):
    """Components of all links of a partition."""
    ends = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
    if ends:
        u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
        other = u != v
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(u[other], v[other])], ["node", "component"])


def _is_small(*tables: DataFrame) -> bool:
    """Whether saved tables of whole numbers fit one partition together."""
    return sum(map(C.rows_of, tables)) <= C.SAVED_ROWS and all(kind == "bigint" for t in tables for _, kind in t.dtypes)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node with a link; ``component`` is its smallest reachable node."""
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    links = C.saved(links)
    if _is_small(links):
        return links.mapInArrow(_of_partition, "node long, component long")
    before = _state(links)
    while before[0]:
        links = C.saved(_small_star(_large_star(links, before[0]), before[0]))
        after = _state(links)
        if after == before:
            break
        before = after
    nodes = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("e"))
    return nodes.select("e.node", "e.component").distinct()


def joined_components(found: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The components ``found`` with further ``links``, both saved: only the components that these join are gone through."""
    if _is_small(found, links):
        ways = links.select(F.col(a).alias("node"), F.col(b).alias("component")).where("node is not null and component is not null")
        return C.together(C.rows_of(found) + C.rows_of(links), found, ways).mapInArrow(_of_partition, "node long, component long")
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    rows = C.rows_of(found)
    for end in ("u", "v"):
        ends = ends.join(C.hinted(found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), rows), end, "left")
    ends = C.saved(ends.select("u", "v", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv")))
    merged = C.saved(connected_components(ends, "cu", "cv").select(F.col("node").alias("component"), F.col("component").alias("to")))
    n = C.rows_of(merged)
    fresh = ends.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("cu").alias("component")), F.struct(F.col("v").alias("node"), F.col("cv").alias("component")))).alias("e")).select("e.*")
    # Components that merged are named by their smallest: a node that stood for one alone is one of its nodes.
    named = merged.select(F.col("component").alias("node"), "component")
    nodes = found.unionByName(fresh).unionByName(named).distinct()
    return nodes.join(C.hinted(merged, n), "component", "left").select("node", F.coalesce("to", "component").alias("component")).distinct()
