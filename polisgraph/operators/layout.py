"""Layouts over time: fitting a new layout onto an older one, and cluster ids that stay."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polisgraph.operators.traverse import components
from polisgraph.session import shared_dir

#: Nodes in both layouts below which a fit is refused.
LEAST_ANCHORS = 100
#: Share of members that make two clusters the same.
SAME_CLUSTER = 0.5


def similarity_fit(old: DataFrame, new: DataFrame, least: int = LEAST_ANCHORS) -> DataFrame:
    """One row: the rotation, mirror, scale and shift that bring ``new`` closest to ``old`` (least squares).

    Both hold ``(id, x, y)``.  With points as complex numbers the best map is a ratio of two sums, with and without
    a mirrored ``y``; the one that leaves less error counts, without the mirror if equal.  Columns: ``anchors,
    mirror, scale, rotation, tx, ty, error``.  A fit on fewer than ``least`` anchors raises an error; where all
    points of ``new`` are one, the scale is 1.
    """
    both = new.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(old.select("id", F.col("x").cast("double").alias("u"), F.col("y").cast("double").alias("v")), "id")
    sums = both.agg(
        F.count("*").alias("anchors"),
        *[F.avg(c).alias(f"m{c}") for c in "xyuv"],
        *[F.covar_pop(a, b).alias(a + b) for a, b in ("xu", "yv", "xv", "yu")],
        (F.var_pop("x") + F.var_pop("y")).alias("spread"),
        (F.var_pop("u") + F.var_pop("v")).alias("target"),
    )
    checked = sums.withColumn("anchors", F.when(F.col("anchors") < least, F.raise_error(F.concat(F.lit("too few anchors: "), "anchors")).cast("long")).otherwise(F.col("anchors")))
    turn = checked.withColumns({"re0": F.expr("xu + yv"), "im0": F.expr("xv - yu"), "re1": F.expr("xu - yv"), "im1": F.expr("xv + yu")})
    turn = turn.withColumn("mirror", F.expr("re1 * re1 + im1 * im1 > re0 * re0 + im0 * im0"))
    turn = turn.withColumns({"re": F.expr("if(mirror, re1, re0)"), "im": F.expr("if(mirror, im1, im0)"), "my": F.expr("if(mirror, -my, my)")})
    turn = turn.withColumns({"a": F.expr("if(spread > 0, re / spread, 1D)"), "b": F.expr("if(spread > 0, im / spread, 0D)")})
    return turn.selectExpr(
        "anchors",
        "mirror",
        "sqrt(a * a + b * b) AS scale",
        "atan2(b, a) AS rotation",
        "mu - (a * mx - b * my) AS tx",
        "mv - (b * mx + a * my) AS ty",
        "greatest(0D, anchors * (target - if(spread > 0, (re * re + im * im) / spread, 0D))) AS error",
    )


def similarity_apply(points: DataFrame, fit: DataFrame) -> DataFrame:
    """``(id, x, y)`` after a fit, which is a single row."""
    rows = points.crossJoin(F.broadcast(fit.limit(1)))
    y = F.expr("if(mirror, -y, y)")
    a, b = F.col("scale") * F.cos("rotation"), F.col("scale") * F.sin("rotation")
    return rows.select("id", (a * F.col("x") - b * y + F.col("tx")).alias("x"), (b * F.col("x") + a * y + F.col("ty")).alias("y"))


def heaviest_pairs(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns, each at most once, with the largest sum of weights, by shortest augmenting ways."""
    turned = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if turned else weights).astype(np.float64)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.int64)  # columns from 1; column 0 is the row's start
    for row in range(1, n + 1):
        match[0], at = row, 0
        least, before, seen = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while match[at]:
            seen[at] = True
            open_ = np.flatnonzero(~seen[1:]) + 1
            slack = cost[match[at] - 1, open_ - 1] - u[match[at]] - v[open_]
            closer = slack < least[open_]
            least[open_[closer]], before[open_[closer]] = slack[closer], at
            to = int(open_[least[open_].argmin()])
            step = least[to]
            u[match[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            at = to
        while at:
            match[at] = match[before[at]]
            at = int(before[at])
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((j, i) if turned else (i, j) for i, j in pairs)


def assigned(overlap: DataFrame) -> DataFrame:
    """``(cluster, prior)``: pairs of the largest total overlap, solved for each connected part of the overlaps.

    ``overlap`` holds ``(cluster, prior, both)``, a row per pair with members in common.  A part is held by one task.
    """
    # One name space: prior clusters get even numbers, new ones odd ones.
    ends = overlap.select((F.col("cluster") * 2 + 1).alias("a"), (F.col("prior") * 2).alias("b"))
    parts = components(ends).where("node % 2 <> 0").select(F.expr("(node - 1) div 2").alias("cluster"), "component")

    def solve(table: pa.Table) -> pa.Table:
        rows, i = np.unique(table.column("cluster").to_numpy(), return_inverse=True)
        columns, j = np.unique(table.column("prior").to_numpy(), return_inverse=True)
        weights = np.zeros((len(rows), len(columns)))
        weights[i, j] = table.column("both").to_numpy()
        pairs = [(int(rows[a]), int(columns[b])) for a, b in heaviest_pairs(weights) if weights[a, b] > 0]
        return pa.table({"cluster": pa.array([a for a, _ in pairs], pa.int64()), "prior": pa.array([b for _, b in pairs], pa.int64())})

    return overlap.join(parts, "cluster").select("component", "cluster", "prior", "both").groupBy("component").applyInArrow(solve, "cluster long, prior long")


def stable_ids(prior: DataFrame, new: DataFrame, least: float = SAME_CLUSTER) -> DataFrame:
    """``(cluster, stable_id, rename)`` of every cluster of ``new``; both sides hold ``(id, cluster)``, an id once.

    Clusters are paired for the largest total overlap (``assigned``); a pair with a Jaccard similarity of ``least`` or
    more is the same cluster.  Any other cluster takes the id
    of the prior one it overlaps most, if no cluster has it (of several, the smallest cluster), or else a fresh id
    above all.  Clusters to be named anew: those that were not the same, and those with members of several prior
    ones.  Only overlap counts and cluster sizes, never members, meet after the join; the fresh ids are numbered in one
    task, a row per cluster.
    """
    p, n = prior.select("id", F.col("cluster").cast("long").alias("prior")), new.select("id", F.col("cluster").cast("long").alias("cluster"))
    sizes_p = p.groupBy("prior").agg(F.count("*").alias("np"))
    sizes_n = n.groupBy("cluster").agg(F.count("*").alias("nn"))
    shared_dir(new.sparkSession)
    overlap = n.join(p, "id").groupBy("cluster", "prior").agg(F.count("*").alias("both")).join(sizes_p, "prior").join(sizes_n, "cluster").checkpoint()
    rank = lambda part, *order: F.row_number().over(Window.partitionBy(part).orderBy(*order))
    close = assigned(overlap).join(overlap, ["cluster", "prior"]).where(F.col("both") >= least * (F.col("np") + F.col("nn") - F.col("both")))
    same = close.select("cluster", F.col("prior").alias("same")).checkpoint()

    rest = overlap.join(same.select("cluster"), "cluster", "left_anti").withColumn("k", rank("cluster", F.desc("both"), "prior")).where("k = 1")
    rest = rest.join(same.select(F.col("same").alias("prior")), "prior", "left_anti").withColumn("j", rank("prior", "cluster")).where("j = 1")
    heirs = rest.select("cluster", F.col("prior").alias("heir"))
    origins = overlap.groupBy("cluster").agg(F.count("*").alias("origins"))
    known = sizes_n.select("cluster").join(same, "cluster", "left").join(heirs, "cluster", "left").join(origins, "cluster", "left").withColumn("held", F.coalesce("same", "heir"))
    top = p.agg(F.coalesce(F.max("prior"), F.lit(-1)).alias("top"))
    fresh = known.where("held is null").select("cluster", F.row_number().over(Window.orderBy("cluster")).alias("r")).crossJoin(F.broadcast(top)).select("cluster", (F.col("top") + F.col("r")).alias("fresh"))
    rename = F.col("same").isNull() | (F.coalesce("origins", F.lit(0)) > 1)
    return known.join(fresh, "cluster", "left").select("cluster", F.coalesce("held", "fresh").cast("long").alias("stable_id"), rename.alias("rename"))
