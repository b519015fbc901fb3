"""A map of vectors in two dimensions that keeps neighbours together, and places for new vectors on it.

Each vector's nearest neighbours get weights that fall with the distance beyond the first, at a width that makes them
add up to the logarithm of their number; the two directions of a pair are joined as independent chances.  The start is spectral:
power iteration of the smoothed graph, free of what all rows share.  Then come rounds.  In a round tasks hold blocks of
``BLOCK_ROWS`` neighbouring rows with their own neighbours' places, and go through some epochs of seeded edge
sampling: a row is drawn to its sampled neighbours and pushed off rows of a pool of ``POOL_ROWS`` that all blocks share.
Rows of other blocks stand still until the round ends.  A row is moved by its own neighbours only, so a row that is near to
very many others has no more edges than any.  With the same rows, settings and seed the result is the same.

Rows without direction (null, not finite, empty or of length 0) are left out; equal vectors share a place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgraph.operators import neighbours as N

NEIGHBOURS, MIN_DIST, SEED = 30, 0.1, 42
ROUNDS, EPOCHS = 8, 30
#: Steps of power iteration.
STEPS = 12
BLOCK_ROWS, POOL_ROWS = 8192, 4096
#: Pushes for each pull.
PUSHES = 5
#: Half the width of the start, and the longest single move.
SPREAD, LONGEST = 10.0, 4.0


def falloff(min_dist: float) -> tuple[float, float]:
    """``a, b`` for which ``1 / (1 + a * d ** (2 * b))`` is nearest to 1 up to ``min_dist`` and an exponential after."""
    d = np.linspace(0, 3, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist)))
    p = np.array([1.0, 1.0])
    for _ in range(100):
        power = d ** (2 * p[1])
        got = 1 / (1 + p[0] * power)
        slope = np.stack([-(got**2) * power, -(got**2) * p[0] * power * 2 * np.log(d)], 1)
        p = p + np.linalg.lstsq(slope, want - got, rcond=None)[0] * 0.5
    return float(p[0]), float(p[1])


def _weighted(batches):
    """Weights of each row's neighbours, by bisection of the width."""
    for batch in batches:
        rid, out = batch.column(0).to_numpy(), [[], [], [], []]
        lists = batch.column(1)
        flat = lists.flatten()
        cut = lists.offsets.to_numpy() - lists.offsets[0].as_py() if batch.num_rows else np.zeros(1, int)
        d, near = flat.field("d").to_numpy(), flat.field("near").to_numpy()
        d = np.square(d) / 2  # cosine distance of vectors of length 1
        for k in range(batch.num_rows):
            x, to = d[cut[k] : cut[k + 1]], near[cut[k] : cut[k + 1]]
            if not len(x):
                continue
            beyond = np.maximum(0, x - x.min())
            lo, hi, want = 0.0, np.inf, np.log2(len(x) + 1)
            width = max(float(beyond.mean()), 1e-12)
            for _ in range(64):
                total = np.exp(-beyond / width).sum()
                lo, hi = (lo, width) if total > want else (width, hi)
                width = (lo + hi) / 2 if np.isfinite(hi) else 2 * width
                if not 0 < width < 1e12:
                    break
            w = np.exp(-beyond / max(width, 1e-12))
            out[0] += [rid[k]] * len(x)
            out[1] += to.tolist()
            out[2] += w.tolist()
            out[3] += list(range(len(x)))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int32())], ["u", "v", "w", "k"])


def fuzzy_graph(lists: DataFrame) -> DataFrame:
    """``(u, v, w)``: each row's own neighbours with the chance that either direction holds."""
    own = N.staged(lists.mapInArrow(_weighted, "u long, v long, w double, k int").select("u", "v", "w"), "weights")
    back = own.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("w").alias("w2"))
    w, w2 = F.col("w"), F.coalesce("w2", F.lit(0.0))
    return N.staged(own.join(back, ["u", "v"], "left").select("u", "v", (w + w2 - w * w2).alias("w")), "graph")


def spectral(graph: DataFrame, rows: DataFrame, seed: int, steps: int = STEPS) -> DataFrame:
    """``(rid, x, y)``: two smooth coordinates of the graph, scaled to ``SPREAD``."""
    two = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    degree = N.staged(rows.select("rid").join(two.groupBy(F.col("u").alias("rid")).agg(F.sum("w").alias("deg")), "rid", "left").select("rid", F.sqrt(F.coalesce("deg", F.lit(1e-9))).alias("deg")), "degrees")
    scaled = two.join(degree.select(F.col("rid").alias("u"), F.col("deg").alias("du")), "u").join(degree.select(F.col("rid").alias("v"), F.col("deg").alias("dv")), "v")
    scaled = N.staged(scaled.select("u", "v", (F.col("w") / (F.col("du") * F.col("dv"))).alias("w")), "scaled")
    chance = lambda salt: F.xxhash64("rid", F.lit(seed), F.lit(salt)) / F.lit(float(1 << 63))
    at = N.staged(degree.select("rid", "deg", chance(1).alias("x"), chance(2).alias("y")), "start")
    for _ in range(steps):
        pulled = scaled.join(at.select(F.col("rid").alias("v"), "x", "y"), "v").groupBy(F.col("u").alias("rid")).agg(F.sum(F.col("w") * F.col("x")).alias("px"), F.sum(F.col("w") * F.col("y")).alias("py"))
        at = at.join(pulled, "rid", "left").select("rid", "deg", *[((F.col(c) + F.coalesce(f"p{c}", F.lit(0.0))) / 2).alias(c) for c in "xy"])
        at = N.staged(at, "step")
        s = at.agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in (("deg", "deg"), ("x", "deg"), ("y", "deg"), ("x", "x"), ("x", "y"), ("y", "y"))]).first()
        if not s or not s["degdeg"]:
            return at.select("rid", "x", "y")
        # Take out what all rows share, then from the second coordinate what the first holds, and scale.
        fx, fy = s["xdeg"] / s["degdeg"], s["ydeg"] / s["degdeg"]
        xx, xy, yy = s["xx"] - fx * s["xdeg"], s["xy"] - fx * s["ydeg"], s["yy"] - fy * s["ydeg"]
        share = xy / xx if xx > 0 else 0.0
        left = yy - share * xy
        x = F.col("x") - F.lit(fx) * F.col("deg")
        y = F.col("y") - F.lit(fy) * F.col("deg") - F.lit(share) * x
        at = at.select("rid", "deg", (x / F.lit(max(xx, 1e-300) ** 0.5)).alias("x"), (y / F.lit(max(left, 1e-300) ** 0.5)).alias("y"))
    plain = at.select("rid", (F.col("x") / F.col("deg")).alias("x"), (F.col("y") / F.col("deg")).alias("y"))
    top = plain.agg(F.max(F.abs("x")).alias("x"), F.max(F.abs("y")).alias("y")).first()
    noise = lambda salt: F.xxhash64("rid", F.lit(seed), F.lit(salt)) / F.lit(float(1 << 63)) * 1e-2
    return plain.select("rid", (F.col("x") * SPREAD / F.lit(top["x"] or 1.0) + noise(3)).alias("x"), (F.col("y") * SPREAD / F.lit(top["y"] or 1.0) + noise(4)).alias("y"))


def _epochs(held, a: float, b: float, epochs: int, first: int, every: int, seed: int):
    """Moves of one block's rows: input ``block, u, ux, uy, v, vx, vy, w``, sorted by block and row."""

    def moved(parts):
        u, v = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (1, 4))
        start, end, w = (np.concatenate([np.stack([p.column(k).to_numpy() for k in ks], 1) for p in parts]) for ks in ((2, 3), (5, 6), (7,)))
        w = w[:, 0]
        rows, first_at, i = np.unique(u, return_index=True, return_inverse=True)
        at = start[first_at].copy()
        place = np.searchsorted(rows, v)
        place[place == len(rows)] = 0
        inside = rows[place] == v
        pool_ids, pool = held.value
        chance = w / max(w.max(), 1e-300)
        for e in range(first, first + epochs):
            r = np.random.default_rng([seed, e, int(rows[0]) & 0xFFFFFFFF])
            rate = 1.0 - e / every
            edge = np.flatnonzero(r.random(len(u)) < chance)
            i_, other = i[edge], np.where(inside[edge, None], at[place[edge]], end[edge])
            gap = at[i_] - other
            d2 = np.maximum(np.square(gap).sum(1), 1e-12)
            pull = np.clip(gap * (-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b))[:, None], -LONGEST, LONGEST)
            move = np.zeros_like(at)
            np.add.at(move, i_, pull)
            for _ in range(PUSHES):
                k = r.integers(0, len(pool), len(edge))
                gap = at[i_] - pool[k]
                d2 = np.square(gap).sum(1)
                push = np.clip(gap * (2 * b / ((1e-3 + d2) * (1 + a * d2**b)))[:, None], -LONGEST, LONGEST)
                push[pool_ids[k] == rows[i_]] = 0
                np.add.at(move, i_, push)
            # Moves of one epoch are made at once: a row's are averaged where there are many.
            count = np.bincount(i_, minlength=len(rows))
            at += rate * move / np.maximum(1, np.sqrt(count))[:, None]
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(at[:, 0]), pa.array(at[:, 1])], ["rid", "x", "y"])

    def run(batches):
        block, parts = None, []
        for now, part in N.runs(batches, ["block"]):
            if now != block and parts:
                yield moved(parts)
                parts = []
            block = now
            parts.append(part)
        if parts:
            yield moved(parts)

    return run


def arranged(graph: DataFrame, start: DataFrame, blocks: DataFrame, still: DataFrame | None = None, rounds: int = ROUNDS, epochs: int = EPOCHS, min_dist: float = MIN_DIST, seed: int = SEED) -> DataFrame:
    """``(rid, x, y)`` after the rounds.  ``blocks`` holds ``(rid, block)``; rows of ``still`` never move."""
    spark = graph.sparkSession
    a, b = falloff(min_dist)
    at = N.staged(start.select("rid", "x", "y"), "places")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = N.staged(graph.join(blocks.select(F.col("rid").alias("u"), "block"), "u").select("block", "u", "v", "w"), "blocks")
    for k in range(rounds):
        every = at if still is None else at.unionByName(still.select("rid", "x", "y"))
        pool = every.select("rid", "x", "y", F.xxhash64("rid", F.lit(seed), F.lit(k)).alias("h")).orderBy("h", "rid").limit(POOL_ROWS).toArrow()
        held = spark.sparkContext.broadcast((pool.column("rid").to_numpy(), np.stack([pool.column(c).to_numpy() for c in "xy"], 1)))
        rows = edges.join(at.select(F.col("rid").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), "u").join(every.select(F.col("rid").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
        dealt = rows.select("block", "u", "ux", "uy", "v", "vx", "vy", "w").repartition(n, "block").sortWithinPartitions("block", "u", "v")
        fresh = dealt.mapInArrow(_epochs(held, a, b, epochs, k * epochs, rounds * epochs, seed), "rid long, x double, y double")
        # Rows without neighbours stay where they are.
        at = N.staged(at.join(fresh.select("rid", F.col("x").alias("x2"), F.col("y").alias("y2")), "rid", "left").select("rid", F.coalesce("x2", "x").alias("x"), F.coalesce("y2", "y").alias("y")), "places")
        held.destroy()
    return at


def _blocks(placed: DataFrame, cells: N.Cells) -> DataFrame:
    """Neighbouring cells together: their numbers follow the k-d tree."""
    total = placed.count()
    per = max(1, cells.count * BLOCK_ROWS // max(1, total))
    return placed.select("rid", (F.col("cell") / per).cast("long").alias("block"))


def project(vectors: DataFrame, id_col: str = "id", vector: str = "v", neighbours: int = NEIGHBOURS, min_dist: float = MIN_DIST, seed: int = SEED, rounds: int = ROUNDS, epochs: int = EPOCHS) -> DataFrame:
    """``(id, x, y)``: a place for every vector."""
    spark = vectors.sparkSession
    points = N.numbered(vectors, id_col, vector, unit=True)
    placed, cells = N.in_cells(points)
    graph = fuzzy_graph(N.nearest(spark, placed, cells, neighbours - 1))
    start = spectral(graph, placed, seed)
    at = arranged(graph, start, _blocks(placed, cells), rounds=rounds, epochs=epochs, min_dist=min_dist, seed=seed)
    firsts = placed.select("v", F.col("rid").alias("first"))
    return points.join(firsts, "v").join(at.withColumnRenamed("rid", "first"), "first").select("id", "x", "y")


def place_new(stored: DataFrame, places: DataFrame, fresh: DataFrame, id_col: str = "id", vector: str = "v", neighbours: int = NEIGHBOURS, min_dist: float = MIN_DIST, seed: int = SEED, rounds: int = 2, epochs: int = EPOCHS) -> DataFrame:
    """``(id, x, y)`` of ``fresh`` vectors on the map ``places`` of ``stored`` ones, which do not move.

    A new vector starts at the weighted mean of its nearest stored ones and is then arranged among them.
    """
    spark = stored.sparkSession
    points = N.numbered(stored, id_col, vector, unit=True)
    placed, cells = N.in_cells(points)
    new = N.numbered(fresh, id_col, vector, unit=True).withColumn("rid", -F.col("rid") - 1)  # apart from the stored rows
    asking = new.groupBy("v").agg(F.max("rid").alias("rid")).select("rid", "v")
    lists = N.nearest_to(spark, placed, cells, asking, neighbours)
    graph = N.staged(lists.mapInArrow(_weighted, "u long, v long, w double, k int").select("u", "v", "w"), "graph")
    known = places.select("id", "x", "y").join(points.select("id", "rid"), "id").select("rid", "x", "y")
    near = graph.join(known.withColumnRenamed("rid", "v"), "v")
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    start = N.staged(near.groupBy(F.col("u").alias("rid")).agg(mean("x"), mean("y")), "start")
    blocks = start.select("rid", F.pmod(F.xxhash64("rid"), F.lit(max(1, -(-start.count() // BLOCK_ROWS)))).alias("block"))
    at = arranged(graph, start, blocks, known, rounds, epochs, min_dist, seed)
    return new.join(asking.withColumnRenamed("rid", "first"), "v").join(at.withColumnRenamed("rid", "first"), "first").select("id", "x", "y")
