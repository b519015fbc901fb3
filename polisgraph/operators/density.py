"""Density clustering: core distances, the minimum spanning tree of mutual reachability, and a condensed tree.

Two rows are as far apart as the largest of their core distances and their distance, a row's core distance being that
of its ``min_samples``-th nearest other row.  Edges are ordered by weight and then by their rows, so there is one
spanning tree.  Links to nearest rows and the trees of single cells (``neighbours``) join all rows first.  Merging these links puts
the rows in a line in which the heaviest link of the way between two rows is the largest step between their places.  An edge that
is heavier than that way is in no tree, so each task takes two blocks of the line and keeps the pairs that are not: all pairs are
looked at, by products, but few are kept.  The edges found are then merged in that order, ``MERGE_EDGES`` to a task, each round starting from the components of
the one before.  Merging builds the condensed tree from its leaves: a component of ``min_size`` rows is a cluster, smaller ones
that join it fall out there, and two clusters that meet end as children of a new one.  A cluster that outweighs its
children's sum of stabilities stands for them; the topmost of those, the root aside, are the result.

Rows with equal vectors are tied to the first of them at their core distance.  Null vectors and those that are not finite
are left out; fewer than ``min_size`` rows are all noise; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polisgraph.operators import neighbours as N

MIN_SIZE, MIN_SAMPLES = 15, 5
#: Edges that one merging task takes.
MERGE_EDGES = 1_000_000
#: Distances below count as this one, so that densities stay finite.
LEAST_GAP = 1e-9
#: Edges that a task holds before it keeps only those of a spanning forest.
HELD_EDGES = 1 << 20


# ---------------------------------------------------------------- core distances and the spanning tree


def core_distances(placed: DataFrame, lists: DataFrame, min_samples: int) -> DataFrame:
    """``(rid, n, v, cell, core)``: copies count as neighbours at no distance; with too few rows the farthest counts."""
    rows = lists.select("rid", F.posexplode("list").alias("at", "e")).select("rid", "at", F.col("e.d").alias("d"), F.col("e.near").alias("near"))
    counted = rows.join(placed.select(F.col("rid").alias("near"), F.col("n").alias("more")), "near")
    far = counted.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("at", "d", "more"))).alias("l"))  # min_samples at most
    own = placed.join(far, "rid", "left")
    step = lambda a, x: F.when(a["left"] <= 0, a).otherwise(F.struct((a["left"] - x["more"]).alias("left"), x["d"].alias("core")))
    start = F.struct((F.lit(min_samples) - (F.col("n") - 1)).cast("long").alias("left"), F.lit(0.0).alias("core"))
    return own.select("rid", "n", "v", "cell", F.aggregate(F.coalesce("l", F.array().cast("array<struct<at:int,d:double,more:bigint>>")), start, step)["core"].alias("core"))


def prim(ids: np.ndarray, points: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and ends ``u < v`` of the spanning tree of a few rows; equal weights are ordered by their ends."""
    n = len(ids)
    weight, lo, hi = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
    out = np.zeros(n, bool)
    picked: list[int] = []
    at = 0
    for _ in range(n - 1):
        out[at] = True
        gap = np.maximum(np.maximum(core, core[at]), N.gaps(points[at][None], points)[0])
        a, b = np.minimum(ids, ids[at]), np.maximum(ids, ids[at])
        better = (gap < weight) | (gap == weight) & ((a < lo) | (a == lo) & (b < hi))
        better &= ~out
        weight[better], lo[better], hi[better] = gap[better], a[better], b[better]
        open_ = np.flatnonzero(~out)
        tied = open_[weight[open_] == weight[open_].min()]
        at = int(tied[np.lexsort((hi[tied], lo[tied]))[0]])
        picked.append(at)
    return weight[picked], lo[picked], hi[picked]


def _trees(batches):
    """Edges of the tree over each cell."""
    cell, parts = None, []

    def solved():
        ids, core = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (1, 3))
        w, u, v = prim(ids, np.concatenate([N.matrix(p.column(2)) for p in parts]), core)
        return pa.RecordBatch.from_arrays([pa.array(w, pa.float64()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["w", "u", "v"])

    for now, part in N.runs(batches, ["cell"]):
        if now != cell and parts:
            yield solved()
            parts = []
        cell = now
        parts.append(part)
    if parts:
        yield solved()


def known_edges(spark: SparkSession, cored: DataFrame, lists: DataFrame) -> DataFrame:
    """``(w, u, v)``: links to nearest rows, the tree of each cell and a tree over one row of each; together they join all rows."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trees = cored.select("cell", "rid", "v", "core").repartition(4 * n, "cell").sortWithinPartitions("cell").mapInArrow(_trees, "w double, u long, v long")
    one = cored.groupBy("cell").agg(F.min(F.struct("rid", "v", "core")).alias("r")).select("r.rid", "r.v", "r.core").toArrow()  # a row per cell
    w, u, v = prim(one.column("rid").to_numpy(), N.matrix(one.column("v")), one.column("core").to_numpy())
    across = spark.createDataFrame(list(zip(w.tolist(), u.tolist(), v.tolist(), strict=True)), "w double, u long, v long")
    near = lists.select("rid", F.explode("list").alias("e")).select("rid", F.col("e.d").alias("d"), F.col("e.near").alias("near"))
    ends = cored.select("rid", "core")
    both = near.join(ends, "rid").join(ends.select(F.col("rid").alias("near"), F.col("core").alias("core2")), "near")
    links = both.select(F.greatest("d", "core", "core2").alias("w"), F.least("rid", "near").alias("u"), F.greatest("rid", "near").alias("v"))
    return N.staged(links.unionByName(trees).unionByName(across).distinct(), "known")


class _Line:
    """Rows of joined components in one line each: of two, the smaller goes behind the larger, whose first row names both."""

    def __init__(self):
        self.root: dict[int, int] = {}
        self.behind: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.used: list[tuple] = []
        self.step: list[tuple] = []

    def find(self, x: int) -> int:
        path = []
        while (up := self.root.get(x, x)) != x:
            path.append(x)
            x = up
        total = 0
        for p in reversed(path):
            total += self.behind[p]
            self.behind[p], self.root[p] = total, x
        return x

    def edge(self, w: float, u0: int, v0: int, u: int, v: int) -> None:
        u, v = self.find(u), self.find(v)
        if u == v:
            return
        if (a := self.size.get(u, 1)) < (b := self.size.get(v, 1)):
            u, v, a, b = v, u, b, a
        self.root[v], self.behind[v], self.size[u] = u, a, a + b
        self.used.append((w, u0, v0))
        self.step.append((w, v))


def _lined(batches):
    """Rows of kind 0: edge used; 1: component, its new name and how many rows are before it; 2: size; 3: step before a row."""
    m = _Line()
    for batch in batches:
        for w, u0, v0, u, v, nu, nv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for x, n in ((u, nu), (v, nv)):
                if x not in m.root:
                    m.root[x] = x
                    m.size[x] = n or 1
            m.edge(w, u0, v0, u, v)
    out = [(0, w, u, v, None) for w, u, v in m.used] + [(3, w, row, None, None) for w, row in m.step]
    for x in list(m.root):
        top = m.find(x)
        out.append((2, None, x, None, m.size[x]) if top == x else (1, None, x, top, m.behind[x]))
    for at in range(0, len(out), 50_000):
        columns = zip(*out[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["kind", "w", "a", "b", "n"])


def in_line(spark: SparkSession, rows: DataFrame, edges: DataFrame, merge_edges: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``place`` and ``step``, and the edges ``(w, u, v)`` of a spanning tree of those given.

    On the tree's way between two rows the heaviest edge weighs as much as the largest ``step`` after the first of their places
    up to the second.
    """
    chunks = max(1, -(-edges.count() // merge_edges))
    dealt = edges.repartitionByRange(chunks, "w", "u", "v").withColumn("chunk", F.spark_partition_id())
    left = N.staged(dealt.select("chunk", "w", F.col("u").alias("u0"), F.col("v").alias("v0"), "u", "v"), "edges")
    at = rows.select("rid", F.col("rid").alias("part"), F.lit(0).cast("long").alias("place"))
    used = steps = sizes = None
    for k in range(chunks):
        now = left.where(F.col("chunk") == k)
        for end in "uv":
            now = now.withColumn(f"n{end}", F.lit(None).cast("long")) if sizes is None else now.join(sizes.select(F.col("a").alias(end), F.col("n").alias(f"n{end}")), end, "left")
        one = now.select("w", "u0", "v0", "u", "v", "nu", "nv").repartition(1).sortWithinPartitions("w", "u0", "v0")
        found = N.staged(one.mapInArrow(_lined, "kind int, w double, a long, b long, n long"), "lined")
        fresh, moved = found.where("kind = 2").select("a", "n"), found.where("kind = 1").select("a", "b", "n")
        used = (lambda x: x if used is None else used.unionByName(x))(found.where("kind = 0").select("w", F.col("a").alias("u"), F.col("b").alias("v")))
        steps = (lambda x: x if steps is None else steps.unionByName(x))(found.where("kind = 3").select(F.col("a").alias("rid"), F.col("w").alias("step")))
        at = N.staged(at.join(moved.withColumnRenamed("a", "part"), "part", "left").select("rid", F.coalesce("b", "part").alias("part"), (F.col("place") + F.coalesce("n", F.lit(0))).alias("place")), "line")
        if k < chunks - 1:
            gone = moved.select("a").unionByName(fresh.select("a"))
            sizes = fresh if sizes is None else N.staged(sizes.join(gone, "a", "left_anti").unionByName(fresh), "sizes")
            rest = left.where(F.col("chunk") > k)
            for end in "uv":
                rest = rest.join(moved.select(F.col("a").alias(end), F.col("b").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
            left = N.staged(rest.where("u <> v").select("chunk", "w", "u0", "v0", "u", "v"), "edges")
    placed = rows.join(at.select("rid", "place"), "rid").join(steps, "rid", "left").select(*rows.columns, "place", F.coalesce("step", F.lit(float("inf"))).alias("step"))
    return N.staged(placed, "in-line"), used


def forest(w: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges that a spanning forest of the given ones has, by weight and ends."""
    root: dict[int, int] = {}
    kept = []
    order = np.lexsort((v, u, w))
    for k, a, b in zip(order.tolist(), u[order].tolist(), v[order].tolist(), strict=True):
        while (up := root.get(a, a)) != a:
            root[a] = root.get(up, up)
            a = up
        while (up := root.get(b, b)) != b:
            root[b] = root.get(up, up)
            b = up
        if a != b:
            root[b] = a
            kept.append(k)
    return w[kept], u[kept], v[kept]


class _Pair:
    """Rows of one or two blocks of the line: those pairs that are not farther apart than the way between them."""

    def __init__(self, parts: list[pa.RecordBatch], border: int | None, between: float):
        self.ids, self.core, self.step = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (2, 4, 5))
        self.rows = N.Rows(np.concatenate([N.matrix(p.column(3)) for p in parts]))
        self.border, self.between = border, between

    def _edges(self, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.ids[i], self.ids[j]
        return w, np.minimum(a, b), np.maximum(a, b)

    def _of_run(self, run: np.ndarray):
        """Pairs of the run, and those of its rows with all later ones of the other block, or of this one if it is alone."""
        step, core, n = self.step[run], self.core[run], len(run)
        if self.border is None:
            later = np.arange(n) > np.arange(n)[:, None]
            way = np.maximum.accumulate(np.where(later, step[None], -np.inf), 1)
            w = np.maximum(np.maximum(core, core[:, None]), N.gaps(self.rows.x[run], self.rows.x[run]))
            i, j = np.nonzero(later & (w <= way))
            yield self._edges(run[i], run[j], w[i, j])
        rest = np.arange(run[-1] + 1 if self.border is None else self.border, len(self.ids))
        if not len(rest):
            return
        # The way from a row to one of ``rest``: the steps up to the end of the run, those between, those up to the other.
        up = np.r_[np.maximum.accumulate(step[:0:-1])[::-1], -np.inf]
        gap = self.step[run[-1] + 1 : rest[0]].max(initial=self.between)
        down = np.maximum(np.maximum.accumulate(self.step[rest]), gap)
        x = self.rows.x
        lo, hi = x[run].min(0), x[run].max(0)
        most = np.maximum(down, up.max())
        least = np.sqrt(np.square(np.maximum(0, np.maximum(lo - x[rest], x[rest] - hi))).sum(1)) * (1 - 1e-12)
        kept = np.maximum(np.maximum(least, self.core[rest]), core.min()) <= most
        rest, down = rest[kept], down[kept]
        if not len(rest):
            return
        own = core <= np.maximum(up, down.max())
        run, up = run[own], up[own]
        for i, j, d in N.within(self.rows.take(run), up, self.rows.take(rest), down):
            w = np.maximum(d, np.maximum(self.core[run[i]], self.core[rest[j]]))
            light = w <= np.maximum(up[i], down[j])
            yield self._edges(run[i[light]], rest[j[light]], w[light])

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, size = [], 0
        end = len(self.ids) if self.border is None else self.border
        for k in range(0, end, N.CELL_ROWS):
            for part in self._of_run(np.arange(k, min(k + N.CELL_ROWS, end))):
                found.append(part)
                size += len(part[0])
                if size > HELD_EDGES:
                    found = [forest(*(np.concatenate(c) for c in zip(*found, strict=True)))]
                    size = len(found[0][0])
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))


def _lighter(held):
    def lighter(batches):
        tops = held.value
        job, parts, border = None, [], None

        def solved():
            a, b = divmod(job, len(tops))
            w, u, v = _Pair(parts, border, float(tops[a + 1 : b].max(initial=-np.inf))).edges()
            return pa.RecordBatch.from_arrays([pa.array(w, pa.float64()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["w", "u", "v"])

        for (now, second), part in N.runs(batches, ["job", "second"]):
            if now != job:
                if parts:
                    yield solved()
                job, parts, border = now, [], None
            if second and border is None:
                border = sum(p.num_rows for p in parts)
            parts.append(part)
        if parts:
            yield solved()

    return lighter


def spanning_edges(spark: SparkSession, cored: DataFrame, lists: DataFrame, merge_edges: int) -> DataFrame:
    """``(w, u, v)`` with all edges of the spanning tree of distinct vectors, and some more."""
    line, tree = in_line(spark, cored.select("rid", "v", "core"), known_edges(spark, cored, lists), merge_edges)
    per = N.block_rows(line.count())
    blocks = line.withColumn("block", F.floor(F.col("place") / per))
    top = blocks.groupBy("block").agg(F.max("step").alias("step")).orderBy("block").collect()  # a row per block
    held, m = spark.sparkContext.broadcast(np.array([r["step"] for r in top])), len(top)
    first, second = F.least("block", "other"), F.greatest("block", "other")
    jobs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(0, m - 1))))).select((first * m + second).alias("job"), ((F.col("block") == second) & (first < second)).cast("int").alias("second"), "rid", "v", "core", "step", "place")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = jobs.repartition(4 * n, "job").sortWithinPartitions("job", "place").select("job", "second", "rid", "v", "core", "step")
    return N.staged(tree.unionByName(dealt.mapInArrow(_lighter(held), "w double, u long, v long")), "light")


# ---------------------------------------------------------------- the condensed tree

_STATE = "kind int, a long, b long, n long, x double, y double, own boolean, members array<long>"


class _Merge:
    """Components by union of their rows; states of those that are larger than one row.

    A state is (size, cluster or None, sum of densities at which rows fell out, children's value, rows while small).
    """

    def __init__(self, min_size: int, first_cluster: int):
        self.least, self.next = min_size, first_cluster
        self.root: dict[int, int] = {}
        self.state: dict[int, list] = {}
        self.fell: list[tuple[int, int]] = []
        self.ended: list[tuple] = []

    def find(self, x: int) -> int:
        path = []
        while (up := self.root.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.root[p] = x
        return x

    def _fall(self, s: list, cluster: int) -> None:
        self.fell += [(row, cluster) for row in s[4]]

    def edge(self, w: float, u: int, v: int) -> None:
        u, v = self.find(u), self.find(v)
        if u == v:
            return
        density = 1 / max(w, LEAST_GAP)
        a, b = self.state.pop(u, None) or [1, None, 0.0, 0.0, [u]], self.state.pop(v, None) or [1, None, 0.0, 0.0, [v]]
        if a[0] < b[0]:
            u, v, a, b = v, u, b, a
        self.root[v] = u
        size = a[0] + b[0]
        if b[1] is not None:  # two clusters end, their parent begins
            new, value = self.next, 0.0
            self.next += 1
            for s in (a, b):
                stability = s[2] - s[0] * density
                value += max(stability, s[3])
                self.ended.append((s[1], new, s[0], stability, stability >= s[3]))
            self.state[u] = [size, new, size * density, value, []]
        elif a[1] is not None:
            self._fall(b, a[1])
            self.state[u] = [size, a[1], a[2] + b[0] * density, a[3], []]
        elif size >= self.least:
            new = self.next
            self.next += 1
            self._fall(a, new)
            self._fall(b, new)
            self.state[u] = [size, new, size * density, 0.0, []]
        else:
            self.state[u] = [size, None, 0.0, 0.0, a[4] + b[4]]


def _merger(min_size: int, first_cluster: int):
    """Rows of kind 0: row and cluster it fell from; 1: cluster, parent, size, stability; 2: state; 3: old and new component."""

    def merge(batches):
        m = _Merge(min_size, first_cluster)
        for batch in batches:
            columns = {c: batch.column(k).to_pylist() for k, c in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                for end, s in (("u", "su"), ("v", "sv")):
                    x, state = columns[end][k], columns[s][k]
                    if state is not None and x not in m.root:
                        m.state[x] = [state["n"], state["b"], state["x"], state["y"], state["members"]]
                    m.root.setdefault(x, x)
                m.edge(columns["w"][k], columns["u"][k], columns["v"][k])
        out = [(0, a, b, None, None, None, None, None) for a, b in m.fell]
        out += [(1, a, b, n, x, None, own, None) for a, b, n, x, own in m.ended]
        out += [(2, a, s[1], s[0], s[2], s[3], None, s[4]) for a, s in m.state.items()]
        out += [(3, x, top, None, None, None, None, None) for x in list(m.root) if (top := m.find(x)) != x]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int64())]
        for at in range(0, max(1, len(out)), 50_000):
            columns = list(zip(*out[at : at + 50_000], strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "a", "b", "n", "x", "y", "own", "members"])

    return merge


def condensed(spark: SparkSession, edges: DataFrame, min_size: int, merge_edges: int) -> tuple[DataFrame, DataFrame]:
    """``(rid, cluster)`` of rows at the cluster that they fall from, and ``(cluster, parent, size, stability, own)``."""
    chunks = max(1, -(-edges.count() // merge_edges))
    dealt = edges.repartitionByRange(chunks, "w", "u", "v").withColumn("chunk", F.spark_partition_id())
    left = N.staged(dealt.select("chunk", "w", F.col("u").alias("u0"), F.col("v").alias("v0"), "u", "v"), "edges")
    fell = ended = states = None
    for k in range(chunks):
        now = left.where(F.col("chunk") == k)
        side = F.struct("n", "b", "x", "y", "members")
        for end in "uv":
            if states is None:
                now = now.withColumn(f"s{end}", F.lit(None).cast("struct<n:bigint,b:bigint,x:double,y:double,members:array<bigint>>"))
            else:
                now = now.join(states.select(F.col("a").alias(end), side.alias(f"s{end}")), end, "left")
        one = now.select("w", "u", "v", "u0", "v0", "su", "sv").repartition(1).sortWithinPartitions("w", "u0", "v0").select("w", "u", "v", "su", "sv")
        found = N.staged(one.mapInArrow(_merger(min_size, k << 40), _STATE), "merged")
        fresh, moved = found.where("kind = 2").select("a", "b", "n", "x", "y", "members"), found.where("kind = 3").select("a", "b")
        gone = moved.select("a").unionByName(fresh.select("a"))
        fell = (lambda x: x if fell is None else fell.unionByName(x))(found.where("kind = 0").select(F.col("a").alias("rid"), F.col("b").alias("cluster")))
        ended = (lambda x: x if ended is None else ended.unionByName(x))(found.where("kind = 1").select(F.col("a").alias("cluster"), F.col("b").alias("parent"), "n", F.col("x").alias("stability"), "own"))
        states = fresh if states is None else N.staged(states.join(gone, "a", "left_anti").unionByName(fresh), "states")
        if k < chunks - 1:
            rest = left.where(F.col("chunk") > k)
            for end in "uv":
                rest = rest.join(moved.select(F.col("a").alias(end), F.col("b").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
            left = N.staged(rest.where("u <> v").select("chunk", "w", "u0", "v0", "u", "v"), "edges")
    roots = states.where("b is not null").select(F.col("b").alias("cluster"), F.lit(None).cast("long").alias("parent"), "n", F.lit(None).cast("double").alias("stability"), F.lit(False).alias("own"))
    return fell, ended.unionByName(roots)


def topmost(clusters: DataFrame) -> DataFrame:
    """``(cluster, chosen)``: the topmost ancestor or self that stands for its children, by doubling of steps."""
    at = clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("own"), F.col("cluster")).alias("chosen"))
    at = N.staged(at, "chosen")
    while at.where("up is not null").limit(1).count():
        above = at.select(F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("chosen").alias("higher"))
        at = N.staged(at.join(above, "up", "left").select("cluster", F.col("up2").alias("up"), F.coalesce("higher", "chosen").alias("chosen")), "chosen")
    return at.select("cluster", "chosen")


def clusters(vectors: DataFrame, id_col: str = "id", vector: str = "v", min_size: int = MIN_SIZE, min_samples: int = MIN_SAMPLES, cell_rows: int = N.CELL_ROWS, merge_edges: int = MERGE_EDGES) -> DataFrame:
    """``(id, cluster, distance)``: clusters from 0 in the order of their smallest ids, -1 for noise.

    ``distance`` is that from the cluster's centroid, for noise from the centroid of all rows.
    """
    spark = vectors.sparkSession
    points = N.numbered(vectors, id_col, vector)
    placed, cells = N.in_cells(points, cell_rows)
    lists = N.nearest(spark, placed, cells, min_samples)
    cored = N.staged(core_distances(placed, lists, min_samples), "cores")
    edges = spanning_edges(spark, cored, lists, merge_edges)
    firsts = cored.where("n > 1").select(F.col("rid").alias("u"), "v", "core")
    copies = points.join(firsts, "v").where("rid <> u").select(F.col("core").alias("w"), "u", F.col("rid").alias("v"))
    fell, tree = condensed(spark, edges.unionByName(copies), min_size, merge_edges)
    labelled = points.select("rid", "id", "v").join(fell.join(topmost(tree), "cluster").select("rid", "chosen"), "rid", "left")
    labelled = N.staged(labelled.select("id", "v", "chosen"), "labelled")
    # Numbers of clusters: a row per cluster.
    order = labelled.where("chosen is not null").groupBy("chosen").agg(F.min("id").alias("first"))
    order = order.select("chosen", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("cluster"))
    return centroid_distances(labelled.join(order, "chosen", "left").select("id", "v", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster")))


def centroid_distances(rows: DataFrame) -> DataFrame:
    def sums(batches):
        for (cluster,), part in N.runs(batches, ["cluster"]):
            x = N.matrix(part.column(1))
            d = x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, cluster), pa.int64()), pa.array(np.arange(d), pa.int32()), pa.array(x.sum(0)), pa.array(np.full(d, len(x)), pa.int64())], ["cluster", "d", "s", "n"])

    parts = rows.select("cluster", "v").sortWithinPartitions("cluster").mapInArrow(sums, "cluster long, d int, s double, n long")
    parts = N.staged(parts.groupBy("cluster", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), "sums")
    whole = parts.groupBy("d").agg(F.lit(-1).cast("long").alias("cluster"), F.sum("s").alias("s"), F.sum("n").alias("n")).select("cluster", "d", "s", "n")
    means = parts.where("cluster >= 0").unionByName(whole).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", (F.col("s") / F.col("n")).alias("m")))), lambda e: e["m"]).alias("c"))

    def away(batches):
        for batch in batches:
            if batch.num_rows:
                c = batch.column(3)
                gap = np.sqrt(np.square(N.matrix(batch.column(1)) - c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(gap)], ["id", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.join(means, "cluster").select("id", "v", "cluster", "c").mapInArrow(away, f"id {kind}, cluster long, distance double")
