"""Exact nearest neighbours of vectors, cell by cell.

A k-d tree over a bounded sample cuts space into cells; each cell's true bounds are then measured over all rows.  A row
finds neighbours in its own cell first.  The k-th distance there bounds the search.  Neighbouring cells make a block: a task
holds a block's rows with the lists they have so far and streams the cells that any of them may need, so each cell is sent
to ``BLOCKS`` blocks at most (more where a block would pass ``BLOCK_ROWS``) and bounds tighten on the way.  A streamed cell meets only
rows whose bound reaches its own.  Pairs are sifted by products in single precision with a margin above their rounding, and
those left are measured.  With many dimensions that carry equal weight few cells can be ruled out: then the work is that of
all pairs, but memory, rows sent and rows written are not.  Equal vectors are searched once, as one row with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polisgraph.session import new_path

#: Rows that the k-d tree is cut by, rows that a cell should hold, and numbers that all cells' bounds may have.
SAMPLE_ROWS, CELL_ROWS, BOUND_NUMBERS = 100_000, 512, 1 << 18
#: Differences that are held at once, and products.
HELD_NUMBERS, HELD_PRODUCTS = 1 << 21, 1 << 18
#: Blocks that rows are dealt to, and rows that a block holds at most: more rows make more blocks.
BLOCKS, BLOCK_ROWS = 48, 16_384


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(vectors: DataFrame, id_col: str, vector: str, unit: bool = False) -> DataFrame:
    """``(rid, id, v)`` with a row number in the order of ids and the vector's bytes, of length 1 if asked for.

    Rows whose vector is null, empty or holds a null or a number that is not finite are left out, with ``unit`` also those
    of length 0.
    """
    x = F.transform(F.col(vector).cast("array<double>"), lambda c: c + F.lit(0.0))  # no negative zeros
    rows = vectors.select(F.col(id_col).alias("id"), x.alias("x")).where(F.size("x") > 0)
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            cut = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            out = [flat[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            if unit:
                norms = [np.sqrt(np.square(v).sum()) for v in out]
                out = [v / n if n else None for v, n in zip(out, norms, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if v is None else v.astype("<f8").tobytes() for v in out], pa.binary())], ["id", "v"])

    kind = rows.schema["id"].dataType.simpleString()
    packed = rows.mapInArrow(pack, f"id {kind}, v binary").where("v is not null")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = packed.repartitionByRange(n, "id", "v").sortWithinPartitions("id", "v")
    return staged(order.select(F.monotonically_increasing_id().alias("rid"), "id", "v"), "numbered")


def matrix(column) -> np.ndarray:
    """Rows of a binary column as a matrix; rows of different lengths raise an error."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1) if values else np.zeros((0, 0))


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` from all of ``b``, which both are parts of one cell or batch."""
    step = max(1, HELD_NUMBERS // max(1, b.size))
    return np.concatenate([np.sqrt(np.square(a[k : k + step, None] - b[None]).sum(-1)) for k in range(0, len(a), step)]) if len(a) else np.zeros((0, len(b)))


def one_thread(spark: SparkSession) -> None:
    """Products in tasks take the one core that a task has; without this each takes all cores of its machine."""
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")


class Rows:
    """Vectors, and what a product needs to tell that two of them are far apart."""

    def __init__(self, x: np.ndarray):
        self.x = x
        with np.errstate(over="ignore", invalid="ignore"):
            low = x.astype(np.float32)
            # Less than the square by more than all rounding of a product of both forms.
            square = np.square(low).sum(1, keepdims=True) * np.float32(1 - (4 * x.shape[1] + 32) * 2.0**-24)
            one = np.ones_like(square)
            self.left, self.right = np.concatenate([low, square, one], 1), np.concatenate([-2 * low, one, square], 1)
            self.told = bool((square < 1e37).all())

    def __len__(self) -> int:
        return len(self.x)

    def take(self, rows: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        out.x, out.left, out.right, out.told = self.x[rows], self.left[rows], self.right[rows], self.told
        return out


def within(a: Rows, reach: np.ndarray, b: Rows, other: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, distance)`` of all rows of ``a`` and ``b`` that are at most ``reach[i]``, or the larger ``other[j]``, apart."""
    with np.errstate(over="ignore", invalid="ignore"):
        ra, rb = ((np.square(r) * (1 + 1e-6) + 1e-30).astype(np.float32) if r is not None else None for r in (reach, other))
        step = max(1, HELD_PRODUCTS // max(1, len(b)))
        most = max(1, HELD_NUMBERS // max(1, a.x.shape[1]))
        for k in range(0, len(a), step):
            near = a.left[k : k + step] @ b.right.T <= (ra[k : k + step, None] if other is None else np.maximum(ra[k : k + step, None], rb))
            if not (a.told and b.told):
                near[:] = True  # too large for products: all are measured
            i, j = np.divmod(np.flatnonzero(near), max(1, len(b)))
            i += k
            for at in range(0, len(i), most):
                u, v = i[at : at + most], j[at : at + most]
                d = np.sqrt(np.square(a.x[u] - b.x[v]).sum(-1))
                kept = d <= (reach[u] if other is None else np.maximum(reach[u], other[v]))
                yield u[kept], v[kept], d[kept]


# ---------------------------------------------------------------- cells


class Cells:
    """The cuts of a k-d tree, and the bounds of its leaves over all rows."""

    def __init__(self, sample: np.ndarray, leaf: int):
        self.dim, self.at, self.low, self.high = [], [], [], []
        self.count = 0
        self._cut(sample, np.arange(len(sample)), leaf)
        self.dim, self.low, self.high = (np.array(x, np.int64) for x in (self.dim, self.low, self.high))
        self.at = np.array(self.at, np.float64)

    def _cut(self, sample: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        """The number of a node; leaves are negative."""
        part = sample[rows]
        if len(rows) > leaf:
            wide = part.max(0) - part.min(0)
            d = int(wide.argmax())
            middle = float(np.median(part[:, d]))
            right = part[:, d] >= middle if middle > part[:, d].min() else part[:, d] > middle
            if wide[d] > 0 and right.any() and not right.all():
                me = len(self.dim)
                self.dim.append(d)
                self.at.append(float(part[right, d].min()))
                self.low.append(0)
                self.high.append(0)
                self.low[me] = self._cut(sample, rows[~right], leaf)
                self.high[me] = self._cut(sample, rows[right], leaf)
                return me
        self.count += 1
        return -self.count

    def of(self, points: np.ndarray) -> np.ndarray:
        """Each point's leaf, from 0."""
        node = np.full(len(points), 0 if len(self.dim) else -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            n = node[inner]
            node[inner] = np.where(points[inner, self.dim[n]] >= self.at[n], self.high[n], self.low[n])
        return -node - 1


def in_cells(points: DataFrame, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, Cells]:
    """Distinct vectors ``(rid, n, v, cell)``, ``n`` rows each, and their cells with bounds ``lo`` and ``hi``."""
    distinct = staged(points.groupBy("v").agg(F.min("rid").alias("rid"), F.count("*").alias("n")), "distinct")
    total = distinct.count()
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    drawn = distinct if share == 1 else distinct.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = drawn.select("v").toArrow().column("v")  # about SAMPLE_ROWS rows
    sample = matrix(rows)
    most = max(1, BOUND_NUMBERS // max(1, sample.shape[1]))
    cells = Cells(sample, max(1, int(max(cell_rows, total / most) * share)))
    held = points.sparkSession.sparkContext.broadcast(cells)

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.of(matrix(batch.column(2))) if batch.num_rows else [], pa.int64())], ["rid", "n", "v", "cell"])

    found = staged(distinct.select("rid", "n", "v").mapInArrow(place, "rid long, n long, v binary, cell long"), "cells")

    def bounds(batches):
        lo: dict[int, np.ndarray] = {}
        hi: dict[int, np.ndarray] = {}
        for batch in batches:
            x, c = matrix(batch.column(1)), batch.column(0).to_numpy()
            for k in np.unique(c).tolist():
                a, b = x[c == k].min(0), x[c == k].max(0)
                lo[k], hi[k] = (np.minimum(lo[k], a), np.maximum(hi[k], b)) if k in lo else (a, b)
        keys = [(k, d) for k in lo for d in range(len(lo[k]))]
        columns = [[k for k, _ in keys], [d for _, d in keys], [lo[k][d] for k, d in keys], [hi[k][d] for k, d in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())], ["cell", "d", "lo", "hi"])

    cells.total = total
    rows = found.select("cell", "v").mapInArrow(bounds, "cell long, d int, lo double, hi double").groupBy("cell", "d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    width = sample.shape[1]
    cells.lo, cells.hi = np.full((cells.count, width), np.inf), np.full((cells.count, width), -np.inf)
    for r in rows:  # BOUND_NUMBERS at most
        cells.lo[r["cell"], r["d"]], cells.hi[r["cell"], r["d"]] = r["lo"], r["hi"]
    return found, cells


def beyond(cells: Cells, points: np.ndarray) -> np.ndarray:
    """Least distance of each point from each cell's bounds; endless for cells without rows."""
    step = max(1, HELD_NUMBERS // max(1, cells.lo.size))
    out = []
    for k in range(0, len(points), step):
        p = points[k : k + step, None]
        with np.errstate(invalid="ignore"):
            out.append(np.sqrt(np.square(np.maximum(0, np.maximum(cells.lo[None] - p, p - cells.hi[None]))).sum(-1)))
    return np.concatenate(out) if out else np.zeros((0, cells.count))


# ---------------------------------------------------------------- search


def runs(batches, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of batches within which the key columns are constant."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        for a, b in zip(np.r_[0, change].tolist(), np.r_[change, batch.num_rows].tolist(), strict=True):
            yield tuple(int(v[a]) for v in values), batch.slice(a, b - a)


def _search(k: int):
    """Lists of the ``k`` nearest rows of a cell; rows of the cell (``asks`` 0) come before those that ask (1)."""

    def search(batches):
        cell, ids, parts, held = None, [], [], None
        for (now, asks), part in runs(batches, ["cell", "asks"]):
            if now != cell:
                cell, ids, parts, held = now, [], [], None
            if not asks:
                ids.append(part.column(2).to_numpy())
                parts.append(matrix(part.column(3)))
                continue
            if held is None:
                held = (np.concatenate(ids), np.concatenate(parts)) if ids else (np.zeros(0, np.int64), np.zeros((0, 1)))
            own, points, bound = part.column(2).to_numpy(), matrix(part.column(3)), part.column(4).to_numpy()
            if not len(held[0]):
                continue
            step = max(1, HELD_NUMBERS // max(1, held[1].size))
            for at in range(0, len(own), step):
                far = gaps(points[at : at + step], held[1])
                far[held[0][None] == own[at : at + step, None]] = np.inf
                far[far > bound[at : at + step, None]] = np.inf
                order = np.lexsort((np.broadcast_to(held[0], far.shape), far), axis=1)[:, :k]
                near = np.take_along_axis(far, order, 1)
                kept = np.isfinite(near)
                row = np.repeat(own[at : at + step], kept.sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(near[kept]), pa.array(held[0][order[kept]], pa.int64())], ["rid", "d", "near"])

    return search


def _asked(placed: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    rows = placed.select("cell", F.lit(0).alias("asks"), "rid", "v", F.lit(0.0).alias("bound")).unionByName(asking.withColumn("asks", F.lit(1)))
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(4 * n, "cell").sortWithinPartitions("cell", "asks").select("cell", "asks", "rid", "v", "bound")
    return dealt.mapInArrow(_search(k), "rid long, d double, near long")


def best_lists(found: DataFrame, k: int) -> DataFrame:
    """``(rid, list)`` with the ``k`` nearest of all rows found, nearest first, ties by row."""
    return found.groupBy("rid").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "near"))), 1, k).alias("list"))


def box_gap(cells: Cells, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least distance of each cell's bounds from those of one other; endless or no number for cells without rows."""
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.square(np.maximum(0, np.maximum(cells.lo - hi, lo - cells.hi))).sum(1))


def block_rows(total: int) -> int:
    return min(BLOCK_ROWS, max(1, -(-total // BLOCKS)))


def _met(held):
    """Blocks and the cells that their rows may find neighbours in."""

    def met(batches):
        cells, bound, per = held.value
        for batch in batches:
            for a in batch.column(0).to_pylist():
                far = box_gap(cells, cells.lo[a], cells.hi[a])
                other = np.flatnonzero((far * (1 - 1e-12) <= bound[a]) & np.isfinite(far) & (np.arange(cells.count) != a))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), a // per), pa.int32()), pa.array(other, pa.int64())], ["block", "cell"])

    return met


class _Lists:
    """The rows of a block, each with the ``k`` nearest rows that it met."""

    def __init__(self, parts: list[pa.RecordBatch], k: int):
        self.cell, self.ids = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (2, 3))
        self.rows = Rows(np.concatenate([matrix(p.column(4)) for p in parts]))
        self.d, self.near = np.full((len(self.ids), k), np.inf), np.full((len(self.ids), k), np.iinfo(np.int64).max)
        at = 0
        for p in parts:
            lists = p.column(5)
            size = lists.value_lengths().fill_null(0).to_numpy()
            row, place = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            flat = lists.flatten()
            self.d[at + row, place], self.near[at + row, place] = flat.field("d").to_numpy(), flat.field("near").to_numpy()
            at += len(size)

    def meet(self, cell: int, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes rows of a cell into the lists of the rows of all other cells."""
        bound = self.d[:, -1]
        p = self.rows.x
        least = np.sqrt(np.square(np.maximum(0, np.maximum(lo - p, p - hi))).sum(1))
        asks = np.flatnonzero((least * (1 - 1e-12) <= bound) & (self.cell != cell))
        if not len(asks):
            return
        whole = len(asks) == len(p)
        found = list(within(self.rows if whole else self.rows.take(asks), bound[asks], Rows(x)))
        i, j, d = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        if not len(i):
            return
        k = self.d.shape[1]
        i = asks[i]
        rows = np.unique(i)
        row, d, near = np.r_[np.repeat(rows, k), i], np.r_[self.d[rows].ravel(), d], np.r_[self.near[rows].ravel(), ids[j]]
        order = np.lexsort((near, d, row))
        first = np.searchsorted(row[order], rows)
        best = order[(first[:, None] + np.arange(k)).ravel()]
        self.d[rows], self.near[rows] = d[best].reshape(-1, k), near[best].reshape(-1, k)

    def out(self) -> pa.RecordBatch:
        held = np.isfinite(self.d)
        offsets = np.r_[0, np.cumsum(held.sum(1))]
        entries = pa.StructArray.from_arrays([pa.array(self.d[held]), pa.array(self.near[held], pa.int64())], ["d", "near"])
        return pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)], ["rid", "list"])


def _blockwise(held, k: int):
    """Lists of the rows of each block (``streamed`` 0), which come before the cells that they may need (1)."""

    def search(batches):
        cells = held.value[0]
        block, parts, lists = None, [], None
        for (now, streamed, cell), part in runs(batches, ["block", "streamed", "cell"]):
            if now != block:
                if parts:
                    yield (lists or _Lists(parts, k)).out()
                block, parts, lists = now, [], None
            if not streamed:
                parts.append(part)
                continue
            lists = lists or _Lists(parts, k)
            lists.meet(cell, cells.lo[cell], cells.hi[cell], part.column(3).to_numpy(), matrix(part.column(4)))
        if parts:
            yield (lists or _Lists(parts, k)).out()

    return search


_LIST = "array<struct<d:double,near:bigint>>"


def nearest(spark: SparkSession, placed: DataFrame, cells: Cells, k: int) -> DataFrame:
    """``(rid, list)``: the ``k`` nearest other distinct vectors of each, or all if there are fewer."""
    one_thread(spark)
    endless = F.lit(float("inf"))
    own = staged(best_lists(_asked(placed, placed.select("cell", "rid", "v", endless.alias("bound")), k), k), "own-cell")
    asking = staged(placed.join(own, "rid", "left").select("cell", "rid", "v", F.col("list").cast(_LIST).alias("list")), "asking")
    reach = F.when(F.coalesce(F.size("list"), F.lit(0)) >= k, F.get("list", F.lit(k - 1))["d"]).otherwise(endless)
    bound = np.zeros(cells.count)
    for r in asking.groupBy("cell").agg(F.max(reach).alias("reach")).collect():  # a row per cell
        bound[r["cell"]] = r["reach"]
    per = max(1, cells.count * block_rows(cells.total) // max(1, cells.total))
    held = spark.sparkContext.broadcast((cells, bound, per))
    needed = spark.range(cells.count, numPartitions=max(1, min(cells.count // 64, 1000))).mapInArrow(_met(held), "block int, cell long").distinct()
    streamed = asking.join(needed, "cell").select("block", F.lit(1).alias("streamed"), "cell", "rid", "v", F.lit(None).cast(_LIST).alias("list"))
    rows = asking.select((F.col("cell") / per).cast("int").alias("block"), F.lit(0).alias("streamed"), "cell", "rid", "v", "list").unionByName(streamed)
    dealt = rows.repartitionById(-(-cells.count // per), F.col("block")).sortWithinPartitions("block", "streamed", "cell")
    return staged(dealt.mapInArrow(_blockwise(held, k), f"rid long, list {_LIST}"), "nearest")


def _routed(cells_held):
    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = cells_held.value
            points, bound = matrix(batch.column(1)), batch.column(2).to_numpy()
            far = beyond(cells, points)
            far[np.arange(len(points)), batch.column(3).to_numpy()] = np.inf  # its own cell was searched
            row, cell = np.nonzero((far * (1 - 1e-12) <= bound[:, None]) & np.isfinite(far))
            for at in range(0, len(row), 10_000):
                r = pa.array(row[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(cell[at : at + 10_000], pa.int64()), batch.column(0).take(r), batch.column(1).take(r), batch.column(2).take(r)], ["cell", "rid", "v", "bound"])

    return route


def _into_cells(cells_held):
    def place(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells_held.value.of(matrix(batch.column(1))), pa.int64())], ["rid", "v", "cell"])

    return place


def nearest_to(spark: SparkSession, placed: DataFrame, cells: Cells, asking: DataFrame, k: int) -> DataFrame:
    """``(rid, list)``: for rows ``(rid, v)`` that are not in ``placed``, the ``k`` nearest that are."""
    endless = F.lit(float("inf"))
    held = spark.sparkContext.broadcast(cells)
    at = staged(asking.select("rid", "v").mapInArrow(_into_cells(held), "rid long, v binary, cell long"), "asking")
    own = staged(best_lists(_asked(placed, at.select("cell", "rid", "v", endless.alias("bound")), k), k), "own-cell")
    bound = F.when(F.size("list") >= k, F.get("list", F.lit(k - 1))["d"]).otherwise(endless)
    more = at.join(own.select("rid", bound.alias("bound")), "rid", "left").select("rid", "v", F.coalesce("bound", endless).alias("bound"), "cell")
    other = _asked(placed, more.mapInArrow(_routed(held), "cell long, rid long, v binary, bound double"), k)
    flat = own.select("rid", F.explode("list").alias("e")).select("rid", "e.d", "e.near")
    return staged(best_lists(flat.unionByName(other), k), "nearest")
