"""Exact top-k inner products by Fagin's threshold algorithm.

Components are turned into whole numbers, ``floor(256 * x)``.  Candidates are dealt into blocks of about
``BLOCK_ROWS`` rows; a task gets one block, sorts it by every dimension once, and streams the queries past it from
files in the shared folder, so neither side is copied for the other.  A query walks the block's lists, those that
hold most of the bound first, from the end that its sign prefers, scores each row that it meets for the first time,
and stops when the bound of the rows not met cannot beat its k-th score, or when no row is left that it has not met.
The bound is the sum of its weights times the lists' current values, or the product of its length and the longest
row's, if that is smaller.  A tie of the bound goes on, since a row not met could win it by its smaller id.  One
block is searched first; its k-th scores are floors for the others, which stop at them and report only what reaches
them.

Both sides are first turned to the candidates' principal axes, which leaves every product as it is: where dimensions go
together, a few lists then hold most of a score and the bound falls early.  Turned values serve the lists and the bound,
with a margin for rounding; scores are products of the whole numbers.  Where a vector's directions are all alike the
bound can only fall after nearly every row was met, whatever the axes.

Defined cases: rows with a null id, a null or empty vector, or a null or non-finite component take no part;
vectors are compared with vectors of the same length only; a query meets no row of its own id; equal rows are
gathered with their number first and each takes a rank; a query id with several vectors is ranked over all of
them together; an empty table has no result.  Components too large for exact sums in doubles are multiplied as whole
numbers of any size; a reported score beyond 64 bits raises an error.  Input columns other than the id and the vector
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polisgraph.llm import _common as C

K = 5
SCALE = 256
BLOCK_ROWS = 8192
#: Vectors of up to so many bytes (1024 components), of up to so many lengths, are turned to their principal axes.
TURNED, LENGTHS = 8192, 4
#: Rows of a list that a query walks at first; each further time it goes twice as deep.
FIRST_DEPTH = 8


class SortedLists:
    """A block of candidates, sorted by every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray | None = None):
        first = np.argsort(ids, kind="stable")  # equal scores then come in order of id
        self.ids, vectors = ids[first], vectors[first]
        self.small = bool(np.abs(vectors).max(initial=0) < 1 << 20)
        # Sums up to 2**53 are exact in doubles; larger whole numbers are Python's.
        self.vectors = vectors if self.small else np.vectorize(int, otypes=[object])(vectors)
        self.axes = axes if self.small else None
        turned = self.vectors if self.axes is None else vectors @ self.axes
        self.order = np.argsort(-turned, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(turned, self.order, axis=0)
        self.longest = float(np.sqrt((vectors**2).sum(axis=1).max(initial=0))) * (1 + 1e-9)
        self.scored = 0

    def best(self, query: np.ndarray, k: int, own: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows whose id is not ``own`` and whose score is at least ``floor``."""
        n = len(self.ids)
        small = self.small and bool(np.abs(query).max(initial=0) < 1 << 20)
        vectors = self.vectors if small or not self.small else self.vectors.astype(np.int64).astype(object)
        q = query if small else np.vectorize(int, otypes=[object])(query)
        along = q if self.axes is None else query @ self.axes
        used = np.flatnonzero(along)
        weights, falling = along[used], along[used] > 0
        reach = float(np.sqrt((query**2).sum())) * self.longest * (1 + 1e-9)
        seen = np.zeros(n, bool)
        places, scores = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        depth = np.zeros(len(used), np.int64)  # rows walked of each list
        bound, margin = reach, 0 if self.axes is None else 1e-9 * reach
        while True:
            worst = scores.min() if len(places) >= k else None
            worst = floor if worst is None or floor is not None and floor > worst else worst
            if seen.all() or worst is not None and bound < worst:
                return places, scores
            if len(used):
                at = np.where(falling, np.maximum(depth - 1, 0), n - np.maximum(depth, 1))
                terms = weights * self.values[at, used]
                # Lists that hold half as much of the bound as the first go on; any choice keeps the bound true.
                going = terms >= terms.max() / 2 if terms.max() > 0 else np.ones(len(used), bool)
                fresh = np.zeros(n, bool)
                for level in np.unique(depth[going]).tolist():
                    lists = going & (depth == level)
                    to = min(n, max(FIRST_DEPTH, 2 * level))
                    fresh[self.order[level:to, used[lists & falling]].ravel()] = True
                    fresh[self.order[n - to : n - level, used[lists & ~falling]].ravel()] = True
                    depth[lists] = to
                fresh = np.flatnonzero(fresh & ~seen)
                at = np.where(falling, depth - 1, n - depth)
                at = np.where(depth > 0, at, np.where(falling, 0, n - 1))
                bound = min(reach, (weights * self.values[at, used]).sum() + margin)
            else:
                fresh = np.flatnonzero(~seen)  # every score is 0
            seen[fresh] = True
            self.scored += len(fresh)
            fresh = fresh[self.ids[fresh] != own]
            found = vectors[fresh] @ q
            if floor is not None:
                keep = np.asarray(found >= floor, bool)
                fresh, found = fresh[keep], found[keep]
            places, scores = np.concatenate([places, fresh]), np.concatenate([scores, found])
            if len(places):
                keep = np.array(sorted(range(len(places)), key=lambda i: (-scores[i], places[i]))[:k]) if not small else np.lexsort((places, -scores))[:k]
                places, scores = places[keep], scores[keep]


def _numbers(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<f8").reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch | pa.Table):
    """The rows of each vector length."""
    import pyarrow.compute as pc

    size = pc.binary_length(batch.column(1))
    for n in pc.unique(size).to_pylist():
        yield n, batch.filter(pc.equal(size, n))


def _moments(batches):
    """Sums of the products of components, for each vector length up to ``TURNED`` bytes, over a task's rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.schema.names[1] == "v":
            for n, part in _by_length(batch):
                if n <= TURNED:
                    v = _numbers(part["v"])
                    sums[n] = sums.get(n, 0) + v.T @ v
        else:
            for n, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[n] = sums.get(n, 0) + np.frombuffer(m).reshape(n // 8, n // 8)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), C.binary([m.tobytes() for m in sums.values()])], ["id", "m"])


def principal_axes(cands: DataFrame) -> dict[int, np.ndarray]:
    """The principal axes of the vectors of each of the ``LENGTHS`` shortest lengths, from all rows, by bytes of a vector."""
    part = cands.select("id", "v").mapInArrow(_moments, "id long, m binary")
    lengths = [r["id"] for r in part.select("id").distinct().orderBy("id").limit(LENGTHS).collect()]
    whole = part.where(F.col("id").isin(*lengths)).repartition(8).mapInArrow(_moments, "id long, m binary")
    sums: dict[int, np.ndarray] = {}
    for r in whole.toLocalIterator():  # a matrix for each of eight tasks and length
        sums[r["id"]] = sums.get(r["id"], 0) + np.frombuffer(r["m"]).reshape(r["id"] // 8, -1)
    return {n: np.linalg.eigh(m)[1][:, ::-1] for n, m in sums.items() if np.isfinite(m).all()}


def _searcher(folder: str, k: int, axes):
    def search(batches):
        import pyarrow.dataset as ds

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = {n: SortedLists(part["id"].to_numpy(), _numbers(part["v"]), axes.value.get(n)) for n, part in _by_length(rows)}
        copies = dict(zip(rows["id"].to_pylist(), rows["n"].to_pylist(), strict=True)) if max(rows["n"].to_pylist()) > 1 else {}
        fs, root = C.local_folder(folder)
        for queries in ds.dataset(root, format="parquet", filesystem=fs).to_batches(columns=["id", "v", "floor"], batch_size=4096, fragment_readahead=1, batch_readahead=1):
            for n, part in _by_length(queries):
                if n not in lists or not part.num_rows:
                    continue
                out: list[list] = [[], [], [], []]
                for own, vector, floor in zip(part["id"].to_pylist(), _numbers(part["v"]), part["floor"].to_pylist(), strict=True):
                    places, scores = lists[n].best(vector, k, own, floor)
                    ids = lists[n].ids[places].tolist()
                    out[0] += [own] * len(ids)
                    out[1] += ids
                    out[2] += [int(x) for x in scores]  # beyond 64 bits Arrow raises
                    out[3] += [copies.get(i, 1) for i in ids]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score", "n"])

    return search


def _packer(scale: int):
    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype("<f8")
            cut = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([batch.column(0), C.binary([(flat[a:b] + 0.0).tobytes() for a, b in zip(cut, cut[1:], strict=False)])], ["id", "v"])

    return pack


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows of ``vectors`` for every row of ``queries``."""
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        x = F.col("v")
        fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
        return rows.mapInArrow(_packer(scale), "id long, v binary").groupBy("id", "v").agg(F.count("*").alias("n"))

    cands = C.staged(whole(vectors), "vectors")
    blocks = max(1, -(-cands.count() // block_rows))
    axes = spark.sparkContext.broadcast(principal_axes(cands))
    dealt = cands.withColumn("block", C.salted_bucket(blocks, "id", "v"))
    folder = C.new_path(spark, "queries")
    whole(queries).select("id", "v", F.lit(None).cast("long").alias("floor")).write.parquet(folder)
    asked = spark.read.schema("id long, v binary, floor long").parquet(folder)

    def searched(rows: DataFrame, folder: str) -> DataFrame:
        found = rows.repartitionById(blocks, "block").select("id", "v", "n").mapInArrow(_searcher(folder, k, axes), "query_id long, vec_id long, score long, n long")
        # Copies of a row each take a rank; a repeat beyond k ranks is never reported.
        return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy")
    found = searched(dealt.where("block = 0"), folder)
    if blocks > 1:
        found = C.staged(found, "first-block")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        floors = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("low"))
        again = C.new_path(spark, "queries")
        asked.join(floors, "id", "left").select("id", "v", F.col("low").alias("floor")).write.parquet(again)
        found = found.unionByName(searched(dealt.where("block > 0"), again))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = C.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP7_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= {K}
"""
