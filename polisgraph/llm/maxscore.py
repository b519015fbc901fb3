"""Ranked lexical search: an inverted index in shards, and MaxScore in each shard.

``build_index`` writes one row per shard.  A shard holds the documents of about ``SHARD_BYTES`` of one task's text, in id
order, with a sorted lexicon of term hashes and, for each term, ascending document places and occurrences.  Every term of
every document is indexed; texts are neither shuffled nor kept.

``search`` takes queries in blocks of about ``BLOCK_TERMS`` terms, which are the only things broadcast.  A first pass reads
the lexicons and sums document frequencies; a second one searches each shard by itself.  There, a term's upper bound is
its weight times the largest value in its list.  A shard's floor starts at the best k-th value of any one list.  Terms
are ordered by upper bound; those whose bounds together stay below the floor are non-essential.  Documents are taken in
windows of ``WINDOW_DOCS``: the essential lists name the candidates of a window, and the non-essential lists are probed, the
highest bound first, only for candidates that can still reach the floor, which then rises to the k-th score found.
Equal scores are kept until ids settle them.  A window over the shards' best rows gives the whole table's.

A term's number is 64 bits of a hash.  With ``N`` documents of at least one term, ``L`` terms in all, ``n`` in a document, a
term found ``tf`` times there and in ``df`` documents adds ``w * (1000000000*tf div (1000*tf + 8*m))``, where ``m`` is
``25 + 75*n*N div L`` and ``w`` is ``floor(1000*ln((2*N+2)/(2*df+1)))``.

Defined cases: null and termless texts have no terms, count as no documents and are never found; null ids rank behind
others of their score; repeated rows are found one by one, each with a rank of its own; repeated items (equal id and text)
are one item, and rows of one item id with different texts pool their terms; an item with a null id is an item; empty
tables give no rows.  Only the id and text columns are read, so further columns may have any names.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polisgraph.llm import _common as C

K = 10
#: Text bytes and documents of one shard, and text bytes that are hashed at a time.
SHARD_BYTES, SHARD_DOCS, SLICE_BYTES = 8 << 20, 1 << 16, 2 << 20
WINDOW_DOCS = 2048
#: Distinct terms of the items that are searched, and broadcast, at a time.
BLOCK_TERMS = 1_000_000
#: A shard is a row group by itself: a writer holds a hundred rows before it looks at their size, a reader holds a whole group.
#: A shard's arrays do not repeat, so no dictionary of them is tried.
STORED = {"parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
_KEPT = C.kept("maxscore")


# ---------------------------------------------------------------- index


def _counted(data: np.ndarray, offsets: np.ndarray, limit: int):
    """``(row, hash, count)`` arrays of slices of rows; a long row comes in pieces cut between terms."""
    for a, b in C.row_slices(offsets, limit):
        at, stop = int(offsets[a]), int(offsets[b])
        while at < stop:
            to = stop
            if b - a == 1 and stop - at > limit:
                to = at + limit
                while to < stop and C.ALNUM[data[to]]:
                    to += 1
            cut = np.clip(offsets[a : b + 1], at, to) - at
            starts, ends, first = C.word_spans(data[at:to], cut, C.ALNUM)
            hashes = C.span_hashes(data[at:to], starts, ends, C.LOWER)
            rows = np.repeat(np.arange(a, b), np.diff(first))
            order = np.lexsort((hashes, rows))
            hashes, rows = hashes[order], rows[order]
            new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]) if len(rows) else np.zeros(0, np.int64)
            yield rows[new], hashes[new], np.diff(new, append=len(rows))
            at = to


class _Shard:
    """Terms of documents until they fill a shard."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.parts: list[tuple] = []
        self.docs = self.bytes = 0

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        ids = pa.concat_arrays(self.ids)
        docs, hashes, counts = (np.concatenate([p[k] for p in self.parts] or [np.zeros(0, np.int64)]) for k in range(3))
        order = pc.sort_indices(ids).to_numpy()  # nulls last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.bincount(docs, counts, len(order)).astype(np.int64)[order]
        docs = place[docs]
        at = np.lexsort((docs, hashes))
        docs, hashes, counts = docs[at], hashes[at], counts[at]
        # Pieces of one text meet here: their counts add up.
        new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])]) if len(docs) else np.zeros(0, np.int64)
        counts = np.add.reduceat(counts, new) if len(new) else counts
        docs, hashes = docs[new], hashes[new]
        terms = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
        binary = [lengths.astype("<i8"), hashes[terms].astype("<u8"), np.append(terms[1:], len(hashes)).astype("<i8") if len(terms) else terms.astype("<i8"), docs.astype("<u4"), counts.astype("<i8")]
        numbers = [int((lengths > 0).sum()), int(lengths.sum())]
        held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)).cast(kind))
        return pa.RecordBatch.from_arrays([*(pa.array([n], pa.int64()) for n in numbers), held, *(pa.array([x.tobytes()], pa.large_binary()).cast(pa.binary()) for x in binary)], _FIELDS)


_FIELDS = ["n_docs", "n_terms", "ids", "lengths", "terms", "ends", "docs", "counts"]


def _indexer(shard_bytes: int, shard_docs: int, slice_bytes: int):
    def index(batches):
        C.begin("maxscore")
        shard = _Shard()
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(1))
            at = 0
            while at < batch.num_rows:
                room = int(np.searchsorted(offsets, offsets[at] + shard_bytes - shard.bytes, "right")) - 1
                to = min(max(at + 1, room), at + shard_docs - shard.docs, batch.num_rows)
                cut = offsets[at : to + 1] - offsets[at]
                shard.parts += [(rows + shard.docs, hashes, counts) for rows, hashes, counts in _counted(data[offsets[at] : offsets[to]], cut, slice_bytes)]
                shard.ids.append(batch.column(0).slice(at, to - at))
                shard.docs += to - at
                shard.bytes += int(cut[-1])
                if shard.bytes >= shard_bytes or shard.docs >= shard_docs:
                    yield shard.row(batch.column(0).type)
                    shard = _Shard()
                at = to
        if shard.docs:
            yield shard.row(shard.ids[0].type)

    return index


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Write the index of all rows to ``path`` and return it: one row per shard."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    binary = [T.StructField(c, T.BinaryType()) for c in _FIELDS[3:]]
    schema = T.StructType([T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["doc_id"].dataType)), *binary])
    rows.mapInArrow(_indexer(shard_bytes, shard_docs, slice_bytes), schema).write.options(**STORED).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


# ---------------------------------------------------------------- search


class _Lists:
    """The lists of a shard that a block's terms name: places and values of documents, without the terms' weights."""

    def __init__(self, wanted: np.ndarray, lengths, terms, ends, docs, counts, n: int, total: int, k: int):
        found = np.searchsorted(terms, wanted)
        found[found == len(terms)] = 0
        has = terms[found] == wanted if len(terms) else np.zeros(len(wanted), bool)
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        if int(lengths.max(initial=0)) * 75 * n < 1 << 62:
            m = 25 + 75 * lengths * n // total
        else:  # beyond 64 bits: Python's whole numbers
            m = np.array([25 + 75 * int(x) * n // total for x in lengths], np.int64)
        self.n_docs = len(lengths)
        self.lists: dict[int, tuple] = {}
        for t in np.flatnonzero(has).tolist():
            a, b = int(starts[found[t]]), int(ends[found[t]])
            places, tf = docs[a:b].astype(np.int64), counts[a:b]
            values = 1_000_000_000 * tf // (1000 * tf + 8 * m[places])
            kth = int(np.partition(values, -k)[-k]) if len(values) >= k else 0
            self.lists[t] = (places, values, int(values.max()), kth)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores above 0 of at least the ``k`` best documents, ties with the k-th and all."""
        held = []
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            if w > 0 and t in self.lists:
                places, values, most, kth = self.lists[t]
                held.append((w * most, w, places, values, w * kth))
        held.sort(key=lambda x: x[0])
        bounds = np.cumsum([x[0] for x in held])  # of this term and all before
        floor = max([1, *(x[4] for x in held)])
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not held or bounds[-1] < floor:
            return places, scores
        edges = np.arange(0, self.n_docs + window, window)
        cuts = [np.searchsorted(x[2], edges) for x in held]
        for j in range(len(edges) - 1):
            least = int(np.searchsorted(bounds, floor))  # the first essential term
            low = int(edges[j])
            sums = np.zeros(window, np.int64)
            for (_, w, at, values, _), cut in zip(held[least:], cuts[least:], strict=True):
                a, b = cut[j], cut[j + 1]
                sums[at[a:b] - low] += w * values[a:b]
            rest = int(bounds[least - 1]) if least else 0
            cands = np.flatnonzero((sums > 0) & (sums >= floor - rest))
            found = sums[cands]
            for i in range(least - 1, -1, -1):
                if not len(cands):
                    break
                _, w, at, values, _ = held[i]
                a, b = cuts[i][j], cuts[i][j + 1]
                if a < b:
                    near = np.minimum(np.searchsorted(at[a:b], cands + low), b - a - 1) + a
                    found = found + np.where(at[near] == cands + low, w * values[near], 0)
                rest = int(bounds[i - 1]) if i else 0
                alive = found >= floor - rest
                cands, found = cands[alive], found[alive]
            alive = found >= floor
            places, scores = np.r_[places, cands[alive] + low], np.r_[scores, found[alive]]
            if len(scores) >= k:
                floor = max(floor, int(np.partition(scores, -k)[-k]))
                alive = scores >= floor
                places, scores = places[alive], scores[alive]
        return places, scores


def _read(batch, columns):
    kinds = {"lengths": "<i8", "terms": "<u8", "ends": "<i8", "docs": "<u4", "counts": "<i8"}
    for i in range(batch.num_rows):
        yield [np.frombuffer(batch.column(batch.schema.get_field_index(c))[i].as_buffer(), kinds[c]) for c in columns]


def _frequencies(held):
    def count(batches):
        wanted = held.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, ends in _read(batch, ["terms", "ends"]):
                if len(terms):
                    found = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                    total += np.where(terms[found] == wanted, np.diff(ends, prepend=0)[found], 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    return count


def _searcher(held, n: int, total: int, k: int, window: int):
    def search(batches):
        C.begin("maxscore")
        wanted, weights, items = held.value
        for batch in batches:
            for i, arrays in enumerate(_read(batch, _FIELDS[3:])):
                lists = _Lists(wanted, *arrays, n, total, k)
                ids = batch.column(0)[i].values
                rows: list[np.ndarray] = []
                scores: list[np.ndarray] = []
                numbers: list[np.ndarray] = []
                for number, (terms, counts) in enumerate(items):
                    at, found = lists.best(terms, weights[terms] * counts, k, window)
                    best = np.lexsort((at, -found))[:k]  # places are in id order
                    rows.append(at[best])
                    scores.append(found[best])
                    numbers.append(np.full(len(best), number, np.int64))
                flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, rows, scores)]
                yield pa.RecordBatch.from_arrays([pa.array(flat[0]), ids.take(pa.array(flat[1])), pa.array(flat[2])], ["item", "doc_id", "score"])

    return search


def _item_terms(batches):
    """Each item's term numbers and how often each occurs."""
    for batch in batches:
        hashes, first = C.word_hashes(batch.column(1), C.ALNUM)
        found = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(first, first[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), C.binary([t.astype("<u8").tobytes() for t, _ in found]), C.binary([c.astype("<i8").tobytes() for _, c in found]), pa.array([len(t) for t, _ in found], pa.int64())], ["item_id", "terms", "counts", "n"])


def search(index: DataFrame, items: DataFrame, k: int = K, item_id: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS, window: int = WINDOW_DOCS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents with a score above 0 for each item."""
    spark = index.sparkSession
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    kind = items.schema[item_id].dataType
    # Texts of one item, joined by a space, pool their terms; equal rows count once.
    pooled = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null").distinct()
    pooled = pooled.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("n", T.LongType())])
    asked = C.staged(pooled.mapInArrow(_item_terms, schema).where("n > 0"), "items")
    words = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * words // block_terms)) if words > block_terms else 1
    id_kind = index.schema["ids"].dataType.elementType
    out_schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", id_kind), T.StructField("score", T.LongType())])
    result = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), *out_schema.fields[1:]]))
    for b in range(blocks if total else 0):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # a block's items only
        if not rows:
            continue
        pairs = [(np.frombuffer(r["terms"], "<u8"), np.frombuffer(r["counts"], "<i8")) for r in rows]
        wanted = np.unique(np.concatenate([t for t, _ in pairs]))
        held = spark.sparkContext.broadcast(wanted)
        df = np.zeros(len(wanted), np.int64)
        for r in index.select("terms", "ends").mapInArrow(_frequencies(held), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a block's terms at most
            df[r["term"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)
        asked_for = spark.sparkContext.broadcast((wanted, weights, [(np.searchsorted(wanted, t), c) for t, c in pairs]))
        found = index.select("ids", *_FIELDS[3:]).mapInArrow(_searcher(asked_for, n, total, k, window), out_schema)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
        found = C.staged(found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"), f"found-{uuid.uuid4().hex[:8]}")
        held.destroy()
        asked_for.destroy()
        result = result.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return result.withColumn("rank", F.row_number().over(order)).select(F.col("item_id").alias(item_id), "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    index = build_index(C.read_table(spark, sf_dir, "documents"), C.new_path(spark, "lexical-index"))
    return search(index, C.read_table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH word AS (
  SELECT rid, doc_id, unnest(ws) AS term FROM (SELECT row_number() OVER () AS rid, doc_id, {_TERMS.format("text")} AS ws FROM documents)
), doc AS (
  SELECT rid, doc_id, count(*) AS n FROM word GROUP BY rid, doc_id
), whole AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM doc
), item AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS q
  FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term
), tf AS (
  SELECT rid, term, count(*) AS tf FROM word WHERE term IN (SELECT term FROM item) GROUP BY rid, term
), df AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term
), scored AS (
  SELECT i.item_id, d.doc_id, d.rid, CAST(sum(i.q * f.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * d.n * whole.docs) // whole.words)))) AS BIGINT) AS score
  FROM item i JOIN tf t ON i.term = t.term JOIN df f ON i.term = f.term JOIN doc d ON d.rid = t.rid, whole
  GROUP BY i.item_id, d.doc_id, d.rid
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= {K}
"""
