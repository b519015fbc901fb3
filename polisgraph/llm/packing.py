"""Packing token sequences by shortest-pack-first over the length histogram.

A document's ids (with its end id) are cut into full pieces of 2048 and a rest.  The histogram of piece
lengths has at most 2048 bins whatever the corpus; over it, lengths are placed longest first, each into the
pack with the most room left, counting how often each packing pattern occurs.  Patterns give every length a
table of rank intervals, and pieces join it by length and rank.  Ranks come from counts per length and hash
bucket, so pieces of one length never meet in one task.

Defined cases: a null or empty text is its end id alone; repeated rows and ids are packed one by one; rows
with a null id are packed too; an empty table packs to no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polisgraph.llm import _common as C
from polisgraph.llm import _tokens

SEQUENCE_TOKENS = 2048
END_ID = 1
#: Text bytes that are encoded at a time.
ENCODE_BYTES = 4 << 20


def _cutter(path: str, end_id: int, size: int, with_ids: bool):
    tail = int(end_id).to_bytes(4, "little")

    def cut(batches):
        encode = _tokens.encoder(path).ids
        for whole in batches:
            _, offsets = C.text_buffers(whole.column(1))
            for a, b in C.row_slices(offsets, ENCODE_BYTES):
                batch = whole.slice(a, b - a)
                row, start, length, total, crc, ids = [], [], [], [], [], []
                for i, found in enumerate(encode(batch.column(1).to_pylist())):
                    found += tail
                    n = len(found) // 4
                    for at in range(0, n, size):
                        piece = found[4 * at : 4 * (at + size)]
                        row.append(i)
                        start.append(at)
                        length.append(len(piece) // 4)
                        total.append(n)
                        crc.append(zlib.crc32(piece))
                        if with_ids:
                            ids.append(piece)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total, crc))]
                names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, C.binary(ids)], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns and how many packs follow each; every length of the histogram is placed."""
    room: list[int] = []  # negated free space of open patterns, the most room first
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(count: int, pattern: tuple[int, ...]) -> None:
        free = size - sum(pattern)
        if free == 0:
            done.append((count, pattern))
            return
        if not open_.get(free):
            heapq.heappush(room, -free)
        open_.setdefault(free, []).append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not room or -room[0] < length:
                put(left, (length,))
                break
            free = -room[0]
            count, pattern = open_[free].pop()
            if not open_[free]:
                heapq.heappop(room)
            used = min(count, left)
            if used < count:
                put(count - used, pattern)
            put(used, (*pattern, length))
            left -= used
    return done + [x for free in open_ for x in open_[free]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """For each place in a pattern: length, first rank, count, first sequence, offset in the sequence."""
    out, ranks, sequence = [], {}, 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            out.append((length, rank, count, sequence, offset))
            ranks[length] = rank + count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SEQUENCE_TOKENS, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, ``start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "ids_crc32"))]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    pieces = C.staged(rows.mapInArrow(_cutter(vocabulary or _tokens.default_vocabulary(), end_id, size, with_ids), T.StructType(fields)), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``size`` bins at most
    places = slots(pack_histogram(histogram, size))
    table = spark.createDataFrame(places, "length long, rank0 long, held long, sequence0 long, offset long")

    buckets = 4 * C.partitions_for(spark)
    pieces = pieces.withColumn("_bucket", C.salted_bucket(buckets, "doc_id", "start", "ids_crc32"))
    held = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("_in", F.row_number().over(within) - 1).join(held, ["length", "_bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("_in"))
    # Places are bounded by the patterns over ``size`` bins, a few ten thousand rows however large the corpus.
    side = F.broadcast(table) if len(places) <= 200_000 else table
    side = side.select(F.col("length").alias("l2"), "rank0", "held", "sequence0", "offset")
    placed = ranked.join(side, (F.col("length") == F.col("l2")) & (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank0") + F.col("held")))
    ids = ["ids"] if with_ids else []
    return placed.select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence0") + F.col("rank") - F.col("rank0")).alias("sequence_id"), "offset", *ids)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(C.read_table(spark, sf_dir, "documents"))
