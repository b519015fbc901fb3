"""Vectors of nodes' texts, encoded again only where a text or its neighbours changed.

A store is a folder of finished batches.  A node is encoded if the store has no vector of its current hash: the hash is that of its
text with its neighbours, so a changed neighbour touches only the nodes that name it.  The work of a run is dealt into batches; each
is encoded by tasks and renamed into the store when all of it is written, with its audit lines.  A run that is lost between
batches loses the batch at hand; the next run finds the others done.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polisgraph.functions.cleaning import synthesis_hash
from polisgraph.sources.store import append_audit

#: Texts that one call of an encoder takes, and texts of one batch of the store.
CALL_TEXTS, BATCH_TEXTS = 128, 100_000
SCHEMA = "id string, hash string, embedding array<float>, version int, run long"
Encoder = Callable[[list[str]], np.ndarray]


def hashed_words(dims: int = 64) -> Encoder:
    """An encoder without a model: words hashed to ``dims`` signed counts, of length 1."""

    def encode(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % dims] += 1 if h & 0x80000000 else -1
            row /= max(float(np.sqrt(np.square(row).sum())), 1e-9)
        return out

    return encode


def _files(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def rename(spark: SparkSession, source: str, target: str) -> None:
    at, fs = _files(spark, source)
    to, _ = _files(spark, target)
    if not fs.rename(at, to):
        raise OSError(f"{source} could not be renamed to {target}")


def state(spark: SparkSession, store: str) -> DataFrame:
    """The latest vector of every node: ``id, hash, embedding, version, run``."""
    glob, fs = _files(spark, f"{store}/batch-*")
    found = [str(s.getPath().toString()) for s in fs.globStatus(glob) or []]
    rows = spark.read.schema(SCHEMA).parquet(*found) if found else spark.createDataFrame([], SCHEMA)
    last = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), F.struct("run", "hash")).alias("r"))
    return last.select("r.*")


def changed(texts: DataFrame, known: DataFrame, full: bool = False) -> DataFrame:
    """The rows of ``texts (id, node_type, text, neighbours)`` that have no vector of their hash, with it; all of them if ``full``."""
    now = texts.select("id", "node_type", "text", "neighbours", synthesis_hash("text", "neighbours").alias("hash"))
    return now if full else now.join(known.select("id", "hash"), ["id", "hash"], "left_anti")


def _encoded(encode: Encoder, calls: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, calls):
                part = batch.slice(at, calls)
                vectors = np.asarray(encode(part.column(2).to_pylist()), np.float32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), vectors.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["id", "hash", "embedding"])

    return run


def embed(texts: DataFrame, store: str, encode: Encoder, version: int = 1, full: bool = False, batch_texts: int = BATCH_TEXTS, calls: int = CALL_TEXTS, vendor: str = "local") -> int:
    """Encode what changed and return how many rows that were.  A null text is encoded as an empty one; ids must be unique."""
    spark = texts.sparkSession
    known = state(spark, store)
    run = (known.agg(F.max("run")).first()[0] or 0) + 1
    work = changed(texts, known, full)
    total = work.count()
    batches = -(-total // batch_texts)
    for k in range(batches):
        # Batches are told apart by a hash of the id, and those that the store has by now are not chosen again.
        part = work.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k)
        vectors = part.select("id", "hash", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_encoded(encode, calls), "id string, hash string, embedding array<float>")
        name = uuid.uuid4().hex
        vectors.withColumns({"version": F.lit(version), "run": F.lit(run).cast("long")}).write.parquet(f"{store}/_writing-{name}")
        rename(spark, f"{store}/_writing-{name}", f"{store}/batch-{name}")
        append_audit(part.select("id", "node_type", F.col("neighbours").alias("included"), F.array().cast("array<string>").alias("dropped"), "text"), f"{store}/_audit", vendor)
    return total
