"""Token ids in binary files of patched frame-of-reference blocks.

Documents are put in ascending id order by range partitioning; each task encodes its range and writes
shards.  A shard is

    magic ``PFOR1``, then blocks of up to 4096 ids, then the index, then its length and the block count

and a block is: base (u32), width (u8), id count (u32), exception count (u32), ids minus the base packed at
``width`` bits, exception places (u16), exception values (u32).  The width holds all but the largest tenth of
a block's differences; larger ones are exceptions.  The index gives every block's start in the file and its
first id's place in the shard.  Shards are written under names of their attempt, and only those named in the
committed manifest count, so a repeated or lost task leaves no trace in the result.

Defined cases: a null or empty text is its end id alone; null ids come first, equal ids in the order of
their text hashes; an empty table has no shards and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polisgraph.llm import _common as C
from polisgraph.llm import _tokens

END_ID = 2
BLOCK_IDS = 4096
#: Share of a block's differences that its width holds.
PERCENTILE = 90
#: Ids after which a task begins another shard.
SHARD_IDS = 4 << 20
MAGIC = b"PFOR1"
_HEAD = struct.Struct("<IBII")
_ENCODE_BYTES = 4 << 20


def encode_block(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    base = int(ids.min())
    gap = (ids - np.uint32(base)).astype(np.uint32)
    at = np.partition(gap, k := min(len(gap) - 1, len(gap) * percentile // 100))[k]
    width = max(1, int(at).bit_length())
    if width >= 32:
        over = np.zeros(0, np.int64)
    else:
        over = np.flatnonzero(gap >> np.uint32(width))
    low = gap.copy()
    low[over] = 0
    bits = np.unpackbits(low.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    return _HEAD.pack(base, width, len(ids), len(over)) + packed + over.astype("<u2").tobytes() + gap[over].astype("<u4").tobytes()


def decode_block(raw: bytes, at: int = 0) -> np.ndarray:
    base, width, n, m = _HEAD.unpack_from(raw, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    # Eight bytes from the one in which each value begins: a value of up to 32 bits lies within them.
    packed = np.zeros(size + 8, np.uint8)
    packed[:size] = np.frombuffer(raw, np.uint8, size, at)
    first = np.arange(0, n * width, width)
    words = np.ndarray(size + 1, "<u8", packed, strides=(1,))[first >> 3]
    gap = (words >> (first & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.uint32)
    places = np.frombuffer(raw, "<u2", m, at + size)
    gap[places] = np.frombuffer(raw, "<u4", m, at + size + 2 * m)
    return gap + np.uint32(base)


class ShardWriter:
    """Buffers at most one block."""

    def __init__(self, sink):
        self.sink, self.index, self.held, self.n, self.at = sink, [], [], 0, len(MAGIC)
        self.count = 0
        sink.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= BLOCK_IDS:
            every = np.concatenate(self.held)
            whole = len(every) // BLOCK_IDS * BLOCK_IDS
            for k in range(0, whole, BLOCK_IDS):
                self._block(every[k : k + BLOCK_IDS])
            self.held, self.n = [every[whole:]], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        raw = encode_block(ids)
        self.index.append((self.at, self.count))
        self.sink.write(raw)
        self.at += len(raw)
        self.count += len(ids)

    def close(self) -> None:
        if self.n:
            self._block(np.concatenate(self.held))
        index = np.array(self.index, "<u8").tobytes()
        self.sink.write(index + struct.pack("<QQ", self.at, len(self.index)))
        self.sink.close()


class ShardReader:
    """Reads any run of a shard's ids by its index, a block at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 16)
        self.end, n = struct.unpack("<QQ", source.read(16))
        source.seek(self.end)
        index = np.frombuffer(source.read(16 * n), "<u8").reshape(n, 2)
        self.starts, self.first = np.append(index[:, 0], self.end), index[:, 1]
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a shard of token ids")
        self.block, self.ids = -1, np.zeros(0, np.uint32)

    def _load(self, k: int) -> np.ndarray:
        if k != self.block:
            self.source.seek(int(self.starts[k]))
            self.ids = decode_block(self.source.read(int(self.starts[k + 1] - self.starts[k])))
            self.block = k
        return self.ids

    def read(self, start: int, n: int) -> np.ndarray:
        out = []
        k = int(np.searchsorted(self.first, start, "right")) - 1
        while n > 0:
            at = start - int(self.first[k])
            part = self._load(k)[at : at + n]
            out.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _writer(path: str, folder: str, end_id: int):
    tail = int(end_id).to_bytes(4, "little")

    def write(batches):
        from pyspark import TaskContext

        encode = _tokens.encoder(path).ids
        fs, root = C.local_folder(folder)
        fs.create_dir(root, recursive=True)
        part, shard, writer = TaskContext.get().partitionId(), -1, None
        for whole in batches:
            _, offsets = C.text_buffers(whole.column(1))
            for a, b in C.row_slices(offsets, _ENCODE_BYTES):
                batch = whole.slice(a, b - a)
                names, shards, starts, counts = [], [], [], []
                for found in encode(batch.column(1)):
                    if writer is None or writer.count + writer.n >= SHARD_IDS:
                        if writer is not None:
                            writer.close()
                        shard += 1
                        name = f"part-{part:06d}-{shard:04d}-{uuid.uuid4().hex}.ids"
                        writer = ShardWriter(fs.open_output_stream(f"{root}/{name}"))
                    ids = np.frombuffer(found + tail, "<u4")
                    names.append(name)
                    shards.append(shard)
                    starts.append(writer.count + writer.n)
                    counts.append(len(ids))
                    writer.add(ids)
                columns = [batch.column(0), pa.array([part] * len(names), pa.int32()), pa.array(shards, pa.int32()), pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "shard", "file", "at", "n_tokens"])
        if writer is not None:
            writer.close()

    return write


def _reader(folder: str):
    def read(batches):
        fs, root = C.local_folder(folder)
        name, reader, source = None, None, None
        for batch in batches:
            files, at, n = (batch.column(k).to_pylist() for k in (batch.schema.get_field_index(c) for c in ("file", "at", "n_tokens")))
            crc = []
            for f, a, k in zip(files, at, n, strict=True):
                if f != name:
                    if source is not None:
                        source.close()
                    source = fs.open_input_file(f"{root}/{f}")
                    name, reader = f, ShardReader(source)
                crc.append(zlib.crc32(reader.read(a, k).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crc, pa.int64())], [*batch.schema.names, "ids_crc32"])
        if source is not None:
            source.close()

    return read


def write_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Write the ids of all documents and return the committed manifest: id, part, shard, file, place, count."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange(C.partitions_for(docs.sparkSession), F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType())])
    written = ranged.mapInArrow(_writer(vocabulary or _tokens.default_vocabulary(), folder, end_id), schema)
    return C.staged(written, "ids-manifest")


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document's place in the whole stream and the checksum of its ids, read back from the shards."""
    sizes = manifest.groupBy("part", "shard", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    bases = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = T.StructType([*manifest.schema.fields, T.StructField("ids_crc32", T.LongType())])
    found = manifest.mapInArrow(_reader(folder), schema)
    return found.join(bases, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_ids(spark, sf_dir: str) -> DataFrame:
    folder = C.new_path(spark, "token-ids")
    return read_digests(write_ids(C.read_table(spark, sf_dir, "documents"), folder), folder)
