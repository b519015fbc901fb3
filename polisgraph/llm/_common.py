"""Shared helpers: the cluster's shared folder, row keys, and vectorised text hashing.

Text is handled as UTF-8 bytes straight from Arrow buffers.  A word hash is a polynomial hash over
a word's bytes, taken from running sums, so a batch of texts is hashed with a handful of numpy passes
and no Python loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polisgraph.session import new_path

#: Bytes of text whose running sums are held at once.
SLICE_BYTES = 1 << 20
#: Input bytes that one shuffle partition should hold at most.
PARTITION_BYTES = 128 << 20
#: Rows of a few numbers that one partition of a saved table holds, and that may be broadcast.
SAVED_ROWS, BROADCAST_ROWS = 250_000, 100_000


# ---------------------------------------------------------------- shared folder, named by ``session.shared_dir`` with its store


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame) -> DataFrame:
    """Write a table of small rows to the shared folder and read it in as few partitions as ``SAVED_ROWS`` rows in each allow.

    A table of one partition is grouped and joined with another such without a shuffle.  ``rows_of`` tells its rows.
    """
    with _one_partition_joins(df.sparkSession):
        kept = staged(df, "saved")
    return _in_few(kept, kept.coalesce(1).count())  # from the files' footers


@contextlib.contextmanager
def _one_partition_joins(spark: SparkSession):
    """Tables of one partition are joined where they are, however large Spark takes the plans above them to be."""
    name = "spark.sql.maxSinglePartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str((1 << 63) - 1))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _in_few(df: DataFrame, rows: int) -> DataFrame:
    out = df.coalesce(max(1, -(-rows // SAVED_ROWS)))
    out.saved_rows = rows
    return out


def rows_of(df: DataFrame) -> int | None:
    """Rows of a table as ``saved`` or ``together`` returned it: they were counted once.  Of any other table none are known."""
    return getattr(df, "saved_rows", None)


def together(rows: int, *tables: DataFrame) -> DataFrame:
    """The rows of tables that were saved, ``rows`` in all at most, in as few partitions as if they were saved together."""
    return _in_few(functools.reduce(DataFrame.unionByName, tables), rows)


def none(spark: SparkSession, schema: str) -> DataFrame:
    """A saved table without rows."""
    return _in_few(spark.createDataFrame([], schema), 0)


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its number of small rows, which was counted, is at most ``BROADCAST_ROWS``."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def joined(left: DataFrame, n_left: int | None, right: DataFrame, n_right: int, on, how: str = "inner") -> DataFrame:
    """A join of saved tables whose rows were counted, inner or left.

    Two tables of one partition are merged by one task, which takes no job of its own and sends nothing through the driver.
    """
    if n_left is None or max(n_left, n_right) > SAVED_ROWS:
        return left.join(hinted(right, n_right), on, how)
    # Spark takes a join of joins for one of many partitions.
    return left.join(right.hint("merge"), on, how).coalesce(1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Shuffle partitions as set, but no fewer than give each ``PARTITION_BYTES`` of ``df`` by Spark's estimate of its size."""
    found = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if df is None:
        return found
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # Spark takes plans of unknown size for endless: those keep the setting.
    return max(found, -(-size // PARTITION_BYTES)) if size < 1 << 56 else found


def salted_bucket(buckets: int, *cols):
    """A bucket in ``0..buckets-1`` that spreads rows whatever their key's frequency."""
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


# ---------------------------------------------------------------- what a worker keeps

_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What workers keep from task to task for one operator."""
    return _KEPT.setdefault(name, {})


def begin(name: str) -> None:
    """At the start of a task: what other operators' tasks have left goes, and free memory goes back to the system."""
    for other, values in _KEPT.items():
        if other != name:
            values.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc only
        trim(0)


# ---------------------------------------------------------------- bytes and words


def table_of(member) -> np.ndarray:
    return np.array([bool(member(b)) for b in range(256)])


#: Lower-cases A-Z and leaves every other byte.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Space, tab, newline, vertical tab, form feed, carriage return part words.
NOT_SPACE = table_of(lambda b: not (b == 32 or 9 <= b <= 13))
#: Only digits, letters and all bytes beyond ASCII are in words.
ALNUM = table_of(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)

_PRIME = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, np.uint64(_PRIME), dtype=np.uint64)
        up[0] = 1
        down = np.full(n, np.uint64(pow(_PRIME, -1, 1 << 64)), dtype=np.uint64)
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values; a bijection."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers, n = column.buffers(), len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, 8 * column.offset)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes after ``fold``; spans are ascending and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
            base, stop = int(starts[at]), int(ends[to - 1])
            up, down = _powers(max(SLICE_BYTES, 1 << int(stop - base).bit_length()))
            sums = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[fold[data[base:stop]]] * up[: stop - base], out=sums[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            at = to
    return mix(out)


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin in them (``n + 1`` values)."""
    starts, ends = [], []
    for base in range(0, max(len(data), 1), 8 * SLICE_BYTES):
        stop = min(len(data), base + 8 * SLICE_BYTES)
        inside = member[data[base:stop]]
        lead = np.empty_like(inside)
        lead[1:] = inside[:-1]
        if len(lead):
            lead[0] = base > 0 and member[data[base - 1]]
        tail = np.empty_like(inside)
        tail[:-1] = inside[1:]
        if len(tail):
            tail[-1] = stop < len(data) and member[data[stop]]
        cut = offsets[np.searchsorted(offsets, base) : np.searchsorted(offsets, stop)] - base
        lead[cut] = False
        cut = offsets[np.searchsorted(offsets, base, "right") : np.searchsorted(offsets, stop, "right")] - base - 1
        tail[cut] = False
        starts.append(np.flatnonzero(inside & ~lead) + base)
        ends.append(np.flatnonzero(inside & ~tail) + base + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column, member: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and where each text's words begin."""
    data, offsets = text_buffers(column)
    starts, ends, first = word_spans(data, offsets, member)
    return span_hashes(data, starts, ends, fold), first


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words of one text; with fewer words, of the whole run."""
    if len(words) == 0:
        return words
    with np.errstate(over="ignore"):
        n = max(1, len(words) - width + 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(width, len(words))):
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
        return mix(out + np.uint64(min(width, len(words))))


def row_slices(offsets: np.ndarray, limit: int):
    """Ranges of rows that hold about ``limit`` bytes each, at least one row in each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def local_folder(uri: str) -> tuple:
    """A pyarrow file system and path for a folder of the shared store, whose name has its store's scheme."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
