"""WARC archives and a globally ordered capture index.

Writing: payloads are compared by SHA-1 and length with a partial aggregation, so a payload shared by a third
of all pages is one row when it is shuffled.  Of the pages with an equal payload of at least ``MIN_REVISIT``
bytes the one with the largest id becomes a response record, the others are revisits of it.  Each task writes
gzip archives, one member a record, under names of its attempt; only those that the committed manifest names
count.

Reading: archives are read record by record, payload digests are checked, and the captures of each archive
are sorted by URL key and timestamp: a run.  Runs are cut at splitters taken from a bounded sample and the cuts
of one key range, about ``RANGE_ROWS`` captures at most, meet in one task, which holds them compressed and merges
them with a loser tree, row by row.  Ranges in order of their number, and rows in order within, are the global
history of every URL, however often one is captured.

Defined cases: a null payload is empty; equal ids with one payload are all responses where that id is the
largest; rows with a null id are responses unless a page with an id has their payload; ids of any size are kept
(a page without a capture time gets one from its id, within a century); a null URL is empty; an
empty table has no archives.  Columns other than id, URL, payload and (optionally) capture time are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgraph.llm import _common as C

MIN_REVISIT = 1000
#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Records after which a task begins another archive.
ARCHIVE_RECORDS = 200_000
#: Captures in a key range, about: what a merging task holds, compressed, at a time.
RANGE_ROWS = 1_000_000
#: Payload bytes that are turned into records at a time.
_SLICE = 8 << 20
#: Pages without a capture time get one within a century of this, by their id.
#: Sampled captures for each key range.
SAMPLE_PER_RANGE = 64
_EPOCH = datetime(2000, 1, 1, tzinfo=UTC)
_CENTURY = 36_500 * 86_400
_RUN = "urlkey string, stamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, at long"
_FIELDS = [x.split()[0] for x in _RUN.split(", ")]


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query: captures of one site lie together."""
    if not url:
        return ""
    try:
        cut = urlsplit(url.strip())
        host = ",".join(reversed((cut.hostname or "").removeprefix("www.").split(".")))
        port = f":{cut.port}" if cut.port and (cut.scheme, cut.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:  # not a URL: its own key
        return url.strip().lower()
    return f"{host}{port}){(cut.path or '/').lower()}" + (f"?{cut.query.lower()}" if cut.query else "")


# ---------------------------------------------------------------- records


def _plain(value: str) -> str:
    return re.sub(r"[\r\n]", " ", value)


def record(page_id, url: str, stamp: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP header with the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {stamp}",
        f"WARC-Target-URI: {_plain(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _id(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def parse_record(raw: bytes) -> dict:
    """Fields of a record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    length = int(_fields(http)["content-length"])
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a record's payload does not match its digest")
    return {"page_id": _id(fields["warc-record-id"]), "url": fields.get("warc-target-uri", ""), "stamp": fields["warc-date"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": _id(fields.get("warc-refers-to")), "payload": payload}


def read_records(source) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of every record: one gzip member each, read a piece at a time."""
    at, held, machine, out = 0, source.read(1 << 20), zlib.decompressobj(31), io.BytesIO()
    used = 0
    while held:
        out.write(machine.decompress(held))
        used += len(held) - len(machine.unused_data)
        held = machine.unused_data
        if machine.eof:
            yield at, out.getvalue()
            at += used
            used, machine, out = 0, zlib.decompressobj(31), io.BytesIO()
        held = held or source.read(1 << 20)


# ---------------------------------------------------------------- writing


def classified(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", stamp: str | None = None, least: int = MIN_REVISIT) -> DataFrame:
    """Pages with digest, length and the page that they revisit, if any."""
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    when = F.date_format(F.col(stamp), "yyyy-MM-dd'T'HH:mm:ss'Z'") if stamp else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), body.alias("payload"), when.alias("stamp"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = C.saved(first)  # a table of its own, so that the join's large side can be split where one payload is frequent
    named = rows.join(first, ["payload_digest", "payload_bytes"], "left")
    return named.select("page_id", "url", "payload", "stamp", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _rows_of(batches) -> Iterator[dict]:
    """Rows as Python values, a bounded slice of payloads at a time."""
    import pyarrow.compute as pc

    for whole in batches:
        sizes = pc.binary_length(whole.column("payload")).to_numpy(zero_copy_only=False)
        for a, b in C.row_slices(np.concatenate([[0], np.cumsum(sizes)]), _SLICE):
            yield from whole.slice(a, b - a).to_pylist()


def _writer(folder: str, limit: int):
    def write(batches):
        from pyspark import TaskContext

        fs, root = C.local_folder(folder)
        fs.create_dir(root, recursive=True)
        part, name, sink, size, n = TaskContext.get().partitionId(), None, None, 0, 0
        done: list[tuple[str, int]] = []
        for row in _rows_of(batches):
            if sink is None:
                name = f"part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz"
                sink, size, n = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
            stamp = row["stamp"] or (_EPOCH + timedelta(seconds=abs(row["page_id"] or 0) % _CENTURY)).strftime("%Y-%m-%dT%H:%M:%SZ")
            machine = zlib.compressobj(6, zlib.DEFLATED, 31)
            sink.write(machine.compress(record(row["page_id"], row["url"], stamp, row["payload"], row["payload_digest"], row["refers_to"])) + machine.flush())
            size, n = size + len(row["payload"]), n + 1
            if size >= limit or n >= ARCHIVE_RECORDS:
                sink.close()
                done.append((name, n))
                sink = None
        if sink is not None:
            sink.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "records"])

    return write


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Write all pages and return the committed manifest: archive and number of records."""
    return C.staged(classified(pages, **columns).mapInArrow(_writer(folder, archive_bytes), "file string, records long"), "warc-manifest")


# ---------------------------------------------------------------- index


def _run_reader(folder: str):
    def read(batches):
        fs, root = C.local_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    run = []
                    for at, raw in read_records(source):
                        r = parse_record(raw)
                        run.append((url_key(r["url"]), r["stamp"], r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], name, at))
                run.sort(key=order_key)
                yield _batch(run)

    return read


def order_key(row: tuple) -> tuple:
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if "long" in x else pa.string() for x in _RUN.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _FIELDS)


class LoserTree:
    """Merges sorted runs: a tree of the losers of matches, of which each next row replays one path."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.n = max(1, len(runs))
        self.heads = [self._next(k) for k in range(len(runs))] or [None]
        self.losers = [-1] * self.n
        self.winner = self._play(1) if self.n > 1 else 0

    def _next(self, k: int):
        row = next(self.runs[k], None)
        return None if row is None else (self.key(row), row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) <= (y[0], b)

    def _play(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self._play(2 * node), self._play(2 * node + 1)
        self.losers[node] = b if self._beats(a, b) else a
        return a if self._beats(a, b) else b

    def __iter__(self):
        while self.heads[self.winner] is not None:
            k = self.winner
            yield self.heads[k][1]
            self.heads[k] = self._next(k)
            node = (k + self.n) // 2
            while node >= 1 and self.n > 1:
                if self._beats(self.losers[node], k):
                    self.losers[node], k = k, self.losers[node]
                node //= 2
            self.winner = k


def _cutter(held):
    def cut(batches):
        """Pieces of runs, each in the run's order: one row for every key range that a run's rows fall in."""
        for batch in batches:
            key = zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(7).to_pylist(), strict=True)
            place = [(f, bisect_right(held.value, (u, s, p is not None, p or 0))) for u, s, p, f in key]
            edges = [0, *(k for k in range(1, len(place)) if place[k] != place[k - 1]), len(place)]
            pieces, ranges = [], []
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(batch.slice(a, b - a))
                    pieces.append(sink.getvalue().to_pybytes())
                    ranges.append(place[a][1])
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), C.binary(pieces)], ["range", "piece"])

    return cut


def _rows(piece: bytes) -> Iterator[tuple]:
    for batch in pa.ipc.open_stream(piece):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _merge(batches):
    """A task's key ranges, one after another; the pieces of one range are merged by a loser tree."""
    ranges: dict[int, list[bytes]] = {}
    for batch in batches:
        for c, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ranges.setdefault(c, []).append(piece)
    for c in sorted(ranges):
        held = []
        for row in LoserTree([_rows(p) for p in ranges.pop(c)], order_key):
            held.append(row)
            if len(held) == 4096:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)


def capture_index(manifest: DataFrame, folder: str) -> DataFrame:
    """Captures of all archives of the manifest in order of URL key, timestamp and id, from sorted runs."""
    spark = manifest.sparkSession
    n = C.partitions_for(spark)
    files = manifest.select("file").repartition(n, "file")
    runs = C.staged(files.mapInArrow(_run_reader(folder), _RUN), "capture-runs")
    total = runs.count()
    n = max(n, -(-total // RANGE_ROWS))
    share = min(1.0, n * SAMPLE_PER_RANGE / max(total, 1))
    draw = F.pmod(F.xxhash64("urlkey", "stamp", "page_id", "file", "at"), F.lit(1 << 30)) / float(1 << 30)
    seen = runs.where(draw < share).select("urlkey", "stamp", "page_id").collect()  # about n * SAMPLE_PER_RANGE keys
    seen = sorted({(r[0], r[1], r[2] is not None, r[2] or 0) for r in seen})
    splitters = [seen[k * len(seen) // n] for k in range(1, n)] if len(seen) >= n else seen
    held = spark.sparkContext.broadcast(splitters)
    pieces = runs.mapInArrow(_cutter(held), "range int, piece binary").repartitionById(n, "range")
    return pieces.mapInArrow(_merge, _RUN)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    folder = C.new_path(spark, "warc")
    manifest = write_archives(C.read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return capture_index(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS first FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY ALL
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN g.first IS NULL OR p.page_id IS NOT DISTINCT FROM g.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM g.first THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes = g.payload_bytes
"""
