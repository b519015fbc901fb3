"""Line dedup by pairwise alignment.

Lines are compared by a hash of their words, with A-Z lowered and white space collapsed.  Equal texts are one
text, held by its first document.  Documents are brought together by hashes of lines that are long enough to be
rare: from every line with words, the fewest lines onwards, and the fewest lines back, that reach ``BLOCK_WORDS``
words (a run; one line, if it is as long).  Each line of a block of that size lies in a run that is wholly in the
block, and every text with a run is paired with the first text that has it, so each block that can be deleted is
met, in a number of pairs linear in the lines.

Each pair's line hashes, a few bytes a line, are aligned by patience diff: lines that are unique on both sides and
in the same order are anchors, equal lines next to an anchor join it, and the gaps between anchors are aligned in
the same way.  Aligned blocks of at least ``BLOCK_WORDS`` words go from the later text; what is left of it is
aligned again until nothing more goes, which finds blocks that were moved or stand there twice.  A block without
any unique line is aligned from a run that both texts have.  So a document loses exactly the
lines of the blocks of at least ``BLOCK_WORDS`` words that an earlier document also has; the tests hold this
against all pairs of places.  The first holder of a run never loses it for that run, so no passage disappears
from the corpus.

Defined cases: documents are ordered by id, then by text hash; of equal texts all but the first lose every line, if
they have ``BLOCK_WORDS`` words; equal rows are one document, and each gets its deletions; rows with a null id or text
are left as they are; a blank line goes where the nearest lines with words before and after it go (a text's end counts
as gone), whether the block has it or not; a
text with no line left becomes empty; an empty table stays empty.  Added columns replace input columns of the same name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polisgraph.llm import _common as C

#: A repeated block of at least so many words is deleted.
BLOCK_WORDS = 40
_SLICE = 4 << 20


def line_hashes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and word count of every line of a string column, and where each text's lines begin."""
    data, offsets = C.text_buffers(column)
    starts, ends, _ = C.word_spans(data, offsets, C.NOT_SPACE)
    words = C.span_hashes(data, starts, ends, C.LOWER)
    breaks = np.flatnonzero(data == 10) + 1
    # A text of k newlines has k + 1 lines, each of which begins at the text's start or after a newline.
    own = np.searchsorted(breaks, offsets[:-1], "right"), np.searchsorted(breaks, offsets[1:], "right")
    count = own[1] - own[0] + 1
    first = np.concatenate([[0], np.cumsum(count)])
    line_start = np.empty(first[-1], np.int64)
    line_start[first[:-1]] = offsets[:-1]
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    line_start[inner] = breaks
    at = np.searchsorted(starts, line_start)
    to = np.append(at[1:], len(starts))
    hashes = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        # Lines are hashed from running sums, as words are.
        up, down = C._powers(1 << max(1, int(len(words)).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(words) * up[: len(words)])])
        some = to > at
        hashes[some] = C.mix((sums[to[some]] - sums[at[some]]) * down[at[some]] + (to - at)[some].astype(np.uint64))
    return hashes, (to - at).astype(np.int32), first


def _signatures(batches):
    C.begin("linededup")
    for whole in batches:
        _, offsets = C.text_buffers(whole.column(2))
        for a, b in C.row_slices(offsets, _SLICE):
            batch = whole.slice(a, b - a)
            hashes, words, first = line_hashes(batch.column(2))
            cut = [(hashes[first[i] : first[i + 1]], words[first[i] : first[i + 1]]) for i in range(batch.num_rows)]
            lines, sizes = C.binary([h.astype("<u8").tobytes() for h, _ in cut]), C.binary([w.astype("<i4").tobytes() for _, w in cut])
            total = pa.array([int(w.sum()) for _, w in cut], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lines, sizes, total], ["doc", "th", "lines", "words", "total"])


def minimal_runs(lines: np.ndarray, words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each run of lines that loses ``least`` words if a line at one of its ends goes.

    ``first`` tells where each text's lines begin; a run stays in its text.  A line with words has the run that begins with
    it and the run that ends with it, where its text has enough words.
    """
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    some = np.flatnonzero(words)
    text = np.searchsorted(first, some, "right") - 1
    on, back = np.searchsorted(total, total[some] + least), np.searchsorted(total, total[some + 1] - least, "right") - 1
    ahead, behind = on <= first[text + 1], back >= first[text]
    ends = np.unique(np.stack([np.append(some[ahead], back[behind]), np.append(on[ahead], some[behind] + 1)], 1), axis=0)
    start, stop = ends[:, 0], ends[:, 1]
    with np.errstate(over="ignore"):
        up, down = C._powers(1 << max(14, int(len(lines)).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(lines) * up[: len(lines)])])
        return start, stop, C.mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def _flat(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column's arrays, and where each array begins."""
    own = [np.frombuffer(v.as_buffer(), kind) for v in column]
    return np.concatenate([*own, np.zeros(0, kind)]), np.concatenate([[0], np.cumsum([len(v) for v in own], dtype=np.int64)])


def _seeds(least: int):
    """The distinct runs of each text."""

    def seeds(batches):
        C.begin("linededup")
        for batch in batches:
            (lines, first), (words, _) = _flat(batch.column(2), "<u8"), _flat(batch.column(3), "<i4")
            start, _, run = minimal_runs(lines, words, first, least)
            own = np.unique(np.stack([np.searchsorted(first, start, "right") - 1, run.view(np.int64)], 1), axis=0)
            take = pa.array(own[:, 0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(own[:, 1], pa.int64())], ["doc", "th", "run"])

    return seeds


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, that also ascends in the second."""
    tails, where, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        tails[p:p + 1] = [j]
        where[p:p + 1] = [k]
        back.append(where[p - 1] if p else -1)
    out, k = [], where[-1] if where else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _anchors(x: list[int], y: list[int], blank: int) -> list[tuple[int, int]]:
    """Places of equal lines in ascending order on both sides: of lines unique on both, or else of equal counts before."""

    def unique(lines):
        seen = Counter(lines)
        return {v: k for k, v in enumerate(lines) if v != blank and seen[v] == 1}

    def numbered(lines):
        seen: Counter = Counter()
        out = {}
        for k, v in enumerate(lines):
            if v != blank:
                out[v, seen[v]] = k
                seen[v] += 1
        return out

    for places in (unique, numbered):
        own, other = places(x), places(y)
        found = sorted((i, other[v]) for v, i in own.items() if v in other)
        if found:
            return _increasing(found)
    return []


def common_blocks(x: list[int], y: list[int], blank: int = 0) -> list[tuple[int, int, int]]:
    """Patience diff: blocks ``(start in x, start in y, lines)`` of equal lines in the same order."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(x), 0, len(y))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and x[a] == y[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        anchors = [(a + i, c + j) for i, j in _anchors(x[a:b], y[c:d], blank)]
        if anchors:
            matched += anchors
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    blocks: list[list[int]] = []
    for i, j in sorted(matched):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    return [tuple(b) for b in blocks]


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of each stretch, one stretch after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())


def shared_runs(x: np.ndarray, y: np.ndarray, x_words: np.ndarray, y_words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``y`` that ``x`` has too: start in x, start in y, lines."""
    xs, xe, xh = minimal_runs(x, x_words, np.array([0, len(x)]), least)
    ys, ye, yh = minimal_runs(y, y_words, np.array([0, len(y)]), least)
    known, where = np.unique(xh, return_index=True)
    if not len(known) or not len(yh):
        return ys[:0], ys[:0], ys[:0]
    at = np.minimum(np.searchsorted(known, yh), len(known) - 1)
    of = where[at]
    hit = (known[at] == yh) & (xe[of] - xs[of] == ye - ys)
    start, length, of = ys[hit], (ye - ys)[hit], of[hit]
    if not hit.any():
        return start, start, length
    same = np.logical_and.reduceat(x[_spread(xs[of], length)] == y[_spread(start, length)], np.cumsum(length) - length)
    return xs[of][same], start[same], length[same]


def grown(x: list[int], y: list[int], i: int, j: int, n: int) -> tuple[int, int]:
    """Start and end in ``y`` of the block of equal lines around ``n`` lines at ``i`` and ``j``."""
    to, stop = i + n, j + n
    while i and j and x[i - 1] == y[j - 1]:
        i, j = i - 1, j - 1
    while to < len(x) and stop < len(y) and x[to] == y[stop]:
        to, stop = to + 1, stop + 1
    return j, stop


def aligned_lines(x: np.ndarray, y: np.ndarray, x_words: np.ndarray, y_words: np.ndarray, least: int) -> np.ndarray:
    """The lines with words of ``y`` that go: those of the blocks of ``least`` words that are aligned with ``x``.

    Patience diff aligns what is left of ``y`` again and again.  Where it finds no block, but a run with a line that still
    stands is shared, that run is the anchor: the texts are aligned from it both ways.
    """
    early, late, size = x.tolist(), y.tolist(), np.concatenate([[0], np.cumsum(y_words, dtype=np.int64)])
    gone = np.zeros(len(y), bool)
    left = [(0, len(y))]
    while left:
        a, b = left.pop()
        if size[b] - size[a] < least:
            continue
        blocks = [(a + j, a + j + n) for _, j, n in common_blocks(early, late[a:b]) if size[a + j + n] - size[a + j] >= least]
        for start, stop in blocks:
            gone[start:stop] = True
        if blocks:
            edges = [a, *(k for block in sorted(blocks) for k in block), b]
            left += list(zip(edges[::2], edges[1::2], strict=True))
    for i, j, n in zip(*(k.tolist() for k in shared_runs(x, y, x_words, y_words, least)), strict=True):
        if not gone[j : j + n].all():
            start, stop = grown(early, late, i, j, n)
            gone[start:stop] = True
    return np.flatnonzero(gone & (y_words > 0))


def _blanks(gone: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blank lines before which, and after which, the nearest line with words is gone or there is none."""
    n = len(words)
    lost = np.zeros(n + 2, bool)
    lost[gone + 1] = True
    lost[[0, -1]] = True
    place = np.arange(n + 2)
    full = np.concatenate([[True], words > 0, [True]])
    last = np.maximum.accumulate(np.where(full, place, 0))
    following = np.minimum.accumulate(np.where(full, place, n + 1)[::-1])[::-1]
    return np.flatnonzero(~full & lost[last]) - 1, np.flatnonzero(~full & lost[following]) - 1


def _aligner(least: int):
    def align(batches):
        C.begin("linededup")
        for batch in batches:
            rows, out = [], []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in (1, 2))
                v, w = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i4") for c in (3, 4))
                gone = aligned_lines(x, y, v, w, least)
                if len(gone):
                    rows.append(i)
                    out.append((gone, *_blanks(gone, w)))
            lists = [pa.array([o[k] for o in out], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *lists], ["th", "gone", "after", "before"])

    return align


def deletions(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(th, first, whole, gone)``: of each text (by hash) its first document, the line numbers, from 0, that this
    document loses (null: none), and whether other documents with the text lose all of it."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where("doc is not null and text is not null")
    signed = rows.mapInArrow(_signatures, f"doc {kind}, th long, lines binary, words binary, total long")
    signed = C.staged(signed.groupBy("th").agg(F.min("doc").alias("doc"), *[F.any_value(c).alias(c) for c in ("lines", "words", "total")]), "line-signatures")
    seeds = C.staged(signed.select("doc", "th", "lines", "words").mapInArrow(_seeds(block_words), f"doc {kind}, th long, run long"), "line-runs")
    # A table of its own, so that the join's large side can be split where one run is frequent.
    holders = C.saved(seeds.groupBy("run").agg(F.count("*").alias("held"), F.min(F.struct("doc", "th")).alias("owner")).where("held > 1").select("run", F.col("owner.th").alias("owner")))
    pairs = seeds.select("run", "th").join(holders, "run").where("th <> owner").select("th", "owner").distinct()
    early = signed.select(F.col("th").alias("owner"), F.col("lines").alias("early"), F.col("words").alias("early_words"))
    late = signed.select("th", F.col("lines").alias("late"), "words")
    aligned = pairs.join(late, "th").join(early, "owner").select("th", "early", "late", "early_words", "words")
    lost = aligned.mapInArrow(_aligner(block_words), "th long, gone array<int>, after array<int>, before array<int>")
    gone, after, before = (F.flatten(F.collect_list(c)) for c in ("gone", "after", "before"))
    lost = lost.groupBy("th").agg(F.array_sort(F.array_union(gone, F.array_intersect(after, before))).alias("gone"))
    return signed.select("th", F.col("doc").alias("first"), (F.col("total") >= block_words).alias("whole")).join(lost, "th", "left").where("whole or gone is not null")


def _cutter(text_at: int, kept: int, names: list[str]):
    """Cut the lines in the last column (null: none) out of the text; an empty list there stands for all lines."""

    def cut(batches):
        C.begin("linededup")
        for batch in batches:
            bodies, lost = batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out, count, numbers, empty = [], [], [], []
            for body, gone in zip(bodies, lost, strict=True):
                n = 0 if body is None else body.count("\n") + 1
                if gone is not None:
                    gone = gone or range(n)
                    away = set(gone)
                    body = "\n".join(line for k, line in enumerate(body.split("\n")) if k not in away)
                out.append(body)
                count.append(n)
                numbers.append(list(gone) if gone is not None else [])
                empty.append(gone is not None and not body.strip(" \t\n\v\f\r"))
            columns = list(batch.columns[:kept])
            columns[text_at] = pa.array(out, batch.column(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(empty, pa.bool_())], names)

    return cut


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with repeated blocks cut out of ``text``, and ``n_lines``, ``deleted_lines`` and ``all_deleted``."""
    docs = docs.drop(*[c for c in ("n_lines", "deleted_lines", "all_deleted", "_th", "_first", "_whole", "_gone") if c not in (text, id_col)])
    lost = C.staged(deletions(docs, id_col, text, block_words), "line-deletions").toDF("_th", "_first", "_whole", "_gone")
    keyed = docs.withColumn("_h", F.when(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{text}`").isNotNull(), F.xxhash64(F.col(f"`{text}`"))))
    joined = keyed.join(lost, F.col("_h") == F.col("_th"), "left")
    again = F.col("_whole") & (F.col(f"`{id_col}`") != F.col("_first"))
    gone = F.when(again, F.array().cast("array<int>")).otherwise(F.col("_gone"))
    rows = joined.select(*[F.col(f"`{c}`") for c in docs.columns], gone.alias("_gone"))
    added = [T.StructField("n_lines", T.LongType()), T.StructField("deleted_lines", T.ArrayType(T.IntegerType())), T.StructField("all_deleted", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])
    return rows.mapInArrow(_cutter(docs.columns.index(text), len(docs.columns), schema.names), schema)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = dedup_lines(docs)
    return found.select("doc_id", "n_lines", F.size("deleted_lines").cast("long").alias("n_deleted"), F.array_join("deleted_lines", ",").alias("deleted_lines"), "text")
