"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts are cut into windows of 13 consecutive normalised words (a text with fewer words, but
at least one, is one window).  The automaton over those windows, with words as symbols, scans every
document once; the word positions it reports are mapped back to character offsets of the original.

The windows of one automaton and the item ids that they name are bounded by ``BLOCK_WORDS`` together, so many equal items
are several blocks too.  A larger benchmark is scanned block after
block, with the marks so far written to the shared folder in between, so neither the driver nor a worker
ever holds more than one block.

Defined cases: a null or wordless text has no words and no hits; items that are null, wordless or without
an id take no part; repeated items and documents are each reported; equal item ids count once; input
columns named like an added column are replaced; other columns pass through untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polisgraph.llm import _common as C

WINDOW_WORDS = 13
#: Words in the windows of one automaton and ids at them: about 200 MB of states at most.
BLOCK_WORDS = 2_000_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else (b if C.ALNUM[b] else 32) for b in range(256))
_AUTOMATA: dict[str, tuple] = C.kept("decontaminate")

_MARKS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.LongType())),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
        T.StructField("hit_chars", T.ArrayType(T.LongType())),
    ]
)
_ARROW = {"n_words": pa.int64(), "hit_words": pa.list_(pa.int64()), "hit_items": pa.list_(pa.string()), "hit_chars": pa.list_(pa.int64())}


def normal_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").translate(_FOLD).split()


def _blocks(items: Iterator[tuple], width: int, limit: int) -> Iterator[dict[tuple, dict[str, None]]]:
    """Windows to the ids of the items that hold them, in blocks of bounded size."""
    block, held = {}, 0
    for item_id, text in items:
        words = normal_words(text)
        if item_id is None or not words:
            continue
        for k in range(max(1, len(words) - width + 1)):
            window = tuple(words[k : k + width])
            ids = block.setdefault(window, {})
            held += 0 if ids else len(window)
            held += item_id not in ids
            ids[item_id] = None
            if held >= limit:
                yield block
                block, held = {}, 0
    yield block


def _automaton(key: str, block: dict[tuple, list[str]]) -> tuple:
    if key not in _AUTOMATA:
        import ahocorasick

        _AUTOMATA.clear()
        symbols: dict[bytes, int] = {}
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in block.items():
            machine.add_word(tuple(symbols.setdefault(w, len(symbols) + 1) for w in window), (len(window), ids))
        if block:
            machine.make_automaton()
        _AUTOMATA[key] = (symbols, machine)
    return _AUTOMATA[key]


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def char_spans(text: bytes, words: list[int]) -> list[int]:
    """Character offsets of flat word spans."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = C.word_spans(data, np.array([0, len(data)]), C.ALNUM)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out: list[int] = []
    for a, b in zip(words[::2], words[1::2], strict=True):
        out += [int(chars[starts[a]]), int(chars[ends[b - 1]])]
    return out


def _scan(batches, text_at: int, key: str, block: dict, fields: list[str], marked: bool):
    C.begin("decontaminate")
    symbols, machine = _automaton(key, block)
    get = symbols.get
    for batch in batches:
        data, offsets = C.text_buffers(batch.column(text_at))
        raw = data.tobytes()
        folded = raw.translate(_FOLD)
        before = batch.column(batch.num_columns - 1).to_pylist() if marked else None
        marks = []
        for i in range(batch.num_rows):
            a, b = int(offsets[i]), int(offsets[i + 1])
            words = folded[a:b].split()
            spans, ids = [], set()
            if block and words:
                for end, (width, items) in machine.iter(tuple([get(w, 0) for w in words])):
                    spans.append((end - width + 1, end + 1))
                    ids.update(items)
            if before:
                old = before[i]["hit_words"]
                spans += zip(old[::2], old[1::2], strict=True)
                ids.update(before[i]["hit_items"])
            flat = _merged(spans)
            marks.append((len(words), flat, sorted(ids), char_spans(raw[a:b], flat) if flat else []))
        columns = list(zip(*marks, strict=True)) or [[], [], [], []]
        new = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.values(), strict=True)], list(_ARROW))
        kept = batch.columns[: batch.num_columns - int(marked)]
        yield pa.RecordBatch.from_arrays([*kept, new], fields)


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", width: int = WINDOW_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``item_ids``, ``hit_spans`` and ``contaminated``.

    ``hit_spans`` holds the character offsets (start, end) of the merged hits in the original text.  A
    document is contaminated if at least one word in twenty is inside a window.
    """
    spark = docs.sparkSession
    added = ["_marks", "n_words", "n_hit", "n_items", "item_ids", "hit_spans", "contaminated"]
    docs = docs.drop(*[c for c in added if c != text])
    items = ((r[0], r[1]) for r in benchmark.select(F.col(item_id).cast("string"), F.col(item_text)).toLocalIterator())
    marked, out = False, docs
    for block in _blocks(items, width, block_words):
        if marked and not block:
            break
        if marked:
            out = C.staged(out, "marks")
        held = spark.sparkContext.broadcast(block)
        fields = [*docs.columns, "_marks"]
        schema = T.StructType([*docs.schema.fields, T.StructField("_marks", _MARKS)])
        scan = _scanner(docs.columns.index(text), uuid.uuid4().hex, held, fields, marked)
        out, marked = out.mapInArrow(scan, schema), True
    flat, chars = F.col("_marks.hit_words"), F.col("_marks.hit_chars")
    pairs = F.sequence(F.lit(0), F.size(chars) - 2, F.lit(2))
    n_hit = F.aggregate(F.transform(flat, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    spans = F.transform(pairs, lambda k: F.struct(F.get(chars, k).alias("start"), F.get(chars, k + 1).alias("end")))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col("_marks.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_marks.hit_items").cast("long").alias("n_items"),
        F.col("_marks.hit_items").alias("item_ids"),
        F.when(F.size(chars) > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("hit_spans"),
        ((n_hit > 0) & (20 * n_hit >= F.col("_marks.n_words"))).alias("contaminated"),
    )


def _scanner(text_at: int, key: str, held, fields: list[str], marked: bool):
    def scan(batches):
        return _scan(batches, text_at, key, held.value, fields, marked)

    return scan


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark(docs, C.read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.sort_array("item_ids"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


_FOLDED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _FOLDED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item, array_to_string(ws[k : k + least({WINDOW_WORDS}, len(ws)) - 1], ' ') AS win, least({WINDOW_WORDS}, len(ws)) AS width
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW_WORDS} + 2, 2))) AS k FROM item WHERE len(ws) > 0)
), doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents
), cut AS (
  SELECT rid, k, width, array_to_string(ws[k : k + width - 1], ' ') AS win
  FROM (SELECT rid, ws, width, unnest(range(1, len(ws) - width + 2)) AS k FROM doc, (SELECT DISTINCT width FROM win) WHERE len(ws) >= width)
), hit AS (
  SELECT c.rid, c.k, c.width, w.item FROM cut c JOIN win w ON c.win = w.win AND c.width = w.width
), word AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + width)) AS p FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(w.n_hit, 0) > 0 AND 20 * coalesce(w.n_hit, 0) >= len(d.ws) AS contaminated
FROM doc d LEFT JOIN word w ON d.rid = w.rid LEFT JOIN items i ON d.rid = i.rid
"""
