"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

A task walks the bytes of its rows.  Texts are cut into pieces of about ``PIECE_BYTES`` at safe boundaries, and pieces
of neighbouring rows fill batches of about ``BATCH_BYTES``, so neither a long text nor many short ones make a batch
large.  A batch's pieces are cut again before each space that follows something else; these chunks repeat, so a worker
keeps the counts of up to ``CACHE_CHUNKS`` short ones and the library encodes, many to a call, only those that are new.
Nothing is shuffled, and no id leaves the function.

A boundary is safe where the tokens of both sides, joined, are those of the whole:

* byte-level BPE whose pattern is the usual one: before a space after a character that is not white space, since no
  match of the pattern holds both;
* sentencepiece models that put a space before a text and have no piece with a space inside: at such a space, which the
  right side leaves out as the model adds it again.

Any other vocabulary gets whole texts.  Strings of special tokens inside a text are handled as the library does by default,
and neither begin nor end tokens are added, nor is anything truncated or padded.

Defined cases: a null or empty text has no bytes and no tokens; repeated rows and ids are counted one by one; rows with a
null id are counted too; a text without a safe boundary is encoded whole; an empty table has no rows.  Only the id and
text columns are read, so further columns may have any names.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polisgraph.llm import _common as C
from polisgraph.llm import _tokens

#: A text of more tokens is over the limit.
LIMIT_TOKENS = 1024
PIECE_BYTES, BATCH_BYTES = 256 << 10, 1 << 20
#: Chunks whose counts a worker keeps, and the longest of them; the table is emptied when full.
CACHE_CHUNKS, CACHE_CHARS = 1_000_000, 64
#: New chunks that are encoded as one text.
JOINED_CHUNKS = 500
_KEPT = C.kept("token-counts")
_BOUNDARY = re.compile(rb"(?<=[!-~]) ")
_CHUNK, _SINGLE, _IRREGULAR = re.compile(r"(?<=\S) "), re.compile(r"(?<=[!-~]) (?=[!-~])"), re.compile(r"\s ")


class Library:
    """One vocabulary: ``.json`` by tokenizers, ``.model`` by sentencepiece."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.counts: dict[str, int] = {}  # by chunk, without the space before it
        self.opens = None  # tokens that open with a space, where chunks may be encoded joined by spaces
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda texts: model.encode(texts, num_threads=1)
            inside = any("▁" in model.id_to_piece(k).lstrip("▁") for k in range(model.vocab_size()))
            self.cuts, self.space = not inside and model.encode("a", out_type=str)[0].startswith("▁"), ""
            self.special = None
        else:
            from tokenizers import Tokenizer

            found = Tokenizer.from_file(path)
            found.no_truncation()
            found.no_padding()
            self.ids = lambda texts: [e.ids for e in found.encode_batch_fast(texts, add_special_tokens=False)]
            parts = json.loads(found.to_str())
            shape, added = parts["pre_tokenizer"] or {}, parts["added_tokens"]
            plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
            self.cuts = plain and parts["normalizer"] is None and parts["model"]["type"] == "BPE" and shape.get("type") == "ByteLevel" and shape["use_regex"] and not shape["add_prefix_space"]
            self.space = " "
            self.special = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
            if self.cuts:
                self.opens = np.zeros(found.get_vocab_size(), bool)
                for token, k in found.get_vocab().items():
                    self.opens[k] = token.startswith("\u0120")  # a space in byte-level vocabularies

    def lengths(self, texts: list[str]) -> list[int]:
        return list(map(len, self.ids(texts)))

    def _joined(self, chunks: list[str]) -> None:
        """Counts of chunks without spaces, special strings or white space at the end, each encoded after a space."""
        groups = [chunks[at : at + JOINED_CHUNKS] for at in range(0, len(chunks), JOINED_CHUNKS)]
        for group, ids in zip(groups, self.ids([" " + " ".join(g) for g in groups]), strict=True):
            starts = np.flatnonzero(self.opens[np.array(ids, np.int64)])
            if len(starts) == len(group):
                self.counts.update(zip(group, np.diff(starts, append=len(ids)).tolist(), strict=True))
            else:
                self._single(group)

    def _single(self, chunks: list[str]) -> None:
        self.counts.update(zip(chunks, self.lengths([self.space + c for c in chunks]), strict=True))

    def count(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece; a piece right of a boundary begins with its space, if spaces are kept."""
        if not self.cuts:
            return self.lengths(pieces)
        if len(self.counts) > CACHE_CHUNKS:
            self.counts.clear()
        cut, firsts = [], []
        plain: set[str] = set()
        other: set[str] = set()
        for piece in pieces:
            if self.opens is None:
                first, *rest = _SINGLE.split(piece)
                other.update(rest)
            elif piece[0] == " " or _IRREGULAR.search(piece):
                first, *rest = _CHUNK.split(piece)
                other.update(rest)
            else:
                first, *rest = piece.split(" ")
                plain.update(rest)
                if rest and (not rest[-1] or rest[-1][-1].isspace()):  # only a piece's end can be white space here
                    plain.discard(rest[-1])
                    other.add(rest[-1])
            firsts.append(first)
            cut.append(rest)
        plain -= other
        if self.special is not None:
            odd = {c for c in plain.difference(self.counts) if self.special.search(c)}
            plain, other = plain - odd, other | odd
        for chunks, learn in ((plain, self._joined), (other, self._single)):
            for group in _filled(list(chunks.difference(self.counts))):
                learn(group)
        get = self.counts.__getitem__
        out = [n + sum(map(get, rest)) for n, rest in zip(self.lengths(firsts), cut, strict=True)]
        for c in [c for c in plain | other if len(c) > CACHE_CHARS]:
            del self.counts[c]
        return out


def _filled(chunks: list[str]):
    """Groups of chunks of at most ``BATCH_BYTES`` characters, or of one longer chunk."""
    at = 0
    ends = np.cumsum([len(c) for c in chunks])
    while at < len(chunks):
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + BATCH_BYTES, "right")))
        yield chunks[at:to]
        at = to


def pieces(data: memoryview, start: int, stop: int, keep_space: bool, limit: int = PIECE_BYTES):
    """Ranges of bytes of one text, each from one safe boundary to a next one at least ``limit`` bytes on."""
    drop = 0 if keep_space else 1
    while stop - start > limit:
        found = _BOUNDARY.search(data, start + limit, stop)
        while found and drop and not (found.end() < stop and 33 <= data[found.end()] <= 126):
            found = _BOUNDARY.search(data, found.end(), stop)
        if found is None:
            break
        yield start, found.start()
        start = found.start() + drop
    yield start, stop


def _library(path: str) -> Library:
    C.begin("token-counts")
    if path not in _KEPT:
        _KEPT[path] = Library(path)
    return _KEPT[path]


def _counter(path: str):
    def count(batches):
        library = _library(path)
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(1))
            view, tokens = memoryview(data), np.zeros(batch.num_rows, np.int64)
            rows: list[int] = []
            texts: list[str] = []
            size = 0

            def flush():
                np.add.at(tokens, rows, library.count(texts))  # noqa: B023
                rows.clear()  # noqa: B023
                texts.clear()  # noqa: B023

            for k in np.flatnonzero(np.diff(offsets)).tolist():
                a, b = int(offsets[k]), int(offsets[k + 1])
                for x, y in pieces(view, a, b, library.space == " ") if library.cuts else [(a, b)]:
                    if size + y - x > BATCH_BYTES and texts:
                        flush()
                        size = 0
                    rows.append(k)
                    texts.append(str(view[x:y], "utf-8"))
                    size += y - x
            if texts:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = LIMIT_TOKENS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    found = rows.mapInArrow(_counter(vocabulary or _tokens.default_vocabulary()), schema)
    return found.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(C.read_table(spark, sf_dir, "documents"))
