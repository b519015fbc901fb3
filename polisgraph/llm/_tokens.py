"""Token ids of whole texts with the tokenizers library, with each chunk encoded once per worker.

Byte-level BPE never merges across the start of a run of white space that follows other text, so a text
is cut there and the ids of its chunks, joined, are the ids of the text.  Chunks repeat, so Arrow finds the different ones of
a batch, and a worker keeps the ids of up to ``CACHE_CHUNKS`` of them.  Special tokens' strings inside a text are ordinary text.
New chunks are encoded many to a call, joined by spaces: each begins at the only ids that open with a space.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from polisgraph.llm import _common as C

#: Chunks whose ids a worker keeps; when the table is full, those of the batch at hand stay.
CACHE_CHUNKS = 1_000_000
#: New chunks that are encoded as one text.
JOINED_CHUNKS = 500
_ENCODERS: dict[str, Encoder] = C.kept("tokens")
_IRREGULAR = re.compile(r"\s ")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[str, bytes] = {}
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.opens[k] = token.startswith("\u0120")  # a space in byte-level vocabularies

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[str]) -> None:
        """Cache the ids of chunks that hold no space and do not end in white space, each after a space."""
        groups = [chunks[at : at + JOINED_CHUNKS] for at in range(0, len(chunks), JOINED_CHUNKS)]
        for group, raw in zip(groups, self.whole([" " + " ".join(g) for g in groups]), strict=True):
            starts = (4 * np.flatnonzero(self.opens[np.frombuffer(raw, "<u4")])).tolist()
            if len(starts) == len(group):
                self.cache.update(zip(group, map(raw.__getitem__, map(slice, starts, [*starts[1:], len(raw)])), strict=True))
            else:
                self.learn_each(group)

    def learn_each(self, chunks: list[str]) -> None:
        self.cache.update(zip(chunks, self.whole([" " + w for w in chunks]), strict=True))

    def _known(self, chunks: list[str], single: set[str] | None = None) -> list[bytes]:
        """Ids of different chunks, each after a space; those in ``single``, or all without it, are learned one to a call."""
        found = list(map(self.cache.get, chunks))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if len(self.cache) + len(missing) > CACHE_CHUNKS:
            self.cache = {w: ids for w, ids in zip(chunks, found, strict=True) if ids is not None}
        new = [chunks[k] for k in missing]
        alone = new if single is None else [w for w in new if w in single]
        joined = [] if single is None else [w for w in new if w not in single]
        for group, learn in ((joined, self.learn), (alone, self.learn_each)):
            for at in range(0, len(group), 50_000):
                learn(group[at : at + 50_000])
        for k, w in zip(missing, new, strict=True):
            found[k] = self.cache[w]
        return found

    def ids(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null has none."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = column.to_pylist() if column is texts else texts
        out = [b""] * len(texts)
        regular = []
        for k, text in enumerate(texts):
            if not text:
                continue
            if text[0] == " " or _IRREGULAR.search(text):
                first, rest = _cut(text)
                found = dict(zip(each := list(set(rest)), self._known(each), strict=True))
                out[k] = self.whole([first])[0] + b"".join(map(found.__getitem__, rest))
            else:
                regular.append(k)
        for k, found in zip(regular, self._regular(column.take(pa.array(regular, pa.int64()))), strict=True) if regular else ():
            out[k] = found
        return out

    def _regular(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that begin with no space and have none after white space: every space begins a chunk."""
        cut = pc.split_pattern(texts.cast(pa.large_string()), " ")
        begin = np.asarray(cut.offsets).astype(np.int64)
        words = cut.values.dictionary_encode()
        place, chunks = np.asarray(words.indices).astype(np.int64), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = begin[:-1]
        firsts = self.whole([chunks[p] for p in place[heads].tolist()])
        rest = np.ones(len(place), bool)
        rest[heads] = False
        asked = np.zeros(len(chunks), bool)
        asked[place[rest]] = True
        # Only a text's end can be white space here, and such a chunk is not followed by another.
        last = (chunks[p] for p in np.unique(place[begin[1:] - 1]).tolist())
        ends = {w for w in last if not w or w[-1].isspace()}
        held: list[bytes] = [b""] * len(chunks)
        at = np.flatnonzero(asked).tolist()
        for k, found in zip(at, self._known([chunks[k] for k in at], ends), strict=True):
            held[k] = found
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        source = np.frombuffer(b"".join(held), "<u4")
        start = np.cumsum(size) - size
        # Each chunk's ids in the order of the texts; a text's first chunk is put before them.
        n = np.where(rest, size[place], 0)
        done = np.cumsum(n)
        stream = source[np.repeat(start[place] - (done - n), n) + np.arange(done[-1])].tobytes()
        upto = [0, *(4 * done[begin[1:] - 1]).tolist()]
        return [first + stream[a:b] for first, a, b in zip(firsts, upto, upto[1:], strict=False)]


def _cut(text: str) -> tuple[str, list[str]]:
    """The text cut before each space that follows something that isn't white space; without that space."""
    parts = re.split(r"(?<=\S) ", text)
    return parts[0], parts[1:]


def encoder(path: str) -> Encoder:
    C.begin("tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
