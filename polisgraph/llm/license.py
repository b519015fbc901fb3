"""License scan: MinHash bands over overlapping windows, then exact shingle containment.

Texts are words (A-Z lowered, split at white space and ASCII punctuation) and five-word shingles.  For a
template of ``t`` shingles the document is cut into blocks of half of the next length class above ``t``;
three neighbouring blocks are a window, so every passage as long as the template lies in one window whole.
A window that holds 0.8 of the template has at least the Jaccard similarity ``least_jaccard``, and
``band_settings`` takes as many bands as make a miss at that similarity rarer than ``MISS``.  Every shingle is hashed
once a band for all templates, and a window's band is looked up among those of all templates of its class.
Windows that share a band with a template are verified: in each stretch of such windows the shortest passages that
hold 0.8 of the template's shingles are found one after another, so a text reports every notice that it has.

Every document is scanned once, in its own task, without a shuffle.  Templates are a small side: they are taken in
blocks of about ``MAX_TEMPLATE_WORDS`` words, and each further block is one more step over the same rows.

Defined cases: a null, empty or wordless text has no match; a template that is null or wordless, or without a
license, is dropped; one of fewer than five words is a single shingle of its own width; equal templates both match;
repeated rows are each reported; an empty table, and templates without a row, give no match; input columns named like
an added one are replaced, others pass through.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polisgraph.llm import _common as C
from polisgraph.llm import license_texts as texts

WIDTH = 5
#: Share of a template's shingles that a window must hold.
CONTAINMENT = 0.8
#: Chance to miss a window that holds it.
MISS = 1e-6
#: Length classes of templates grow by this factor.
CLASS_STEP = 1.25
#: Words of the templates of one step.
MAX_TEMPLATE_WORDS = 1_000_000
_SLICE = 2 << 20

#: Notices by which works name their license, and whole texts of short ones.
TEMPLATES = [
    ("MIT", texts.MIT),
    ("ISC", texts.ISC),
    ("BSD", texts.BSD_2),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def length_class(shingles: int) -> int:
    """Half of the smallest class length that is at least ``shingles``: a window's stride."""
    size = 2.0
    while size < shingles:
        size = max(size + 1, size * CLASS_STEP)
    return max(1, math.ceil(int(size) / 2))


def least_jaccard(stride: int, shingles: int, containment: float = CONTAINMENT) -> float:
    """Similarity of a template and a window of three strides that holds ``containment`` of it, at the worst."""
    held = math.ceil(containment * shingles)
    return held / (3 * stride + shingles - held)


def band_settings(jaccard: float, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows in each, the fewest hashes of which a pair of this similarity shares a band but for ``miss``."""
    best = None
    for rows in range(1, 9):
        bands = math.ceil(math.log(miss) / math.log1p(-min(jaccard**rows, 1 - 1e-12)))
        if best is None or bands * rows < best[0] * best[1]:
            best = (bands, rows)
    return best


class Templates:
    """Shingle sets and band values of all templates, by shingle width and window stride."""

    def __init__(self, rows: list[tuple[str, str]], containment: float = CONTAINMENT, miss: float = MISS):
        self.containment, self.names = containment, []
        self.sets: list[np.ndarray] = []
        classes: dict[tuple[int, int], list[int]] = {}
        worst = 1.0
        for name, text in rows:
            words, _ = C.word_hashes(pa.array([text], pa.string()), C.ALNUM)
            if name is None or not len(words):
                continue
            width = min(WIDTH, len(words))
            own = np.unique(C.shingles(words, width))
            stride = length_class(len(words) - width + 1)
            classes.setdefault((width, stride), []).append(len(self.sets))
            worst = min(worst, least_jaccard(stride, len(own), containment))
            self.names.append(name)
            self.sets.append(own)
        self.bands, self.rows = band_settings(worst, miss)
        seeds = C.mix(np.arange(1, 2 * self.bands * self.rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.flip, self.times = seeds[::2], seeds[1::2] | np.uint64(1)
        #: Width to stride to, for each band, the templates of a band value.
        self.marks: dict[int, dict[int, list[dict[int, list[int]]]]] = {}
        for (width, stride), members in classes.items():
            tables: list[dict[int, list[int]]] = [{} for _ in range(self.bands)]
            for t in members:
                for band, value in enumerate(self.signature(self.sets[t])):
                    tables[band].setdefault(value, []).append(t)
            self.marks.setdefault(width, {})[stride] = tables

    def hashed(self, k: int, shingles: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (shingles ^ self.flip[k]) * self.times[k]
            return x ^ (x >> np.uint64(32))

    def folded(self, value: np.ndarray, low: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return value * np.uint64(0xD6E8FEB86659FD93) + low

    def signature(self, shingles: np.ndarray) -> list[int]:
        out = []
        for band in range(self.bands):
            value = np.zeros(1, np.uint64)
            for k in range(band * self.rows, (band + 1) * self.rows):
                value = self.folded(value, self.hashed(k, shingles).min())
            out.append(int(value[0]))
        return out

    def scan(self, words: np.ndarray, first: np.ndarray) -> list[list[tuple[int, float, int, int]]]:
        """Of each text: template, containment, first and last word of each passage that holds a template."""
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in range(len(first) - 1)]
        for width, strides in sorted(self.marks.items()):
            cut = [C.shingles(words[a:b], width) if b - a >= width else words[:0] for a, b in zip(first, first[1:], strict=False)]
            base = np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])
            flat = np.concatenate(cut) if cut else words[:0]
            if len(flat):
                self._windows(flat, base, width, strides, out)
        return [sorted(x) for x in out]

    def _windows(self, flat, base, width, strides, out) -> None:
        shapes = {}
        for stride in strides:
            blocks = -(-np.diff(base) // stride)
            start = np.concatenate([[0], np.cumsum(blocks)])
            owner = np.repeat(np.arange(len(blocks)), blocks)
            cuts = base[owner] + (np.arange(len(owner)) - start[owner]) * stride
            last, places = start[owner + 1] - 1, np.arange(len(owner))  # a text's last block
            shapes[stride] = owner, cuts, np.minimum(places + 1, last), np.minimum(places + 2, last)
        found: dict[tuple[int, int], set[tuple[int, int]]] = {}
        for band in range(self.bands):
            value = {stride: np.zeros(len(shapes[stride][0]), np.uint64) for stride in strides}
            for k in range(band * self.rows, (band + 1) * self.rows):
                hashed = self.hashed(k, flat)
                for stride, (_, cuts, second, third) in shapes.items():
                    low = np.minimum.reduceat(hashed, cuts)
                    value[stride] = self.folded(value[stride], np.minimum(low, np.minimum(low[second], low[third])))
            for stride, tables in strides.items():
                known = np.sort(np.fromiter(tables[band], np.uint64, len(tables[band])))
                at = np.minimum(np.searchsorted(known, value[stride]), len(known) - 1)
                owner, cuts, _, _ = shapes[stride]
                for i in np.flatnonzero(known[at] == value[stride]).tolist():
                    doc, a = int(owner[i]), int(cuts[i])
                    for t in tables[band][int(value[stride][i])]:
                        found.setdefault((doc, t), set()).add((a, min(a + 3 * stride, int(base[doc + 1]))))
        for (doc, t), windows in found.items():
            reach: list[list[int]] = []
            for a, b in sorted(windows):
                if reach and a <= reach[-1][1]:
                    reach[-1][1] = max(reach[-1][1], b)
                else:
                    reach.append([a, b])
            for a, b in reach:
                for share, x, y in passages(flat[a:b], self.sets[t], self.containment):
                    out[doc].append((t, share, a - int(base[doc]) + x, a - int(base[doc]) + y + width - 1))


def passages(shingles: np.ndarray, template: np.ndarray, containment: float) -> list[tuple[float, int, int]]:
    """Disjoint stretches that hold ``containment`` of a template, the earliest end first: share, first and last place.

    A stretch is as short as it can be, and then goes on while the template does.
    """
    need = max(1, math.ceil(containment * len(template) - 1e-9))
    at = np.flatnonzero(np.isin(shingles, template)).tolist()
    values = shingles[at].tolist()
    out, held, left, right = [], Counter(), 0, 0
    while right < len(at):
        held[values[right]] += 1
        if len(held) >= need:
            while held[values[left]] > 1 or len(held) > need:
                held[values[left]] -= 1
                if not held[values[left]]:
                    del held[values[left]]
                left += 1
            while right + 1 < len(at) and at[right + 1] - at[right] <= 2 * WIDTH and values[right + 1] not in held:
                right += 1
                held[values[right]] += 1
            out.append((len(held) / len(template), at[left], at[right]))
            held, left = Counter(), right + 1
        right += 1
    return out


_HELD: dict[str, Templates] = C.kept("license")


def _templates(key: str, held) -> Templates:
    if key not in _HELD:
        _HELD[key] = Templates(*held.value)
    return _HELD[key]


def _blocks(rows: Iterable[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    block, words = [], 0
    for name, text in rows:
        block.append((name, text))
        words += len((text or "").split())
        if words >= MAX_TEMPLATE_WORDS:
            yield block
            block, words = [], 0
    yield block


def _scanner(key: str, held, text_at: int, names: list[str]):
    kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        C.begin("license")
        templates = _templates(key, held)
        for whole in batches:
            _, offsets = C.text_buffers(whole.column(text_at))
            for a, b in C.row_slices(offsets, _SLICE):
                batch = whole.slice(a, b - a)
                data, own = C.text_buffers(batch.column(text_at))
                starts, ends, first = C.word_spans(data, own, C.ALNUM)
                found = []
                for i, matches in enumerate(templates.scan(C.span_hashes(data, starts, ends, C.LOWER), first)):
                    if matches:
                        chars = np.concatenate([[0], np.cumsum((data[own[i] : own[i + 1]] & 0xC0) != 0x80)])
                        place = lambda x: int(chars[x - own[i]])  # noqa: B023, E731
                        matches = [{"license": templates.names[t], "containment": share, "start": place(starts[first[i] + x]), "end": place(ends[first[i] + y])} for t, share, x, y in matches]
                    found.append(matches)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names)

    return scan


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame | None = None, text: str = "text", containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """Every row of ``docs`` with ``matches``: license, containment, and character offsets in the original text.

    ``templates``: pairs of license and text, or a DataFrame with the columns ``license`` and ``text``.
    """
    if isinstance(templates, DataFrame):
        rows = ((r[0], r[1]) for r in templates.where(F.col("license").isNotNull() & F.col("text").rlike(r"\S")).select("license", "text").toLocalIterator())
    else:
        rows = TEMPLATES if templates is None else templates
    docs = docs.drop(*[c for c in ("matches", "_more") if c != text])
    match = T.StructType([T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = None
    for block in _blocks(rows):
        held = docs.sparkSession.sparkContext.broadcast((block, containment, miss))
        source = docs if out is None else out
        schema = T.StructType([*source.schema.fields, T.StructField("matches" if out is None else "_more", T.ArrayType(match))])
        found = source.mapInArrow(_scanner(uuid.uuid4().hex, held, docs.columns.index(text), schema.names), schema)
        out = found if out is None else found.withColumn("matches", F.concat("matches", "_more")).drop("_more")
    return out


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(C.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.round(best, 6).alias("containment"), spans.alias("spans"))
