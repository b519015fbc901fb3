"""Language identification with string kernels.

The kernel of two texts is the cosine of their blended-spectrum presence vectors: which byte n-grams of two
to four bytes of the lower-cased text occur at all, over all n-grams of the landmarks (a text of one byte is taken
with a space after it).  N-grams are told apart by 20 bits of a hash.  Kernels to Nystroem
landmarks are the features, and one ridge regression per language, solved once on the driver over landmarks
times landmarks numbers, gives its scores.  A batch of texts is scored by two matrix products.

Bounds, all parameters: ``TRAIN_PER_LANG`` labelled rows of each language are fitted, ``LANDMARKS`` of them
in all are landmarks (the longest of twice as many drawn), and ``MAX_LANGS`` languages can be told apart; more
raise an error.  Copies of a text are drawn once.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows without a language, and
held-out rows, are not learned from; with one learned language every text with a letter gets it; with none,
every text is ``und``.  Repeated rows are each predicted.  Extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polisgraph.llm import _common as C

TRAIN_PER_LANG = 1500
LANDMARKS = 96
MAX_LANGS = 200
RIDGE = 1e-3
#: Width of the softmax over the regressions' values, which aim at 0 and 1.
SOFTNESS = 0.15
_ORDERS = (2, 3, 4)
_TABLE_BITS = 20
#: Texts whose presence vectors are held at a time.
_ROWS = 64
_MODELS: dict[str, tuple] = C.kept("langid")
#: Bytes of text whose n-grams are marked at a time.
_MARK_BYTES = 4 << 20


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lowered(column) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    return C.text_buffers(pc.utf8_lower(column if not isinstance(column, pa.ChunkedArray) else column.combine_chunks()))


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """The n-grams that end at each byte, as numbers that also tell their order."""
    x = data.astype(np.uint64)
    out, value = [], x
    for order in range(2, max(_ORDERS) + 1):
        value = (value[:-1] << np.uint64(8)) | x[order - 1 :]
        out.append(value | np.uint64(order << 40))
    return out


def _slot(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def _slots(data: np.ndarray) -> list[np.ndarray]:
    data = np.append(data, np.uint8(32)) if len(data) == 1 else data
    return [_slot(g) for g in _grams(data)]


def presence(column, columns: np.ndarray, width: int) -> np.ndarray:
    """Rows of 0 and 1: which columns' n-grams occur in each text.  ``columns``: column of a slot, or ``width``."""
    data, offsets = lowered(column)
    out = np.zeros((len(offsets) - 1, width + 1), np.float32)
    flat = out.ravel()
    for a in range(len(offsets) - 1):
        for at in range(int(offsets[a]), int(offsets[a + 1]), _MARK_BYTES):
            part = data[at : min(at + _MARK_BYTES + max(_ORDERS) - 1, int(offsets[a + 1]))]
            for slots in _slots(part):
                flat[a * (width + 1) + columns[slots]] = 1
    return out[:, :width]


def _normal(marks: np.ndarray) -> np.ndarray:
    return marks / np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))


def _all_slots(batches):
    C.begin("langid")
    for batch in batches:
        sets = []
        for i in range(batch.num_rows):
            data, _ = lowered(batch.column(0).slice(i, 1))
            sets.append(np.unique(np.concatenate(_slots(data))).astype("<i4").tobytes() if len(data) else b"")
        yield pa.RecordBatch.from_arrays([batch.column(1), C.binary(sets)], ["lang", "slots"])


def _features(key, held):
    def features(batches):
        C.begin("langid")
        columns, marks, _ = _model(key, held)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                k = _normal(presence(batch.column(0), columns, marks.shape[1])) @ marks.T
                yield pa.RecordBatch.from_arrays([batch.column(1), C.binary([row.astype("<f4").tobytes() for row in k])], ["lang", "kernels"])

    return features


def _model(key, held) -> tuple:
    if key not in _MODELS:
        _MODELS.clear()
        slots, packed, shape, weights = held.value
        columns = np.full(1 << _TABLE_BITS, len(slots), np.int32)
        columns[slots] = np.arange(len(slots))
        marks = _normal(np.unpackbits(np.frombuffer(packed, np.uint8))[: shape[0] * shape[1]].reshape(shape).astype(np.float32))
        _MODELS[key] = (columns, marks, weights)
    return _MODELS[key]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp((x - x.max(axis=1, keepdims=True)) / SOFTNESS)
    return e / e.sum(axis=1, keepdims=True)


def _predictor(key, held, text_at: int, langs: list[str], names: list[str]):
    def predict(batches):
        import pyarrow.compute as pc

        C.begin("langid")

        columns, marks, weights = _model(key, held)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                text = batch.column(text_at)
                lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                k = _normal(presence(text, columns, marks.shape[1])) @ marks.T
                p = _softmax(np.column_stack([k, np.ones(len(k), np.float32)]) @ weights)
                best = p.argmax(axis=1)
                pred = [langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, p[np.arange(len(best)), best], 0.0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))], names)

    return predict


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = TRAIN_PER_LANG, landmarks: int = LANDMARKS) -> tuple[list[str], tuple] | None:
    """Languages and the model, learned from the rows that are not held out; None without any such row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(~held_out("id") & F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return None
    langs = sorted(counts)
    # Rows are drawn by a hash of id and text; the shares make the expected number of rows the bound.
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)

    def sample(n: int) -> DataFrame:
        share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, n / counts[k]))])
        return rows.where(draw < share[F.col("lang")]).select("text", "lang").dropDuplicates()

    each = max(1, landmarks // len(langs))
    found = sample(2 * each).mapInArrow(_all_slots, "lang string, slots binary").collect()  # about 2 * landmarks rows
    sets, taken = [], dict.fromkeys(langs, 0)
    for r in sorted(found, key=lambda r: (r["lang"], -len(r["slots"]), r["slots"])):
        if taken[r["lang"]] < each and r["slots"]:
            taken[r["lang"]] += 1
            sets.append(np.frombuffer(r["slots"], "<i4"))
    spread = np.bincount(np.concatenate(sets), minlength=1 << _TABLE_BITS)
    slots = np.flatnonzero(spread)
    marks = np.zeros((len(sets), len(slots)), bool)
    for i, s in enumerate(sets):
        marks[i] = np.isin(slots, s)
    packed = (slots, np.packbits(marks).tobytes(), marks.shape, None)
    held = spark.sparkContext.broadcast(packed)
    fitted = sample(per_lang).mapInArrow(_features(uuid.uuid4().hex, held), "lang string, kernels binary").collect()  # per_lang rows a language
    k = np.array([np.frombuffer(r["kernels"], "<f4") for r in fitted], np.float64).reshape(len(fitted), -1)
    k = np.column_stack([k, np.ones(len(k))])
    y = np.array([[r["lang"] == x for x in langs] for r in fitted], np.float64)
    weight = 1 / np.maximum(y.sum(axis=0), 1)
    w = (y @ weight)[:, None]
    normal = marks / np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    among = np.zeros((k.shape[1], k.shape[1]))
    among[: len(marks), : len(marks)] = normal @ normal.T
    among[-1, -1] = 1e-6
    left = (k * w).T @ k + RIDGE * among + 1e-9 * np.eye(k.shape[1])
    weights = np.linalg.solve(left, (k * w).T @ y)
    return langs, (*packed[:3], weights.astype(np.float32))


def identify(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``lang_score``; columns of these names are replaced."""
    docs = docs.drop(*[c for c in ("lang_pred", "lang_score") if c != text])
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0)})
    langs, values = model
    held = docs.sparkSession.sparkContext.broadcast(values)  # n-grams x landmarks bits and landmarks x languages weights
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.mapInArrow(_predictor(uuid.uuid4().hex, held, docs.columns.index(text), langs, schema.names), schema)


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
