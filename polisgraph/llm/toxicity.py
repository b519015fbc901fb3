"""Toxic spans and document scores from a linear-chain conditional random field.

Labels mark documents, so tokens are labelled first: a token of a toxic document is toxic if one of its features
(its word and its beginnings, which carry the stem) is in far more toxic documents than chance allows.  A two-state
chain over runs of 64 tokens is trained on these by gradient ascent on the conditional likelihood, whose gradient is
a sum over chains, one small job a round.  The labels are then weighed anew by the chain itself: given that some
token of a chain with labelled ones is toxic, the chance that this one is (its marginal over the chance that any is),
which takes weight from listed words that stand in clean surroundings; training goes on from there.
Forward-backward marginals give each token's probability; their sum over the background, calibrated on the labelled
sample, is the document's score, and tokens over one half are its offending spans.

Bounds, both parameters: about ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled documents are learned from, whole.  All their
features that are evidence enough and all their chains with such a feature are used; nothing else is bounded.

With too few labels for such evidence the ``WEAK_FEATURES`` features with the largest ratio are used instead, in whatever number
of toxic documents they are, so that scores still tell documents apart.

Defined cases: null, empty and wordless texts have no tokens and the score of a text without a toxic token;
rows with a null id or label teach nothing; of several labels of one document the largest counts; without
both kinds of labels, or if no toxic document has a word, every score is the toxic share of the labels (0 without labels).  Added columns replace
input columns of the same name.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polisgraph.llm import _common as C
from polisgraph.llm.langid import held_out

MAX_TOXIC = 3000
MAX_CLEAN = 6000
ROUNDS, FURTHER_ROUNDS = 40, 12
CHAIN = 64
#: Log-likelihood ratio from which a feature is used, and from which it labels tokens; toxic documents that hold it at least.
USED_G, LABEL_G, USED_IN = 12.0, 20.0, 3
#: Where no feature is that evident, as with few labels: toxic documents that hold it at least, and how many of the most
#: evident features are used instead.
WEAK_IN, WEAK_FEATURES = 1, 40
#: Marginals up to this are background and do not count towards a document's score.
BACKGROUND = 0.2
#: Words whose scores a worker keeps.
CACHE_WORDS = 400_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else (b if C.ALNUM[b] else 32) for b in range(256))
_MODELS: dict[str, tuple] = C.kept("toxicity")
_SLICE = 2 << 20


def features(word: str) -> list[str]:
    found = ["w" + word]
    found += ["p" + word[:k] for k in range(4, min(8, len(word)) + 1)]
    return found


def _words(column) -> list[list[bytes]]:
    """Lower-cased words of each text."""
    import pyarrow.compute as pc

    data, offsets = C.text_buffers(pc.utf8_lower(column))
    raw = data.tobytes().translate(_FOLD)
    return [raw[offsets[i] : offsets[i + 1]].split() for i in range(len(offsets) - 1)]


def _sliced(batches, text_at: int):
    for whole in batches:
        _, offsets = C.text_buffers(whole.column(text_at))
        for a, b in C.row_slices(offsets, _SLICE):
            yield whole.slice(a, b - a)


def _count_features(batches):
    C.begin("toxicity")
    toxic: Counter = Counter()
    clean: Counter = Counter()
    for batch in _sliced(batches, 0):
        for words, label in zip(_words(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update({f for w in set(words) for f in features(w.decode("utf-8", "replace"))})
    names = sorted(toxic)  # what no toxic document holds can't speak for toxicity
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64())], ["feature", "toxic"])


def _clean_counter(held):
    def count(batches):
        C.begin("toxicity")
        wanted, clean = held.value, Counter()
        for batch in _sliced(batches, 0):
            for words in _words(batch.column(0)):
                clean.update({f for w in set(words) for f in features(w.decode("utf-8", "replace")) if f in wanted})
        names = sorted(clean)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([clean[n] for n in names], pa.int64())], ["feature", "clean"])

    return count


def evidence(a, b, p: float):
    """Signed log-likelihood ratio of ``a`` toxic and ``b`` clean documents against a share ``p`` of toxic ones."""
    n = a + b
    log = lambda x: np.log(np.maximum(x, 1e-12))
    g = a * (log(a / n) - math.log(p)) + b * (log(b / n) - math.log(1 - p))
    return np.where(a / n > p, g, -g)


def _chain_maker(held):
    def chains(batches):
        C.begin("toxicity")
        index, strong = held.value
        for batch in _sliced(batches, 0):
            size, place, feature, marked = [], [], [], []
            for words, label in zip(_words(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for at in range(0, len(words), CHAIN):
                    part = words[at : at + CHAIN]
                    found = [(k, index[f]) for k, w in enumerate(part) for f in features(w.decode("utf-8", "replace")) if f in index]
                    if found:
                        size.append(len(part))
                        place.append([k for k, _ in found])
                        feature.append([f for _, f in found])
                        marked.append(sorted({k for k, f in found if label and strong[f]}))
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((size, place, feature, marked), kinds, strict=True)], ["size", "place", "feature", "marked"])

    return chains


def marginals(emission: np.ndarray, size: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains of up to ``CHAIN`` tokens.

    ``emission``: log odds of toxic for each token (rows: chains).  Returns each token's probability of
    toxic, and the expected number of each transition over all chains.
    """
    n, length = emission.shape
    t = np.exp(transition)
    local = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -30, 30))], axis=2)
    inside = np.arange(length)[None, :] < size[:, None]
    alpha, beta = np.zeros((length, n, 2)), np.ones((length, n, 2))
    alpha[0] = np.exp(start) * local[:, 0]
    alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
    for k in range(1, length):
        alpha[k] = (alpha[k - 1] @ t) * local[:, k]
        alpha[k] /= alpha[k].sum(axis=1, keepdims=True)
    for k in range(length - 2, -1, -1):
        back = (beta[k + 1] * local[:, k + 1]) @ t.T
        back /= back.sum(axis=1, keepdims=True)
        beta[k] = np.where(inside[:, k + 1, None], back, 1.0)
    both = alpha * beta
    p = (both[:, :, 1] / both.sum(axis=2)).T * inside
    moves = np.zeros((2, 2))
    for k in range(1, length):
        joint = alpha[k - 1][:, :, None] * t[None] * (local[:, k] * beta[k])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        moves += (joint * inside[:, k, None, None]).sum(axis=0)
    return p, moves


def gradient(theta: np.ndarray, n_features: int, size, place, feature, marked, again: bool) -> np.ndarray:
    """Of the conditional log-likelihood of chains.

    ``again``: a chain with marked tokens is only known to hold some toxic token; its tokens' labels are what the chain
    itself expects under that condition, and all its transitions likewise.
    """
    n = len(size)
    size = np.asarray(size)
    w, bias, trans, start = theta[:n_features], theta[n_features], theta[n_features + 1 : -2].reshape(2, 2), theta[-2:]
    row = np.repeat(np.arange(n), [len(x) for x in place])
    at, ids = np.concatenate(place).astype(int), np.concatenate(feature).astype(int)
    gold = np.zeros((n, CHAIN))
    for i, x in enumerate(marked):
        gold[i, x] = 1
    inside = np.arange(CHAIN)[None, :] < size[:, None]
    emission = np.full((n, CHAIN), bias)
    np.add.at(emission, (row, at), w[ids])
    p, moves = marginals(emission, size, trans, start)
    if again:
        some = gold.any(axis=1)
        clean = _all_clean(emission, size, trans, start)
        gold[some] = np.minimum(p[some] / np.maximum(1 - clean[some], 1e-6)[:, None], 1)
    seen = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            x, y = gold[:, :-1] if i else 1 - gold[:, :-1], gold[:, 1:] if j else 1 - gold[:, 1:]
            seen[i, j] = (x * y * inside[:, 1:]).sum()
    gap = gold - p
    return np.concatenate([
        np.bincount(ids, gap[row, at], n_features),
        [gap[inside].sum()],
        (seen - moves).ravel(),
        [(1 - gold[:, 0]).sum() - (1 - p[:, 0]).sum(), gold[:, 0].sum() - p[:, 0].sum()],
    ])


def _all_clean(emission: np.ndarray, size: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The chance of each chain that none of its tokens is toxic."""
    t = np.exp(transition)
    local = np.exp(np.clip(emission, -30, 30))
    alpha = np.exp(start) * np.stack([np.ones(len(size)), local[:, 0]], 1)
    log_clean = np.full(len(size), start[0])
    log_all = np.log(alpha.sum(axis=1))
    alpha /= alpha.sum(axis=1, keepdims=True)
    for k in range(1, emission.shape[1]):
        on = size > k
        step = (alpha @ t) * np.stack([np.ones(len(size)), local[:, k]], 1)
        total = step.sum(axis=1)
        log_all += np.where(on, np.log(total), 0)
        log_clean += np.where(on, transition[0, 0], 0)
        alpha = np.where(on[:, None], step / total[:, None], alpha)
    return np.exp(np.minimum(log_clean - log_all, 0))


def _gradients(held):
    def gradients(batches):
        C.begin("toxicity")
        theta, n_features, again = held.value
        total = np.zeros_like(theta)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                total += gradient(theta, n_features, *(c.to_pylist() for c in batch.columns), again)
        yield pa.RecordBatch.from_arrays([C.binary([total.tobytes()])], ["g"])

    return gradients


def train(chains: DataFrame, n_features: int, ridge: float = 0.02) -> tuple:
    """Feature weights, bias, transitions and start of the chain, by Adam on the penalised likelihood."""
    spark = chains.sparkSession
    theta = np.zeros(n_features + 1 + 4 + 2)
    theta[n_features] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + FURTHER_ROUNDS + 1):
        held = spark.sparkContext.broadcast((theta, n_features, step > ROUNDS))
        parts = chains.mapInArrow(_gradients(held), "g binary").collect()  # a row of n_features numbers for each task
        grad = sum((np.frombuffer(r["g"]) for r in parts), -ridge * theta)
        held.unpersist()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + (0.35 if step <= ROUNDS else 0.05) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:n_features], float(theta[n_features]), theta[n_features + 1 : -2].reshape(2, 2), theta[-2:]


class Scorer:
    def __init__(self, weights: dict[str, float], bias: float, transition, start):
        self.weights, self.bias, self.transition, self.start = weights, bias, transition, start
        self.words: dict[bytes, float] = {}
        #: A chain without any feature is all background, or else every chain is scored.
        self.plain = bool(marginals(np.full((CHAIN, CHAIN), bias), np.arange(1, CHAIN + 1), transition, start)[0].max() <= BACKGROUND)

    def emission(self, word: bytes) -> float:
        found = sum(self.weights.get(f, 0.0) for f in features(word.decode("utf-8", "replace")))
        if len(self.words) < CACHE_WORDS:
            self.words[word] = found
        return found

    def texts(self, lists: list[list[bytes]]) -> tuple[np.ndarray, list[list[int]]]:
        """The sum of each text's marginals over the background, and the words over one half."""
        total, over = np.zeros(len(lists)), [[] for _ in lists]
        owner, base, size, rows = [], [], [], []
        get, cache = self.emission, self.words
        for i, words in enumerate(lists):
            values = np.array([cache[w] if w in cache else get(w) for w in words])
            some = np.flatnonzero(values) // CHAIN if self.plain else np.arange(-(-len(words) // CHAIN))
            for c in np.unique(some).tolist():
                part = values[c * CHAIN : (c + 1) * CHAIN]
                owner.append(i)
                base.append(c * CHAIN)
                size.append(len(part))
                rows.append(np.pad(part, (0, CHAIN - len(part))))
        if rows:
            p, _ = marginals(np.array(rows) + self.bias, np.array(size), self.transition, self.start)
            np.add.at(total, owner, np.where(p > BACKGROUND, p, 0).sum(axis=1))
            for r, k in zip(*np.nonzero(p > 0.5), strict=True):
                over[owner[r]].append(base[r] + int(k))
        return total, over


def char_spans(text: bytes, words: list[int]) -> list[int]:
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = C.word_spans(data, np.array([0, len(data)]), C.ALNUM)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [int(chars[x[k]]) for k in words for x in (starts, ends)]


def _scorer(key: str, held) -> tuple:
    if key not in _MODELS:
        _MODELS.clear()
        parts, curve = held.value
        _MODELS[key] = (Scorer(*parts), curve)
    return _MODELS[key]


def _sums(key: str, held):
    def sums(batches):
        C.begin("toxicity")
        scorer, _ = _scorer(key, held)
        for batch in _sliced(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(scorer.texts(_words(batch.column(0)))[0]), batch.column(1)], ["x", "toxic"])

    return sums


def _score(key: str, held, text_at: int, names: list[str]):
    def score(batches):
        C.begin("toxicity")
        scorer, (slope, cut) = _scorer(key, held)
        for batch in _sliced(batches, text_at):
            column = batch.column(text_at)
            total, over = scorer.texts(_words(column))
            data, offsets = C.text_buffers(column)
            spans = [char_spans(data[offsets[i] : offsets[i + 1]].tobytes(), x) if x else [] for i, x in enumerate(over)]
            p = 1 / (1 + np.exp(-np.clip(slope * np.log(total + 0.5) + cut, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(spans, pa.list_(pa.int64()))], names)

    return score


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept with a light penalty, by Newton's method; both classes weigh the same."""
    a = np.column_stack([x, np.ones_like(x)])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    theta = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        grad = a.T @ (weight * (y - p)) - 1e-2 * theta
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta += np.clip(step, -2, 2)
    return float(theta[0]), float(theta[1])


def _ratios(rows: DataFrame, share: float, least: int) -> tuple[list[str], np.ndarray]:
    """Features of at least ``least`` toxic documents of the sample, in order, and their log-likelihood ratios."""
    a = rows.where("toxic = 1").mapInArrow(_count_features, "feature string, toxic long").groupBy("feature").agg(F.sum("toxic").alias("toxic")).where(F.col("toxic") >= least)
    found = {r["feature"]: r["toxic"] for r in a.collect()}  # the sample's words
    wanted = rows.sparkSession.sparkContext.broadcast(frozenset(found))
    b = rows.where("toxic = 0").mapInArrow(_clean_counter(wanted), "feature string, clean long").groupBy("feature").agg(F.sum("clean").alias("clean"))
    clean = {r["feature"]: r["clean"] for r in b.collect()}
    wanted.destroy()
    names = sorted(found)
    return names, evidence(np.array([found[f] for f in names], float), np.array([clean.get(f, 0) for f in names], float), share)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic"):
    """The model from rows that are not held out, or the share of toxic labels where one kind is missing."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("toxic")).where(~held_out("id") & F.col("id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, MAX_TOXIC / counts[1])).otherwise(min(1.0, MAX_CLEAN / counts[0]))
    drawn = F.broadcast(known.where(draw < share))  # about MAX_TOXIC + MAX_CLEAN rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text is not null").join(drawn, "id").select("text", "toxic").dropDuplicates()  # copies are one witness
    rows = C.staged(rows, "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return counts[1] / (counts[0] + counts[1])
    share = sizes[1] / (sizes[0] + sizes[1])
    names, g = _ratios(rows, share, USED_IN)
    order = [int(k) for k in np.argsort(-g, kind="stable") if g[k] >= USED_G]
    if not order:
        names, g = _ratios(rows, share, WEAK_IN)
        order = np.argsort(-g, kind="stable")[:WEAK_FEATURES].tolist()
    if not order:
        return counts[1] / (counts[0] + counts[1])
    index = {names[k]: i for i, k in enumerate(order)}
    strong = np.array([g[k] >= LABEL_G for k in order])
    if not strong.any():
        strong[:] = True
    held = spark.sparkContext.broadcast((index, strong))
    made = C.staged(rows.mapInArrow(_chain_maker(held), "size int, place array<int>, feature array<int>, marked array<int>"), "toxicity-chains")
    weights, bias, transition, start = train(made, len(index))
    parts = ({f: float(weights[i]) for f, i in index.items() if weights[i]}, bias, transition, start)
    held = spark.sparkContext.broadcast((parts, None))
    sums = rows.mapInArrow(_sums(uuid.uuid4().hex, held), "x double, toxic int").collect()  # the sample's rows
    x, y = np.array([r["x"] for r in sums]), np.array([r["toxic"] for r in sums], float)
    return parts, _logistic(np.log(x + 0.5), y)


def score_toxicity(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``toxicity`` and ``toxic_spans`` (character offsets, start and end by turns)."""
    docs = docs.drop(*[c for c in ("toxicity", "toxic_spans") if c != text])
    if isinstance(model, float):
        return docs.withColumns({"toxicity": F.lit(model), "toxic_spans": F.array().cast("array<bigint>")})
    held = docs.sparkSession.sparkContext.broadcast(model)  # the weights of the sample's features
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_spans", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(_score(uuid.uuid4().hex, held, docs.columns.index(text), schema.names), schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_toxicity(docs, fit(docs, C.read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
