"""N-gram Jaccard join by rare-first prefix filtering.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  Documents with equal sets
form one class, and only one set per class goes on.

1. Every set is dealt out by shingle: a task packs its sets' shingles into one binary block per bucket, so
   counting document frequencies moves about eight bytes a shingle.  Shingles that are frequent already within
   a task's slice of texts are counted over all slices; the ``MAX_HOT`` most frequent of those in ``HOT_SETS``
   sets or more are known to every task, rank last, and stay with their sets, so that no bucket gathers them.
2. Only shingles in at least two different sets return to their set.  Those in one set alone come first in
   the rare-first order, so a set whose prefix they fill is done.  For the others the rest of the prefix is
   known exactly: the rarest returned shingles, with their positions.
3. Sets are joined on prefix shingles, under the length and positional filters.  The suffix filter is a
   parity bitmap of the returned shingles: the bits in which two bitmaps differ, and the shingles in one set
   alone, are in the sets' symmetric difference, so a pair with too many of them is never similar.  Short
   posting lists give their pairs.
4. Long lists (groups of near copies, common passages) are joined on differences.  Lists are grouped by a pivot,
   the member that lies in the most long lists, and a member ``x`` is written as its difference ``D`` from the
   pivot's set.  Two members are similar if and only if ``2 |Dx & Dy| >= s_x + s_y`` with ``s = |D| - c n`` and
   ``c = (1 - t) / (1 + t)``.  Where ``s_x + s_y <= 0`` both are similar to the member of least ``s`` too, so one
   pair a member stands for all of those.  The other pairs share a shingle of their differences, and of a rare-first
   prefix of them: edits, which are rare where texts were changed independently.  Entries of a list that no other
   entry of it can meet at their place and ``s`` are left out, and so are pairs within one component or with too many
   differing bits, which make no row.  A difference that is itself frequent is a long list of the next round, without the pivot.
5. Each pair is verified once, on the shingles that returned: those in one set alone cannot be shared.

Defined cases: a null or wordless text has an empty set and is linked with nothing; with one to four words
the whole sequence is one shingle; rows with a null id keep their set size and a null component; rows with
equal ids share one component only if their sets do.  Sets and shingles are named by 64-bit hashes: among ``m``
different shingles a given one has the hash of another with a chance of ``m / 2**64``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polisgraph.llm import _common as C
from polisgraph.llm.components import connected_components, joined_components

WIDTH = 5
#: Lists up to this length give all their pairs; longer ones are resolved by pivots.
SHORT_LIST = 16
#: Lists of differences are joined where one side has up to so many times ``SHORT_LIST`` members.
DIRECT = 16
#: 64-bit words of a set's parity bitmap.
BITMAP_WORDS = 16
#: Text bytes whose shingles are dealt out at a time.
DEAL_BYTES = 2 << 20
#: Sets of one slice that hold a shingle from which on it is counted over all slices.
SLICE_SETS = 16
#: Shingles in so many sets stay with their sets, the ``MAX_HOT`` most frequent ones (eight bytes each in every task).
HOT_SETS = 4096
MAX_HOT = 1_000_000
_HEAD = np.dtype([("sid", "<i8"), ("n", "<u4"), ("k", "<u4")])
#: Frequent shingles rank from here on, all others below.
_HOT_RANK = 1 << 31


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def document_sets(column, member=C.NOT_SPACE, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = C.word_hashes(column, member)
    return [np.unique(C.shingles(words[first[i] : first[i + 1]], width)) for i in range(len(first) - 1)]


def _slices(batch: pa.RecordBatch, column: int):
    _, offsets = C.text_buffers(batch.column(column))
    for a, b in C.row_slices(offsets, DEAL_BYTES):
        yield batch.slice(a, b - a)


def _name_sets(batches):
    """Size and name of each row's set; with a slice's first row, the slice's frequent shingles and their sets' number."""
    C.begin("jaccard")
    names = ["row_id", "n_shingles", "sid", "often", "held"]
    for whole in batches:
        for batch in _slices(whole, 1):
            sets = document_sets(batch.column(1))
            sid = [set_id(s) if len(s) else None for s in sets]
            own = {k: s for k, s in zip(sid, sets, strict=True) if k is not None}
            token, held = np.unique(np.concatenate([*own.values(), np.zeros(0, np.uint64)]), return_counts=True)
            some = held >= SLICE_SETS
            rest = [None] * (batch.num_rows - 1)
            often, held = ([x.tolist(), *rest] for x in (token[some].view(np.int64), held[some]))
            numbers = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], sid)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, *(pa.array(x, pa.list_(pa.int64())) for x in (often, held))], names)


def _blob(head: np.ndarray, *parts: np.ndarray) -> bytes:
    return b"".join([len(head).to_bytes(4, "little"), head.tobytes(), *(np.ascontiguousarray(x).tobytes() for x in parts)])


def _runs(sids: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A head for each stretch of one owner."""
    at = np.flatnonzero(np.diff(owner, prepend=-1))
    head = np.empty(len(at), _HEAD)
    head["sid"], head["n"], head["k"] = sids[owner[at]], sizes[owner[at]], np.diff(at, append=len(owner))
    return head


def _stretches(values: np.ndarray):
    """Each value of an ascending array, and where its stretch begins and ends."""
    edge = np.flatnonzero(np.diff(values, prepend=values[:1] - 1))
    if not len(edge):
        return
    yield from zip(values[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(values)], strict=True)


def _dealer(buckets: int, held):
    def deal(batches):
        C.begin("jaccard")
        hot, rank = held.value
        for whole in batches:
            for batch in _slices(whole, 0):
                sets = {set_id(s): s for s in document_sets(batch.column(0)) if len(s)}
                if not sets:
                    continue
                sizes = np.array([len(s) for s in sets.values()])
                tokens = np.concatenate(list(sets.values()))
                sids = np.fromiter(sets, np.int64, len(sets))
                owner = np.repeat(np.arange(len(sets)), sizes)
                ids, kinds, blobs = [], [], []
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
                    known = hot[at] == tokens
                    who, at = owner[known], at[known]
                    place = np.mod(sids[who], buckets)
                    order = np.lexsort((who, place))
                    who, at, place = who[order], at[order], place[order]
                    for p, a, b in _stretches(place):
                        ids.append(p)
                        kinds.append(True)
                        blobs.append(_blob(_runs(sids, sizes, who[a:b]), hot[at[a:b]], rank[at[a:b]]))
                    tokens, owner = tokens[~known], owner[~known]
                bucket = ((tokens >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
                order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
                bucket, owner, tokens = bucket[order], owner[order], tokens[order]
                for p, a, b in _stretches(bucket):
                    ids.append(p)
                    kinds.append(False)
                    blobs.append(_blob(_runs(sids, sizes, owner[a:b]), tokens[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(kinds, pa.bool_()), C.binary(blobs)], ["bucket", "hot", "blob"])

    return deal


def _shared(buckets: int):
    """Tokens in at least two sets, with their frequency, dealt out by set; those known as frequent pass through."""

    def count(batches):
        C.begin("jaccard")
        blobs: dict[int, list] = {}
        for batch in batches:
            for bucket, hot, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                blob = blob.as_buffer().to_pybytes()
                if hot:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), C.binary([blob])], ["bucket", "blob"])
                    continue
                runs = int.from_bytes(blob[:4], "little")
                blobs.setdefault(bucket, []).append((np.frombuffer(blob, _HEAD, runs, 4), np.frombuffer(blob, np.uint64, offset=4 + runs * _HEAD.itemsize)))
        for bucket in sorted(blobs):
            parts = blobs.pop(bucket)
            head = np.concatenate([h for h, _ in parts])
            tokens = np.concatenate([t for _, t in parts])
            del parts
            first = np.unique(head["sid"], return_index=True)[1]  # one of each class of equal sets
            kept = np.zeros(len(head), bool)
            kept[first] = True
            owner = np.repeat(np.arange(len(head), dtype=np.int32), head["k"])
            use = kept[owner]
            tokens, owner = tokens[use], owner[use]
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            run = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
            size = np.diff(run, append=len(tokens))
            often = np.repeat(size > 1, size)
            df = np.repeat(size, size)[often]
            tokens, owner = tokens[often], owner[often]
            if not len(tokens):
                continue
            place = np.mod(head["sid"][owner], buckets)
            order = np.lexsort((owner, place))
            tokens, owner, df, place = tokens[order], owner[order], df[order], place[order]
            ids, out = [], []
            for p, a, b in _stretches(place):
                ids.append(p)
                out.append(_blob(_runs(head["sid"], head["n"], owner[a:b]), tokens[a:b], np.minimum(df[a:b], _HOT_RANK - 1).astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), C.binary(out)], ["bucket", "blob"])

    return count


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of ``n`` of which one is in every set that is similar enough."""
    return n - (n * percent + 99) // 100 + 1


def _prefixes(percent: int):
    """Sets whose prefix holds shared tokens: set, size, prefix, number of other tokens, all shared tokens rare first."""

    def order(batches):
        C.begin("jaccard")
        heads, tokens, dfs = [], [], []
        for batch in batches:
            for blob in batch.column(1):
                blob = blob.as_buffer().to_pybytes()
                runs = int.from_bytes(blob[:4], "little")
                head = np.frombuffer(blob, _HEAD, runs, 4)
                m, at = int(head["k"].sum()), 4 + runs * _HEAD.itemsize
                heads.append(head)
                tokens.append(np.frombuffer(blob, np.uint64, m, at))
                dfs.append(np.frombuffer(blob, np.uint32, m, at + 8 * m))
        if not heads:
            return
        head = np.concatenate(heads)
        token, df = np.concatenate(tokens), np.concatenate(dfs)
        sid, n = np.repeat(head["sid"], head["k"]), np.repeat(head["n"], head["k"])
        rank = np.lexsort((token, df, sid))
        token, sid, n = token[rank], sid[rank], n[rank]
        edge = np.flatnonzero(np.diff(sid, prepend=~sid[:1]))
        rows = []
        for a, b in zip(edge, [*edge[1:], len(sid)], strict=True):
            size = int(n[a])
            alone = size - int(b - a)
            k = int(prefix_length(np.int64(size), percent)) - alone
            if k > 0:
                own = token[a:b]
                rows.append((int(sid[a]), size, own[: min(k, len(own))].view(np.int64), alone, own.tobytes(), parity(own)))
            if len(rows) >= 2000:
                yield _prefix_batch(rows)
                rows = []
        if rows:
            yield _prefix_batch(rows)

    return order


def parity(tokens: np.ndarray) -> list[int]:
    """Of each bit's shingles the parity: sets of d different shingles differ in d bits at most."""
    bits = np.bincount((tokens >> np.uint64(13)).astype(np.int64) & (64 * BITMAP_WORDS - 1), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _prefix_batch(rows: list) -> pa.RecordBatch:
    sid, n, prefix, alone, tokens, bits = zip(*rows, strict=True)
    columns = [pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array([list(p) for p in prefix], pa.list_(pa.int64())), pa.array(alone, pa.int64()), C.binary(list(tokens)), pa.array(bits, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["sid", "n", "prefix", "alone", "tokens", "bits"])


def _verify(batches):
    for batch in batches:
        x, y = batch.column(4), batch.column(5)
        both = []
        for i in range(batch.num_rows):
            p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
            both.append(len(np.intersect1d(p, q, assume_unique=True)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, pa.int64())], ["a", "b", "na", "nb", "both"])


def _differences(batches):
    """Each member's difference from its pivot: shingles of its own, rare first, then the pivot's that it lacks, frequent first."""
    for batch in batches:
        x, p = batch.column(6), batch.column(7)
        out = []
        for i in range(batch.num_rows):
            own, pivot = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(p[i].as_buffer(), np.uint64)
            out.append(np.concatenate([own[~np.isin(own, pivot)], pivot[~np.isin(pivot, own)][::-1]]).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.list_(pa.int64()))], ["pivot", "sid", "comp", "largest", "n", "alone", "d"])


_PAIR = "a long, b long, na long, nb long, both long"


def _similar(percent: int, both="both", na="na", nb="nb"):
    """``both / union >= percent / 100`` in whole numbers."""
    return (100 + percent) * F.col(both) >= percent * (F.col(na) + F.col(nb))


class _Join:
    def __init__(self, sets: DataFrame, percent: int, short_list: int):
        self.sets, self.percent, self.short = sets, percent, short_list
        entries = sets.select("sid", "n", "alone", F.posexplode("prefix").alias("rank", "token"))
        entries = entries.select("token", "sid", "n", (F.col("alone") + F.col("rank")).alias("pos"))
        # The positional filter, solved for the partner: a set meets none of more than ``most`` shingles here.
        entries = entries.withColumn("most", F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent + 1e-9) - F.col("n"))
        least = entries.groupBy("token").agg(F.min("n").alias("least"), F.count("*").alias("held")).where("held > 1")
        entries = entries.join(least, "token").where("most >= least").drop("least", "held")
        lists = entries.groupBy("token").agg(F.count("*").alias("members")).where("members > 1")
        self.entries = C.staged(entries.join(lists, "token"), "postings")
        self.thin = C.saved(sets.select("sid", "n", "alone", "bits"))
        self.known: DataFrame | None = None

    def suffix(self, x: str, y: str):
        """The suffix filter of two sets given by their names' prefixes: ``n``, ``alone`` and ``bits``."""
        differ = sum((F.bit_count(F.get(f"{x}bits", k).bitwiseXOR(F.get(f"{y}bits", k))) for k in range(BITMAP_WORDS)), F.col(f"{x}alone") + F.col(f"{y}alone"))
        return (100 + self.percent) * differ <= (100 - self.percent) * (F.col(f"{x}n") + F.col(f"{y}n"))

    def with_sides(self, pairs: DataFrame) -> DataFrame:
        """Saved ``pairs`` with size and tokens of both sets, as ``x`` and ``y`` columns: each side of the pairs is sought by itself."""
        sides = []
        for end, side in (("a", "x"), ("b", "y")):
            own = self.sets.select(F.col("sid").alias(end), F.col("n").alias(f"{side}n"), F.col("tokens").alias(f"{side}t"))
            sides.append(own.join(C.hinted(pairs, C.rows_of(pairs)), end))
        return sides[0].join(sides[1], ["a", "b"])

    def may_be_similar(self, pairs: DataFrame) -> DataFrame:
        """Saved ``pairs`` that pass the suffix filter."""
        n = C.rows_of(pairs)
        for end in ("a", "b"):
            own = self.thin.select(*[F.col(c).alias(f"{end}{c}") for c in self.thin.columns])
            own = own.withColumnRenamed(f"{end}sid", end)
            pairs = C.joined(own, C.rows_of(self.thin), pairs, n, end)
        return pairs.where(self.suffix("a", "b")).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Overlaps of pairs that pass the suffix filter and were not verified before."""
        most, pairs = C.rows_of(pairs), pairs.distinct()
        if self.known is not None:
            # Spark would take an anti join below the pairs' one partition, and deal them out.
            known = self.known.select("a", "b", F.lit(True).alias("known"))
            pairs = C.joined(pairs, most, known, C.rows_of(self.known), ["a", "b"], "left").where("known is null").drop("known")
        pairs = C.saved(pairs)
        if C.rows_of(pairs):
            pairs = C.saved(self.may_be_similar(pairs))
        if not C.rows_of(pairs):
            return C.none(pairs.sparkSession, _PAIR)
        rows = self.with_sides(pairs).select("a", "b", F.col("xn").alias("na"), F.col("yn").alias("nb"), F.col("xt").alias("x"), F.col("yt").alias("y"))
        found = C.saved(rows.mapInArrow(_verify, _PAIR))
        self.known = found if self.known is None else C.together(C.rows_of(self.known) + C.rows_of(found), self.known, found)
        return found

    def short_pairs(self) -> DataFrame:
        group = self.entries.where(F.col("members") <= self.short).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("sid", "n", "most"))).alias("g"))
        one = group.select("g", F.posexplode("g").alias("i", "x"))
        two = one.select("x", F.explode(F.expr("slice(g, i + 2, size(g))")).alias("y"))
        return two.where(self.can_meet("x.", "y.")).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))

    def can_meet(self, x: str, y: str):
        """Length and positional filters of two entries of one list."""
        nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
        return (100 * F.least(nx, ny) >= self.percent * F.greatest(nx, ny)) & (ny <= F.col(f"{x}most")) & (nx <= F.col(f"{y}most"))

    def similar(self, verified: DataFrame) -> DataFrame:
        return C.together(C.rows_of(verified), verified.where(_similar(self.percent)).select("a", "b"))

    def named(self, members: DataFrame, found: DataFrame) -> DataFrame:
        """Saved ``members`` with their component, or their own name."""
        known = C.joined(members, C.rows_of(members), found, C.rows_of(found), F.col("sid") == F.col("node"), "left")
        return known.select(*members.columns, F.coalesce("component", "sid").alias("comp"))

    def components(self) -> DataFrame:
        found = C.saved(connected_components(self.similar(self.verified(self.short_pairs()))))
        large = self.entries.where(F.col("members") > self.short).select(F.col("token").alias("list"), "sid")
        weights = large.groupBy("sid").agg(F.count("*").alias("w"))
        open_ = C.saved(large.join(weights, "sid").select("list", "sid", "w"))
        while C.rows_of(open_):
            n_open = C.rows_of(open_)
            named = self.named(open_, found)
            lists = named.groupBy("list").agg(F.max_by("sid", F.struct("w", "sid")).alias("pivot"), F.min("comp").alias("low"), F.max("comp").alias("high"))
            groups = C.saved(C.joined(named, n_open, lists.where("low <> high"), n_open, "list").select("pivot", "sid", "w").distinct())
            if not C.rows_of(groups):
                break
            star = groups.where("sid <> pivot").select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b"))
            found = C.saved(joined_components(found, self.similar(self.verified(C.together(C.rows_of(groups), star)))))
            pairs, open_ = self.by_differences(groups, found)
            if C.rows_of(pairs):
                found = C.saved(joined_components(found, self.similar(self.verified(pairs))))
        return found

    def by_differences(self, groups: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of the members of each pivot's group that can be similar, and the lists to be resolved in another round.

        All in whole numbers: ``s`` stands for ``(100 + percent) (|D| - c n)``.
        """
        up, down = 100 + self.percent, 100 - self.percent
        n_groups = C.rows_of(groups)
        named = self.named(groups, found)
        sizes = named.groupBy("pivot", "comp").agg(F.count("*").alias("size"))
        most = sizes.groupBy("pivot").agg(F.max_by("comp", F.struct("size", "comp")).alias("largest"), F.count("*").alias("comps")).where("comps > 1")
        members = C.saved(C.joined(named.where("sid <> pivot"), n_groups, most, n_groups, "pivot").select("pivot", "sid", "comp", "largest"))
        n_members = C.rows_of(members)
        if not n_members:
            return C.none(groups.sparkSession, "a long, b long"), C.none(groups.sparkSession, "list long, sid long, w long")
        own = self.sets.select("sid", "n", "alone", F.col("tokens").alias("x")).join(C.hinted(members, n_members), "sid")
        asked = members.select("pivot").distinct()
        pivots = self.sets.select(F.col("sid").alias("pivot"), F.col("tokens").alias("p")).join(C.hinted(asked, n_members), "pivot")
        both = own.join(pivots, "pivot").select("pivot", "sid", "comp", "largest", "n", "alone", "x", "p")
        rows = both.mapInArrow(_differences, "pivot long, sid long, comp long, largest long, n long, alone long, d array<long>")
        rows = rows.withColumn("nd", F.size("d") + F.col("alone")).withColumn("s", up * F.col("nd") - down * F.col("n"))
        rows = C.staged(rows, "differences")
        outside = F.col("comp") != F.col("largest")
        bounds = C.saved(rows.groupBy("pivot").agg(F.min("s").alias("least"), F.min_by("sid", F.struct("s", "sid")).alias("nearest"), F.min(F.when(outside, F.col("s"))).alias("least_outside")))
        rows = rows.join(C.hinted(bounds, C.rows_of(bounds)), "pivot")
        certain = rows.where((F.col("s") + F.col("least") <= 0) & (F.col("sid") != F.col("nearest"))).select(F.least("sid", "nearest").alias("a"), F.greatest("sid", "nearest").alias("b"))

        def overlap(x, y):
            """The least common part of the differences of a pair in two components."""
            return F.greatest(F.lit(1), F.ceil((x + y) / (2.0 * up))).cast("long")

        def entries(df: DataFrame, least: str, probe: bool) -> DataFrame:
            prefix = (F.col("nd") - overlap(F.col("s"), F.col(least)) + 1 - F.col("alone")).cast("int")
            cut = F.when(prefix > 0, F.slice("d", F.lit(1), F.greatest(prefix, F.lit(0))))
            out = df.select("pivot", "sid", "n", "nd", "s", "comp", "alone", F.posexplode(cut).alias("k", "token")).withColumn("pos", F.col("alone") + F.col("k"))
            # At this place of the prefix a partner has no more than ``cap`` for its ``s``.
            cap = 2 * up * (F.col("nd") - F.col("pos")) - F.col("s")
            return out.select("pivot", "token", "sid", "n", "nd", "s", "comp", "pos", cap.alias("cap"), F.lit(probe).alias("probe"))

        def bounded(df: DataFrame) -> DataFrame:
            """Entries that some entry of the other side of their list can meet."""
            ends = [f(F.when(F.col("probe") == side, F.col(c))).alias(f"{name}{c}") for side, name in ((True, "x"), (False, "y")) for f, c in ((F.min, "s"), (F.max, "cap"))]
            held = df.groupBy("pivot", "token").agg(*ends, F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high")
            meets = F.when(F.col("probe"), (F.col("s") <= F.col("ycap")) & (F.col("cap") >= F.col("ys"))).otherwise((F.col("s") <= F.col("xcap")) & (F.col("cap") >= F.col("xs")))
            return df.join(held, ["pivot", "token"]).where(meets).select(df.columns)

        postings = entries(rows.where(outside), "least", True).unionByName(entries(rows, "least_outside", False))
        postings = C.staged(bounded(C.staged(bounded(postings), "difference-postings")), "difference-postings")
        probes = F.sum(F.col("probe").cast("int"))
        held = postings.groupBy("pivot", "token").agg(probes.alias("probes"), (F.count("*") - probes).alias("others"))
        held = held.where("probes > 0 and others > 0").select("pivot", "token", (F.least("probes", "others") > DIRECT * self.short).alias("long"))
        postings = C.saved(postings.join(held, ["pivot", "token"]))
        # The suffix filter is part of the join: a shingle that many differences share does not turn all pairs of them into rows.
        n_postings = C.rows_of(postings)
        bits = C.joined(self.thin.select("sid", "alone", "bits"), C.rows_of(self.thin), members.select("sid").distinct(), n_members, "sid")
        direct = C.joined(postings.where("not long"), n_postings, bits, 4 * n_members, "sid")
        x = direct.where("probe")
        y = direct.where("not probe").select("pivot", "token", *[F.col(c).alias(f"p{c}") for c in ("sid", "n", "nd", "s", "comp", "pos", "alone", "bits")])
        similar = 100 * F.least("n", "pn") >= self.percent * F.greatest("n", "pn")
        enough = F.least(F.col("nd") - F.col("pos"), F.col("pnd") - F.col("ppos")) >= overlap(F.col("s"), F.col("ps"))
        # No side of this join is sent: many postings are joined by key.
        both = x.join(y.hint("merge"), ["pivot", "token"])
        met = both.where(similar & enough & (F.col("comp") != F.col("pcomp")) & self.suffix("", "p"))
        pairs = certain.unionByName(met.select(F.least("sid", "psid").alias("a"), F.greatest("sid", "psid").alias("b")))
        again = postings.where("long").select(F.xxhash64("pivot", "token").alias("list"), "sid").distinct()
        weights = groups.groupBy("sid").agg(F.max("w").alias("w"))
        return C.saved(pairs), C.saved(C.joined(again, n_postings, weights, n_groups, "sid").select("list", "sid", "w"))


def frequent_shingles(named: DataFrame, least: int = HOT_SETS, most: int = MAX_HOT) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and their ranks, the most frequent last; ``most`` of them at most."""
    each = named.where("often is not null").select(F.explode(F.arrays_zip("often", "held")).alias("x"))
    held = each.groupBy(F.col("x.often").alias("token")).agg(F.sum("x.held").alias("held")).where(F.col("held") >= least)
    found = [r["token"] for r in held.orderBy(F.desc("held"), "token").limit(most).collect()]
    tokens = np.array(found, np.int64).view(np.uint64)
    order = np.argsort(tokens)
    rank = np.uint32(_HOT_RANK) + np.arange(len(tokens), dtype=np.uint32)[::-1]
    return tokens[order], rank[order]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80, short_list: int = SHORT_LIST, hot_sets: int = HOT_SETS) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``; documents link at Jaccard ``percent``/100 or more."""
    spark = docs.sparkSession
    buckets = C.partitions_for(spark, docs)
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text).alias("row_text"))
    fields = [T.StructField("row_id", rows.schema["row_id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("sid", T.LongType())]
    fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("often", "held")]
    named = C.staged(rows.mapInArrow(_name_sets, T.StructType(fields)), "set-names")
    hot = spark.sparkContext.broadcast(frequent_shingles(named, hot_sets))
    dealt = rows.select("row_text").mapInArrow(_dealer(buckets, hot), "bucket int, hot boolean, blob binary").repartitionById(buckets, "bucket")
    back = dealt.mapInArrow(_shared(buckets), "bucket int, blob binary").repartitionById(buckets, "bucket")
    sets = C.staged(back.mapInArrow(_prefixes(percent), "sid long, n long, prefix array<long>, alone long, tokens binary, bits array<bigint>"), "prefixes")
    found = _Join(sets, percent, short_list).components()
    classed = named.join(found, F.col("sid") == F.col("node"), "left").select("row_id", "n_shingles", "sid", F.coalesce("component", "sid").alias("class"))
    least = classed.where("sid is not null").groupBy("class").agg(F.min("row_id").alias("least_id"))
    out = classed.join(least, "class", "left")
    whole = F.when(F.col("row_id").isNotNull(), F.coalesce("least_id", "row_id"))
    return out.select(F.col("row_id").alias(id_col), "n_shingles", whole.alias("component_id"))


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read_table(spark, sf_dir, "documents"))


_WS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP8_SQL = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce({_WS}, []) AS ws FROM documents
), cut AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k : k + {WIDTH} - 1], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WIDTH} + 2, 2))) AS k FROM doc WHERE len(ws) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM cut a JOIN cut b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)
), both_ways AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM doc UNION SELECT r.node, e.y FROM reach r JOIN both_ways e ON r.seen = e.x
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM doc d LEFT JOIN size s USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id
"""
