"""Prefix trie of conversations, with subtree totals by heavy-path decomposition.

Conversations that share their first turns share the nodes of those turns.  A turn is digested where it is read, so texts
are never shuffled.  A prefix's key is the exclusive or of its turns' digests, each taken with its place, 120 bits in all:
such keys add up in any order, so ``running`` can find the keys of one endless conversation in many tasks.

Every node marks the child with the most members (ties: the smallest conversation) as heavy; the others are light.
Chains of heavy children are paths, each with one leaf at its end, so a path is named by that leaf's smallest
conversation, and the rows of this conversation are the path's array from its head on.  A light child has at most half of
its parent's members, so no node lies under more light children than the logarithm of all conversations.  From the
deepest level up, one round per level gives each path its total and attaches it to the node above its head; after
the rounds, one suffix sum along the path arrays gives every node its subtree.

A node's digest runs over the ids of the conversations that end there: tasks join sorted ids to chunks of ``CHUNK_IDS``,
and one pass over a node's chunks, held one batch at a time, hashes them.

Defined cases: a null role or text is an empty one; rows without a conversation id are left out; equal turns of one
conversation are ordered by the digests of role and text, and repeated rows each count as a turn; a conversation may end
up without turns and is then a member of the root alone; an empty table has no nodes.  Only the four named columns are
read, so further columns may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polisgraph.llm import _common as C

#: Conversations whose ids differ by less than ``FAMILY`` may borrow up to ``BORROWED - 1`` turns from the family's first.
FAMILY, BORROWED = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Ids that are joined to one string.
CHUNK_IDS = 512
KEY = ["a", "b"]
NO_IDS = hashlib.sha256(b"").hexdigest()


def _halves(digest: Column) -> list[Column]:
    """Two numbers of 60 bits from a digest in hex."""
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]


def running(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, tuple[str, Column]], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with running ``sum`` or ``xor`` of values per key, itself included, however many rows one key has.

    Rows are dealt by ranges of key and order, so a large key is split over tasks; each task's totals per key are a row.
    ``parts`` says into how many; Spark's guess at the size of ``df`` does, unless joins made it.
    """
    named = df.withColumns({f"_{c}": of for c, (_, of) in values.items()})
    dealt = named.repartitionByRange(parts or C.partitions_for(df.sparkSession, df), *keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = C.staged(dealt, name)
    total = {"sum": F.sum, "xor": F.bit_xor}
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "_part").agg(*[total[how](f"_{c}").alias(f"_{c}") for c, (how, _) in values.items()])
    bases = totals.select(*keys, "_part", *[F.coalesce(total[how](f"_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c, (how, _) in values.items()])
    inside = dealt.withColumns({c: total[how](f"_{c}").over(within) for c, (how, _) in values.items()})
    join = {"sum": lambda x, y: x + y, "xor": lambda x, y: x.bitwiseXOR(y)}
    found = inside.join(bases, [*keys, "_part"])
    return found.select(*df.columns, *[join[how](F.col(c), F.col(f"_before_{c}")).alias(c) for c, (how, _) in values.items()])


# ---------------------------------------------------------------- turns


def digested(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, place, x, y, words``: each turn's place in its conversation, digest and number of words."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said))
    turns = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("d"), F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"))
    x, y = _halves(F.col("d"))
    turns = turns.select("conv_id", "turn", x.alias("x"), y.alias("y"), "words", F.monotonically_increasing_id().alias("_row"))
    order = [F.col("turn").asc_nulls_first(), F.col("x").asc(), F.col("y").asc(), F.col("_row").asc()]
    return running(turns, ["conv_id"], order, {"place": ("sum", F.lit(1))}, "turns").select("conv_id", "place", "x", "y", "words")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, x, y, words``: each conversation's first turns are those of the first of its family."""
    borrow = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).cast("long")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = convs.select(F.col("conv_id").alias("first"), F.col("n").alias("has"))
    lent = convs.select("conv_id", borrow.alias("h"), first.alias("first")).join(heads, "first", "left")
    lent = lent.select("conv_id", "first", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("lent"))
    short = lent.where("lent < h").select("conv_id", (F.col("h") - F.col("lent")).alias("less"))
    own = turns.where(F.col("place") > borrow).join(short, "conv_id", "left").select("conv_id", (F.col("place") - F.coalesce("less", F.lit(0))).alias("depth"), "x", "y", "words")
    opening = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < BORROWED)).withColumnRenamed("conv_id", "first")
    taken = lent.where("lent > 0").join(opening, "first").where("place <= lent").select("conv_id", F.col("place").alias("depth"), "x", "y", "words")
    return own.unionByName(taken)


def prefixes(turns: DataFrame, parts: int) -> DataFrame:
    """``conv_id, depth, words, a, b, pa, pb``: for each turn the key of the prefix that it ends, and of the one before."""
    x, y = _halves(F.md5(F.concat_ws(",", "depth", "x", "y")))
    placed = turns.select("conv_id", "depth", "words", x.alias("x"), y.alias("y"))
    keyed = running(placed, ["conv_id"], [F.col("depth").asc()], {"a": ("xor", F.col("x")), "b": ("xor", F.col("y"))}, "placed", parts)
    before = [F.col(k).bitwiseXOR(F.col(v)).alias(f"p{k}") for k, v in (("a", "x"), ("b", "y"))]
    return C.staged(keyed.select("conv_id", "depth", "words", "a", "b", *before), "prefixes")


# ---------------------------------------------------------------- nodes and paths


def nodes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node, the root with key (0, 0) included; ``light`` unless it is its parent's heavy child."""
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("words", "pa", "pb")])
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("a"), zero.alias("b"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("words"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"))
    nodes = C.staged(nodes.unionByName(root), "nodes")
    order = F.struct("n_convs", F.bitwise_not("conv_id"), *KEY)  # more members first, then smaller ids
    kids = nodes.where("depth > 0").groupBy("pa", "pb").agg(F.count("*").alias("n_children"), F.max(order).alias("heavy"))
    kids = C.staged(kids.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children", F.col("heavy.a").alias("ha"), F.col("heavy.b").alias("hb")), "children")
    heavy = kids.select(F.col("ha").alias("a"), F.col("hb").alias("b"), F.lit(False).alias("light"))
    found = nodes.join(kids.select(*KEY, "n_children"), KEY, "left").join(heavy, KEY, "left")
    saved = (F.col("n_convs") - 1) * F.col("words")
    return C.staged(found.select(*KEY, "pa", "pb", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), saved.alias("saved"), ((F.col("depth") > 0) & F.coalesce("light", F.lit(True))).alias("light")), "marked")


def path_arrays(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(places, heads)``: every node's path and depth, with its own numbers; and every path's level and parent."""
    leaves = nodes.where("n_children = 0").select(F.col("conv_id").alias("path"))
    lines = rows.withColumnRenamed("conv_id", "path").select("path", "depth", *KEY).join(leaves, "path", "left_semi")
    turned = lines.join(nodes.where("light").select(*KEY), KEY, "left_semi").groupBy("path").agg(F.max("depth").alias("head"), F.count("*").alias("level"))
    paths = leaves.join(turned, "path", "left").select("path", F.coalesce("head", F.lit(0).cast("long")).alias("head"), F.coalesce("level", F.lit(0).cast("long")).alias("level"))
    paths = C.staged(paths, "paths")
    zero = F.lit(0).cast("long")
    top = paths.where("level = 0").select("path", zero.alias("depth"), zero.alias("a"), zero.alias("b"), "head", "level")
    held = lines.join(paths, "path").where("depth >= head").select("path", "depth", *KEY, "head", "level").unionByName(top)
    numbers = nodes.select(*KEY, "pa", "pb", (F.col("n_children") == 0).cast("long").alias("leaves"), "saved")
    places = C.staged(held.join(numbers, KEY), "places")
    totals = places.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    heads = places.where("depth = head").select("path", "level", "pa", "pb").join(totals, "path")
    return places, C.staged(heads, "heads")


def attached(places: DataFrame, heads: DataFrame) -> DataFrame:
    """``a, b, leaves, saved``: what hangs on each node by light children, level after level from the deepest."""
    above = heads.where("level > 0").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
    above = C.staged(above.join(places.select(*KEY, F.col("path").alias("up")), KEY), "above")
    top = heads.agg(F.max("level")).first()[0] or 0
    totals, out = heads.where(F.col("level") == top), above.select(*KEY, F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")).where("false")
    for level in range(top, 0, -1):
        hung = C.saved(totals.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        out = out.unionByName(hung)
        up = hung.join(above, KEY).groupBy(F.col("up").alias("path")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        totals = heads.where(F.col("level") == level - 1).join(up, "path", "left")
        totals = totals.select("path", "level", "pa", "pb", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
    return out


# ---------------------------------------------------------------- ends


def _joined(chunk: int):
    def join(batches):
        from pyspark import TaskContext

        part, key, held, count = TaskContext.get().partitionId(), None, [], 0
        out: list[tuple] = []

        def close():
            nonlocal held, count
            out.append((*key, part, count, ",".join(map(str, held))))
            held, count = [], count + 1

        for batch in batches:
            a, b, ids = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(a)].tolist(), strict=True):
                if hi > lo and key != (now := (int(a[lo]), int(b[lo]))):
                    if held:
                        close()
                    key, count = now, 0
                while lo < hi:
                    to = min(hi, lo + chunk - len(held))
                    held += ids[lo:to].tolist()
                    lo = to
                    if len(held) == chunk:
                        close()
            yield _rows(out)
            out.clear()
        if held:
            close()
        yield _rows(out)

    return join


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    columns = list(zip(*out, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["a", "b", "part", "chunk", "ids"])


def _hashed(batches):
    key, state = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if key != (a, b):
                if state is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield _digests(done)
    yield _digests([(*key, state.hexdigest())] if state is not None else [])


def _digests(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["a", "b", "ends_sha256"])


def end_digests(rows: DataFrame, convs: DataFrame, chunk: int = CHUNK_IDS) -> DataFrame:
    """``a, b, ends_sha256`` of every node where a conversation ends."""
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", *KEY)).alias("last"))
    zero = F.lit(0).cast("long")
    ends = convs.join(last, "conv_id", "left").select(F.coalesce("last.a", zero).alias("a"), F.coalesce("last.b", zero).alias("b"), "conv_id")
    n = C.partitions_for(rows.sparkSession, rows)
    dealt = ends.repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    chunks = dealt.mapInArrow(_joined(chunk), "a long, b long, part long, chunk long, ids string")
    together = chunks.repartition(n, *KEY).sortWithinPartitions(*KEY, "part", "chunk").select(*KEY, "ids")
    return together.mapInArrow(_hashed, "a long, b long, ends_sha256 string")


# ---------------------------------------------------------------- the trie


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK_IDS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    turns = C.staged(digested(conversations, conv_id, turn, role, text), "digested")
    convs = C.staged(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    rows = prefixes(rebuilt(turns, convs), C.partitions_for(turns.sparkSession, turns))
    nodes = nodes_of(rows, convs)
    places, heads = path_arrays(rows, nodes)
    hung = attached(places, heads)
    more = places.select("path", "depth", *KEY, "leaves", "saved").join(hung.select(*KEY, F.col("leaves").alias("l"), F.col("saved").alias("s")), KEY, "left")
    more = more.select("path", "depth", *KEY, *[(F.col(c) + F.coalesce(o, F.lit(0))).alias(c) for c, o in (("leaves", "l"), ("saved", "s"))])
    summed = running(more, ["path"], [F.col("depth").desc()], {"n_leaves": ("sum", F.col("leaves")), "saved_tokens": ("sum", F.col("saved"))}, "suffixes", C.partitions_for(places.sparkSession, places)).select(*KEY, "n_leaves", "saved_tokens")
    parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(summed, KEY).join(end_digests(rows, convs, chunk), KEY, "left").join(parents, ["pa", "pb"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return found.select(*columns, F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(C.read_table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
  SELECT conv_id, count(*) AS n, list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps
  FROM turns GROUP BY conv_id
), conv AS (
  SELECT conv_id, n, conv_id - conv_id % 20 AS first,
    xor(list_reduce(steps, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 4 AS h
  FROM bits
), rebuilt AS (
  SELECT c.conv_id, t.place - c.h + least(c.h, coalesce(f.n, 0)) AS depth, t.role, t.text
  FROM conv c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h LEFT JOIN conv f ON f.conv_id = c.first
  UNION ALL SELECT c.conv_id, t.place, t.role, t.text FROM conv c JOIN turns t ON t.conv_id = c.first AND t.place <= c.h
), whole AS (
  SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY depth) AS d, list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY depth) AS w FROM rebuilt GROUP BY conv_id
), reach AS (
  SELECT conv_id, depth, md5(array_to_string(d[1:depth], ',')) AS key, md5(array_to_string(d[1:depth - 1], ',')) AS up, w[depth] AS words, depth = len(d) AS ends
  FROM (SELECT *, unnest(range(1, len(d) + 1)) AS depth FROM whole)
  UNION ALL SELECT c.conv_id, 0, md5(''), NULL, 0, w.conv_id IS NULL FROM conv c LEFT JOIN whole w ON c.conv_id = w.conv_id
), node AS (
  SELECT key, any_value(up) AS up, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM reach GROUP BY key
), kids AS (
  SELECT up AS key, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up
), sums AS (
  SELECT r.key, count(*) FILTER (k.key IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM node n LEFT JOIN kids k ON n.key = k.key JOIN reach r ON r.conv_id = n.conv_id AND r.depth <= n.depth GROUP BY r.key
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN sums s ON n.key = s.key LEFT JOIN kids k ON n.key = k.key LEFT JOIN node p ON n.up = p.key
"""
