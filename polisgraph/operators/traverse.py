"""Bounded traversal: expansion, must-show rings, weighted paths, reachability, edges among nodes.

Rounds are joins of a frontier with the filtered edges, at most four, so plans stay small and hubs that are
excluded never enter them.  A hop count is the shortest distance; no path arrays are built but for path search,
which keeps one best path per node and hop (weights and penalties are not negative, so the best walk of at most
h hops is a simple path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polisgraph.functions import vocabulary as V
from polisgraph.graph import Graph
from polisgraph.session import shared_dir


def walkable(g: Graph, rels=V.TRAVERSED, extra: tuple[str, ...] = ()) -> DataFrame:
    """Undirected edges of the whitelist: ``(u, rel, v)``."""
    return g.undirected(*rels, *extra)


def starts_with(c: str, types) -> Column:
    out = F.lit(False)
    for t in types:
        out = out | F.col(c).startswith(V.PREFIX[t] + "-")
    return out


def kept(df: DataFrame) -> DataFrame:
    """A frontier in the shared folder: it is used twice, by the result and by the next hop."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: A table of at most so many counted ids is sent to every task; larger ones are sorted.
SENT_IDS = 300_000


def among(rows: DataFrame, ids: DataFrame, n: int, on: str, how: str = "left_semi") -> DataFrame:
    """``rows`` joined with the ``n`` rows of ``ids``; few of them are looked up, so that ``rows`` need no shuffle."""
    return rows.join(F.broadcast(ids) if n <= SENT_IDS else ids.hint("merge"), on, how)


def next_hop(edges: DataFrame, frontier: DataFrame, n: int, seen: DataFrame, n_seen: int) -> DataFrame:
    """``(id)`` of what the ``n`` rows of ``frontier`` reach, without the ``n_seen`` rows of ``seen``."""
    reached = among(edges, frontier.select(F.col("id").alias("u")), n, "u").select(F.col("v").alias("id"))
    return kept(among(reached, seen.select("id"), n_seen, "id", "left_anti").distinct())


def distances(edges: DataFrame, starts: DataFrame, hops: int, blocked=()) -> DataFrame:
    """``(id, hop)`` of nodes within ``hops`` of any row of ``starts`` (a column ``id``), which are hop 0."""
    seen = kept(starts.select("id").distinct()).withColumn("hop", F.lit(0))
    frontier, n = seen, seen.count()
    n_seen = n
    passable = edges.where(~starts_with("v", blocked)) if blocked else edges
    for k in range(1, hops + 1):
        frontier = next_hop(passable, frontier, n, seen, n_seen)
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(k)))
        n = frontier.count() if k < hops else 0
        n_seen += n
    return seen


def quota(hop: int) -> Column:
    """Rows of a type that one expansion may add; grows with the hop count."""
    out = F.lit(2 * V.EXPAND_STEP[hop])
    for types, n in V.EXPAND_QUOTA:
        out = F.when(F.col("node_type").isin(*types), n * V.EXPAND_STEP[hop]).otherwise(out)
    return out


def expand(g: Graph, start: str, hop: int, loaded: tuple[str, ...] = (), excluded: tuple[str, ...] | None = None, excluded_rels: tuple[str, ...] = (), universal: bool = False) -> DataFrame:
    """Nodes within ``hop`` of ``start``: by type the best of its quota, then the best of the hop's cap.

    ``universal`` walks the universal relationships too; their types are left out without it, unless ``excluded`` says
    otherwise.  Relationships of ``excluded_rels`` are not walked.
    """
    if hop not in V.EXPAND_CAP:
        raise ValueError("hop must be 1 to 4")
    spark = g.spark
    excluded = (() if universal else V.UNIVERSAL_TYPES) if excluded is None else excluded
    walked = walkable(g, [r for r in V.TRAVERSED if r not in excluded_rels], tuple(r for r in V.UNIVERSAL_RELS if universal and r not in excluded_rels))
    walked = walked.where(~starts_with("v", excluded)) if excluded else walked
    order = Window.partitionBy("node_type").orderBy("hop", F.desc("rank_value"), "id")
    seen = frontier = spark.createDataFrame([(start,)], "id string")
    n = n_seen = 1
    best, full = None, ()
    for k in range(1, hop + 1):
        # A nearer node comes before a farther one: a type whose quota is full takes none of the hops that follow, and what
        # the last hop reaches leads nowhere else.
        frontier = next_hop(walked.where(~starts_with("v", full)) if k == hop else walked, frontier, n, seen, n_seen)
        n = frontier.count()
        seen, n_seen = seen.unionByName(frontier), n_seen + n
        near = frontier.where(~F.col("id").isin(*loaded)) if loaded else frontier
        found = among(g.nodes.where(~F.col("node_type").isin(*full)), near, n, "id", "inner").select("id", "node_type", "label", F.lit(k).alias("hop"), F.coalesce("event_date", F.lit("")).alias("rank_value"))
        best = kept((found if best is None else best.unionByName(found)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= quota(hop)).drop("k"))
        full = tuple(r["node_type"] for r in best.groupBy("node_type").agg(F.count("*").alias("n")).where(F.col("n") >= quota(hop)).collect() if r["node_type"] in V.PREFIX)  # a row for each type
    return best.orderBy("hop", F.desc("rank_value"), F.desc("id")).limit(V.EXPAND_CAP[hop]).select("id", "node_type", "label", "hop")


def neighbourhood_total(g: Graph, starts: DataFrame, hops: int = 2) -> DataFrame:
    """How many other nodes lie within ``hops`` of each start: ``(start, total)``."""
    edges = walkable(g).select("u", "v")
    reached = starts.select(F.col("id").alias("start"), F.col("id").alias("u"))
    seen = None
    for _ in range(hops):
        reached = reached.join(edges, "u").select("start", F.col("v").alias("u")).distinct()
        seen = reached if seen is None else seen.unionByName(reached).distinct()
    return seen.where("u <> start").groupBy("start").agg(F.count("*").alias("total"))


def edges_among(g: Graph, ids: DataFrame) -> DataFrame:
    """Distinct whitelisted edges with both ends among ``ids``, smaller end first."""
    e = walkable(g).where("u < v").select("u", "rel", "v").distinct()
    return e.join(ids.select(F.col("id").alias("u")), "u", "left_semi").join(ids.select(F.col("id").alias("v")), "v", "left_semi")


def weighted_path(g: Graph, start: str, target: str, max_hops: int = 4, loose: bool = False) -> DataFrame:
    """The lightest path of at most ``max_hops``: ``(path, hops, weight)``, no row if there is none.

    Hubs (records, issues, places, agenda items) are not passed through; ``loose`` passes them and universal
    relationships at a penalty.  Ties go to fewer hops, then to the smaller path.
    """
    spark = g.spark
    weights = spark.createDataFrame(list(V.PATH_WEIGHT.items()) + ([(r, V.LOOSE_PENALTY) for r in V.UNIVERSAL_RELS] if loose else []), "rel string, w int")
    edges = g.undirected(*V.PATH_WEIGHT, *(V.UNIVERSAL_RELS if loose else ())).join(F.broadcast(weights), "rel").select("u", "v", "w")
    hub = starts_with("id", V.PATH_EXCLUDED)
    # What can reach the target in one hop: the last hop but one goes nowhere else.
    last = spark.createDataFrame([(target,)], "id string")
    back = among(edges, last.select(F.col("id").alias("u")), 1, "u").select(F.col("v").alias("id"))
    reach = [last, kept(last.unionByName(back).distinct())]
    sizes = [1, reach[1].count()]
    state = spark.createDataFrame([(start, 0, 0, start)], "id string, weight int, hops int, path string").where(F.lit(start != target))
    best, n = state, 1
    for k in range(1, max_hops + 1):
        pass_on = state.where(F.col("id") != target)
        penalty = F.when(hub & (F.col("id") != start), V.LOOSE_PENALTY).otherwise(0)
        pass_on = pass_on.withColumn("weight", F.col("weight") + penalty) if loose else pass_on.where(~hub | (F.col("id") == start))
        left = max_hops - k
        ways = among(edges, reach[left].withColumnRenamed("id", "v"), sizes[left], "v") if left < len(reach) else edges
        step = among(ways, pass_on.withColumnRenamed("id", "u"), n, "u", "inner")
        step = step.select(F.col("v").alias("id"), (F.col("weight") + F.col("w")).alias("weight"), (F.col("hops") + 1).alias("hops"), F.concat_ws(" > ", "path", "v").alias("path"))
        state = kept(step.groupBy("id").agg(F.min(F.struct("weight", "hops", "path")).alias("b")).select("id", "b.*"))
        n = state.count()
        best = best.unionByName(state)
    return best.where(F.col("id") == target).agg(F.min(F.struct("weight", "hops", "path")).alias("b")).where("b is not null").select("b.path", "b.hops", "b.weight")


def must_show(g: Graph, focus: str, pattern: list[tuple[int, list[str]]]) -> DataFrame:
    """Nodes that fixed chains of relationships reach from ``focus``, each at its smallest ring."""
    spark = g.spark
    out = None
    for ring, chain in pattern:
        at = spark.createDataFrame([(focus,)], "u string")
        for rel in chain:
            at = at.join(g.undirected(rel), "u").select(F.col("v").alias("u")).distinct()
        rows = at.select(F.col("u").alias("id"), F.lit(ring).alias("ring"))
        out = rows if out is None else out.unionByName(rows)
    return out.where(F.col("id") != focus).groupBy("id").agg(F.min("ring").alias("ring"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``, the smallest node that each node's links reach.

    Rounds take the smallest label of a node's neighbours and jump to that label's own label; each round is
    checkpointed in the cluster's shared folder and ends the loop when no label moves.
    """
    shared_dir(links.sparkSession)
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    label = e.groupBy("u").agg(F.least("u", F.min("v")).alias("c")).checkpoint()
    while True:
        near = e.join(label.select(F.col("u").alias("v"), F.col("c").alias("nc")), "v").groupBy("u").agg(F.min("nc").alias("nc"))
        low = label.join(near, "u").select("u", F.col("c").alias("old"), F.least("c", "nc").alias("c"))
        own = label.select(F.col("u").alias("c"), F.col("c").alias("cc"))
        moved = low.join(own, "c").select("u", "old", F.least("c", "cc").alias("c")).checkpoint()
        label = moved.select("u", "c")
        if not moved.where("c <> old").limit(1).count():
            return label.select(F.col("u").alias("node"), F.col("c").alias("component"))
