"""The neighbourhood of an entity's page: what must be shown, what fills the rest, and the plain view of other types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polisgraph.functions import vocabulary as V
from polisgraph.functions.provenance import effective_date
from polisgraph.graph import Graph
from polisgraph.operators.traverse import among, kept

_NO_EDGE: tuple[str, ...] = ()  # a relationship of the vocabulary that no edge has yet
_SEAT = ("<", ("HELD_BY",), ("SeatService",))
_AGREED = ("<", ("RELATES_TO_PROJECT",), ("Agreement",))
_ABOUT_PROJECT = ("<", ("RELATES_TO_PROJECT",), ("Decision",))
_ABOUT_PROGRAM = ("<", ("RELATES_TO_PROGRAM",), ("Decision",))

# For a type of focus, the chains of edges to what must be shown, with ring and name of the relation.
# A step is a direction (> along the edge, < against it, - either way), relationships, and types of the node reached.
MUST_SHOW = {
    "Person": [
        (1, "HELD_BY", [_SEAT]),
        (2, "FOR_SEAT", [_SEAT, (">", ("FOR_SEAT",), ("Seat",))]),
        (1, "CONTROLLED_BY", [("<", ("CONTROLLED_BY", "CONTROLLED_BY_COMMITTEE"), ("Committee",))]),
        (1, "BY_PERSON", [("<", ("CANDIDATE_ACTOR",), ("Candidacy",))]),
        (1, "PARTY_TO", [("-", ("PARTY_TO",), ("Case",))]),
        (3, "AT_INSTITUTION", [_SEAT, (">", ("FOR_SEAT",), ("Seat",)), (">", ("AT_INSTITUTION",), ("Organization",))]),
    ],
    "Decision": [
        (1, "AT_MEETING", [(">", ("AT_MEETING", "DECIDED_AT"), ("Meeting",))]),
        (1, "ABOUT_AGENDA_ITEM", [(">", ("ABOUT_AGENDA_ITEM",), ("AgendaItem",))]),
        (1, "DECIDED_BY", [(">", ("DECIDED_BY",), ("Organization",))]),
        (1, "CAST_VOTE", [("<", ("CAST_VOTE",), ("Person",))]),
        (1, "ABOUT_PROJECT", [(">", ("RELATES_TO_PROJECT",), ("Project",))]),
        (1, "ABOUT_PROGRAM", [(">", ("RELATES_TO_PROGRAM",), ("Program",))]),
        (1, "CONSTRAINS", [("<", _NO_EDGE, ("Case",))]),
    ],
    "Project": [
        (1, "FOR_PROJECT", [_AGREED]),
        (2, "AMENDS", [_AGREED, ("<", ("AMENDS_AGREEMENT",), ("Amendment",))]),
        (1, "ABOUT_PROJECT", [_ABOUT_PROJECT]),
        (2, "ABOUT_PROGRAM", [_ABOUT_PROJECT, (">", ("RELATES_TO_PROGRAM",), ("Program",))]),
    ],
    "Program": [
        (1, "ABOUT_PROGRAM", [_ABOUT_PROGRAM]),
        (2, "ABOUT_PROJECT", [_ABOUT_PROGRAM, (">", ("RELATES_TO_PROJECT",), ("Project",))]),
        (2, "CONSTRAINS", [_ABOUT_PROGRAM, ("<", _NO_EDGE, ("Case",))]),
    ],
    "Case": [
        (1, "PART_OF_CASE", [("<", ("PART_OF_MEETING", "PART_OF_CASE"), ("Proceeding",))]),
        (1, "HEARD_IN", [(">", ("HEARD_IN", "HEARD_BY"), ("Organization",))]),
        (1, "PARTY_TO", [("<", ("PARTY_TO",), ("Person", "Organization"))]),
        (1, "CONSTRAINS", [(">", _NO_EDGE, ("Decision",))]),
    ],
    "Meeting": [
        (1, "AT_INSTITUTION", [(">", ("AT_INSTITUTION",), ("Organization",))]),
        (1, "PART_OF_MEETING", [("<", ("PART_OF_MEETING", "PART_OF_CASE"), ("AgendaItem",))]),
        (1, "AT_MEETING", [("<", ("AT_MEETING", "DECIDED_AT"), ("Decision",))]),
    ],
    "Filing": [
        (1, "FILED_BY", [(">", ("FILED_BY", "FILED_BY_COMMITTEE", "OFFICIAL_FILER", "FILED_BY_ORG"), ("Person", "Committee", "Organization"))]),
        (1, "FOR_ELECTION", [(">", ("FOR_ELECTION",), ("Election",))]),
        (1, "DISCLOSED_IN_FILING", [("<", ("DISCLOSED_IN_FILING",), ("MoneyFlow",))]),
    ],
    "Committee": [
        (1, "CONTROLLED_BY", [(">", ("CONTROLLED_BY", "CONTROLLED_BY_COMMITTEE"), ("Person",))]),
        (1, "FILED_BY", [("<", ("FILED_BY", "FILED_BY_COMMITTEE", "OFFICIAL_FILER", "FILED_BY_ORG"), ("Filing",))]),
    ],
}

# How many nodes of a type fill a page, in order of the types' priority, and by what they are ranked.
FILL = [
    ("MoneyFlow", 8, "amount"), ("Decision", 8, "event_date"), ("Filing", 6, "event_date"), ("Meeting", 6, "event_date"), ("Person", 6, "links"), ("Organization", 4, "links"),
    ("AgendaItem", 4, "kind"), ("Amendment", 2, "event_date"), ("Proceeding", 4, "event_date"), ("Election", 2, "event_date"), ("Candidacy", 2, "id"),
]

# Fixed value: nodes of a page, unless more must be shown.
PAGE_CAP = 40
# The plain view of any other type shows so many neighbours; these types are reached by one more relationship.
PLAIN_CAP = 40
PLAIN_EXTRA = {"Place": "IN_JURISDICTION", "Issue": "RELATES_TO_ISSUE"}


def _step(g: Graph, reached: DataFrame, step: tuple) -> DataFrame:
    way, rels, types = step
    along = g.rel(*rels, source="id", target="next")
    against = g.rel(*rels, source="next", target="id")
    edges = along if way == ">" else against if way == "<" else along.unionByName(against)
    prefixes = [F.col("next").startswith(V.PREFIX[t] + "-") for t in types]
    return kept(among(edges.where(reduce(lambda a, b: a | b, prefixes)), reached, reached.count(), "id").select(F.col("next").alias("id")).distinct())


def must_show(g: Graph, focus: str, focus_type: str) -> DataFrame:
    """``(id, node_type, label, ring, relationship)`` of everything that the page of a focus must show."""
    if focus_type not in MUST_SHOW:
        raise ValueError(f"no page for {focus_type}")
    start = kept(g.nodes_of(focus_type).where(F.col("id") == focus).select("id"))
    names = g.nodes.select("id", "node_type", F.coalesce("label", "id").alias("label"))
    out = None
    for ring, name, steps in MUST_SHOW[focus_type]:
        if any(not rels for _, rels, _ in steps):
            continue
        found = reduce(lambda r, s: _step(g, r, s), steps, start)
        rows = among(names.where(F.col("node_type").isin(*steps[-1][2])), found, found.count(), "id").select("id", "node_type", "label", F.lit(ring).alias("ring"), F.lit(name).alias("relationship"))
        out = rows if out is None else out.unionByName(rows)
    return out


def fill(g: Graph, focus: str, shown: DataFrame) -> DataFrame:
    return _filled(g, focus, shown).drop("k")


def page(g: Graph, focus: str, focus_type: str) -> DataFrame:
    """``(position, id, node_type, label, ring, event_date)``: what must be shown, then what fills the page up to its cap."""
    must = kept(must_show(g, focus, focus_type))
    first = must.where(F.col("id") != focus).groupBy("id").agg(F.min(F.struct("ring", "relationship")).alias("f"), F.first("node_type").alias("node_type"), F.first("label").alias("label"))
    first = first.select("id", "node_type", "label", "f.ring", F.lit(0).alias("type_priority"), F.lit(0).alias("k"))
    rest = _filled(g, focus, must).select("id", "node_type", "label", "ring", "type_priority", "k")  # 52 rows at most
    shown = must.agg(F.count("*").alias("shown"))
    rest = rest.withColumn("n", F.row_number().over(Window.orderBy("type_priority", "k"))).crossJoin(shown).where(F.col("n") <= PAGE_CAP - F.col("shown")).drop("n", "shown")
    rows = kept(first.unionByName(rest))
    rows = among(g.nodes.select("id", effective_date("node_type", "event_date").alias("event_date")), rows, rows.count(), "id", "inner")
    # What must be shown is not capped: a page is as long as that.
    return rows.withColumn("position", F.row_number().over(Window.orderBy("type_priority", "k", "ring", "id"))).select("position", "id", "node_type", "label", "ring", "event_date")


def _filled(g: Graph, focus: str, shown: DataFrame) -> DataFrame:
    """``(id, node_type, label, ring, rank_value, type_priority, k)``: the best nodes of each type within two hops that are not shown.

    ``shown`` has the ids of what must be shown.  People and organisations are ranked by their edges to those.
    """
    both = g.undirected(*V.TRAVERSED).select("u", "v")
    near = kept(both.where(F.col("u") == focus).select(F.col("v").alias("id")).distinct())
    second = among(both, near.select(F.col("id").alias("u")), near.count(), "u").select(F.col("v").alias("id")).distinct()
    rings = near.withColumn("ring", F.lit(1)).unionByName(second.withColumn("ring", F.lit(2))).groupBy("id").agg(F.min("ring").alias("ring"))
    # What is near is counted: few ids are looked up, so that edges and nodes need no shuffle.
    shown = kept(shown.select("id").distinct())
    n_shown = shown.count()
    rings = kept(among(rings.where(F.col("id") != focus), shown, n_shown, "id", "left_anti"))
    rows = kept(among(g.of(*[t for t, _, _ in FILL]), rings, rings.count(), "id", "inner"))
    ranked_by_links = [t for t, _, by in FILL if by == "links"]
    linked = among(g.undirected(), shown.select(F.col("id").alias("v")), n_shown, "v")
    links = linked.join(rows.where(F.col("node_type").isin(*ranked_by_links)).select(F.col("id").alias("u")), "u", "left_semi").groupBy(F.col("u").alias("id")).agg(F.count("*").alias("links"))
    rows = rows.join(links, "id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    pick = lambda make: reduce(lambda out, x: F.when(F.col("node_type") == x[0], make(*x)).otherwise(out), FILL, F.lit(None))
    # Nulls are the largest (T1): first in descending order, last in ascending.
    own = lambda kind: F.when(pick(lambda t, n, by: F.lit(by)) == kind, F.col(kind))
    order = Window.partitionBy("node_type").orderBy(own("amount").desc_nulls_first(), own("links").desc(), F.when(~F.col("node_type").isin("AgendaItem", "Candidacy", *ranked_by_links), F.col("event_date")).desc_nulls_first(), own("kind").asc_nulls_last(), "id")
    best = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= pick(lambda t, n, by: F.lit(n)))
    value = pick(lambda t, n, by: F.col(by).cast("string"))
    priority = reduce(lambda out, x: F.when(F.col("node_type") == x[1][0], x[0] + 1).otherwise(out), enumerate(FILL), F.lit(None))
    return best.select("id", "node_type", F.coalesce("label", "id").alias("label"), "ring", value.alias("rank_value"), priority.alias("type_priority"), "k")


def plain_view(g: Graph, focus: str, focus_type: str) -> DataFrame:
    """``(id, node_type, label, relationship, start_id, end_id)``: the first forty edges of a focus without a page of its own."""
    e = g.edges.where((F.col("source_id") == focus) | (F.col("target_id") == focus)).where("source_id <> target_id")
    if focus_type == "Record":
        e = e.where((F.col("rel") == "EVIDENCED_BY") & (F.col("target_id") == focus))
    else:
        e = e.where(F.col("rel").isin(*V.TRAVERSED, *([PLAIN_EXTRA[focus_type]] if focus_type in PLAIN_EXTRA else [])))
    e = e.select(F.when(F.col("source_id") == focus, F.col("target_id")).otherwise(F.col("source_id")).alias("id"), F.col("rel").alias("relationship"), F.col("source_id").alias("start_id"), F.col("target_id").alias("end_id")).distinct()
    hidden = {"Record": (), "Place": ("Issue",), "Issue": ("Place",)}.get(focus_type, ("Place", "Issue"))
    names = g.nodes.select("id", "node_type", F.coalesce("label", "id").alias("label"))
    out = names.where(~F.col("node_type").isin(*hidden)).join(e, "id")
    return out.orderBy("node_type", "id", "relationship", "start_id").limit(PLAIN_CAP)
