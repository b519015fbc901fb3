"""Registered queries for cleaning, search, browsing, resolution, integrity, the query pack and layout."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polisgraph.functions import cleaning as K
from polisgraph.graph import Graph
from polisgraph.operators import resolve, search, traverse
from polisgraph.plans import views
from polisgraph.plans.tabular import is_current
from polisgraph.sources.fixtures import fixture_graph, with_graph
from polisgraph.sources.store import type_digests

AS_OF = "2026-01-01"
#: Three years before: activity before this day adds nothing to a rank.
RANKED_SINCE = "2023-01-02"
#: Kind of actors that came from unreliable sources.
NOISY_ACTORS = "noisy-import"
TERMS = ("the", "que", "license")
SEARCHED = "org-3"
K1, B = 1.2, 0.75


def clean_names(spark, d) -> DataFrame:
    g = fixture_graph(spark, d)
    n = g.of("Organization", "Person", "Project", "Committee")
    return n.select("id", K.slug("label").alias("slug"), K.name_key("label").alias("name_key"), K.fingerprint("id", "kind", "amount").alias("fingerprint"), K.type_of_id("id").alias("inferred"), K.display_label("ref_id", "label", fallback="id").alias("shown"))


def html_text(spark, d) -> DataFrame:
    p = spark.read.parquet(f"{d}/pages.parquet")
    text = K.html_text("html")
    return p.select("page_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("length"), F.size(K.links("html")).cast("long").alias("links"))


def record_urls(spark, d) -> DataFrame:
    r = fixture_graph(spark, d).of("Record")
    return r.select("id", K.public_url("url").alias("preferred_url"), K.artifact_label("url").alias("artifact"))


def packed(c: str):
    """A shorter name for an id that ends in a digest of sixteen hex digits; any other id's bytes. No two ids have one name."""
    digest = F.concat(F.encode(F.substring_index(c, "-", 1), "UTF-8"), F.unhex(F.lit("00")), F.unhex(F.right(F.col(c), F.lit(16))))
    return F.when(F.col(c).rlike("^[a-z]+-[0-9a-f]{16}$"), digest).otherwise(F.encode(F.col(c), "UTF-8"))


def activity(g: Graph, since: str = "") -> DataFrame:
    """``(id, degree, last_activity)`` of searched nodes: links, and the latest date of dated neighbours or else one's own.

    Ids tell their type by prefix, so ends that are not searched are not counted, and ends that are never dated are not sought.
    With ``since``, a last activity before it may be missing or another one before it: links between types without
    any later date are not followed.
    """
    links = g.undirected().where(traverse.starts_with("u", K.V.SEARCH_WEIGHT))
    degree = links.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    dated = g.nodes_of(*K.V.ACTIVITY_TYPES).where(F.coalesce("event_date", F.lit("")) != "")
    followed = links.where(traverse.starts_with("v", K.V.ACTIVITY_TYPES))
    if since:
        last = g.nodes_of(*{**dict.fromkeys(K.V.ACTIVITY_TYPES), **K.V.SEARCH_WEIGHT}).groupBy("node_type").agg(F.max("event_date").alias("last"))
        late = [r["node_type"] for r in last.where(F.col("last") >= since).collect()]  # a row for each type
        # A late date of one's own counts only without dated neighbours, so links of types that have such are followed too.
        followed = followed.where(traverse.starts_with("v", late) | traverse.starts_with("u", late))
    latest = followed.select("u", packed("v").alias("v")).join(dated.select(packed("id").alias("v"), "event_date"), "v").groupBy(F.col("u").alias("id")).agg(F.max("event_date").alias("linked"))
    out = g.nodes_of(*K.V.SEARCH_WEIGHT).join(degree, "id", "left").join(latest, "id", "left")
    return out.withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("last_activity", F.coalesce("linked", F.nullif("event_date", F.lit(""))))


def search_rank(spark, d, since: str = "") -> DataFrame:
    return activity(fixture_graph(spark, d), since).select("id", "last_activity", K.search_rank("node_type", "degree", "last_activity", AS_OF).alias("rank"))


def search_properties(spark, d) -> DataFrame:
    """Label, terms and key fact by which each searched node is shown and found."""
    g = fixture_graph(spark, d)
    filer = g.rel("FILED_BY", source="id", target="filer_id", source_type="filing").join(g.of("Person", "Committee", "Organization").select(F.col("id").alias("filer_id"), F.col("label").alias("filer")), "filer_id").groupBy("id").agg(F.min("filer").alias("filer"))
    n = g.nodes_of(*K.V.SEARCH_WEIGHT).join(filer, "id", "left")
    return n.select("id", K.search_label("node_type", "id", "label", "kind", "event_date", "filer").alias("search_label"), K.search_terms("node_type", "id", "label", "kind", "event_date", "filer", "url").alias("search_terms"), K.search_key_fact("node_type", "label", "kind", "status", "event_date", "filer").alias("search_key_fact"))


_INDEXES: dict[tuple[str, str], search.Index] = {}


def search_index(spark, d) -> search.Index:
    """The index of ``d``'s searched nodes, stored once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        g = fixture_graph(spark, d)
        text = search_properties(spark, d).select("id", F.concat_ws(" ", "search_label", "search_terms").alias("text"))
        ranked = search_rank(spark, d, RANKED_SINCE).select("id", "rank")  # earlier activity adds nothing to a rank
        captured = g.nodes_of(*K.V.SEARCH_WEIGHT).select("id", "node_type", F.when(F.col("node_type") == "Record", F.col("event_date")).alias("captured"))
        _INDEXES[key] = search.build_index(captured.join(text, "id").join(ranked, "id"))
    return _INDEXES[key]


def browse_page(g: Graph, node_type: str, after: str = "", size: int = 50) -> DataFrame:
    """The next page of a type in id order: a seek past the last id, never an offset."""
    return g.of(node_type).where(F.col("id") > after).orderBy("id").limit(min(200, max(1, size))).select("id", "label", "kind", "event_date")


def bm25(docs: DataFrame, terms: tuple[str, ...], id_col: str = "doc_id", text: str = "text", top: int = 50) -> DataFrame:
    """The best documents for a few terms; term counts are taken in the scan, so no inverted list is shuffled."""
    words = F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), lambda w: w != "")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), words.alias("w"))
    count = lambda t: F.size(F.filter("w", lambda x: x == t))
    rows = rows.select("id", F.size("w").alias("n"), *[count(t).alias(f"t{i}") for i, t in enumerate(terms)])
    total = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = rows.where(" + ".join(f"t{i}" for i in range(len(terms))) + " > 0").crossJoin(F.broadcast(total))  # a single row of totals
    idf = lambda i: F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    part = lambda i: idf(i) * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    score = sum((part(i) for i in range(1, len(terms))), part(0))
    return joined.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def search_bm25(spark, d) -> DataFrame:
    return bm25(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), TERMS)


def catalog(spark, d) -> DataFrame:
    """Number of nodes of every known type, with those that have none."""
    g = fixture_graph(spark, d)
    types = spark.createDataFrame([(t,) for t in K.V.PREFIX], "node_type string")
    return types.join(g.nodes.groupBy("node_type").agg(F.count("*").alias("n")), "node_type", "left").select("node_type", F.coalesce("n", F.lit(0)).alias("n"))


def edge_integrity(spark, d) -> DataFrame:
    """Decisions name institutions that may not exist: those and all edges are held against the nodes."""
    g = fixture_graph(spark, d)
    named = g.of("Decision").select(F.col("id").alias("source_id"), F.col("ref_id").alias("target_id"), F.lit("institution_id").alias("rel"))
    return resolve.dangling(g.edges.select("source_id", "target_id", "rel").unionByName(named), g.nodes.where("id <> 'org-11' and id <> 'place-nation-3'"))


def _keyed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Suppliers and parts of them under two keys, some of which disagree."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    new = s.select(F.concat(F.lit("new-"), "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 != 0, F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("ein"), F.lpad(F.col("s_suppkey").cast("string"), 12, "A").alias("uei"))
    old = s.select(F.concat(F.lit("org-"), "s_suppkey").alias("id"), F.lpad(F.when(F.col("s_suppkey") % 7 == 0, F.col("s_suppkey") + 1).otherwise(F.col("s_suppkey")).cast("string"), 9, "0").alias("ein"), F.when(F.col("s_suppkey") % 5 != 0, F.lpad(F.col("s_suppkey").cast("string"), 12, "A")).alias("uei"))
    return new, old


def resolve_keys(spark, d) -> DataFrame:
    return resolve.by_keys(*_keyed(spark, d), ["ein", "uei"])


def resolve_names(spark, d) -> DataFrame:
    """Committees to people: the whole name first, then the number at its end if it is one person's."""
    g = fixture_graph(spark, d)
    committees = g.of("Committee").select("id", "label")
    people = g.of("Person").select("id", F.col("label").alias("name"))
    number = lambda c: F.regexp_extract(F.col(c), "#0*([0-9]+)$", 1)
    return resolve.by_unique(committees, people, [("name", K.name_key("label"), K.name_key("name")), ("number", number("label"), number("name"))])


def fuzzy_names(spark, d) -> DataFrame:
    """All distinct part names against each other, but no name against itself."""
    names = spark.read.parquet(f"{d}/part.parquet").select(F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct().select(F.col("name").alias("id"), "name")
    return resolve.by_similar_names(names, names, "name", settled=names.select("id", F.col("id").alias("match")))


def merged_properties(spark, d) -> DataFrame:
    """Orders of a customer folded into one row: strongest scalars, united lists."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    rows = o.select("o_custkey", F.col("o_orderkey").alias("seq"), rank.alias("rank"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"), F.array("o_orderpriority").alias("priorities"))
    out = resolve.merge_ordered(rows, "o_custkey", "seq", "rank", ["priority"], ["priorities"])
    return out.select("o_custkey", "priority", F.array_join("priorities", "|").alias("priorities"))


def query_pack(spark, d) -> DataFrame:
    """The gated pack: each query's two or three measures and whether it passes."""
    g = fixture_graph(spark, d)
    filings = g.of("Filing").select(F.col("id").alias("f"), F.col("kind").alias("family"), F.substring("event_date", 1, 4).alias("year"))
    by = filings.join(g.rel("FILED_BY", "OFFICIAL_FILER", source="f", target="actor"), "f")
    actors = by.groupBy("actor").agg(F.count_distinct("family").alias("families"), F.count_distinct(F.nullif("year", F.lit(""))).alias("years"))
    current = g.of("SeatService").where(is_current("ended_date", AS_OF)).select(F.col("id").alias("tenure"))
    disclosed = filings.where(F.col("family").isin("form_700", "form_803") & (F.col("year") >= "2019")).join(g.rel("FILED_DURING_SEAT_SERVICE", source="f", target="tenure"), "f").join(current, "tenure", "left_semi").select("f").distinct()
    resolved = disclosed.join(by.select("f", "actor").distinct().groupBy("f").agg(F.count("*").alias("actors")), "f", "left")
    meetings = g.of("Meeting").where(F.coalesce("event_date", F.lit("")) != "").select(F.col("id").alias("m"), F.substring("event_date", 1, 4).alias("year"))
    timeline = g.rel("DECIDED_AT", "AT_MEETING", source="decision", target="m", source_type="decision").join(meetings, "m")
    spine = g.rel("DISCLOSED_IN_FILING", source="flow", target="f", source_type="moneyflow").join(filings.where("year <> ''"), "f")
    noisy = g.of("Person", "Organization").where(F.col("kind") == NOISY_ACTORS)
    cases = g.of("Case").select(F.col("id").alias("c"))
    lineage = cases.join(g.rel("PART_OF_CASE", source="p", target="c").select("c").distinct().withColumn("heard", F.lit(1)), "c", "left")
    programs = g.rel("RELATES_TO_PROGRAM", source="c", target="program", source_type="case").groupBy("program").agg(F.count_distinct("c").alias("n")).where("n >= 2")
    linked = g.rel("RELATES_TO_DECISION", source="c", target="decision", source_type="case").select("decision").distinct()
    checked = views.checks(g)
    rows = [
        ("actor_dossier", [actors.agg(F.count_if((F.col("families") >= 2) & (F.col("years") >= 2)).alias("a"), F.count("*").alias("b"))], F.col("a") > 0),
        ("disclosure_coverage", [resolved.agg(F.count("*").alias("a"), F.count("actors").alias("b"))], (F.col("a") > 0) & (F.col("a") == F.col("b"))),
        ("decision_timeline", [timeline.agg(F.count_distinct("decision").alias("a"), F.count_distinct("m").alias("b"), F.count_distinct("year").alias("c"))], (F.col("a") > 100) & (F.col("b") > 20) & (F.col("c") > 1)),
        ("election_money_spine", [spine.agg(F.count_distinct("year").alias("a")), noisy.agg(F.count("*").alias("b"))], (F.col("a") >= 2) & (F.col("b") == 0)),
        ("validation_queue", [checked.agg(F.count("*").alias("a"), F.count_distinct("subject").alias("b"))], (F.col("a") <= 20) & (F.col("b") <= 10)),
        ("legal_constraint_chain", [lineage.agg((F.count("*") - F.count("heard")).alias("a")), programs.agg(F.count("*").alias("b")), linked.agg(F.count("*").alias("c"))], (F.col("a") == 0) & ((F.col("b") > 0) | (F.col("c") >= 2))),
    ]
    out = None
    for name, parts, passed in rows:
        df = parts[0]
        for p in parts[1:]:
            df = df.crossJoin(p)  # one row each
        third = F.col("c") if "c" in df.columns else F.lit(None)
        row = df.select(F.lit(name).alias("query"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), third.cast("long").alias("c"), passed.alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def centroids(vectors: DataFrame, cluster: str = "label", vector: str = "embedding", noise: bool = False) -> DataFrame:
    """Mean and size of every cluster by component; noise (a negative cluster) is left out unless asked for."""
    rows = vectors if noise else vectors.where(F.col(cluster) >= 0)
    parts = rows.select(F.col(cluster).alias("cluster"), F.posexplode(vector).alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("members"))
    return parts


def layout_centroids(spark, d) -> DataFrame:
    return centroids(spark.read.parquet(f"{d}/embeddings.parquet")).select("cluster", "dim", F.round("mean", 6).alias("mean"), "members")


def centroid_distance(spark, d) -> DataFrame:
    """Every vector's distance from its cluster's centroid."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("label >= 0")
    c = centroids(e).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"]).alias("c"))
    gap = F.sqrt(F.aggregate(F.zip_with("embedding", "c", lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)), F.lit(0.0), lambda a, x: a + x))
    return e.join(c, F.col("label") == F.col("cluster")).select("vec_id", "cluster", F.round(gap, 6).alias("distance"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Largest and mean shift of the nodes of two layouts over the width of the older one: ``(id, x, y)`` each."""
    both = old.join(new.select("id", F.col("x").alias("x2"), F.col("y").alias("y2")), "id")
    gap = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    width = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    moved = F.hypot(F.avg("x2") - F.avg("x"), F.avg("y2") - F.avg("y"))
    return both.agg(F.count("*").alias("nodes"), F.round(F.max(gap) / width, 6).alias("largest"), F.round(F.avg(gap) / width, 6).alias("mean"), F.round(moved / width, 6).alias("centroid"))


def layout_drift(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return drift(e.select(F.col("vec_id").alias("id"), x.alias("x"), y.alias("y")), e.select(F.col("vec_id").alias("id"), (x + y / 10).alias("x"), y.alias("y")))


def promote(frames: DataFrame) -> DataFrame:
    """Pending layouts become canonical, canonical ones previous: one pass, so readers see one version or the other."""
    entered = F.col("canonical").isNull() & F.col("pending").isNotNull()
    return frames.select("id", F.col("pending").alias("canonical"), F.col("canonical").alias("previous"), entered.alias("entered"))


def layout_promote(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return promote(e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 4 != 0, F.col("label")).alias("pending"), F.when(F.col("vec_id") % 3 != 0, F.col("label") + 1).alias("canonical")))


def name_clusters(members: DataFrame, place: str, kind: str, label: str, cluster: str = "cluster", order: str = "place_in_cluster") -> DataFrame:
    """``(cluster, name)``: the most frequent place, type and word of each cluster's members, first come first where equal.

    ``order`` numbers a cluster's members from 1.
    """
    stop = F.array(*[F.lit(w) for w in K.V.STOP_WORDS])
    words = F.filter(F.split(F.lower(F.coalesce(label, F.lit(""))), "[^a-z]+"), lambda w: (w != "") & ~F.array_contains(stop, w))

    def most_common(values: DataFrame, name: str) -> DataFrame:
        counts = values.where("v is not null and v <> ''").groupBy(cluster, "v").agg(F.count("*").alias("n"), F.min("at").alias("first"))
        return counts.groupBy(cluster).agg(F.max_by("v", F.struct("n", -F.col("first.member"), -F.col("first.word"))).alias(name))

    one = lambda c: members.select(cluster, F.col(c).alias("v"), F.struct(F.col(order).alias("member"), F.lit(0).alias("word")).alias("at"))
    said = members.select(cluster, F.col(order).alias("member"), F.posexplode(words).alias("word", "v")).select(cluster, "v", F.struct("member", "word").alias("at"))
    out = members.select(cluster).distinct()
    for values, name in ((one(place), "_p"), (one(kind), "_t"), (said, "_w")):
        out = out.join(most_common(values, name), cluster, "left")
    return out.select(cluster, F.coalesce(F.nullif(F.concat_ws(" · ", "_p", "_t", "_w"), F.lit("")), F.lit("Unnamed cluster")).alias("name"))


def cluster_names(spark, d) -> DataFrame:
    """Vectors' clusters, each with its ten members nearest to the centroid standing for nodes of the graph."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("label >= 0").select("vec_id", F.col("label").alias("cluster"))
    near = centroid_distance(spark, d).withColumn("place_in_cluster", F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "vec_id"))).where("place_in_cluster <= 10").select("vec_id", "place_in_cluster")
    g = fixture_graph(spark, d)
    projects = g.of("Project").select("id", "node_type", "label").withColumn("vec_id", F.regexp_extract("id", "[0-9]+$", 0).cast("long"))
    places = g.rel("IN_JURISDICTION", source="id", target="p", source_type="project").join(g.of("Place").select(F.col("id").alias("p"), F.col("label").alias("place")), "p").select("id", "place")
    members = e.join(near, "vec_id").join(projects.join(places, "id", "left"), "vec_id", "left")
    return name_clusters(members, "place", "node_type", "label")


def digests(spark, d) -> DataFrame:
    return type_digests(fixture_graph(spark, d).edges.select("source_id", "target_id", "rel"), "rel")


QUERIES = {
    "clean_names": clean_names,
    "html_text": html_text,
    "record_urls": record_urls,
    "search_rank": search_rank,
    "search_properties": search_properties,
    "search_bm25": search_bm25,
    "search_nodes": lambda s, d: search.search(search_index(s, d), SEARCHED),
    "search_entities": lambda s, d: search.search(search_index(s, d), "record-doc-7", include_records=False),
    "browse_page": lambda s, d: browse_page(fixture_graph(s, d), "Project", "project-20"),
    "catalog": catalog,
    "edge_integrity": edge_integrity,
    "edge_digests": digests,
    "resolve_keys": resolve_keys,
    "key_conflicts": lambda s, d: resolve.key_conflicts(*_keyed(s, d), ["ein", "uei"]),
    "complete_edges": lambda s, d: resolve.with_both_ends(fixture_graph(s, d).edges_of("CAST_VOTE", "DECIDED_BY", "FILED_BY").select("source_id", "rel", "target_id"), fixture_graph(s, d).nodes.where("id <> 'org-5'")),
    "resolve_names": resolve_names,
    "fuzzy_names": fuzzy_names,
    "merged_properties": merged_properties,
    "query_pack": query_pack,
    "layout_centroids": layout_centroids,
    "centroid_distance": centroid_distance,
    "layout_drift": layout_drift,
    "layout_promote": layout_promote,
    "cluster_names": cluster_names,
}



def _search_sql(query: str, records: bool) -> str:
    terms = ", ".join(f"'{t}'" for t in sorted(set(re.findall("[a-z0-9]+", query.lower()))))
    bucket = "CASE WHEN t = 'Record' THEN 2 ELSE 1 END"
    return (
        f"WITH sp AS ({ORACLE_SQL['search_properties']}), sr AS ({ORACLE_SQL['search_rank']}), cap AS ({with_graph('SELECT id, node_type, event_date FROM nodes')}), "
        "d AS (SELECT sp.id, node_type AS t, rank, CASE WHEN node_type = 'Record' THEN event_date END AS captured, list_filter(regexp_split_to_array(lower(concat_ws(' ', search_label, search_terms)), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM sp JOIN sr USING (id) JOIN cap USING (id)), "
        f"tot AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d WHERE len(w) > 0), q AS (SELECT unnest([{terms}]) AS term), "
        "p AS (SELECT d.id, t, term, len(w) AS n, len(list_filter(w, lambda x: x = term)) AS tf FROM d, q WHERE list_contains(w, term)), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), "
        f"s AS (SELECT id, t, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + {search.K1} * ({1 - search.B} + {search.B} * n / mean))), 9) AS score FROM p JOIN f USING (term), tot GROUP BY 1, 2), "
        f"b AS (SELECT *, {bucket} AS bucket FROM s{'' if records else " WHERE t <> 'Record'"} QUALIFY row_number() OVER (PARTITION BY {bucket} ORDER BY score DESC, id) <= {search.SCORED}), "
        f"o AS (SELECT b.id, b.t, b.bucket, score, row_number() OVER (PARTITION BY b.bucket ORDER BY score * 100 + rank DESC, captured DESC NULLS FIRST, b.id) AS k FROM b JOIN d USING (id)), "
        f"r AS (SELECT id, t, bucket, score, k FROM o WHERE k <= {search.SHOWN} AND id <> '{query}' UNION ALL SELECT id, t, 0, NULL, 1 FROM d WHERE id = '{query}') "
        f"SELECT CAST(position AS INTEGER) AS position, CAST(bucket AS INTEGER) AS bucket, id, t AS node_type, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY bucket, k) AS position FROM r) WHERE position <= {search.SHOWN}"
    )


_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_KEY = "trim(regexp_replace(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), '(^| )(inc|incorporated|llc|corp)( (inc|incorporated|llc|corp))*$', ''))"
_TYPE = "CASE " + " ".join(f"WHEN id LIKE '{p}-%' THEN '{t}'" for t, p in sorted(K.V.PREFIX.items(), key=lambda x: -len(x[1]))) + " END"
_HTML = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g'))"
_TITLE = "array_to_string(list_transform(string_split(replace(kind, '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
_PATH = "lower(regexp_replace(url, '[?#].*$', ''))"
_T = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "clean_names": with_graph(f"SELECT id, {_SLUG.format('label')} AS slug, {_KEY.format('label')} AS name_key, substr(md5(concat_ws('|', id, coalesce(kind, ''), coalesce(CAST(amount AS VARCHAR), ''))), 1, 8) AS fingerprint, {_TYPE} AS inferred, coalesce(nullif(trim(ref_id), ''), nullif(trim(label), ''), id) AS shown FROM nodes WHERE node_type IN ('Organization', 'Person', 'Project', 'Committee')"),
    "html_text": f"SELECT page_id, md5({_HTML}) AS text_md5, CAST(length({_HTML}) AS BIGINT) AS length, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS BIGINT) AS links FROM pages",
    "record_urls": with_graph(f"SELECT id, CASE WHEN regexp_matches(trim(url), '^https?://') THEN trim(url) WHEN trim(url) LIKE '//%' THEN 'https:' || trim(url) END AS preferred_url, CASE WHEN {_PATH} LIKE '%.pdf' THEN 'PDF' WHEN {_PATH} LIKE '%.html' OR {_PATH} LIKE '%.htm' THEN 'Web page' WHEN url IS NOT NULL THEN 'Link' END AS artifact FROM nodes WHERE node_type = 'Record'"),
    "search_rank": with_graph(f"b AS (SELECT source_id AS x, target_id AS v FROM edges UNION ALL SELECT target_id, source_id FROM edges), deg AS (SELECT x, count(*) AS n FROM b GROUP BY x), act AS (SELECT x, max(event_date) AS linked FROM b JOIN nodes ON id = v AND node_type IN {K.V.ACTIVITY_TYPES} AND event_date <> '' GROUP BY x), p AS (SELECT id, node_type, coalesce(linked, nullif(event_date, '')) AS last_activity, least(25, floor(20 * ln(1 + coalesce(n, 0)) / ln(1000) + 1e-9)) AS l FROM nodes LEFT JOIN deg ON deg.x = id LEFT JOIN act ON act.x = id WHERE node_type IN {tuple(K.V.SEARCH_WEIGHT)}), q AS (SELECT *, datediff('day', TRY_CAST(last_activity AS DATE), DATE '{AS_OF}') AS days FROM p) SELECT id, last_activity, CAST(CASE WHEN node_type = 'Record' THEN least(30, greatest(0, l + 10)) ELSE least(100, greatest(0, 50 + l + coalesce(CASE WHEN days < 0 THEN 25 ELSE greatest(0, 25 - floor(25.0 * days / 1095)) END, 0) + CASE node_type {' '.join(f"WHEN '{t}' THEN {w}" for t, w in K.V.SEARCH_WEIGHT.items())} ELSE 0 END)) END AS INTEGER) AS rank FROM q"),
    "search_properties": with_graph(f"fl AS (SELECT e.source_id AS fid, min(p.label) AS filer FROM edges e JOIN nodes p ON p.id = e.target_id AND p.node_type IN ('Person', 'Committee', 'Organization') WHERE e.rel = 'FILED_BY' AND e.source_id LIKE 'filing-%' GROUP BY 1), n AS (SELECT id, node_type AS t, nullif(label, '') AS name, kind, nullif(status, '') AS status, nullif(event_date, '') AS day, filer, url, {_TITLE} AS title FROM nodes LEFT JOIN fl ON fid = id WHERE node_type IN {tuple(K.V.SEARCH_WEIGHT)}) SELECT id, CASE t WHEN 'Decision' THEN concat_ws(' · ', coalesce(name, id), day) WHEN 'Meeting' THEN concat_ws(' — ', coalesce(name, id), day) WHEN 'Filing' THEN concat_ws(' · ', title, filer, day) WHEN 'Election' THEN concat_ws(' — ', coalesce(kind, 'Election'), day) WHEN 'Record' THEN coalesce(title, 'Record') ELSE coalesce(name, id) END AS search_label, lower(concat_ws(' ', id, CASE WHEN t NOT IN ('Filing', 'Record', 'Election') THEN name END, CASE WHEN t IN ('Decision', 'Meeting') THEN day END, CASE WHEN t IN ('Filing', 'Record') THEN kind END, CASE WHEN t = 'Filing' THEN filer END, CASE WHEN t = 'Record' THEN nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:@]+)', 1), '') END)) AS search_terms, CASE t WHEN 'Person' THEN NULL WHEN 'Decision' THEN nullif(concat_ws(' · ', name, CASE WHEN name IS NOT NULL THEN day END), '') WHEN 'Case' THEN nullif(concat_ws(' · ', name, day), '') WHEN 'Meeting' THEN nullif(concat_ws(' · ', name, day), '') WHEN 'Project' THEN nullif(concat_ws(' · ', name, status), '') WHEN 'Program' THEN nullif(concat_ws(' · ', name, status), '') WHEN 'Filing' THEN nullif(concat_ws(' · ', title, filer, day), '') WHEN 'Organization' THEN nullif(concat_ws(' · ', name, kind), '') WHEN 'Election' THEN concat_ws(' · ', coalesce(kind, 'Election'), day) WHEN 'Record' THEN coalesce(title, 'Record') ELSE name END AS search_key_fact FROM n"),
    "search_bm25": f"WITH w AS (SELECT doc_id AS id, {_T} AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT id, len(w) AS n, " + ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(TERMS)) + " FROM w), s AS (SELECT count(*) AS docs, avg(n) AS mean, " + ", ".join(f"count(*) FILTER (t{i} > 0) AS df{i}" for i in range(len(TERMS))) + " FROM c) SELECT id, round(" + " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * t{i} * {K1 + 1} / (t{i} + {K1} * ({1 - B} + {B} * n / mean))" for i in range(len(TERMS))) + ", 6) AS score FROM c, s WHERE t0 + t1 + t2 > 0 ORDER BY score DESC, id LIMIT 50",
    "browse_page": with_graph("SELECT id, label, kind, event_date FROM nodes WHERE node_type = 'Project' AND id > 'project-20' ORDER BY id LIMIT 50"),
    "catalog": with_graph("SELECT t.node_type, count(n.id) AS n FROM (VALUES " + ", ".join(f"('{t}')" for t in K.V.PREFIX) + ") t(node_type) LEFT JOIN nodes n ON n.node_type = t.node_type GROUP BY 1"),
    "edge_integrity": with_graph("ids AS (SELECT id FROM nodes WHERE id NOT IN ('org-11', 'place-nation-3')), e AS (SELECT source_id, target_id, rel FROM edges UNION ALL SELECT id, ref_id, 'institution_id' FROM nodes WHERE node_type = 'Decision') SELECT rel, count(*) AS missing FROM e WHERE source_id NOT IN (SELECT id FROM ids) OR target_id NOT IN (SELECT id FROM ids) GROUP BY rel"),
    "edge_digests": with_graph("SELECT rel AS type, count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(source_id || '|' || target_id), 1, 8)) AS BIGINT)) AS VARCHAR) AS digest FROM edges GROUP BY rel"),
    "key_conflicts": "WITH n AS (SELECT 'new-' || s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS ein, lpad(CAST(s_suppkey AS VARCHAR), 12, 'A') AS uei FROM supplier), o AS (SELECT 'org-' || s_suppkey AS id, lpad(CAST(CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS VARCHAR), 9, '0') AS ein, CASE WHEN s_suppkey % 5 <> 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 12, 'A') END AS uei FROM supplier), h AS (SELECT n.id, o.id AS match, 0 AS r, 'ein' AS k FROM n JOIN o USING (ein) UNION ALL SELECT n.id, o.id, 1, 'uei' FROM n JOIN o USING (uei)), p AS (SELECT id, match, arg_min(k, r) AS matched_by FROM h GROUP BY 1, 2) SELECT * FROM p WHERE id IN (SELECT id FROM p GROUP BY 1 HAVING count(*) > 1)",
    "complete_edges": with_graph("ids AS (SELECT id FROM nodes WHERE id <> 'org-5') SELECT source_id, rel, target_id FROM edges WHERE rel IN ('CAST_VOTE', 'DECIDED_BY', 'FILED_BY') AND source_id IN (SELECT id FROM ids) AND target_id IN (SELECT id FROM ids)"),
    "resolve_keys": "WITH n AS (SELECT 'new-' || s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS ein, lpad(CAST(s_suppkey AS VARCHAR), 12, 'A') AS uei FROM supplier), o AS (SELECT 'org-' || s_suppkey AS id, lpad(CAST(CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS VARCHAR), 9, '0') AS ein, CASE WHEN s_suppkey % 5 <> 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 12, 'A') END AS uei FROM supplier), h AS (SELECT n.id, o.id AS m, 0 AS r, 'ein' AS k FROM n JOIN o USING (ein) UNION ALL SELECT n.id, o.id, 1, 'uei' FROM n JOIN o USING (uei)), b AS (SELECT id, min(m) AS lo, max(m) AS hi, arg_min(k, r) AS k FROM h GROUP BY id) SELECT n.id, CASE WHEN lo = hi THEN lo END AS match, CASE WHEN lo = hi THEN k END AS matched_by, CASE WHEN lo IS NULL THEN 'new' WHEN lo <> hi THEN 'conflict' ELSE 'matched' END AS status FROM n LEFT JOIN b USING (id)",
    "resolve_names": with_graph(f"c AS (SELECT id, {_KEY.format('label')} AS k0, regexp_extract(label, '#0*([0-9]+)$', 1) AS k1 FROM nodes WHERE node_type = 'Committee'), p AS (SELECT id, {_KEY.format('label')} AS k0, regexp_extract(label, '#0*([0-9]+)$', 1) AS k1 FROM nodes WHERE node_type = 'Person'), u0 AS (SELECT k0, min(id) AS m FROM p WHERE k0 <> '' GROUP BY 1 HAVING count(DISTINCT id) = 1), u1 AS (SELECT k1, min(id) AS m FROM p WHERE k1 <> '' GROUP BY 1 HAVING count(DISTINCT id) = 1) SELECT c.id, coalesce(u0.m, u1.m) AS match, CASE WHEN u0.m IS NOT NULL THEN 'name' WHEN u1.m IS NOT NULL THEN 'number' END AS rung FROM c LEFT JOIN u0 USING (k0) LEFT JOIN u1 USING (k1)"),
    "merged_properties": "WITH o AS (SELECT o_custkey, o_orderkey AS s, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS r, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS p, o_orderpriority AS q FROM orders), f AS (SELECT o_custkey, q, min(s) AS s FROM o GROUP BY 1, 2), l AS (SELECT o_custkey, string_agg(q, '|' ORDER BY s) AS priorities FROM f GROUP BY 1), b AS (SELECT o_custkey, p FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p IS NULL, r DESC, s) AS k FROM o) WHERE k = 1) SELECT o_custkey, p AS priority, priorities FROM b JOIN l USING (o_custkey)",
    "query_pack": with_graph("f AS (SELECT id, kind, substr(event_date, 1, 4) AS y FROM nodes WHERE node_type = 'Filing'), fa AS (SELECT f.*, e.target_id AS actor FROM f JOIN edges e ON e.rel IN ('FILED_BY', 'OFFICIAL_FILER') AND e.source_id = f.id), a AS (SELECT actor, count(DISTINCT kind) AS k, count(DISTINCT nullif(y, '')) AS y FROM fa GROUP BY 1), disc AS (SELECT DISTINCT f.id FROM f JOIN edges e ON e.rel = 'FILED_DURING_SEAT_SERVICE' AND e.source_id = f.id JOIN nodes s ON s.id = e.target_id AND s.node_type = 'SeatService' AND (s.ended_date IS NULL OR s.ended_date = '' OR TRY_CAST(s.ended_date AS DATE) >= DATE '2026-01-01') WHERE f.kind IN ('form_700', 'form_803') AND f.y >= '2019'), tl AS (SELECT e.source_id AS d, m.id AS m, substr(m.event_date, 1, 4) AS y FROM edges e JOIN nodes m ON m.id = e.target_id AND m.node_type = 'Meeting' AND m.event_date <> '' WHERE e.rel IN ('DECIDED_AT', 'AT_MEETING') AND e.source_id LIKE 'decision-%'), r AS (SELECT 'actor_dossier' AS query, count(*) FILTER (k >= 2 AND y >= 2) AS a, count(*) AS b, NULL::BIGINT AS c FROM a UNION ALL SELECT 'disclosure_coverage', count(*), count(*) FILTER (id IN (SELECT id FROM fa)), NULL FROM disc UNION ALL SELECT 'decision_timeline', count(DISTINCT d), count(DISTINCT m), count(DISTINCT y) FROM tl UNION ALL SELECT 'election_money_spine', (SELECT count(DISTINCT f.y) FROM edges e JOIN f ON f.id = e.target_id AND f.y <> '' WHERE e.rel = 'DISCLOSED_IN_FILING' AND e.source_id LIKE 'moneyflow-%'), (SELECT count(*) FROM nodes WHERE node_type IN ('Person', 'Organization') AND kind = 'noisy-import'), NULL UNION ALL SELECT 'validation_queue', count(*), count(DISTINCT id), NULL FROM nodes WHERE node_type = 'Decision' UNION ALL SELECT 'legal_constraint_chain', (SELECT count(*) FROM nodes n WHERE node_type = 'Case' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.rel = 'PART_OF_CASE' AND e.target_id = n.id)), (SELECT count(*) FROM (SELECT target_id FROM edges WHERE rel = 'RELATES_TO_PROGRAM' AND source_id LIKE 'case-%' GROUP BY 1 HAVING count(DISTINCT source_id) >= 2)), (SELECT count(DISTINCT target_id) FROM edges WHERE rel = 'RELATES_TO_DECISION' AND source_id LIKE 'case-%')) SELECT query, a, b, c, CASE query WHEN 'actor_dossier' THEN a > 0 WHEN 'disclosure_coverage' THEN a > 0 AND a = b WHEN 'decision_timeline' THEN a > 100 AND b > 20 AND c > 1 WHEN 'election_money_spine' THEN a >= 2 AND b = 0 WHEN 'validation_queue' THEN a <= 20 AND b <= 10 ELSE a = 0 AND (b > 0 OR c >= 2) END AS passed FROM r"),
    "layout_centroids": "SELECT label AS cluster, CAST(d AS INTEGER) AS dim, round(avg(CAST(embedding[d + 1] AS DOUBLE)), 6) AS mean, count(*) AS members FROM embeddings, range(64) r(d) WHERE label >= 0 GROUP BY 1, 2",
    "centroid_distance": "WITH c AS (SELECT label, d, avg(CAST(embedding[d + 1] AS DOUBLE)) AS m FROM embeddings, range(64) r(d) WHERE label >= 0 GROUP BY 1, 2) SELECT vec_id, e.label AS cluster, round(sqrt(sum((CAST(embedding[d + 1] AS DOUBLE) - m) ** 2)), 6) AS distance FROM embeddings e JOIN c ON e.label = c.label GROUP BY 1, 2",
    "layout_drift": "SELECT count(*) AS nodes, round(max(abs(y / 10)) / greatest(max(x) - min(x), max(y) - min(y)), 6) AS largest, round(avg(abs(y / 10)) / greatest(max(x) - min(x), max(y) - min(y)), 6) AS mean, round(abs(avg(y / 10)) / greatest(max(x) - min(x), max(y) - min(y)), 6) AS centroid FROM (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)",
    "layout_promote": "SELECT vec_id AS id, CASE WHEN vec_id % 4 <> 0 THEN label END AS canonical, CASE WHEN vec_id % 3 <> 0 THEN label + 1 END AS previous, vec_id % 3 = 0 AND vec_id % 4 <> 0 AS entered FROM embeddings",
    "cluster_names": with_graph(f"c AS (SELECT label, d, avg(CAST(embedding[d + 1] AS DOUBLE)) AS m FROM embeddings, range(64) r(d) WHERE label >= 0 GROUP BY 1, 2), dist AS (SELECT vec_id, e.label AS cluster, round(sqrt(sum((CAST(embedding[d + 1] AS DOUBLE) - m) ** 2)), 6) AS distance FROM embeddings e JOIN c ON e.label = c.label GROUP BY 1, 2), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, vec_id) AS k FROM dist) WHERE k <= 10), mem AS (SELECT cluster, k, p.node_type AS t, p.label, l.label AS place FROM near LEFT JOIN nodes p ON p.id = 'project-' || vec_id LEFT JOIN edges e ON e.rel = 'IN_JURISDICTION' AND e.source_id = p.id LEFT JOIN nodes l ON l.id = e.target_id), w AS (SELECT cluster, k, unnest(ws) AS v, generate_subscripts(ws, 1) AS i FROM (SELECT cluster, k, list_filter(regexp_split_to_array(lower(coalesce(label, '')), '[^a-z]+'), lambda x: x <> '' AND x NOT IN {K.V.STOP_WORDS}) AS ws FROM mem)), v AS (SELECT 1 AS what, cluster, place AS v, k, 0 AS i FROM mem WHERE place <> '' UNION ALL SELECT 2, cluster, t, k, 0 FROM mem WHERE t <> '' UNION ALL SELECT 3, cluster, v, k, i FROM w), n AS (SELECT what, cluster, v, count(*) AS n, min(k * 100000 + i) AS first FROM v GROUP BY 1, 2, 3), b AS (SELECT what, cluster, v FROM n QUALIFY row_number() OVER (PARTITION BY what, cluster ORDER BY n DESC, first) = 1) SELECT m.cluster, coalesce((SELECT string_agg(v, ' · ' ORDER BY what) FROM b WHERE b.cluster = m.cluster), 'Unnamed cluster') AS name FROM (SELECT DISTINCT cluster FROM mem) m"),
}
ORACLE_SQL["search_nodes"] = _search_sql(SEARCHED, True)
ORACLE_SQL["search_entities"] = _search_sql("record-doc-7", False)
