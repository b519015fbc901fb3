"""What a query of the graph reads and writes, and traversals that stop where nothing can be added."""

from pyspark.sql import functions as F

from polisgraph.graph import Graph
from polisgraph.operators import traverse
from polisgraph.sources.fixtures import StoredGraph

BASE = "/root/testdata/sf0.001"


def test_a_relationship_stores_itself_only_and_unsorted(spark):
    g = StoredGraph(spark, BASE)
    assert g.rel("DECIDED_AT", "AT_MEETING", source="a", target="b").count() > 0
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(g._path).select("path")
    assert {r[0].split(g._path)[-1].split("/part-")[0] for r in files.collect()} == {"/edges/rel=DECIDED_AT"}


def test_a_step_from_few_nodes_shuffles_no_edges(spark):
    edges = spark.range(1000).select(F.concat(F.lit("person-"), "id").alias("u"), F.concat(F.lit("org-"), "id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = traverse.among(edges, spark.createDataFrame([("person-3",)], "u string"), 1, "u")
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in found.collect()] == [("person-3", "org-3")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_full_types_take_nothing_of_the_last_hop(spark):
    """Thirteen organisations at one hop fill their quota of two at hop 1; others of two hops stay as they are."""
    links = [("person-0", "CAST_VOTE", "decision-0")] + [("decision-0", "DECIDED_BY", f"org-{k}") for k in range(30)] + [("person-0", "PARTY_TO", f"org-{k}") for k in range(40, 53)]
    edges = spark.createDataFrame([(*x, None) for x in links], "source_id string, rel string, target_id string, detail string")
    ids = sorted({x for a, _, b in links for x in (a, b)})
    kind = {"person": "Person", "org": "Organization", "decision": "Decision"}
    nodes = spark.createDataFrame([(x, kind[x.split("-")[0]], x, None) for x in ids], "id string, node_type string, label string, event_date string")
    rows = [tuple(r) for r in traverse.expand(Graph(nodes, edges), "person-0", 2).collect()]
    wanted = sorted(f"org-{k}" for k in range(40, 53))[: 2 * 2]
    assert sorted(r[0] for r in rows) == sorted(["decision-0", *wanted])
    assert {r[3] for r in rows} == {1}
