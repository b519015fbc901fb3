"""Pages of entities look up the few ids that are near: edges and nodes are not sorted for them."""

from polisgraph.operators import entity
from polisgraph.sources.fixtures import fixture_graph

SF = "/root/testdata/sf0.001"


def test_a_page_sorts_no_nodes_for_a_join(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        page = entity.page(fixture_graph(spark, SF), "person-3", "Person")
        assert "SortMergeJoin" not in page._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
