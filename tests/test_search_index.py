"""The index moves each posting once, and ranks need not follow links to what is long past."""

import itertools

import pytest
from pyspark.sql import functions as F

from polisgraph.functions import cleaning as K
from polisgraph.graph import Graph
from polisgraph.operators import search
from polisgraph.plans import cleanq

NODES = "id string, node_type string, kind string, event_date string"


def graph(spark):
    """Every mix of late, early and no dates of a filing or decision and of its neighbours."""
    nodes, edges = [], []
    days = {"late": "2025-06-01", "early": "1995-01-01", "edge": "2023-01-02", "none": None, "blank": ""}
    for k, (own, near, far) in enumerate(itertools.product(days, days, (*days, None))):
        for kind, t in (("filing", "Filing"), ("decision", "Decision"), ("org", "Organization")):
            nodes.append((f"{kind}-{k}", t, "x", days[own] if kind == "filing" else days[own] if own != "late" else None))
        nodes.append((f"moneyflow-{k:016x}", "MoneyFlow", "x", days[near] if near != "late" else "1999-12-31"))
        nodes.append((f"meeting-{k}", "Meeting", "x", days.get(far)))
        edges += [(f"moneyflow-{k:016x}", r, f"{kind}-{k}", None) for r, kind in (("A", "filing"), ("B", "decision"), ("C", "org"))]
        edges += [(f"{kind}-{k}", "D", f"meeting-{k}", None) for kind in ("filing", "decision", "org") if far]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "source_id string, rel string, target_id string, detail string"))


def test_ranks_are_the_same_without_links_to_what_is_long_past(spark):
    g = graph(spark)
    rank = lambda df: {(r[0], r[1]) for r in df.select("id", K.search_rank("node_type", "degree", "last_activity", cleanq.AS_OF)).collect()}
    assert rank(cleanq.activity(g, cleanq.RANKED_SINCE)) == rank(cleanq.activity(g))


def test_activity_shuffles_no_links_of_nodes_that_are_not_searched(spark):
    plan = cleanq.activity(graph(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" in plan
    found = {r["id"]: r for r in cleanq.activity(graph(spark)).collect()}
    assert not [i for i in found if i.startswith("moneyflow")] and found["org-0"]["degree"] == 2


def test_packed_names_tell_ids_apart(spark):
    ids = ["moneyflow-" + "0" * 16, "moneyflow-" + "0" * 15 + "1", "moneyflow-" + "f" * 16, "person-1", "org-1", "moneyflow-" + "F" * 16, "moneyflow-1", ""]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select(cleanq.packed("id").alias("p"))
    assert rows.distinct().count() == len(ids)
    assert rows.agg(F.max(F.length("p"))).first()[0] == 26  # the one in capitals stays as it is


def test_index_counts_words_without_moving_them_for_it(spark, tmp_path, monkeypatch):
    rows = [("a-1", "Place", "x Y x", 1, None), ("a-2", "Place", None, 1, None), ("b-1", "Record", "y", 1, "2020-01-01")]
    nodes = spark.createDataFrame(rows, "id string, node_type string, text string, rank int, captured string")
    moved = []
    agg = type(nodes.groupBy("id")).agg
    monkeypatch.setattr(type(nodes.groupBy("id")), "agg", lambda self, *a: moved.append(a) or agg(self, *a))
    index = search.build_index(nodes, str(tmp_path / "index"))
    assert len(moved) == 1  # the totals
    got = {(r.term, r.id, r.node_type, r.n, r.tf) for r in index.postings.collect()}
    assert got == {("x", "a-1", "Place", 3, 2), ("y", "a-1", "Place", 3, 1), ("y", "b-1", "Record", 1, 1)}
    assert [tuple(r) for r in index.totals.collect()] == [(2, pytest.approx(2.0))]
