import difflib
import hashlib
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from polisgraph.functions import cleaning as K
from polisgraph.functions import provenance as P
from polisgraph.graph import Graph
from polisgraph.operators import resolve, traverse
from polisgraph.operators.reconcile import reconcile
from polisgraph.plans import checksq, cleanq, tabular, views
from polisgraph.sources import store


def graph(spark, edges):
    ids = sorted({x for e in edges for x in (e[0], e[2])})
    nodes = spark.createDataFrame([(i, None, None, None, None, None, None, None, None, i.split("-")[0].title()) for i in ids], store.NODE_SCHEMA)
    return Graph(nodes, spark.createDataFrame([(s, t, None, r) for s, r, t in edges], store.EDGE_SCHEMA))


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


def test_cleaning(spark):
    assert one(spark, K.slug("x"), "  Ärger & Co. No. 5 ") == "rger-co-no-5"
    assert one(spark, K.name_key("x"), "The Acme Co., Inc.") == "the acme co"
    assert one(spark, K.name_key("x"), "Park Foundation, LLC Corp.") == "park foundation" and one(spark, K.name_key("x"), "Inc.") == ""
    assert one(spark, K.first_last("x"), "Doe, Jane") == "Jane Doe"
    assert one(spark, K.ein("x"), "12-3456789") == "123456789"
    assert one(spark, K.ein("x"), "12-34") == "1234" and one(spark, K.ein("x"), "none") is None
    assert one(spark, K.uei("x"), "jz9-fla") == "JZ9FLA" and one(spark, K.uei("x"), "--") is None
    assert str(one(spark, K.parse_date("x"), "3/4/21")) == "2021-03-04"
    assert str(one(spark, K.parse_date("x"), "March 4, 2021")) == "2021-03-04"
    assert one(spark, K.parse_date("x"), "no date") is None
    assert one(spark, K.meeting_type("x"), "Special Joint Meeting") == "joint_meeting"
    assert one(spark, K.type_of_id("x"), "agenda-item-3") == "AgendaItem"
    assert one(spark, K.public_url("x"), "//a.org/b") == "https://a.org/b"


def test_tabular_parameters_are_checked():
    t = tabular.TEMPLATES["money_flows_by_year"]
    assert tabular.bind(t, {"year": ""})["year"] == "1998"
    for bad in ({"year'; DROP": "x"}, {"year": "x" * 500}):
        with pytest.raises(ValueError):
            tabular.bind(t, bad)


def test_interval_join_is_the_theta_join(spark):
    a = spark.createDataFrame([(i, f"2020-01-{i:02d}") for i in range(1, 29)] + [(99, None), (98, "bad")], "a int, da string")
    b = spark.createDataFrame([(i, f"2020-02-{i:02d}") for i in range(1, 29)] + [(97, None)], "b int, db string")
    got = {(r.a, r.b, r.days_delta) for r in tabular.interval_join(a, b, "da", "db", 7).collect()}
    assert got == {(i, j, i - 31 - j) for i in range(1, 29) for j in range(1, 29) if abs(i - 31 - j) <= 7}


def test_path_takes_the_lightest_and_avoids_hubs(spark):
    g = graph(spark, [("person-1", "CAST_VOTE", "decision-1"), ("decision-1", "DECIDED_BY", "org-1"), ("person-1", "FILED_BY", "record-1"), ("record-1", "FILED_BY", "org-1"), ("person-1", "FILED_BY", "org-2"), ("org-2", "FILED_BY", "org-1")])
    assert traverse.weighted_path(g, "person-1", "org-1", 2).first().asDict() == {"path": "person-1 > decision-1 > org-1", "hops": 2, "weight": 2}
    assert traverse.weighted_path(g, "org-1", "person-1", 2).first().weight == 2
    assert traverse.weighted_path(g, "person-1", "person-1").count() == 0
    assert traverse.weighted_path(g, "person-1", "record-1", 1).count() == 1


def test_components_of_a_chain_and_of_nothing(spark):
    links = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y"), ("x", "x"), (None, "z")], "a string, b string")
    got = {r.node: r.component for r in traverse.components(links).collect()}
    assert got == {f"n{i:02d}": "n00" for i in range(21)} | {"x": "x", "y": "x"}
    assert traverse.components(links.where("a = 'none'")).count() == 0


def test_similar_names_are_those_of_brute_force(spark):
    names = ["acme land trust", "acme land trusts", "acme lands trust", "friends of the park", "friends of park", "zebra", "zebras", "x", "a very long name of no one", "", "ACME Land Trust, Inc.", "Zebras LLC", "Friends-of the Park"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, k string")
    settled = spark.createDataFrame([(0, 0), (1, 0)], "id int, match int")
    got = {(r.id, r.match): r.score for r in resolve.by_similar_names(df, df, "k", settled=settled).collect()}
    plain = lambda x: re.sub("( (inc|llc|corp|incorporated))+$", "", re.sub("[^a-z0-9]+", " ", x.lower()).strip())
    ratio = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
    want = {(i, j): 0.9 if plain(a) == plain(b) else round(ratio(a, b), 2) for i, a in enumerate(names) for j, b in enumerate(names) if a and b and (plain(a) == plain(b) or ratio(a, b) >= 0.85)}
    assert got == {k: v for k, v in want.items() if k not in ((0, 0), (1, 0))}


def test_two_ueis_in_a_group_raise(spark):
    df = spark.createDataFrame([("r1", "A"), ("r1", None), (None, "B")], "recipient_id string, uei string")
    assert sorted(r.recipient for r in resolve.recipient_identity(df).collect()) == ["uei:A", "uei:A", "uei:B"]
    with pytest.raises(Exception, match="two UEIs"):
        resolve.recipient_identity(spark.createDataFrame([("r1", "A"), ("r1", "B")], "recipient_id string, uei string")).collect()


def test_reconcile(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (None, 1.0), (1.0, None), (0.5, 1.0)], "m double, r double")
    got = [(r.status, r.direction, r.confidence) for r in reconcile(df, "m", "r").collect()]
    assert got == [("reconciled", "equal", "high"), ("source_inconsistency", "measured_gt_reference", "high"), ("needs_review", None, "medium"), ("needs_review", None, "medium"), ("extraction_gap", "reference_gt_measured", "high")]
    cents = spark.createDataFrame([(1.004, 1.0), (1.02, 1.01)], "m double, r double")
    assert [r.status for r in reconcile(cents, "m", "r").collect()] == ["reconciled", "source_inconsistency"]


def test_store_round_trip_and_difference(spark, tmp_path):
    g = graph(spark, [("person-1", "CAST_VOTE", "decision-1"), ("person-1", "CAST_VOTE", "decision-1")])
    store.save_graph(g, f"{tmp_path}/g")
    back = store.load_graph(spark, f"{tmp_path}/g")
    assert store.multiset_difference(g.edges.select("source_id", "rel"), back.edges.select("source_id", "rel")).count() == 0
    store.write_jsonl(g.nodes.select("id"), f"{tmp_path}/j")
    assert store.read_jsonl(spark, f"{tmp_path}/j", "id string").count() == 2


def test_bundles_lines_tables_and_ledgers(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text('{"id": "a",\n "n": [1, 2]}')
    assert [(r.id, r.n) for r in store.read_bundle(spark, f"{tmp_path}/b", "id string, n array<int>").collect()] == [("a", [1, 2])]
    df = spark.createDataFrame([("é", None, 'say "a, b"\nc')], "z string, a string, q string").coalesce(1)
    store.write_jsonl(df, f"{tmp_path}/named")
    store.write_jsonl(df, f"{tmp_path}/ordered", in_order=True)
    read = lambda d: next((tmp_path / d).glob("part-*")).read_text().strip()
    assert read("named").startswith('{"a":null,"q":') and read("ordered").startswith('{"z":"é","a":null,')
    store.write_csv(df, f"{tmp_path}/csv")
    assert read("csv") == 'z,a,q\né,,"say ""a, b""\nc"'
    store.stamp(spark, f"{tmp_path}/stamp", {"at": "2024-01-01"})
    store.stamp(spark, f"{tmp_path}/stamp", {"at": "2024-01-02"})
    assert [r.at for r in spark.read.json(f"{tmp_path}/stamp").collect()] == ["2024-01-02"]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "f.txt").write_bytes(b"a\nb\n\xff")
    found = store.ledger(spark, f"{tmp_path}/l")
    row = found.first()
    assert (row.sha256, row.bytes, row.lines) == (hashlib.sha256(b"a\nb\n\xff").hexdigest(), 5, 2)
    stated = [(row.path, row.sha256, 5, None), (row.path, "0", 5, 2), (row.path, row.sha256, 6, 2), (row.path, row.sha256, 5, 3), ("gone", "0", 1, None)]
    checked = store.validate_ledger(found, spark.createDataFrame(stated, "path string, sha256 string, bytes long, lines long"))
    assert sorted(str(r.problem) for r in checked.collect()) == ["None", "bytes", "lines", "missing", "sha256"]
    store.export_baseline(df, f"{tmp_path}/base")
    with pytest.raises(Exception, match="(?i)exist"):
        store.export_baseline(df, f"{tmp_path}/base")
    rows = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    assert store.baseline_digest(rows).collect() == store.baseline_digest(rows.orderBy(F.desc("a")).repartition(3)).collect() != store.baseline_digest(rows.where("a > 0")).collect()


def test_edges_overlay_properties(spark):
    kind = "source_id string, rel string, target_id string, properties map<string,string>"
    old = spark.createDataFrame([("a", "R", "b", {"x": "1", "y": "2"}), ("a", "R", "c", None)], kind)
    new = spark.createDataFrame([("a", "R", "b", {"y": "3"}), ("d", "R", "b", {"z": "4"})], kind)
    assert {(r.source_id, r.target_id): r.properties for r in store.upsert_edges(old, new).collect()} == {("a", "b"): {"x": "1", "y": "3"}, ("a", "c"): {}, ("d", "b"): {"z": "4"}}


def test_citations_and_years(spark):
    rows = [({"record_ids": '["r"]'}, True), ({"record_ids": "[]"}, False), ({"minutes_url": '" "'}, False), ({"fppc_id": '"7"'}, True), ({"source_url": '"u"'}, False), ({"source_url": '"u"', "source_id": "3"}, True), ({}, False)]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(rows)], "i int, properties map<string,string>")
    assert [r.c for r in df.select("i", P.is_cited().alias("c")).orderBy("i").collect()] == [w for _, w in rows]
    years = spark.createDataFrame([({"signed_at": '"2020-01-02"', "meeting_date": '"soon"'},), ({"started_at": '"19"'},), ({"election_date": '"2018"', "signed_at": '"2020"'},)], "properties map<string,string>")
    assert [r.y for r in years.select(P.node_year().alias("y")).collect()] == [2020, None, 2018]


def test_a_small_table_has_rows_at_both_ends_and_first_occurrences_win(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a")], "k int, g string")
    assert sorted((r.position, r.k) for r in checksq.ends(df, ["k"], 2, 2).collect()) == [(-2, 2), (-1, 3), (1, 1), (2, 2)]
    assert sorted((r.g, r.k) for r in checksq.first_occurrences(df, ["g"], ["k"]).collect()) == [("a", 2), ("b", 1)]


def test_browse_seeks_past_the_cursor(spark):
    g = graph(spark, [(f"person-{i}", "CAST_VOTE", "decision-1") for i in range(5)])
    assert [r.id for r in cleanq.browse_page(g, "Person", "person-1", 2).collect()] == ["person-2", "person-3"]


def test_expand_grows_with_hops(spark):
    g = graph(spark, [("person-1", "CAST_VOTE", "decision-1"), ("decision-1", "DECIDED_BY", "org-1"), ("org-1", "AT_INSTITUTION", "seat-1")])
    seen = [{r.id for r in traverse.expand(g, "person-1", h).collect()} for h in (1, 2, 3)]
    assert seen == [{"decision-1"}, {"decision-1", "org-1"}, {"decision-1", "org-1", "seat-1"}]
    with pytest.raises(ValueError):
        traverse.expand(g, "person-1", 5)


def with_values(spark, nodes, edges):
    """A graph of ``(id, type, kind, amount, day, ref)`` nodes."""
    schema = "id string, node_type string, kind string, amount decimal(18,2), event_date string, ref_id string, label string, status string, ended_date string, url string"
    return Graph(spark.createDataFrame([(*n[:3], n[3] if n[3] is None else Decimal(n[3]), *n[4:], None, None, None, None) for n in nodes], schema), spark.createDataFrame([(s, t, None, r) for s, r, t in edges], store.EDGE_SCHEMA))


def test_programs_and_elections_bring_a_place_its_decisions_and_threads(spark):
    nodes = [("decision-1", "Decision", None, None, None, None), ("decision-2", "Decision", None, None, None, None), ("program-1", "Program", None, None, None, None), ("program-2", "Program", None, None, None, None), ("project-1", "Project", None, None, None, None)]
    nodes += [("election-1", "Election", "general_municipal", None, None, None), ("election-2", "Election", "primary", None, None, None), ("election-3", "Election", "general_municipal", None, None, None)]
    nodes += [(f"moneyflow-{k}", "MoneyFlow", "contribution", k, None, None) for k in (5, 7, 9)]
    edges = [("program-1", "IN_JURISDICTION", "place-1"), ("program-1", "RELATES_TO_DECISION", "decision-1"), ("program-2", "IN_JURISDICTION", "place-2"), ("program-2", "RELATES_TO_DECISION", "decision-2"), ("project-1", "IN_JURISDICTION", "place-1")]
    edges += [("moneyflow-5", "RELATES_TO_DECISION", "decision-1"), ("moneyflow-7", "RELATED_TO_ELECTION", "election-1"), ("moneyflow-9", "RELATED_TO_ELECTION", "election-2"), ("moneyflow-5", "FROM_SOURCE", "org-1"), ("case-1", "RELATES_TO_DECISION", "decision-1")]
    edges += [(f"election-{k}", "IN_JURISDICTION", "place-1") for k in (1, 2, 3)]
    g = with_values(spark, nodes, edges)
    assert [r.decision for r in views.decisions_in_scope(g, "place-1").collect()] == ["decision-1"]
    assert [(r.decision, r.total_amount) for r in views.decision_money_rollup(g, "place-1").collect()] == [("decision-1", 5)]
    assert [(r.decision, r.party) for r in views.counterparties(g, "place-1").collect()] == [("decision-1", "org-1")]
    assert [(r.case, r.by_decision) for r in views.legal_scope(g, "place-1").collect()] == [("case-1", 1)]
    ranked = sorted(tuple(r) for r in views.pressure_comparison(g).where("place = 'place-1'").collect())
    assert ranked == [("place-1", 1, "election-1", 1, 0, 7), ("place-1", 2, "program-1", 1, 1, 5), ("place-1", 3, "project-1", 0, 0, 0)]
    assert [(r.thread, r.lead) for r in views.pressure_explanation(g).where("place = 'place-1'").collect()] == [("election-1", 2)]


def test_money_around_decisions_takes_every_dated_flow(spark):
    nodes = [("decision-1", "Decision", None, None, "2020-03-01", "org-san-rafael-council"), ("decision-san-rafael-2", "Decision", None, None, "2020-05-01", None), ("decision-3", "Decision", None, None, "2020-03-01", "org-x"), ("decision-san-rafael-4", "Decision", None, None, "", None)]
    nodes += [("moneyflow-a", "MoneyFlow", "behest", None, "2020-03-05", None), ("moneyflow-b", "MoneyFlow", "expenditure", 1, "2020-03-31", None), ("moneyflow-c", "MoneyFlow", "contribution", -4, "2020-04-01", None), ("moneyflow-d", "MoneyFlow", None, 90000, None, None), ("moneyflow-e", "MoneyFlow", None, 90000, "soon", None)]
    got = tabular.query(with_values(spark, nodes, []), "money_around_decisions", jurisdiction="san-rafael").collect()
    assert [(r.decision_id, r.flow_id, r.days_delta) for r in got] == [("decision-1", "moneyflow-a", -4), ("decision-san-rafael-2", "moneyflow-c", 30), ("decision-1", "moneyflow-b", -30)]
