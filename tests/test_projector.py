"""Bundles to a graph, and the graph to its settled types, against values worked out by hand."""

import json

import pytest

from polisgraph.operators import migrate, projector

SCHEMA = "seq long, bundle string, section string, node_type string, promotion string, obj string"


def objects(spark, *rows):
    return spark.createDataFrame([(i, b, s, t, p, json.dumps(o)) for i, (b, s, t, p, o) in enumerate(rows)], SCHEMA)


def made(spark):
    return objects(
        spark,
        ("b1", "decisions", "Decision", "candidate", {"id": "decision-1", "title": " Budget ", "status": "adopted", "meeting_id": "meeting-1", "record_ids": ["record-1", "record-2", 7], "institution_id": "inst-council", "other_id": "thing-9", "n": 3, "note": None, "parts": [], "deep": {"a": 1}, "evidence": [{"document_id": "doc-5", "page": 4, "box": {"x": 1}}, {"record_id": ""}], "votes": [{"actor_id": "actor-jane", "vote": "yes", "why": "x"}, {"actor_id": "org-1", "vote": "no"}]}),
        ("b2", "decisions", "Decision", "promoted", {"id": "decision-1", "name": "The budget", "n": 4, "record_ids": ["record-2", "record-3"], "page": 2}),
        ("b3", "decisions", "Decision", "review", {"id": "decision-1", "n": 5, "page": 3, "status": "late"}),
        ("b1", "actors", "Actor", "canonical", {"id": "actor-jane-doe", "name": "Jane Doe", "actor_type": "person", "observed_labels": ["J. Doe"], "resolves_raw_actor_seed_ids": ["actor-jane", "x"], "employer_id": "actor-acme"}),
        ("b1", "actors", "Actor", "canonical", {"id": "actor-acme", "name": "Acme", "actor_type": "business"}),
        ("b1", "institutions", "Institution", "canonical", {"id": "inst-council", "name": "Council", "institution_type": "council"}),
        ("b1", "eids", "EconomicInterestDisclosure", "canonical", {"id": "eid-1", "filer_actor_id": "actor-jane-doe", "disclosure_type": "annual"}),
        ("b1", "parts", "CaseParticipation", "canonical", {"id": "casepart-1", "actor_id": "actor-acme", "case_id": "case-1", "role": "plaintiff", "evidence_record_ids": ["record-9"], "record_id": "record-8"}),
    )


def test_section_filters_name_the_first_that_fails(spark):
    df = projector.section_filter(made(spark), {"decisions": {"status": ["adopted"], "n": ["3"]}, "parts": {"role": []}})
    assert [r.reason for r in df.orderBy("seq").collect()] == [None, "filter:status", "filter:status", None, None, None, None, "filter:role"]


def test_nodes_keep_scalars_and_lists_of_scalars(spark):
    rows = {r.seq: r for r in projector.project_nodes(made(spark)).collect()}
    first = rows[0]
    assert (first.id, first.label, first.rank, first.status) == ("decision-1", "Budget", 2, "adopted")
    assert json.loads(first.properties["record_ids"]) == ["record-1", "record-2", 7] and first.properties["n"] == "3" and first.properties["title"] == '" Budget "'
    assert not {"note", "parts", "deep", "evidence", "votes", "id"} & set(first.properties)
    assert json.loads(json.loads(first.properties["payload_json"]))["deep"] == {"a": 1}


def test_edges_of_references_evidence_and_votes(spark):
    got = {(r.source_id, r.rel, r.target_id, r.field): dict(r.properties) for r in projector.project_edges(made(spark)).where("seq = 0").collect()}
    assert got == {
        ("decision-1", "DECIDED_AT_MEETING", "meeting-1", "meeting_id"): {},
        ("decision-1", "EVIDENCED_BY", "record-1", "record_ids"): {},
        ("decision-1", "EVIDENCED_BY", "record-2", "record_ids"): {},
        ("decision-1", "DECIDED_BY_INSTITUTION", "inst-council", "institution_id"): {},
        ("decision-1", "EVIDENCED_BY", "doc-5", "evidence"): {"page": "4"},
        ("actor-jane", "CAST_VOTE_ON", "decision-1", "votes"): {"vote": '"yes"'},
    }
    rel = spark.createDataFrame([(0, "b", json.dumps({"source_record_id": "record-1", "target_case_id": "case-2", "target_other_id": "zzz", "relationship_type": "cites", "page": 3}))], "seq long, bundle string, obj string")
    assert [(r.source_id, r.rel, r.target_id, r.target_type, r.properties["page"]) for r in projector.passthrough_edges(rel).collect()] == [("record-1", "CITES", "case-2", "Case", "3")]


def test_aliases_move_the_ends_of_actors_only(spark):
    nodes = projector.project_nodes(made(spark))
    out = projector.remap_aliases(projector.project_edges(made(spark)), projector.alias_map(nodes))
    votes = out.where("rel = 'CAST_VOTE_ON'").collect()
    assert [(r.source_id, r.remapped) for r in votes] == [("actor-jane-doe", True)]
    assert {(r.source_id, r.target_id) for r in out.where("remapped").collect()} == {("actor-jane-doe", "decision-1"), ("actor-jane-doe", "actor-jane-doe")}  # and the reference that names the alias


def test_merge_by_rank_and_order(spark):
    got = {r.id: r for r in projector.merge_nodes(projector.project_nodes(made(spark))).collect()}["decision-1"]
    assert (got.label, got.promotion, got.bundles, got.status) == ("The budget", "promoted", ["b1", "b2", "b3"], "adopted")
    p = got.properties
    assert p["n"] == "4" and json.loads(p["record_ids"]) == ["record-1", "record-2", 7, "record-3"] and p["title"] == '" Budget "'
    assert json.loads(p["pages"]) == [2, 3] and "page" not in p
    assert got.conflicts == ["n", "n", "status"] and json.loads(json.loads(p["payload_json"]))["name"] == "The budget"
    clash = objects(spark, ("b", "s", "Case", "review", {"id": "case-1"}), ("b", "s", "Record", "review", {"id": "case-1"}))
    with pytest.raises(Exception, match="node type collision for case-1"):
        projector.merge_nodes(projector.project_nodes(clash)).collect()
    edges = projector.merge_edges(projector.project_edges(made(spark))).where("target_id = 'record-2'").collect()
    assert [(r.bundles, r.fields) for r in edges] == [(["b1", "b2"], ["record_ids"])]


def test_migration_settles_ids_types_and_relationships(spark):
    nodes = projector.merge_nodes(projector.project_nodes(made(spark)))
    edges = projector.merge_edges(projector.project_edges(made(spark)))
    ids = migrate.id_map(nodes)
    assert {(r.old, r.new) for r in ids.collect()} == {("actor-jane-doe", "person-jane-doe"), ("actor-acme", "org-acme"), ("inst-council", "org-council"), ("eid-1", "filing-1")}
    got = {r.id: r for r in migrate.migrate_nodes(nodes, ids).collect()}
    assert set(got) == {"decision-1", "person-jane-doe", "org-acme", "org-council", "filing-1"}
    assert got["org-acme"].labels == ["Organization", "Business"] and got["org-council"].labels == ["Organization", "Government"] and got["person-jane-doe"].labels == ["Person"]
    jane = got["person-jane-doe"].properties
    assert json.loads(jane["aliases"]) == ["J. Doe"] and "actor_type" not in jane and jane["employer_id"] == '"org-acme"' and "actor-acme" in jane["payload_json"]
    filing = got["filing-1"].properties
    assert (filing["filing_type"], filing["filed_by"], filing["disclosure_subtype"]) == ('"form_700"', '"person-jane-doe"', '"annual"')
    assert got["decision-1"].properties["institution_id"] == '"org-council"' and json.loads(got["decision-1"].properties["record_ids"]) == ["record-1", "record-2", 7, "record-3"]
    moved = {(r.source_id, r.source_type, r.rel, r.target_id, r.target_type) for r in migrate.migrate_edges(edges, ids).collect()}
    assert ("decision-1", "Decision", "DECIDED_BY", "org-council", "Organization") in moved and ("filing-1", "Filing", "FILED_BY", "person-jane-doe", "Person") in moved
    assert ("decision-1", "Decision", "AT_MEETING", "meeting-1", "Meeting") in moved and not any("casepart" in e[0] for e in moved)
    party = migrate.participations(nodes, edges, ids).collect()
    assert [(r.id, r.source_id, r.source_type, r.target_id, r.role, r.start_date, r.evidence) for r in party] == [("edge-org-acme-party_to-case-1", "org-acme", "Organization", "case-1", "plaintiff", None, ["record-9", "record-8"])]


def test_payloads_of_one_id_must_agree(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2")], "id string, payload string")
    assert {(r.id, r.payload) for r in projector.load_once(rows).collect()} == {("a", "1"), ("b", "2")}
    with pytest.raises(Exception, match="differing payloads of a"):
        projector.load_once(rows.union(spark.createDataFrame([("a", "3")], "id string, payload string"))).collect()
