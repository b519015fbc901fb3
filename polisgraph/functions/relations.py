"""Which relationship a reference field of a bundle's object stands for."""

from __future__ import annotations

# Id prefixes of bundles and the types that they tell.
BUNDLE_PREFIX = {
    "agreement-": "Agreement", "actor-": "Actor", "agencyresponse-": "AgencyResponse", "agenda-item-": "AgendaItem", "amendment-": "Amendment", "case-": "Case",
    "casepart-": "CaseParticipation", "claim-": "Claim", "committee-": "Committee", "decision-": "Decision", "doc-": "Record", "eid-": "EconomicInterestDisclosure",
    "election-": "Election", "filing-": "Filing", "finding-": "Finding", "inst-": "Institution", "issue-": "Issue", "lead-": "Lead", "meeting-": "Meeting", "mention-": "Mention",
    "moneyflow-": "MoneyFlow", "oversightreport-": "OversightReport", "place-": "Place", "project-": "Project", "program-": "Program", "proceeding-": "Proceeding",
    "record-": "Record", "recommendation-": "Recommendation", "reliefrequest-": "ReliefRequest", "seat-": "Seat", "seatservice-": "SeatService", "validationcheck-": "ValidationCheck",
}

# The relationship of a field, by the type of the object that has it.
FIELD_RELATION = {
    "Agreement": {"institution_id": "RELATES_TO_INSTITUTION", "counterparty_actor_id": "COUNTERPARTY_ACTOR", "program_id": "RELATES_TO_PROGRAM", "project_id": "RELATES_TO_PROJECT", "evidence_record_ids": "EVIDENCED_BY"},
    "Amendment": {"agreement_id": "AMENDS_AGREEMENT", "project_id": "RELATES_TO_PROJECT", "evidence_record_ids": "EVIDENCED_BY"},
    "Seat": {"institution_id": "BELONGS_TO_INSTITUTION"},
    "SeatService": {"actor_id": "HELD_BY_ACTOR", "seat_id": "FOR_SEAT", "election_id": "RESULT_OF_ELECTION", "institution_id": "SERVES_IN_INSTITUTION"},
    "Election": {"jurisdiction_id": "IN_JURISDICTION", "seat_id": "FOR_SEAT", "related_canonical_election_ids": "RELATED_TO_ELECTION"},
    "EconomicInterestDisclosure": {"filer_actor_id": "FILED_BY_ACTOR", "filing_institution_id": "FILED_WITH_INSTITUTION", "seat_id": "FILED_FOR_SEAT", "seat_service_id": "FILED_DURING_SEAT_SERVICE", "filing_id": "DISCLOSED_IN_FILING"},
    "Meeting": {"institution_id": "HELD_BY_INSTITUTION"},
    "AgendaItem": {"meeting_id": "PART_OF_MEETING", "place_ids": "RELATES_TO_PLACE"},
    "Decision": {"institution_id": "DECIDED_BY_INSTITUTION", "meeting_id": "DECIDED_AT_MEETING", "agenda_item_id": "ABOUT_AGENDA_ITEM", "election_id": "RELATES_TO_ELECTION", "project_id": "RELATES_TO_PROJECT", "record_ids": "EVIDENCED_BY", "related_decision_id": "RELATES_TO_DECISION", "related_decision_ids": "RELATES_TO_DECISION"},
    "Record": {"meeting_id": "RELATES_TO_MEETING", "agenda_item_id": "RELATES_TO_AGENDA_ITEM", "case_id": "RELATES_TO_CASE", "case_ids": "RELATES_TO_CASE", "related_case_ids": "RELATES_TO_CASE", "decision_ids": "RELATES_TO_DECISION", "related_decision_ids": "RELATES_TO_DECISION", "related_moneyflow_ids": "RELATES_TO_MONEY_FLOW", "election_ids": "RELATES_TO_ELECTION", "committee_ids": "RELATES_TO_COMMITTEE", "candidate_actor_ids": "RELATES_TO_ACTOR", "target_actor_ids": "RELATES_TO_ACTOR", "seat_ids": "RELATES_TO_SEAT", "actor_ids": "RELATES_TO_ACTOR", "place_ids": "RELATES_TO_PLACE", "source_record_id": "DERIVED_FROM_RECORD"},
    "Committee": {"controlling_actor_id": "CONTROLLED_BY_ACTOR", "actor_candidate_id": "COMMITTEE_ACTOR", "primary_election_id": "PRIMARY_FOR_ELECTION", "jurisdiction_place_id": "IN_JURISDICTION"},
    "Filing": {"committee_id": "FILED_BY_COMMITTEE", "committee_actor_id": "FILED_BY_ACTOR", "filer_actor_id": "FILED_BY_ACTOR", "election_id": "FILED_FOR_ELECTION", "record_id": "EVIDENCED_BY", "official_actor_id": "OFFICIAL_FILER", "official_seat_id": "FILED_FOR_SEAT", "official_seat_service_id": "FILED_DURING_SEAT_SERVICE", "filing_institution_id": "FILED_WITH_INSTITUTION", "filing_officer_institution_id": "FILED_WITH_OFFICER", "target_actor_id": "TARGETS_ACTOR", "target_seat_id": "TARGETS_SEAT"},
    "Candidacy": {"candidate_actor_id": "CANDIDATE_ACTOR", "committee_id": "CONTROLLED_BY_COMMITTEE", "election_id": "FOR_ELECTION", "seat_id": "FOR_SEAT"},
    "MoneyFlow": {"from_actor_id": "FROM_SOURCE", "to_actor_id": "TO_TARGET", "to_committee_id": "TO_TARGET", "filing_id": "DISCLOSED_IN_FILING", "requested_by_actor_id": "REQUESTED_BY_ACTOR", "requested_by_seat_id": "REQUESTED_BY_SEAT", "requested_by_seat_service_id": "REQUESTED_BY_SEAT_SERVICE", "related_institution_id": "RELATES_TO_INSTITUTION", "related_decision_id": "RELATES_TO_DECISION", "project_id": "RELATES_TO_PROJECT"},
    "Project": {"primary_place_id": "PRIMARY_PLACE", "jurisdiction_place_id": "IN_JURISDICTION", "record_ids": "EVIDENCED_BY", "related_decision_ids": "RELATES_TO_DECISION", "related_program_ids": "RELATES_TO_PROGRAM"},
    "Program": {"institution_id": "OPERATED_BY_INSTITUTION", "jurisdiction_place_id": "IN_JURISDICTION", "record_ids": "EVIDENCED_BY", "related_case_ids": "RELATES_TO_CASE", "related_decision_ids": "RELATES_TO_DECISION", "place_ids": "RELATES_TO_PLACE"},
    "Case": {"court_institution_id": "HEARD_IN_COURT", "record_ids": "EVIDENCED_BY", "issue_ids": "RELATES_TO_ISSUE", "place_ids": "RELATES_TO_PLACE", "related_decision_ids": "RELATES_TO_DECISION", "related_program_ids": "RELATES_TO_PROGRAM"},
    "Proceeding": {"case_id": "PART_OF_CASE", "judge_actor_id": "HEARD_BY_JUDGE", "evidence_record_ids": "EVIDENCED_BY"},
    "CaseParticipation": {"case_id": "PART_OF_CASE", "actor_id": "INVOLVES_ACTOR", "institution_id": "INVOLVES_INSTITUTION", "evidence_record_ids": "EVIDENCED_BY"},
    "ValidationCheck": {"subject_node_id": "VALIDATES", "derived_from_record_id": "DERIVED_FROM_RECORD"},
}

# The relationship of a field of any other type, and of a record's field by the type that it names.
ANY_RELATION = {
    "committee_id": "RELATES_TO_COMMITTEE", "meeting_id": "RELATES_TO_MEETING", "agenda_item_id": "RELATES_TO_AGENDA_ITEM",
    "decision_id": "RELATES_TO_DECISION", "decision_ids": "RELATES_TO_DECISION", "related_decision_id": "RELATES_TO_DECISION", "place_id": "RELATES_TO_PLACE", "place_ids": "RELATES_TO_PLACE",
    "actor_id": "RELATES_TO_ACTOR", "actor_ids": "RELATES_TO_ACTOR", "candidate_actor_ids": "RELATES_TO_ACTOR", "target_actor_ids": "RELATES_TO_ACTOR",
    "seat_id": "RELATES_TO_SEAT", "seat_ids": "RELATES_TO_SEAT", "target_seat_id": "RELATES_TO_SEAT",
    "election_id": "RELATES_TO_ELECTION", "election_ids": "RELATES_TO_ELECTION", "related_canonical_election_ids": "RELATES_TO_ELECTION",
}
RECORD_RELATION = {"record_id": "EVIDENCED_BY", "record_ids": "EVIDENCED_BY", "evidence_record_ids": "EVIDENCED_BY", "source_record_id": "DERIVED_FROM_RECORD"}
#: A field that names nodes although its name does not end in _id or _ids.
OTHER_REFERENCES = ("co_recipient",)

# Settled names of relationships, types of actors and institutions, and labels of organisations.
SETTLED_RELATION = {
    "CAST_VOTE_ON": "CAST_VOTE", "HELD_BY_ACTOR": "HELD_BY", "CONTROLLED_BY_ACTOR": "CONTROLLED_BY", "FILED_BY_ACTOR": "FILED_BY", "DECIDED_BY_INSTITUTION": "DECIDED_BY",
    "DECIDED_AT_MEETING": "AT_MEETING", "HELD_BY_INSTITUTION": "AT_INSTITUTION", "BELONGS_TO_INSTITUTION": "AT_INSTITUTION", "SERVES_IN_INSTITUTION": "AT_INSTITUTION",
    "FILED_WITH_INSTITUTION": "FILED_WITH", "FILED_WITH_OFFICER": "FILED_WITH", "OPERATED_BY_INSTITUTION": "OPERATED_BY", "HEARD_IN_COURT": "HEARD_IN", "HEARD_BY_JUDGE": "HEARD_BY",
    "INVOLVES_ACTOR": "PARTY_TO", "INVOLVES_INSTITUTION": "PARTY_TO", "RELATES_TO_VALIDATIONCHECK": "VALIDATES", "COMMITTEE_ACTOR": "CONTROLLED_BY",
}
ORGANISED_ACTOR = {"business": "Business", "nonprofit": "Nonprofit", "organization": "Nonprofit", "political_committee": "Political", "government_agency": "Government", "institutional_actor": None}
GOVERNMENT_INSTITUTION = ("city_government", "council", "county_government", "municipality", "filing_officer", "state_agency", "state_ethics_agency")
