"""Names and weights of the graph vocabulary."""

from __future__ import annotations

# Weight of a relationship on a path.
PATH_WEIGHT = {
    "CAST_VOTE": 1, "DECIDED_BY": 1, "PARTY_TO": 1,
    "AMENDS_AGREEMENT": 2, "DISCLOSED_IN_FILING": 2, "FROM_SOURCE": 2, "RELATES_TO_AGREEMENT": 2, "TO_TARGET": 2,
    "CANDIDATE_ACTOR": 3, "CONTROLLED_BY": 3, "CONTROLLED_BY_COMMITTEE": 3, "DISCLOSED_AS": 3, "FILED_FOR_ELECTION": 3, "FOR_ELECTION": 3, "FOR_SEAT": 3, "HELD_BY": 3,
    "INTEREST_IN": 3, "MEMBER": 3, "MEMBER_OF_ORG": 3, "RELATED_TO_ELECTION": 3, "RESULT_OF_ELECTION": 3,
    "ABOUT_AGENDA_ITEM": 4, "AT_INSTITUTION": 4, "COUNTERPARTY_ACTOR": 4, "HEARD_BY": 4, "HEARD_IN": 4, "RELATES_TO_PROGRAM": 4, "RELATES_TO_PROJECT": 4,
    "AT_MEETING": 5, "DECIDED_AT": 5, "FILED_BY": 5, "FILED_BY_COMMITTEE": 5, "FILED_BY_ORG": 5, "OFFICIAL_FILER": 5, "PART_OF_CASE": 5, "PART_OF_MEETING": 5,
}

# Relationships that are traversed, though paths do not use them.
TRAVERSED = (*PATH_WEIGHT, "FILED_DURING_SEAT_SERVICE", "FILED_FOR_SEAT", "FILED_WITH", "OPERATED_BY", "PRIMARY_FOR_ELECTION", "PRIMARY_PLACE")
UNIVERSAL_RELS = ("EVIDENCED_BY", "IN_JURISDICTION", "RELATES_TO_ISSUE")
UNIVERSAL_TYPES = ("Record", "Place", "Issue")
PATH_EXCLUDED = ("Record", "Issue", "Place", "AgendaItem")
LOOSE_PENALTY = 10

# Expansion.
EXPAND_CAP = {1: 20, 2: 80, 3: 160, 4: 240}
EXPAND_STEP = {1: 1, 2: 2, 3: 4, 4: 6}
EXPAND_QUOTA = [(("MoneyFlow", "Decision"), 4), (("Filing", "Meeting", "Person"), 3), (("Amendment", "Election", "Candidacy", "Place", "Issue"), 1)]

# Id prefix of a type.
PREFIX = {
    "Person": "person", "Organization": "org", "Committee": "committee", "Place": "place", "Project": "project", "Program": "program", "Decision": "decision", "Meeting": "meeting",
    "AgendaItem": "agenda-item", "MoneyFlow": "moneyflow", "Filing": "filing", "Record": "record", "Case": "case", "Proceeding": "proceeding", "Agreement": "agreement",
    "Amendment": "amendment", "Seat": "seat", "SeatService": "service", "Election": "election", "Candidacy": "candidacy", "Issue": "issue", "Membership": "membership", "EconomicInterest": "economicinterest",
}

# Classes in which edges are drawn; any other edge is governance.  No relationship constrains yet.
EDGE_STYLE = {
    "money": ("FROM_SOURCE", "TO_TARGET", "DISCLOSED_IN_FILING", "RELATES_TO_AGREEMENT"),
    "legal-constrains": (),
}

# What a type adds to its rank in searches; other types are not searched.
SEARCH_WEIGHT = {
    "Person": 20, "Organization": 18, "Decision": 16, "Project": 14, "Program": 14, "Case": 14, "Meeting": 10, "Filing": 10, "Committee": 10,
    "Agreement": 8, "Amendment": 6, "Election": 6, "Place": 4, "Issue": 4, "Record": 0,
}
# Types whose dates count as activity of their neighbours.
ACTIVITY_TYPES = ("Meeting", "Decision", "MoneyFlow", "Filing", "Election", "Proceeding", "Agreement", "Amendment", "Case")
# Endings of names that are left out when names are compared.
NAME_SUFFIXES = ("inc", "incorporated", "llc", "corp")
# Words that a cluster's name takes no account of.
STOP_WORDS = ("the", "a", "an", "of", "for", "and", "or", "in", "on", "at", "to", "by", "with", "from", "is", "as", "this")

# Promotion states from the weakest.
PROMOTION = ("review", "candidate", "promoted", "canonical")
