"""Votes and agenda items of hand-made texts, form by form, and over tables."""

import pytest

from polisgraph.functions import minutes
from polisgraph.functions.extraction import agenda_form, minutes_form

TOWN = """H. CONSENT
COUNCIL ACTION ON MAIN MOTION: Motion made by Vice Mayor O’Neil-Ray and seconded
by Councilmember Abbot, the City Council voted 2-1-1 via roll call to
adopt Resolution No. 2026-021
as amended.
AYES: O’NEIL-RAY, Abbot
NOES: CHO
RECUSED: DUNN
Motion carried.
COUNCIL MOTION: Upon motion by Mayor Cho there was no
second and the motion failed.

COUNCIL ACTION: Upon motion by Cho and seconded by Dunn the City Council voted 0-4 via roll call
continue it.
AYES: none
ABSENT: ABBOT,
"""
HILL = """MOTION: It was M/S/C (Bell/D'Arcy) to approve
 both  plans
ROLL CALL VOTE: 4-1 (Khan opposed) in favor
MOTION: It was M/S/C (Khan/Bell) to adjourn
ROLL CALL VOTE: 5-0 in favor
"""
BAY = """Councilmember Fox moved, seconded by Mayor Gray, and carried 4-1 (Hale dissenting), to open
the pier.

Vice Mayor Hale moved, seconded by Councilmember Fox, and unanimously carried, to close it.

Mayor Gray moved, seconded by Vice Mayor Hale, and carried 3-2."""
COUNTY = "M/s Supervisor Ito - Supervisor Jones to accept the gift. AYES: ALL\nM/s Supervisor Jones - Supervisor Ito to wait. AYES: Ito\n"
SPECIAL = "Motion to rename the road moved by Supervisor Kim and seconded by Supervisor Lane.\nVotes:\nAYES: KIM, LANE\nNOES: MOE\nMotion failed."


def vote(mover, seconder=None, tally=None, motion="", ayes=(), noes=(), recused=(), absent=(), outcome="carried"):
    return minutes.Vote(mover, seconder, tally, motion, list(ayes), list(noes), list(recused), list(absent), outcome)


CASES = {
    "novato": (TOWN, [
        vote("O'NEIL-RAY", "ABBOT", "2-1-1", "adopt Resolution No. 2026-021 as amended.", ["O'NEIL-RAY", "ABBOT"], ["CHO"], ["DUNN"]),
        vote("CHO", motion=minutes.UNSECONDED, outcome="failed"),
        vote("CHO", "DUNN", "0-4", "continue it.", absent=["ABBOT"], outcome="unknown"),
    ]),
    "cortemadera": (HILL, [vote("Bell", "D'Arcy", "4-1", "approve both plans", noes=["KHAN"]), vote("Khan", "Bell", "5-0", "adjourn")]),
    "sausalito": (BAY, [vote("Fox", "Gray", "4-1", "open the pier", noes=["HALE"]), vote("Hale", "Fox", None, "close it"), vote("Gray", "Hale", "3-2", "")]),
    "bos": (COUNTY, [vote("Ito", "Jones", motion="accept the gift", ayes=["ALL"]), vote("Jones", "Ito", motion="wait", ayes=["ITO"])]),
}


@pytest.mark.parametrize("form", CASES)
def test_votes_of_a_form(form):
    text, want = CASES[form]
    assert minutes.votes_of(text, form) == want
    assert minutes.votes_of("", form) == []


def test_special_session_and_blocks():
    assert minutes.votes_of(SPECIAL, "bos") == [vote("Kim", "Lane", motion="rename the road", ayes=["KIM", "LANE"], noes=["MOE"], outcome="failed")]
    late = "COUNCIL ACTION: Upon motion by A and seconded by B, the City Council voted 1-0 via roll call to do\nAYES: A\n" + "\n" * 45 + "Motion carried.\n"
    assert minutes.votes_of(late, "novato")[0].outcome == "unknown"  # forty lines on


def entry(section, name, number=None, title=None):
    return minutes.Entry(section, name, number, title)


AGENDA_CASES = {
    "granicus": ("G. CONSENT CALENDAR\n  G.1.  Approve it\n  G.12.  Accept\nZ. LATE\n  Q.1.  Lost\nG. AGAIN\n", [entry("G", "CONSENT CALENDAR"), entry("Z", "LATE"), entry("G", "CONSENT CALENDAR", "1", "Approve it"), entry("G", "CONSENT CALENDAR", "12", "Accept"), entry("Q", "", "1", "Lost")]),
    "civicplus": ("4. CONSENT CALENDAR\n  4.A  Approve it\n  4.B.  Accept\n", [entry("4", "CONSENT CALENDAR"), entry("4", "CONSENT CALENDAR", "A", "Approve it"), entry("4", "CONSENT CALENDAR", "B", "Accept")]),
    "bos": ("x\nConsent Agenda B\nCA - 1. Parks\nCA-2. Roads\nPublic Hearing\nRequest to hear\nRequest  more\n", [entry("CO", "Consent Agenda B"), entry("PU", "Public Hearing"), entry("CA", "Consent Agenda", "1", "Parks"), entry("CA", "Consent Agenda", "2", "Roads"), entry("PH", "Public Hearing", "1", "to hear"), entry("PH", "Public Hearing", "2", "more")]),
    "fairfax": ("1. Call to Order\n2. First thing\nCONSENT CALENDAR\n3. Approve it\n4. lower\nApproval of minutes\n5. Old\nConsent calendar\n6. More\n", [entry("GE", "General", "2", "First thing"), entry("CO", "Consent Calendar"), entry("CO", "Consent Calendar", "3", "Approve it"), entry("PR", "Procedural"), entry("PR", "Procedural", "5", "Old"), entry("CO", "Consent Calendar", "6", "More")]),
    "tiburon": ("CC-1.\n\n Approve it\nCC-2. Accept\nPH-1.\nAI-7.\n\n\n\n\ntoo far\n", [entry("CC", "Consent Calendar"), entry("CC", "Consent Calendar", "1", "Approve it"), entry("CC", "Consent Calendar", "2", "Accept"), entry("PH", "Public Hearings"), entry("PH", "Public Hearings", "1", ""), entry("AI", "Action Items"), entry("AI", "Action Items", "7", "")]),
}


@pytest.mark.parametrize("form", AGENDA_CASES)
def test_entries_of_a_form(form):
    text, want = AGENDA_CASES[form]
    assert minutes.entries_of(text, form) == want
    assert minutes.entries_of(" \n", form) == []


def test_coded_agenda_without_codes():
    found = minutes.entries_of("Consent Calendar\n1. Approve it\n2. Email us to attend\nAction Items\n3. Act\n", "tiburon")
    assert found == [entry("CO", "Consent Calendar"), entry("CO", "Consent Calendar", "1", "Approve it"), entry("AC", "Action Items"), entry("AC", "Action Items", "3", "Act")]


def test_tables_of_texts(spark):
    rows = [(k, text) for k, (text, _) in enumerate(CASES.values())] + [(90, None), (91, "")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, form string")
    assert {r["id"]: r["f"] for r in table.select("id", minutes_form("text").alias("f")).collect()} == {0: "novato", 1: "cortemadera", 2: "sausalito", 3: "bos", 90: None, 91: "novato"}
    found = minutes.votes(table).collect()
    for k, (form, (_, want)) in enumerate(CASES.items()):
        mine = sorted((r for r in found if r["id"] == k), key=lambda r: r["at"])
        assert [r["form"] for r in mine] == [form] * len(want) and [minutes.Vote(*r[3:]) for r in mine] == want
    assert len(found) == sum(len(w) for _, w in CASES.values())
    assert minutes.votes(table.where("false")).collect() == []


def test_agendas_tell_their_form(spark):
    agendas = spark.createDataFrame([("a", "G. CONSENT\n  G.1.  One\n  G.2.  Two\n"), ("b", "CC-1. One\nCC-2. Two\n"), ("c", "none"), ("d", None)], "id string, text string")
    assert {r["id"]: r["f"] for r in agendas.select("id", agenda_form("text").alias("f")).collect()} == {"a": "granicus", "b": "tiburon", "c": None, "d": None}
    assert sorted((r["id"], r["number"] or "") for r in minutes.agenda_rows(agendas).collect()) == [("a", ""), ("a", "1"), ("a", "2"), ("b", ""), ("b", "1"), ("b", "2")]
