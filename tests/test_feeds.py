"""Feeds and extractions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from polisgraph.functions import extraction as E
from polisgraph.sources import feeds


def test_court_cases_take_the_first_place_named(spark):
    registry = spark.createDataFrame([(1, "Marin County", "org-m", "place-m"), (0, "San Rafael", "org-sr", "place-sr")], "rank int, token string, org string, place string")
    rows = [("7", "1:2/3", "Rivera v. City of SAN RAFAEL and Marin County", None, "", None, "2020-01-01", None, None, "J", "/d/7"), (None, " 1:20-CV/5 x ", "", None, None, None, None, None, None, None, "")]
    got = feeds.court_cases(spark.createDataFrame(rows, feeds.CASE), registry, "https://c.org").orderBy("id").collect()
    assert [(r.id, r.case_name, r.docket_number, r.court, r.url, r.org, r.place) for r in got] == [("case-cl-1-20-cv-5-x", "Unknown", " 1:20-CV/5 x ", None, None, None, None), ("case-cl-7", "Rivera v. City of SAN RAFAEL and Marin County", "1:2/3", None, "https://c.org/d/7", "org-sr", "place-sr")]


def test_permits_are_labelled_and_parsed(spark):
    rows = [("1", "Deck", "1 A St", "", None, None, "12.5", None, None, "2025-06-20T00:00:00.000", "x", None), ("2", "", "2 B St", *[None] * 9), ("3", "Roof", *[None] * 10), ("4", *[None] * 11)]
    got = feeds.permits(spark.createDataFrame(rows, feeds.PERMIT)).orderBy("id").collect()
    assert [r.label for r in got] == ["Deck at 1 A St", "Permit at 2 B St", "Roof", "Permit 4"]
    assert (got[0].construction_value, got[0].latitude, got[0].issued_date, got[0].permit_number) == (12.5, None, "2025-06-20", None)


def test_awards_without_identity_are_left_out_and_without_id_refused(spark):
    kind = f"results array<struct<{feeds.AWARD.replace(' string', ': string').replace(' double', ': double')}>>"
    row = lambda i, rid, uei: (i, "N", rid, uei, 5.0, *[None] * 9)
    pages = spark.createDataFrame([([row("A1", "r", None), row("ASST_AGG_2", "r", "U"), row("A3", None, ""), row("A4", "", "U")],), ([],), (None,)], kind)
    assert sorted((r.award_id, r.uei, r.amount) for r in feeds.awards(pages).select("award_id", F.coalesce("uei", F.lit("-")).alias("uei"), "amount").collect()) == [("A1", "-", 5.0), ("A4", "U", 5.0)]
    with pytest.raises(Exception, match="without generated_internal_id"):
        feeds.awards(spark.createDataFrame([([row(None, "r", "U")],)], kind)).collect()


def test_memberships_keep_the_earliest_year_and_all_records(spark):
    rows = spark.createDataFrame([("m", 2021, "r2", "chair"), ("m", 2019, "r1", "member"), ("m", 2021, "r2", "chair"), ("n", 2020, "r3", "x")], "membership string, year int, record string, role string")
    assert {(r.membership, r.year, r.role, tuple(r.records)) for r in feeds.memberships(rows).collect()} == {("m", 2019, "member", ("r1", "r2")), ("n", 2020, "x", ("r3",))}


def test_urls_fall_back_to_source_and_place(spark):
    records = spark.createDataFrame([("a", "//x.org", "s", "place-p"), ("b", "ftp://x", "s", "place-p"), ("c", None, "none", "place-p"), ("d", None, None, None)], "id string, url string, source_id string, jurisdiction_id string")
    registry = spark.createDataFrame([("s", "https://s.org")], "source_id string, url string")
    places = spark.createDataFrame([("p", "https://p.org")], "key string, url string")
    assert {r.id: r.preferred_url for r in feeds.preferred_url(records, registry, places).collect()} == {"a": "https://x.org", "b": "https://s.org", "c": "https://p.org", "d": None}


def test_aliases_of_ids_in_links(spark):
    rows = spark.createDataFrame([("actor-jo", None), ("actor-jo", "Person"), ("actor-jo", "Case"), ("inst-x", "Organization"), ("agenda-item-1", "AgendaItem"), ("zzz", None)], "id string, context string")
    got = [(r.r.id, r.r.type) if r.r else None for r in rows.select(feeds.resolve_alias("id", F.col("context")).alias("r")).collect()]
    assert got == [("person-jo", "Person"), ("person-jo", "Person"), None, ("org-x", "Organization"), ("agenda-item-1", "AgendaItem"), None]
    assert rows.select(feeds.url_segment(F.lit("EconomicInterest")).alias("s")).first().s == "economic-interest"


def test_forms_of_minutes_and_agendas(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "x string").select(c).first()[0]
    minutes = {"M/s Supervisor Rice": "bos", "MOTION: It was M/S/C to": "cortemadera", "Hill moved, seconded by Mayor Lu": "sausalito", "AYES: all": "novato", None: None}
    assert all(one(E.minutes_form("x"), t) == want for t, want in minutes.items())
    agendas = {
        "CC-1. a\nAI-2. b": "tiburon",
        "CA - 1. a CA-2. b CA-3. c": "bos",
        " 3.A Approve x\n 4.B. Accept y": "civicplus",
        " G.1. Approve\n I.2. Accept": "granicus",
        "A. CALL\nB. ROLL\nC. PUBLIC": "granicus",
        "1. CALL TO\n2. ROLL CALL\n3. CLOSED SESSION": "civicplus",
        "1. Minutes\n2. Budget\n3. Parks\nPublic hearing": "fairfax",
        "nothing": None,
    }
    assert all(one(E.agenda_form("x"), t) == want for t, want in agendas.items())
    text = "RESOLUTION NO. 2026-021 and Resolution No.5; Ordinance No. 1733, ordinance 9"
    assert one(E.numbers("x", E.RESOLUTION), text) == ["2026-021", "5"] and one(E.numbers("x", E.ORDINANCE), text) == ["1733", "9"]


def test_names_of_clusters_are_checked(spark):
    rows = [("San Rafael budget", True), ("Budget", False), ("Alleged budget fraud", False), ("Parks and trees", False), (None, False), ("budget " * 8, False)]
    df = spark.createDataFrame([(i, n, ["budget", "rafael"]) for i, (n, _) in enumerate(rows)], "i int, name string, words array<string>")
    assert [r.ok for r in df.select("i", E.fit_name("name", "words").alias("ok")).orderBy("i").collect()] == [w for _, w in rows]
