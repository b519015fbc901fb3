"""Fact rows and figures: alternatives, lists, periods, amounts, blanks, and types that are not told."""

from polisgraph.functions import facts


def test_rows_of_each_kind_of_value(spark):
    rows = [
        ("a", "Organization", {"name": '"Works"', "labels": '["Organization","Business"]', "website": '""'}),
        ("b", "Membership", {"started_at": '"2020"', "source_basis": "true", "role": "[1]"}),
        ("c", "Filing", {"period_start": '"1"', "period_end": '"2"', "filer_name": '"F"', "filed_by_name": "null"}),
        ("d", "Committee", {"total_money_in": '"1234567.5"', "elections_count": "0", "fppc_id": "12"}),
        ("e", "Committee", {"total_money_in": "0"}),
        ("f", "Unknown", None),
        ("g", "Person", {"service_start_date": '"2019"', "aliases": "[]"}),
    ]
    nodes = spark.createDataFrame(rows, "id string, node_type string, properties map<string,string>")

    def read(df, i):
        return [(r["key"], r["value"]) for r in sorted(df.where(f"id = '{i}'").collect(), key=lambda r: r["position"])]

    told, shown = facts.facts(nodes), facts.figures(nodes)
    assert read(told, "a") == [("Name", "Works"), ("Subtype", "Organization, Business"), ("Jurisdiction", None), ("Website", None), ("ID", "a")]
    assert read(told, "b") == [("Person", None), ("Organization", None), ("Role", None), ("Period", "2020"), ("Source", "true"), ("ID", "b")]
    assert read(told, "c")[2:] == [("Period", "1 – 2"), ("Filer", "F"), ("ID", "c")]
    assert read(told, "f") == [("ID", "f")] and read(shown, "f") == []
    assert read(shown, "d") == [("fppc id", "12"), ("candidate", "—"), ("elections", "0"), ("money in", "$1,234,568")]
    assert read(shown, "e")[3] == ("money in", "—")
    assert read(shown, "g") == [("current seat", "—"), ("service", "2019"), ("filings", "—")] and read(told, "g")[3] == ("Aliases", None)
