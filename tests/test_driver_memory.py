"""Joins whose sides grow with the input send none of them through the driver."""

import re

import pytest

import __spark_entry__ as entry
from polisgraph.plans import bundleq, checksq

QUERIES = bundleq.QUERIES | checksq.QUERIES


@pytest.mark.parametrize("name", ["projected_nodes", "projected_edges", "migrated_nodes", "migrated_edges", "aliased_edges", "citations", "node_summaries"])
def test_projection_broadcasts_nothing(spark, name, monkeypatch):
    plans = []

    def stored(s, d, table, make):
        plans.append(make())
        return plans[-1]

    monkeypatch.setattr(bundleq, "stored", stored)
    plans.append(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not [p for p in plans if "Broadcast" in p._jdf.queryExecution().executedPlan().toString()]


@pytest.mark.parametrize("name", ["view_money_explanation", "view_decision_counterparties", "decision_money_rollup", "view_pressure_comparison"])
def test_no_view_broadcasts_flows(spark, name):
    lines = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [x for x in lines[k + 1 :]]
            below = below[: next((j for j, x in enumerate(below) if depth(x) <= depth(line)), len(below))]
            assert not [x for x in below if re.search(r"FileScan parquet \[[^]]*amount#", x)]


def test_projection_deals_each_property_out_once(spark, monkeypatch):
    plans = []

    def stored(s, d, table, make):
        plans.append(make())
        return plans[-1]

    monkeypatch.setattr(bundleq, "stored", stored)
    checksq.QUERIES["citations"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1  # the nodes; no edges are made for them
    assert plans[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hash") <= 2
