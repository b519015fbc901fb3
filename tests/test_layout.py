"""Layout history, dual roles and names taken out of names."""

import itertools
import math
import random
from decimal import Decimal

import numpy as np
import pytest

from polisgraph.functions.extraction import candidate_name
from polisgraph.graph import Graph
from polisgraph.operators import layout, money

POINTS = [(k, math.cos(k) * k, math.sin(2 * k) + k / 7) for k in range(1, 120)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double")


@pytest.mark.parametrize(("mirror", "scale", "turn", "tx", "ty"), [(False, 1.0, 0.0, 0.0, 0.0), (False, 2.0, 0.7, 3.0, -1.0), (True, 0.5, -2.0, 0.0, 4.0)])
def test_fit_recovers_the_map(spark, mirror, scale, turn, tx, ty):
    a, b = scale * math.cos(turn), scale * math.sin(turn)
    flip = [(k, x, -y if mirror else y) for k, x, y in POINTS]
    old = frame(spark, [(k, a * x - b * y + tx, b * x + a * y + ty) for k, x, y in flip])
    new = frame(spark, POINTS)
    fit = layout.similarity_fit(old, new)
    row = fit.first()
    assert (row.anchors, row.mirror) == (len(POINTS), mirror)
    assert [row.scale, row.rotation, row.tx, row.ty] == pytest.approx([scale, turn, tx, ty], abs=1e-9)
    assert row.error == pytest.approx(0, abs=1e-9)
    moved = {r.id: (r.x, r.y) for r in layout.similarity_apply(new, fit).collect()}
    assert all(moved[r.id] == pytest.approx((r.x, r.y), abs=1e-9) for r in old.collect())


def test_fit_refuses_few_anchors_and_bears_one_point(spark):
    with pytest.raises(Exception, match="too few anchors"):
        layout.similarity_fit(frame(spark, POINTS[:5]), frame(spark, POINTS)).collect()
    same = frame(spark, [(k, 1.0, 1.0) for k in range(5)])
    assert layout.similarity_fit(frame(spark, POINTS[:4]), same, least=2).first().scale == 1.0


def clusters(spark, groups):
    return spark.createDataFrame([(i, c) for c, ids in groups.items() for i in ids], "id long, cluster long")


@pytest.mark.parametrize(
    ("prior", "new", "want"),
    [
        ({0: range(5), 1: range(5, 10)}, {7: range(5), 8: range(5, 10)}, {(7, 0, False), (8, 1, False)}),
        ({0: range(5)}, {0: range(5), 1: range(50, 55)}, {(0, 0, False), (1, 1, True)}),
        ({0: range(9)}, {3: range(6), 4: range(6, 9)}, {(3, 0, False), (4, 1, True)}),
        ({0: range(6), 1: range(6, 10)}, {5: range(10)}, {(5, 0, True)}),
        ({0: range(10)}, {3: range(4), 4: range(4, 7), 5: range(7, 10)}, {(3, 0, True), (4, 1, True), (5, 2, True)}),
        ({}, {4: range(3), 6: range(3, 5)}, {(4, 0, True), (6, 1, True)}),
        ({0: range(3)}, {}, set()),
    ],
)
def test_cluster_ids_stay(spark, prior, new, want):
    found = layout.stable_ids(clusters(spark, prior), clusters(spark, new)).collect()
    assert {tuple(r) for r in found} == want
    assert len(found) == len(want)


@pytest.mark.parametrize("seed", range(30))
def test_pairs_are_the_heaviest_of_all(seed):
    r = np.random.default_rng(seed)
    weights = r.integers(0, 9, (r.integers(1, 6), r.integers(1, 6)))
    wide = weights if weights.shape[0] <= weights.shape[1] else weights.T
    most = max(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
    pairs = layout.heaviest_pairs(weights)
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) == min(weights.shape)
    assert sum(weights[i, j] for i, j in pairs) == most


def test_ids_follow_the_heaviest_pairs(spark):
    """Where the best pairs overall differ from each cluster's own best, and on clusters drawn at random."""
    r = random.Random(4)
    prior = {10: range(10), 11: range(10, 16), 12: range(20, 29), 13: range(40, 44)}
    new = {0: [*range(6), *range(10, 16)], 1: range(6, 10), 2: range(20, 26), 3: [26, 27, 28, 60], 4: range(40, 44), 5: range(70, 75)}
    for _ in range(2):
        found = {c: (s, again) for c, s, again in layout.stable_ids(clusters(spark, prior), clusters(spark, new)).collect()}
        assert found == plain_ids(prior, new)
        prior = {c: [] for c in range(7, 13)}
        new = {c: [] for c in range(6)}
        for k in range(400):
            c = r.randrange(6)
            prior[7 + c].append(k)
            new[c if r.random() < 0.8 else r.randrange(6)].append(k)


def plain_ids(prior, new):
    sets = lambda groups: {c: set(ids) for c, ids in groups.items()}
    prior, new = sets(prior), sets(new)
    order, old = sorted(new), sorted(prior)

    def best(k, taken):
        """The largest overlap of the clusters from the k-th on, and their partners."""
        if k == len(order):
            return 0, ()
        total, rest = best(k + 1, taken)
        found = (total, (None, *rest))
        for p in old:
            if p not in taken:
                total, rest = best(k + 1, taken | {p})
                found = max(found, (total + len(new[order[k]] & prior[p]), (p, *rest)), key=lambda x: x[0])
        return found

    out, used = {}, set()
    for c, p in zip(order, best(0, frozenset())[1], strict=True):
        if p is not None and 2 * len(new[c] & prior[p]) >= len(new[c] | prior[p]):
            out[c] = p
            used.add(p)
    named, fresh = set(), max(prior) + 1
    for c in sorted(new):
        if c not in out:
            over = max(sorted(prior), key=lambda p: len(new[c] & prior[p]))
            if new[c] & prior[over] and over not in used:
                out[c] = over
                used.add(over)
            else:
                out[c], fresh = fresh, fresh + 1
            named.add(c)
    named |= {c for c in new if sum(bool(new[c] & p) for p in prior.values()) > 1}
    return {c: (out[c], c in named) for c in new}


def test_dual_roles_need_both_legs(spark):
    node = "id string, node_type string, label string, kind string, amount decimal(18,2), event_date string"
    flow = lambda k, kind, amount, day: (f"moneyflow-{k}", "MoneyFlow", None, kind, None if amount is None else Decimal(amount), day)
    nodes = spark.createDataFrame([flow(1, "a", None, "2020-01-02"), flow(2, "b", 5, "2019-01-01"), flow(3, "a", 7, None), flow(4, "a", 9, "2021-01-01")], node)
    edges = [("moneyflow-1", "FROM_SOURCE", "org-1"), ("moneyflow-2", "FROM_SOURCE", "org-2"), ("moneyflow-2", "FROM_SOURCE", "org-2"), ("moneyflow-3", "TO_TARGET", "person-1"), ("moneyflow-4", "FROM_SOURCE", "org-9")]
    g = Graph(nodes, spark.createDataFrame([(*e, None) for e in edges], "source_id string, rel string, target_id string, detail string"))
    same = spark.createDataFrame([("org-1", "org-2"), ("org-2", "person-1")], "a string, b string")
    rows = money.dual_roles(g, same).collect()
    assert [(r.subject, r.flow_count, float(r.amount_out), r.first_day, r.last_day, r.flow_types, r.funding_count, float(r.amount_in)) for r in rows] == [("org-1", 2, 5.0, "2019-01-01", "2020-01-02", "a|b", 1, 7.0)]


def test_candidate_names(spark):
    cases = {
        "Friends of Jane  Smith for Council 2024": "Jane Smith",
        "Committee to Re-Elect Ann Lee District 3": "Ann Lee",
        "committee to elect Ann Lee 2020": "Ann Lee",
        "Ann Lee for Supervisor 2022": "Ann Lee",
        "Ann Lee for Supervisor": None,
        "Lee & Doe for Council 2020": None,
        "Friends of Ward 4 for Parks": None,
        "Stay Green for All 2020": None,
        "No on B for 2020": None,
        "": None,
    }
    rows = spark.createDataFrame([(c,) for c in [*cases, None]], "c string").select("c", candidate_name("c").alias("n")).collect()
    assert {r.c: r.n for r in rows} == {**cases, None: None}
