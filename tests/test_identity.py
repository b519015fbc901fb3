"""Dual roles against a plain version of the lanes, and what is refused."""

import json
import random
from decimal import Decimal

import pytest

from polisgraph.operators import identity

EDGES = "source_id string, rel string, target_id string"


def made(seed):
    r = random.Random(seed)
    orgs = [f"org-{k:02d}" for k in range(30)]
    filings = [(f"f{k}", 2000 + k % 5, r.choice([None, -3, 0, 10, 25])) for k in range(12)]
    awards = [(f"w{k}", Decimal(r.randint(-50, 99)), "scope", "2020-01-01", "award") for k in range(14)]
    campaign = [(f"c{k}", r.choice([None, Decimal(r.randint(-9, 99))]), "s", f"20{10 + k % 9}-01-01", r.choice("xyz")) for k in range(18)]
    edges = [(f[0], "FILED_BY_ORG", r.choice(orgs)) for f in filings] + [(w[0], "TO_TARGET", r.choice([*orgs, "person-1"])) for w in awards]
    edges += [(x[0], "EVIDENCED_BY", f"record-{r.randint(0, 9)}") for x in (*filings, *awards)] * 2
    campaign_edges = [(r.choice([*orgs, "person-1"]), "FROM_SOURCE", c[0]) for c in campaign] + [(c[0], "EVIDENCED_BY", f"record-{r.randint(5, 15)}") for c in campaign]
    pair = lambda: tuple(r.sample(orgs, 2))
    same = [(*pair(), r.choice(identity.KEY_BASES)) for _ in range(3)]
    approved = [(*pair(), "approved") for _ in range(3)] * 2
    queued = [(*pair(), r.choice(["queued", "queued", "rejected"])) for _ in range(10)]
    return orgs, filings, awards, campaign, edges, campaign_edges, same, approved, queued


def frames(spark, x):
    orgs, filings, awards, campaign, edges, campaign_edges, same, approved, queued = x
    flow = "id string, amount decimal(18,2), scope string, flow_date string, flow_type string"
    o = spark.createDataFrame([(i, None if i.endswith("5") else f"Name {i}") for i in orgs], "id string, label string")
    f = spark.createDataFrame(filings, "id string, tax_year int, gov_grants_amount int")
    parts = identity.legs(f, spark.createDataFrame(awards, flow), spark.createDataFrame(campaign, flow), o, spark.createDataFrame(edges, EDGES), spark.createDataFrame(campaign_edges, EDGES))
    links = identity.links(spark.createDataFrame(same, "a string, b string, basis string"), spark.createDataFrame(approved, "a string, b string, status string"), o)
    return parts, links, spark.createDataFrame(queued, "a string, b string, status string"), o


def plain(x):
    orgs, filings, awards, campaign, edges, campaign_edges, same, approved, queued = x
    at = {i: row for rows in (filings, awards, campaign) for i, *row in rows}
    funded, gives = {}, {}
    for s, rel, t in edges:
        if rel == "FILED_BY_ORG" and (at[s][1] or 0) > 0 or rel == "TO_TARGET" and t in orgs:
            funded.setdefault(t, []).append(s)
    for s, rel, t in campaign_edges:
        if rel == "FROM_SOURCE" and s in orgs:
            gives.setdefault(s, []).append(t)
    links = sorted({(a, b, f"same_as:{k}") for a, b, k in same} | {(a, b, "approved_resolution") for a, b, _ in approved})
    pairs = sorted({(a, b) for a, b, s in queued if s == "queued"})

    def groups(nodes, joined):
        out = [{n} for n in nodes]
        for a, b in joined:
            both = [g for g in out if a in g or b in g]
            out = [g for g in out if g not in both] + [set().union({a, b}, *both)]
        return out

    both = [g for g in groups({*funded, *gives}, [x[:2] for x in links]) if g & set(funded) and g & set(gives)]
    of = {n: min(m for m in g if m in gives) for g in both for n in g}
    evidence = {}
    for s, rel, t in [*edges, *campaign_edges]:
        if rel == "EVIDENCED_BY":
            evidence.setdefault(s, set()).add(t)
    rows = {}
    for g in both:
        subject = min(m for m in g if m in gives)
        out = [c for m in g for c in gives.get(m, [])]
        money_in = [c for m in g for c in funded.get(m, [])]
        grants, paid = [c for c in money_in if c[0] == "f"], [c for c in money_in if c[0] == "w"]
        rows[subject] = {
            "status": "candidate",
            "flow_count": len(out),
            "amount_total": float(sum(at[c][0] or 0 for c in out)),
            "grants": (len(grants), sum(at[c][1] for c in grants)),
            "awards": (len(paid), float(sum(at[c][0] for c in paid))),
            "joined": sorted([(a, b, k) for a, b, k in links if a in g] + [(m, m, "id_exact") for m in g if m in funded and m in gives]),
            "depends": [p for p in pairs if of.get(p[0]) == subject or of.get(p[1]) == subject],
            "evidence": sorted(set().union(*(evidence.get(c, set()) for c in [*out, *money_in]))),
        }
    order = sorted(rows, key=lambda s: (-rows[s]["amount_total"], s))
    free = [p for p in pairs if p[0] not in of and p[1] not in of]
    rest = groups({*funded, *gives} - set(of), [x[:2] for x in links if x[0] not in of and x[1] not in of] + free)
    held = {min(m for m in g if m in gives): [p for p in free if p[0] in g] for g in rest if g & set(funded) and g & set(gives)}
    count = (len(both), sum(1 for g in rest if g & set(funded) and not g & set(gives)), sum(1 for g in rest if g & set(gives) and not g & set(funded)), len(held))
    return rows, order, held, count


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_table_is_the_plain_one(spark, seed):
    x = made(seed)
    rows, order, held, count = plain(x)
    found = identity.dual_roles(*frames(spark, x))
    got = {r["subject"]: json.loads(r["document"]) for r in identity.documents(found).collect()}
    assert set(got) == {*rows, *held} and rows
    for subject, want in rows.items():
        d = got[subject]
        assert (d["status"], d["rank"], d["flow_count"], float(d["amount_total"])) == ("candidate", order.index(subject) + 1, want["flow_count"], want["amount_total"])
        assert (d.get("grant_count") or 0, d.get("grant_total") or 0) == want["grants"]
        assert (d.get("award_count") or 0, float(d.get("award_total") or 0)) == want["awards"]
        assert [(j["a"], j["b"], j["basis"]) for j in d.get("joined_via") or []] == want["joined"]
        assert [(j["a"], j["b"]) for j in d.get("dependency_refs") or []] == want["depends"]
        assert (d.get("evidence_record_ids") or []) == want["evidence"]
        assert d["label"] == (subject if subject.endswith("5") else f"Name {subject}")
    for subject, pairs in held.items():
        assert got[subject]["status"] == "withheld_pending_resolution" and "rank" not in got[subject]
        assert [(j["a"], j["b"]) for j in got[subject]["dependency_refs"]] == pairs
    assert tuple(found.coverage.select("candidate_rows", "funding_in_only", "influence_out_only", "withheld_pending_resolution").first()) == count


def test_what_is_refused(spark):
    orgs = spark.createDataFrame([("o1", "x"), ("o2", "y")], "id string, label string")
    same = lambda *rows: spark.createDataFrame(rows, "a string, b string, basis string")
    approved = lambda *rows: spark.createDataFrame(rows, "a string, b string, status string")
    for s, a, why in (
        (same(("o1", "o2", "name")), approved(), "trusted key"),
        (same(("o1", "o2", None)), approved(), "trusted key"),
        (same(), approved(("o1", "o2", "queued")), "not an approved"),
        (same(), approved(("o1", "gone", "approved")), "stale approval"),
    ):
        with pytest.raises(ValueError, match=why):
            identity.links(s, a, orgs)


def test_mixed_scopes_raise(spark):
    x = list(made(1))
    x[2] = [("w0", Decimal(1), "one", "d", "t"), ("w1", Decimal(1), "two", "d", "t")]
    x[4] = [("w0", "TO_TARGET", "org-01"), ("w1", "TO_TARGET", "org-01")]
    x[5] = [("org-01", "FROM_SOURCE", "c0")]
    x[6] = x[7] = x[8] = []
    with pytest.raises(Exception, match="mixed scopes"):
        identity.dual_roles(*frames(spark, x)).table.collect()


def test_ranks_over_many_parts(spark):
    rows = [(k % 50, f"n{k:04d}") for k in range(500)]
    from pyspark.sql import functions as F

    found = identity.ranked(spark.createDataFrame(rows, "v int, n string"), [F.desc("v"), F.asc("n")]).collect()
    assert [(r["v"], r["n"]) for r in sorted(found, key=lambda r: r["rank"])] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r["rank"] for r in found) == list(range(1, 501))
