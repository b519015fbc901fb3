"""Parties that take public money and give political money, told to be one by three lanes of identity.

Lane A: one party carries both legs itself.  Lane B: a SAME_AS edge whose basis is a deterministic key.  Lane C: an approved
resolution.  Lanes B and C link parties; a connected group that holds both legs is a candidate.  Queued resolutions never
join: a queued pair that touches candidates is noted as what they depend on, and the others regroup the parties outside of all
candidates, where a group with both legs is withheld until the pair is decided.

Everything stays in rows: totals per group, and long tables of links, dependencies and evidence, so no group's flows meet
in one task; ``documents`` nests them for those who want one document per subject.

Inputs: ``filings (id, tax_year, gov_grants_amount)``, ``flows (id, amount, scope, flow_date, flow_type)``, ``orgs (id, label)``,
``edges (source_id, rel, target_id)``, ``same (a, b, basis)``, ``approved`` and ``queued (a, b, status)``, where ``a`` is the party that
is funded.  Repeated links, pairs and edges count once; amounts may be negative; a null amount counts as none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgraph.operators.neighbours import staged
from polisgraph.operators.traverse import components

#: Keys that are trusted to name one party.
KEY_BASES = ("ein_exact", "uei_exact")
CANDIDATE, WITHHELD = "candidate", "withheld_pending_resolution"


@dataclass
class Legs:
    """Money in by filings and awards, money out, each with the party ``org``; and the records that evidence them."""

    grants: DataFrame
    awards: DataFrame
    out: DataFrame
    evidence: DataFrame


def legs(filings: DataFrame, awards: DataFrame, campaign: DataFrame, orgs: DataFrame, edges: DataFrame, campaign_edges: DataFrame) -> Legs:
    """Directions are exact: awards are those paid to an organisation, campaign flows those that it is the source of.

    A filing counts with positive government grants only.  ``FROM_SOURCE`` runs from the source to the flow.
    """
    known = orgs.select(F.col("id").alias("org"))

    def ends(of: DataFrame, rel: str, item: str, org: str) -> DataFrame:
        return of.where(F.col("rel") == rel).select(F.col(item).alias("id"), F.col(org).alias("org")).distinct()

    grants = ends(edges, "FILED_BY_ORG", "source_id", "target_id").join(filings.where("gov_grants_amount > 0"), "id")
    paid = ends(edges, "TO_TARGET", "source_id", "target_id").join(known, "org", "left_semi").join(awards, "id")
    out = ends(campaign_edges, "FROM_SOURCE", "target_id", "source_id").join(known, "org", "left_semi").join(campaign, "id")
    records = lambda of: of.where("rel = 'EVIDENCED_BY'").select(F.col("source_id").alias("id"), F.col("target_id").alias("record"))
    proof = [leg.select("org", "id").join(records(e), "id").select("org", F.lit(name).alias("leg"), "record") for name, leg, e in (("grants", grants, edges), ("awards", paid, edges), ("out", out, campaign_edges))]
    return Legs(grants, paid, out, proof[0].unionByName(proof[1]).unionByName(proof[2]).distinct())


def links(same: DataFrame, approved: DataFrame, orgs: DataFrame) -> DataFrame:
    """``(a, b, basis)`` of lanes B and C.

    A SAME_AS basis that is no trusted key, an approved row with another status, and an approval of a party that is no longer
    there all raise an error.
    """
    same, approved = same.select("a", "b", "basis").distinct(), approved.select("a", "b", "status").distinct()
    known = orgs.select("id").distinct()

    def refuse(rows: DataFrame, reason: str) -> None:
        bad = rows.limit(1).collect()
        if bad:
            raise ValueError(f"{reason}: {bad[0].asDict()}")

    refuse(same.where(~F.coalesce(F.col("basis").isin(*KEY_BASES), F.lit(False))), "SAME_AS without a trusted key")
    refuse(approved.where("status is null or status <> 'approved'"), "not an approved resolution")
    for end in "ab":
        refuse(approved.join(known, F.col(end) == F.col("id"), "left_anti"), "stale approval")
    key = same.select("a", "b", F.concat(F.lit("same_as:"), "basis").alias("basis"))
    return key.unionByName(approved.select("a", "b", F.lit("approved_resolution").alias("basis")))


def _grouped(parties: DataFrame, joined: DataFrame) -> DataFrame:
    """``(org, funded, gives, component)`` over parties with legs and ends of links."""
    ends = joined.select(F.explode(F.array("a", "b")).alias("org")).distinct()
    every = parties.join(ends, "org", "full")
    group = components(joined.select("a", "b"))
    found = every.join(group, F.col("org") == F.col("node"), "left")
    return found.select("org", F.coalesce("funded", F.lit(False)).alias("funded"), F.coalesce("gives", F.lit(False)).alias("gives"), F.coalesce("component", "org").alias("component"))


def _sides(members: DataFrame) -> DataFrame:
    return members.groupBy("component").agg(F.bool_or("funded").alias("funded"), F.bool_or("gives").alias("gives"), F.min(F.when(F.col("gives"), F.col("org"))).alias("subject"))


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``df`` with its place from 1 in the whole order, counted range by range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Within a part, rows have the numbers that follow the part's own.
    held = staged(part.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranked")
    starts = {r["_part"]: (r["first"], r["n"]) for r in held.groupBy("_part").agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect()}  # a row per part
    base, rows = 0, []
    for p in sorted(starts):
        rows.append((p, base - starts[p][0] + 1))
        base += starts[p][1]
    shift = df.sparkSession.createDataFrame(rows, "_part int, _shift long")
    return held.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


@dataclass
class DualRoles:
    """``table``: candidates by rank and withheld groups; ``joined``, ``dependencies`` and ``evidence`` by subject; ``coverage``: one row."""

    table: DataFrame
    joined: DataFrame
    dependencies: DataFrame
    evidence: DataFrame
    coverage: DataFrame


def dual_roles(parts: Legs, joined: DataFrame, queued: DataFrame, orgs: DataFrame) -> DualRoles:
    """Candidates with the totals of each lane of money apart, withheld groups, and the counts of all groups."""
    paid = parts.grants.select("org").unionByName(parts.awards.select("org")).distinct().withColumn("funded", F.lit(True))
    gives = parts.out.select("org").distinct().withColumn("gives", F.lit(True))
    parties = staged(paid.join(gives, "org", "full"), "parties")
    joined = staged(joined, "links")
    members = staged(_grouped(parties, joined), "members")
    groups = _sides(members).where("funded and gives")
    inside = staged(members.join(groups.select("component", "subject"), "component"), "inside")

    pairs = staged(queued.where("status = 'queued'").select("a", "b").distinct(), "queued")
    at = inside.select("org", "subject")
    touched = pairs.join(at.withColumnsRenamed({"org": "a", "subject": "sa"}), "a", "left").join(at.withColumnsRenamed({"org": "b", "subject": "sb"}), "b", "left")
    touched = staged(touched.select("a", "b", F.array_compact(F.array_distinct(F.array("sa", "sb"))).alias("subjects")), "touched")
    open_pairs = touched.where("size(subjects) = 0").select("a", "b")
    noted = touched.select(F.explode("subjects").alias("subject"), "a", "b")

    outside = parties.join(at.select("org"), "org", "left_anti")
    free = joined.join(at.select(F.col("org").alias("a")), "a", "left_anti").join(at.select(F.col("org").alias("b")), "b", "left_anti")
    again = staged(_grouped(outside, free.select("a", "b").unionByName(open_pairs)), "regrouped")
    others = staged(_sides(again), "other-groups")
    held = again.join(others.where("funded and gives").select("component", "subject"), "component").select("org", "subject")
    waits = open_pairs.join(held.withColumnRenamed("org", "a"), "a").select("subject", "a", "b")

    member = inside.select("org", "subject")
    totals = {
        "grants": parts.grants.join(member, "org").groupBy("subject").agg(F.count("*").alias("grant_count"), F.sum("gov_grants_amount").alias("grant_total")),
        "awards": parts.awards.join(member, "org").groupBy("subject").agg(F.count("*").alias("award_count"), F.sum("amount").alias("award_total"), F.min("scope").alias("scope"), F.max("scope").alias("other_scope")),
        "out": parts.out.join(member, "org").groupBy("subject").agg(F.count("*").alias("flow_count"), F.sum("amount").alias("amount_total"), F.min("flow_date").alias("first_flow_date"), F.max("flow_date").alias("last_flow_date"), F.array_join(F.array_sort(F.collect_set("flow_type")), "|").alias("flow_types")),
    }
    rows = totals["out"].join(totals["grants"], "subject", "left").join(totals["awards"], "subject", "left")
    mixed = F.when(F.col("scope") != F.col("other_scope"), F.raise_error(F.concat(F.lit("mixed scopes of awards: "), "subject")).cast("string"))
    rows = rows.withColumn("scope", F.coalesce(mixed, F.col("scope"))).drop("other_scope").withColumn("amount_total", F.coalesce("amount_total", F.lit(0)))
    rows = ranked(rows, [F.desc("amount_total"), F.asc("subject")])
    table = rows.withColumn("status", F.lit(CANDIDATE)).unionByName(others.where("funded and gives").select("subject", F.lit(WITHHELD).alias("status")), allowMissingColumns=True)
    label = orgs.groupBy(F.col("id").alias("subject")).agg(F.first("label", ignorenulls=True).alias("label"))
    table = table.join(label, "subject", "left").withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "subject"))

    through = joined.join(member.withColumnRenamed("org", "a"), "a").select("subject", "a", "b", "basis")
    own = inside.where("funded and gives").select("subject", F.col("org").alias("a"), F.col("org").alias("b"), F.lit("id_exact").alias("basis"))
    proof = parts.evidence.join(member, "org").select("subject", "leg", "record").distinct()
    count = lambda c: F.count_if(c)
    coverage = others.agg(count(F.expr("funded and not gives")).alias("funding_in_only"), count(F.expr("gives and not funded")).alias("influence_out_only"), count(F.expr("funded and gives")).alias(WITHHELD))
    coverage = groups.agg(F.count("*").alias("candidate_rows")).crossJoin(coverage)  # one row each
    return DualRoles(table, through.unionByName(own), noted.unionByName(waits), proof, coverage)


def documents(found: DualRoles) -> DataFrame:
    """``(subject, document)``: each row of the table as JSON with its links, dependencies and evidence, sorted."""
    nest = lambda df, name, *c: df.groupBy("subject").agg(F.array_sort(F.collect_set(F.struct(*c))).alias(name))
    rows = found.table.join(nest(found.joined, "joined_via", "a", "b", "basis"), "subject", "left").join(nest(found.dependencies, "dependency_refs", "a", "b"), "subject", "left")
    rows = rows.join(found.evidence.groupBy("subject").agg(F.array_sort(F.collect_set("record")).alias("evidence_record_ids")), "subject", "left")
    return rows.select("subject", F.to_json(F.struct(*[c for c in rows.columns])).alias("document"))
