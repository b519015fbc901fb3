"""Bundles of objects to a graph: section filters, node and edge rows, references, aliases, ordered merges.

An object is a JSON text with an id; ``objects`` has ``seq`` (load order), ``bundle``, ``section``, ``node_type``,
``promotion`` and ``obj``.  Properties are a map from names to JSON texts, so any value keeps its type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisgraph.functions import relations as R
from polisgraph.functions import vocabulary as V
from polisgraph.functions.provenance import node_year

EMPTY = ("null", '""', "[]")
#: Names under which the rows of a merge differ on purpose.
PAYLOAD = "payload_json"


def section_filter(objects: DataFrame, filters: dict[str, dict[str, list[str]]]) -> DataFrame:
    """``objects`` with ``reason``: null, or ``filter:<key>`` of the section's first filter that an object does not pass."""
    reasons = [F.lit(None).cast("string")]
    for section, keys in filters.items():
        for key, allowed in keys.items():
            value = F.get_json_object("obj", f"$['{key}']")
            fails = ~F.coalesce(value.isin(*allowed) if allowed else F.lit(False), F.lit(False))
            reasons.append(F.when((F.col("section") == section) & fails, f"filter:{key}"))
    return objects.withColumn("reason", F.coalesce(*reasons[1:], reasons[0]))


def sorted_join(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """A left join that sorts both sides: maps and ids grow with the input, whatever size Spark takes them to have."""
    return rows.join(known.hint("merge"), on, "left")


def fields(rows: DataFrame, obj: str = "obj") -> DataFrame:
    """One row per field of each object: ``rows`` with ``key``, ``value`` (JSON text) and ``kind``: scalar, list, or other."""
    spark = rows.sparkSession
    return spark.sql(
        f"""
        SELECT r.*, f.key, to_json(f.value) AS value, CASE
          WHEN schema_of_variant(f.value) LIKE 'OBJECT%' THEN 'other'
          WHEN schema_of_variant(f.value) NOT LIKE 'ARRAY%' THEN 'scalar'
          WHEN forall(CAST(f.value AS ARRAY<VARIANT>), x -> x IS NULL OR NOT (schema_of_variant(x) LIKE 'OBJECT%' OR schema_of_variant(x) LIKE 'ARRAY%')) THEN 'list'
          ELSE 'other' END AS kind
        FROM {{rows}} r, LATERAL variant_explode(parse_json(r.{obj})) f""",
        rows=rows,
    )


def text_of(value: Column) -> Column:
    """The text of a JSON string; null for any other JSON."""
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"))


def type_of_bundle_id(c: str) -> Column:
    out = F.lit(None).cast("string")
    for prefix, kind in R.BUNDLE_PREFIX.items():
        out = F.when(F.col(c).startswith(prefix), kind).otherwise(out)
    return out


#: An object's own scalars and lists of scalars that say something, taken where the object is: names to JSON texts.
_OWN_VALUES = """transform_values(
  map_filter(try_cast(parse_json(obj) AS MAP<STRING, VARIANT>), (k, v) -> k <> 'id' AND CASE
    WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN false
    WHEN schema_of_variant(v) NOT LIKE 'ARRAY%' THEN coalesce(to_json(v), 'null') <> 'null'
    ELSE to_json(v) <> '[]' AND forall(CAST(v AS ARRAY<VARIANT>), x -> x IS NULL OR NOT (schema_of_variant(x) LIKE 'OBJECT%' OR schema_of_variant(x) LIKE 'ARRAY%')) END),
  (k, v) -> to_json(v))"""


def project_nodes(objects: DataFrame) -> DataFrame:
    """One row per object: id, type, label, promotion and its rank, bundle, section, status, properties."""
    text = lambda k: F.nullif(F.trim(F.get_json_object("obj", f"$.{k}")), F.lit(""))
    rank = F.array_position(F.array(*[F.lit(p) for p in V.PROMOTION]), F.col("promotion"))
    payload = F.create_map(F.lit(PAYLOAD), F.to_json(F.struct(F.to_json(F.parse_json("obj")).alias("v"))))
    return objects.select(
        "seq", F.get_json_object("obj", "$.id").alias("id"), "node_type", F.coalesce(*[text(k) for k in ("name", "title", "summary", "role_label")], F.get_json_object("obj", "$.id")).alias("label"),
        "promotion", rank.cast("int").alias("rank"), "bundle", "section", F.get_json_object("obj", "$.status").alias("status"),
        F.map_concat(F.coalesce(F.expr(_OWN_VALUES), F.create_map().cast("map<string,string>")), F.transform_values(payload, lambda k, v: F.regexp_extract(v, '(?s)^\\{"v":(.*)\\}$', 1))).alias("properties"),
    )


def relation(node_type: str = "node_type", field: str = "field", target_type: str = "target_type") -> Column:
    """The relationship that a field stands for: the type's own, a record's, anyone's, or the target's type."""
    explicit = F.create_map(*[F.lit(x) for t, fs in R.FIELD_RELATION.items() for f, r in fs.items() for x in (f"{t}.{f}", r)])
    record = F.create_map(*[F.lit(x) for kv in R.RECORD_RELATION.items() for x in kv])
    general = F.create_map(*[F.lit(x) for kv in R.ANY_RELATION.items() for x in kv])
    return F.coalesce(
        F.try_element_at(explicit, F.concat_ws(".", node_type, field)),
        F.when(F.col(target_type) == "Record", F.try_element_at(record, F.col(field))),
        F.try_element_at(general, F.col(field)),
        F.concat(F.lit("RELATES_TO_"), F.upper(target_type)),
    )


_EDGE = ("seq", "bundle", "source_id", "source_type", "target_id", "target_type", "rel", "field", "properties")


def _edge_props(*names: str) -> Column:
    """Of a JSON object in ``item`` all scalar and scalar-list values but ``names`` and nulls."""
    values = F.transform_values(F.from_json("item", "map<string,variant>"), lambda k, v: F.to_json(v))
    return F.map_filter(values, lambda k, v: ~k.isin(*names) & v.isNotNull() & (v != "null") & ~v.startswith("{") & ~v.rlike(r"^\[\s*[\[{]"))


def project_edges(objects: DataFrame) -> DataFrame:
    """Edges that objects' fields name: references, evidence and votes; ids of no known type name nothing."""
    base = objects.withColumn("source_id", F.get_json_object("obj", "$.id")).select("seq", "bundle", F.col("node_type").alias("source_type"), "source_id", "obj")
    own = fields(base)
    is_reference = (F.col("key").endswith("_id") | F.col("key").endswith("_ids") | F.col("key").isin(*R.OTHER_REFERENCES)) & (F.col("key") != "id")
    listed = F.from_json("value", "array<string>")
    ids = F.when(F.col("value").startswith("["), F.filter(listed, lambda x: x.isNotNull())).otherwise(F.array(text_of(F.col("value"))))
    none = F.create_map().cast("map<string,string>")
    refs = own.where(is_reference).select("seq", "bundle", "source_type", "source_id", F.col("key").alias("field"), F.explode(ids).alias("target_id")).withColumn("target_type", type_of_bundle_id("target_id"))
    refs = refs.where("target_type is not null").withColumn("rel", relation("source_type")).withColumn("properties", none)
    items = lambda key: base.select("seq", "bundle", "source_type", "source_id", F.explode(F.from_json(F.get_json_object("obj", f"$.{key}"), "array<string>")).alias("item")).where("item like '{%'")
    said = items("evidence").withColumn("target_id", F.coalesce(*[F.nullif(F.get_json_object("item", f"$.{k}"), F.lit("")) for k in ("document_id", "record_id")])).withColumn("target_type", type_of_bundle_id("target_id")).where("target_type is not null")
    said = said.withColumns({"rel": F.lit("EVIDENCED_BY"), "field": F.lit("evidence"), "properties": _edge_props("document_id", "record_id")})
    votes = items("votes").where("source_type = 'Decision'").withColumn("actor", F.get_json_object("item", "$.actor_id")).where("actor like 'actor-%'")
    told = F.map_filter(_edge_props(), lambda k, v: k.isin("vote", "seat_id", "seat_service_id"))
    votes = votes.select("seq", "bundle", F.col("actor").alias("source_id"), F.lit("Actor").alias("source_type"), F.col("source_id").alias("target_id"), F.lit("Decision").alias("target_type"), F.lit("CAST_VOTE_ON").alias("rel"), F.lit("votes").alias("field"), told.alias("properties"))
    return reduce(lambda a, b: a.unionByName(b), [df.select(*_EDGE) for df in (refs, said, votes)])


def passthrough_edges(relationships: DataFrame) -> DataFrame:
    """Edges stated as such: ``seq``, ``bundle`` and ``obj`` with a source record, targets and a relationship."""
    base = relationships.withColumn("source_id", F.get_json_object("obj", "$.source_record_id")).withColumn("source_type", type_of_bundle_id("source_id")).where("source_type is not null")
    targets = fields(base).where("key like 'target\\\\_%' and key like '%\\\\_id'").withColumn("target_id", text_of(F.col("value"))).withColumn("target_type", type_of_bundle_id("target_id")).where("target_type is not null")
    props = F.map_filter(_edge_props("source_record_id", "relationship_type"), lambda k, v: k != F.col("key"))
    return targets.withColumn("item", F.col("obj")).select("seq", "bundle", "source_id", "source_type", "target_id", "target_type", F.upper(F.get_json_object("obj", "$.relationship_type")).alias("rel"), F.lit("record_relationships").alias("field"), props.alias("properties"))


def alias_map(nodes: DataFrame) -> DataFrame:
    """``(alias, id)``: ids of raw actors and the actor that each resolves to; the last one loaded wins."""
    named = nodes.where("node_type = 'Actor'").select("seq", "id", F.explode(F.from_json(F.try_element_at("properties", F.lit("resolves_raw_actor_seed_ids")), "array<string>")).alias("alias"))
    return named.where("alias like 'actor-%'").groupBy("alias").agg(F.max_by("id", "seq").alias("id"))


def remap_aliases(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """``edges`` with actors' raw ids replaced, and ``remapped``: whether one was."""
    out = edges.withColumn("remapped", F.lit(False))
    for end in ("source", "target"):
        known = aliases.select(F.col("alias").alias(f"{end}_id"), F.col("id").alias("_to"))
        hit = F.col("_to").isNotNull() & (F.col(f"{end}_type") == "Actor")
        out = sorted_join(out, known, [f"{end}_id"]).withColumn("remapped", F.col("remapped") | hit).withColumn(f"{end}_id", F.when(hit, F.col("_to")).otherwise(F.col(f"{end}_id"))).drop("_to")
    return out


def merge_properties(rows: DataFrame, key: list[str], ranked: bool) -> DataFrame:
    """``key``, ``properties`` and ``conflicts`` (a name for each value that gave way), rows taken in order of ``seq``.

    The first value stays, or where ``ranked`` the one of a higher ``rank`` than any before.  Lists are united in order.  A page
    that differs moves to ``pages``.  Empty values give way and never win.  Every name is merged by itself: a group's rows of
    one name are ordered, so no group is gathered whole.  Rows are dealt out by their key once, with their properties
    together: every later step groups by the key and more.
    """
    rank = F.col("rank") if ranked else F.lit(0)
    dealt = rows.where(F.size("properties") > 0).select(*key, "seq", rank.alias("rank"), "properties").repartition(*key)
    each = dealt.select(*key, "seq", "rank", F.explode("properties").alias("name", "value"))
    step = F.struct("seq", "rank", "value")
    # Equal values of equal rank after one another add nothing: only the first of each value and rank is kept.
    first = each.groupBy(*key, "name", "value", "rank").agg(F.min("seq").alias("seq"))
    lists = first.groupBy(*key, "name").agg(F.array_sort(F.collect_list(step)).alias("s"))
    empty = lambda v: v.isin(*EMPTY)
    is_list = lambda v: v.startswith("[")
    start = F.struct(F.get("s", 0)["value"].alias("value"), F.get("s", 0)["rank"].alias("best"), F.lit(0).alias("conflicts"), F.lit(False).alias("paged"))
    items = lambda v: F.transform(F.from_json(v, "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))
    united = lambda a, b: F.concat(F.lit("["), F.array_join(F.array_union(items(a), items(b)), ","), F.lit("]"))

    def fold(acc: Column, x: Column) -> Column:
        same, higher = acc["value"] == x["value"], x["rank"] > acc["best"]
        number = F.col("name").eqNullSafe("page") & acc["value"].rlike("^[\\[\\-0-9]") & x["value"].rlike("^-?[0-9]")
        paged = number & ~same
        pages = F.when(acc["paged"], acc["value"]).otherwise(F.concat(F.lit("["), acc["value"], F.lit("]")))
        value = (
            F.when(same, acc["value"])
            .when(F.col("name") == PAYLOAD, F.when(higher, x["value"]).otherwise(acc["value"]))
            .when(paged, united(pages, F.concat(F.lit("["), x["value"], F.lit("]"))))
            .when(is_list(acc["value"]) & is_list(x["value"]), united(acc["value"], x["value"]))
            .when(empty(acc["value"]), x["value"])
            .when(empty(x["value"]), acc["value"])
            .when(higher, x["value"])
            .otherwise(acc["value"])
        )
        clash = ~same & (F.col("name") != PAYLOAD) & ~paged & ~(is_list(acc["value"]) & is_list(x["value"])) & ~empty(acc["value"]) & ~empty(x["value"])
        return F.struct(value.alias("value"), F.greatest(acc["best"], x["rank"]).alias("best"), (acc["conflicts"] + clash.cast("int")).alias("conflicts"), (acc["paged"] | paged).alias("paged"))

    done = lists.withColumn("m", F.aggregate(F.slice("s", F.lit(2), F.size("s")), start, fold))
    name = F.when(F.col("m.paged"), "pages").otherwise(F.col("name"))
    out = done.select(*key, name.alias("name"), F.col("m.value").alias("value"), F.array_repeat("name", F.col("m.conflicts")).alias("c"))
    one = out.groupBy(*key, "name").agg(F.array_sort(F.collect_list("value")).alias("v"), F.flatten(F.collect_list("c")).alias("c"))
    value = F.when(F.size("v") > 1, F.aggregate("v", F.lit("[]"), united)).otherwise(F.get("v", 0))  # a page's list beside a list of pages
    return one.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("name", value))).alias("properties"), F.array_sort(F.flatten(F.collect_list("c"))).alias("conflicts"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: the strongest promotion's label and status, all bundles and sections, merged properties.

    An id with two types raises an error.
    """
    best = F.struct((-F.col("rank")).alias("r"), "seq")
    by_rank = lambda c: F.min_by(c, best)
    stated = F.when(F.col("status").isNotNull() & (F.col("status") != ""), best)
    types = F.when(F.min("node_type") != F.max("node_type"), F.raise_error(F.concat(F.lit("node type collision for "), F.first("id")))).otherwise(F.min("node_type"))
    out = nodes.groupBy("id").agg(types.alias("node_type"), by_rank("label").alias("label"), by_rank("promotion").alias("promotion"), F.array_sort(F.collect_set("bundle")).alias("bundles"), F.array_sort(F.collect_set("section")).alias("sections"), F.min_by("status", stated).alias("status"))
    return sorted_join(out, merge_properties(nodes, ["id"], ranked=True), ["id"])


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per source, relationship and target: all bundles and fields, merged properties."""
    key = ["source_id", "rel", "target_id"]
    out = edges.groupBy(*key).agg(F.min_by("source_type", "seq").alias("source_type"), F.min_by("target_type", "seq").alias("target_type"), F.array_sort(F.collect_set("bundle")).alias("bundles"), F.array_sort(F.collect_set("field")).alias("fields"))
    return sorted_join(out, merge_properties(edges, key, ranked=False), key)


def load_once(nodes: DataFrame) -> DataFrame:
    """``(id, payload)`` with equal repeats once; an id with two payloads raises an error."""
    count = F.count_distinct("payload")
    return nodes.groupBy("id").agg(F.when(count > 1, F.raise_error(F.concat(F.lit("differing payloads of "), F.first("id")))).otherwise(F.min("payload")).alias("payload"))


def node_summaries(nodes: DataFrame) -> DataFrame:
    """``(id, node_type, label, year, bundles, properties)``: properties without the payload and without empty values."""
    kept = F.map_filter("properties", lambda k, v: (k != PAYLOAD) & v.isNotNull() & ~v.isin(*EMPTY))
    return nodes.select("id", "node_type", "label", node_year().alias("year"), "bundles", kept.alias("properties"))
