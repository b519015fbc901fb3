"""Graph tables on disk: Parquet partitioned by node type and by relationship, JSON lines, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polisgraph.graph import Graph

NODE_SCHEMA = "id string, label string, kind string, status string, amount decimal(18,2), event_date string, ended_date string, ref_id string, url string, node_type string"
EDGE_SCHEMA = "source_id string, target_id string, detail string, rel string"


def save_graph(g: Graph, path: str) -> None:
    """A filter on a type then reads that type's folders only."""
    g.nodes.write.partitionBy("node_type").parquet(f"{path}/nodes")
    g.edges.write.partitionBy("rel").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes"), spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with rows of ``new`` in place of those with the same id."""
    return old.join(new.select("id"), "id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_bundle(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of JSON files that each hold one document, or a list, over several lines."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).json(path)


def write_jsonl(df: DataFrame, path: str, in_order: bool = False) -> None:
    """One object a line with all its fields, nulls included: by name, or in the columns' order."""
    columns = df.columns if in_order else sorted(df.columns)
    df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes inside values are doubled, and values with quotes, commas or line breaks are quoted."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per source, relationship and target; properties of ``new`` (a map) overlay those of ``old``."""
    key = ["source_id", "rel", "target_id"]
    none = F.create_map().cast("map<string,string>")
    both = old.select(*key, F.col("properties").alias("o")).join(new.select(*key, F.col("properties").alias("n")), key, "full")
    kept = F.map_filter(F.coalesce("o", none), lambda k, v: ~F.map_contains_key(F.coalesce("n", none), k))
    return both.select(*key, F.map_concat(kept, F.coalesce("n", none)).alias("properties"))


def stamp(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    """The one row that tells when and from what a store was last written."""
    spark.createDataFrame([tuple(values.values())], list(values)).coalesce(1).write.mode("overwrite").json(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256, bytes, lines)`` of every file under a folder; a file is read whole by one task (2 GB at most)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.decode("content", "ISO-8859-1")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("lines"))


def validate_ledger(found: DataFrame, stated: DataFrame) -> DataFrame:
    """``stated`` (path, sha256, bytes, lines) with ``problem``: what differs first; lines count only where they are stated."""
    files = found.toDF("path", "_sha", "_bytes", "_lines")
    problem = F.when(F.col("_sha").isNull(), "missing").when(F.col("_sha") != F.col("sha256"), "sha256").when(F.col("_bytes") != F.col("bytes"), "bytes").when(F.col("lines").isNotNull() & (F.col("_lines") != F.col("lines")), "lines")
    return stated.join(files, "path", "left").select("path", "sha256", "bytes", "lines", problem.alias("problem"))


def baseline_digest(df: DataFrame, buckets: int = 256) -> DataFrame:
    """``(rows, sha256)`` of a table that no order changes: sorted rows of each bucket of hashes, then the buckets' digests."""
    rows = canonical_rows(df).withColumn("b", F.substring(F.md5("row"), 1, 2) if buckets == 256 else F.lit(""))
    parts = rows.groupBy("b").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2("row", 256))), ""), 256).alias("d"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: F.concat(x["b"], x["d"])), ""), 256).alias("sha256"))


def export_baseline(df: DataFrame, path: str) -> DataFrame:
    """Write a baseline where there is none yet (else it raises) and return its digest."""
    write_jsonl(df, path)
    return baseline_digest(df)


def canonical_rows(df: DataFrame) -> DataFrame:
    """``(row)``: the sorted fields of every row as text, nulls apart from empty strings."""
    return df.select(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in sorted(df.columns)]).alias("row"))


def type_digests(df: DataFrame, by: str) -> DataFrame:
    """A digest of each type's rows that no order changes: row count and the sum of the rows' hash prefixes."""
    body = canonical_rows(df.drop(by)).columns[0]
    rows = df.select(F.col(by).alias("type"), F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in sorted(df.columns) if c != by])).alias(body))
    part = F.conv(F.substr(body, F.lit(1), F.lit(8)), 16, 10).cast("decimal(20,0)")
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.sum(part).cast("decimal(30,0)").cast("string").alias("digest"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as they lack on the other."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def append_audit(sent: DataFrame, path: str, vendor: str) -> None:
    """One line for each text that left: ``sent`` has id, node_type, included, dropped (arrays of ids) and text, of which only the hash stays."""
    rows = sent.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.lit(vendor).alias("vendor"), F.col("id").alias("node_id"), "node_type", F.col("included").alias("neighbor_ids_included"), F.col("dropped").alias("neighbor_ids_dropped"), F.sha2("text", 256).alias("prompt_hash"))
    rows.write.mode("append").json(path)
