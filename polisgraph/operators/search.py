"""Search over nodes with an inverted index stored by term, in three buckets: the exact id, entities, records."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polisgraph.session import new_path

K1, B = 1.2, 0.75
#: Folders by which postings are stored; a query reads those of its terms.
BUCKETS = 64
# Rows that are scored further by a bucket's rank, rows of a bucket, rows of a result.
SCORED, SHOWN = 200, 50


@dataclass
class Index:
    """``postings``: term, id, node_type, tf, n.  ``nodes``: id, node_type, rank, captured.  ``totals``: docs, mean (one row)."""

    postings: DataFrame
    nodes: DataFrame
    totals: DataFrame


def words(c: str):
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def build_index(nodes: DataFrame, path: str | None = None) -> Index:
    """Store the index of ``nodes`` (id, node_type, text, rank, captured) in the shared folder and open it.

    ``nodes`` are worked out once, when they are stored.  A node's words are counted where its row is, and postings are moved
    once, to their folder.
    """
    spark = nodes.sparkSession
    path = path or new_path(spark, "search-index")
    nodes.select("id", "node_type", "text", "rank", "captured").write.option("compression", "zstd").parquet(f"{path}/nodes")
    said = spark.read.parquet(f"{path}/nodes").select("id", "node_type", words("text").alias("w")).where(F.size("w") > 0)
    counted = F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.size(F.filter("w", lambda x: x == t)).cast("long").alias("tf")))
    each = said.select("id", "node_type", F.size("w").alias("n"), F.explode(counted).alias("x")).select("x.term", "id", "node_type", "n", "x.tf")
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    dealt = each.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    said.agg(F.count("*").alias("docs"), F.avg(F.size("w")).alias("mean")).write.parquet(f"{path}/totals")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "nodes", "totals")))


def search(index: Index, query: str, include_records: bool = True) -> DataFrame:
    """``(position, bucket, id, node_type, score)`` of at most fifty nodes.

    A node's score is the sum over the query's words of their rarity times their saturated frequency; of each bucket's 200
    best the order is by a hundred scores and the rank, for records then by the latest capture, then by id.  The node whose
    id is the query comes first, even if it is a record and records are not asked for.
    """
    spark = index.nodes.sparkSession
    terms = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b"))
    folders = [r["b"] for r in wanted.select("b").distinct().collect()]  # of the query's words
    found = index.postings.where(F.col("bucket").isin(*folders) & F.col("term").isin(*terms))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    rows = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(index.totals))  # a row for each word of the query; one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    scored = rows.groupBy("id", "node_type").agg(F.round(F.sum(part), 9).alias("score"))
    buckets = [(1, F.col("node_type") != "Record", ["id"])]
    if include_records:
        buckets.append((2, F.col("node_type") == "Record", [F.desc_nulls_first("captured"), "id"]))
    out = index.nodes.where(F.col("id") == query).select(F.lit(0).alias("bucket"), "id", "node_type", F.lit(None).cast("double").alias("score"), F.lit(1).alias("k"))
    for number, of, ties in buckets:
        best = scored.where(of).orderBy(F.desc("score"), "id").limit(SCORED).join(index.nodes.select("id", "rank", "captured"), "id")
        best = best.withColumn("combined", F.col("score") * 100 + F.coalesce("rank", F.lit(0)))
        best = best.withColumn("k", F.row_number().over(Window.orderBy(F.desc("combined"), *ties))).where((F.col("k") <= SHOWN) & (F.col("id") != query))  # 200 rows
        out = out.unionByName(best.select(F.lit(number).alias("bucket"), "id", "node_type", "score", "k"))
    place = F.row_number().over(Window.orderBy("bucket", "k"))  # 101 rows at most
    return out.withColumn("position", place).where(F.col("position") <= SHOWN).select("position", "bucket", "id", "node_type", F.round("score", 6).alias("score"))
