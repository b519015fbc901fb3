"""The corpus pipeline: five filtering stages over ``documents``, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir).  All but the last return the columns of ``documents``; the last returns
the packed pieces.  Between stages ``run`` writes Parquet to the shared folder and reads it again.

Defined cases: language identification drops null texts, empty ones and texts without letters, so later stages meet
none in ``run``; called by themselves they keep rows with a null text or id, but packing gives each row at least its end
id.  Repeated rows share their fate: all stay or all go, except that line dedup counts equal texts under other ids as
repeats.  Ties are settled by the smallest id.  Empty tables pass through.  Further columns are kept, whatever their
names, up to packing, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polisgraph.llm import _common, decontaminate, jaccard, langid, linededup, packing

#: A language is told if its score is at least this part of the way from chance, one over the languages, to certainty.
LEAST_LANGUAGE_LEAD = 0.15


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; null texts and texts without letters go.

    Without a labelled row no language can be learned: then every text with a letter stays.
    """
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    chance = 1 / len(model[0])
    found = langid.identify(docs, model)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= chance + LEAST_LANGUAGE_LEAD * (1 - chance)))
    return kept.select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier one holds; those of which nothing is left go."""
    kept = linededup.dedup_lines(docs).where(~F.col("all_deleted"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; rows without an id stay."""
    found = jaccard.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(_common.saved(gone), "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    found = decontaminate.mark(docs, _common.read_table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its sequence and its place there."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontaminate", benchmark_decontamination),
    ("packing", pack),
]

#: Trained models and alignments are beyond SQL: tests hold each stage after the first against a brute-force version of it,
#: and the first against the labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _common.staged(docs, name)
    return docs
