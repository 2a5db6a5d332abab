"""Corpus pipeline: documents to packed training sequences.

Five stages, each one operator over all that its predecessor kept: reject documents of low quality, reject toxic ones, keep
one of each group of near-duplicates, mix the sources to target weights, pack into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import mixing, packing, quality, simhash, toxicity
from marketlens.llm.common import checkpointed, id_remainder

#: Words of a shingle in the near-duplicate stage, and the similarity of shingle sets from which on texts are near-duplicates.
SHINGLE, SIMILAR = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the operator's threshold. Learns from the labelled documents that its own
    query may learn from; rows keep all columns, repeated rows and rows without an id are judged by their text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    seen = docs.filter(F.coalesce(id_remainder("doc_id", 5) != 0, F.lit(False))).select("doc_id", "text")
    model = quality.fit(quality.labelled(quality.with_statistics(seen).select("doc_id", "stats"), labels, "quality"))
    return quality.score_text(docs, model, into="__quality").filter(F.col("__quality") >= quality.ACCEPT).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the operator's threshold; empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    seen = docs.filter(F.coalesce(id_remainder("doc_id", 3) != 1, F.lit(False)))
    model = toxicity.train(toxicity.training_rows(seen, labels))
    return toxicity.score_text(docs, model, into="__toxic", at="__at").filter(F.col("__toxic") < toxicity.ACCEPT).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates by five-word shingles, that is near fingerprints or shingle sets of
    similarity 0.8 or more: the one with the smallest id."""
    return simhash.keep_first(docs, shingle=SHINGLE, jaccard=SIMILAR).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their source ask for: rows of a large source may go, rows of small
    sources may come twice."""
    return mixing.mix(docs, mixing.plan(docs)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs, ids=False)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("simhash_dedup", simhash_stage), ("source_mixing", mixing_stage), ("packing", packing_stage)]

#: The learned stages have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage kept is written to the checkpoint folder for the next one, so no
    stage is computed again by a later one or by a lost executor."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
