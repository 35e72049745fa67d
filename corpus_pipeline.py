"""Corpus pipeline over the documents table: quality, near duplicates, repeated passages, benchmark leaks, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. ``run`` writes each stage's result as
Parquet under the shared checkpoint folder and reads it again for the next, so
a lost executor never costs more than a stage. Rows without an id pass the
stages that decide by id. An empty table passes through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.decontaminate import benchmark_leaks
from paddock.llm.jaccard_join import jaccard_components
from paddock.llm.quality import judge_quality
from paddock.llm.queries import table, workers_find_library
from paddock.llm.sentence_pieces import BPE_PIECES, encode
from paddock.llm.substring_dedup import drop_passages, repeated_passages
from paddock.session import materialize


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is among ``ids``."""
    gone = materialize(ids.select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    judged = judge_quality(docs, table(spark, sf_dir, "labels"))
    rejected = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("NOT kept")
    return _without(docs, rejected)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Of rows that repeat an id with
    its text the first in order of the other columns stays (nulls first); rows without an id all stay."""
    workers_find_library(spark)
    found = materialize(jaccard_components(docs), "near-duplicates")
    kept = _without(docs, found.filter("component_id <> doc_id"))
    again = materialize(found.filter("doc_id IS NOT NULL AND component_id = doc_id").groupBy("doc_id").count().filter(
        "count > 1").select(F.col("doc_id").alias("__again")), "repeated-ids")
    repeated = kept.join(again, F.col("doc_id") == F.col("__again"), "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = repeated.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("__one"))
    single = kept.join(again, F.col("doc_id") == F.col("__again"), "left_anti")
    return single.unionByName(one.select("doc_id", "text", "__one.*").select(docs.columns))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has too."""
    workers_find_library(spark)
    cut = drop_passages(docs, repeated_passages(docs))
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, benchmark_leaks(docs, table(spark, sf_dir, "benchmark")))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document with its N best segmentations."""
    workers_find_library(spark)
    return encode(docs, BPE_PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", passage_dedup),
    ("decontamination", decontamination),
    ("sentence_pieces", sentence_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
