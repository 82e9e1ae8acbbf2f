"""From raw documents to packed sequences: five stages, each over all rows the one before kept.

Every stage writes what it keeps as Parquet, which the next one reads, so a lost executor costs at
most a part of one stage. Stages that filter return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitwise.llm import exact_dedup, mixing, ngram_join, packing, quality
from unitwise.session import release, release_unread, stage_path, staged_since, staged_tables


def _stage(function):
    """Once a stage is built, what it staged goes, but for the tables its result reads."""
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mark = staged_tables()
        out = function(spark, docs, sf_dir)
        release_unread(out, mark)
        return out
    return run_stage


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts."""
    return quality.accepted(docs, _labels(spark, sf_dir))


@_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts."""
    return exact_dedup.drop_copies(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every component of texts whose word shingles link."""
    return ngram_join.drop_near_copies(docs)


@_stage
def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the fitted rates say."""
    return mixing.mix_rows(docs, mixing.domains_of(_labels(spark, sf_dir)))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("mixing", mix_domains),
    ("best_fit_packing", pack),
]

#: The classifiers and the packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; a stage's input and tables go when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, function in STAGES:
        path, mark = stage_path(spark), staged_tables()
        found = function(spark, docs, sf_dir)
        found.withColumns({c: F.col(c).cast("string") for c, kind in found.dtypes if kind == "void"}).write.parquet(path)
        release(spark, [*before, *staged_since(mark)])
        docs, before = spark.read.parquet(path), [path]
    return docs
