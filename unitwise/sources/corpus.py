"""Collecting documents: inclusion rules, content de-duplication, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitwise.functions import fixed_values as V
from unitwise.functions.scan import numbered


def inclusion_rules(entries: DataFrame) -> DataFrame:
    """Indexed documents of the right type and extension, with why one is out.

    ``entries`` has file_name, types (array) and note.
    """
    name = F.lower("file_name")
    fits = F.lit(False)
    for ext in V.CORPUS_EXTENSIONS:
        fits = fits | name.endswith(ext)
    note = F.lower(F.coalesce("note", F.lit("")))
    text = F.concat_ws(" ", name, note)
    registration = F.lit(False)
    for word in V.REGISTRATION_WORDS:
        registration = registration | text.contains(word)
    return entries.filter(fits & F.array_contains("types", V.CORPUS_TYPE)).withColumn(
        "excluded", F.when(registration, "registration")
        .when(note.contains("blank") & note.contains("template"), "blank template"))


def content_dedupe(files: DataFrame, arrival: str, content: str = "content") -> DataFrame:
    """First arrival per content hash; later copies name the one they repeat.

    The first of each hash is found by aggregation, so a content repeated in a
    third of all files costs no more than any other.
    """
    hashed = files.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).drop(content)
    first = hashed.groupBy("sha256").agg(F.min(arrival).alias("first_arrival"))
    return hashed.join(first, "sha256").withColumn(
        "duplicate_of", F.when(F.col(arrival) != F.col("first_arrival"), F.col("first_arrival")))


def new_content(files: DataFrame, manifest: DataFrame, arrival: str,
                content: str = "content") -> DataFrame:
    """Files whose hash (first sixteen digits) no earlier manifest holds."""
    fresh = content_dedupe(files, arrival, content).filter(F.col("duplicate_of").isNull())
    known = manifest.select(F.substring("sha256", 1, 16).alias("short")).distinct()
    return fresh.withColumn("short", F.substring("sha256", 1, 16)).join(
        known, "short", "left_anti")


def assign_corpus_ids(files: DataFrame, arrival: str, name: str,
                      manifest: DataFrame | None = None, width: int = 2) -> DataFrame:
    """Sequential zero-padded ids with a cleaned name, after the highest so far.

    The number is a bucketed running count over ``arrival`` (an integer), not a
    single-task row number.
    """
    start = F.lit(0)
    ranked = numbered(files.withColumn("_all", F.lit(0)), ["_all"], arrival, "_n", levels=3)
    if manifest is not None:
        top = manifest.agg(F.max(F.regexp_extract("corpus_id", r"^([0-9]+)__", 1)
                                 .try_cast("bigint")).alias("_top")).withColumn("_all", F.lit(0))
        ranked = ranked.join(top, "_all", "left")
        start = F.coalesce(F.col("_top") + 1, F.lit(0))
    number = (F.col("_n") - 1 + start).cast("string")
    padded = F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0"))
    clean = F.regexp_replace(name, r"[^a-zA-Z0-9._-]+", "_")
    return ranked.withColumn("corpus_id", F.concat(padded, F.lit("__"), clean)).drop(
        "_all", "_n", "_top")
