"""Extracted rows to canonical units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitwise.functions import scalars as S
from unitwise.operators.codes import categorize, drop_total_lines, total_charges


def normalize_units(units: DataFrame, status: str = "status") -> DataFrame:
    """Trim ids, clear placeholders and normalize the status of extracted rows."""
    return units.withColumns({
        "unit_number": F.regexp_replace("unit_number", r"^\s+|\s+$", ""),
        "building": S.clean_placeholder("building"),
        "tenant_name": S.clean_placeholder("tenant_name"),
        "unit_type": S.clean_placeholder("unit_type"),
        "status": S.norm_status(status),
    })


def normalize_lines(charges: DataFrame) -> DataFrame:
    """Kept charge lines with a category each."""
    return categorize(drop_total_lines(charges))


def with_total_charges(units: DataFrame, charges: DataFrame) -> DataFrame:
    """Units with the sum of their kept lines; absent where there are none."""
    return units.join(
        total_charges(charges).select("doc_id", "unit_row_id", "total_charges"),
        ["doc_id", "unit_row_id"], "left")
