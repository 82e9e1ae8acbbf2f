"""Category of a charge code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unitwise.functions import fixed_values as V
from unitwise.functions import scalars as S
from unitwise.functions.scalars import col


def _any_word(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def code_text(code) -> Column:
    """Lower case, single spaces."""
    return F.regexp_replace(F.trim(F.lower(F.regexp_replace(
        col(code), r"^\s+|\s+$", ""))), r"\s+", " ")


def charge_category(code) -> Column:
    """First matching rule of the keyword table.

    ``CODE-Description`` texts are split, but a description is always part of
    the raw text, so a word test on the raw text covers both; only base rent
    and the numbered-storage pattern look at the description by itself.
    """
    words = lambda ws: S.sql_text(_any_word(ws))
    ladder = []
    for category, found, abbreviations in V.CHARGE_RULES_BEFORE_RENT:
        ladder.append((f"v.raw RLIKE {words(found)} OR v.abbrev IN ({S.sql_list(abbreviations)})",
                       category))
    ladder.append((
        f"v.descr IN ({S.sql_list(V.BASE_RENT_DESCRIPTIONS)}) OR (v.abbrev ="
        f" '{V.BASE_RENT_ABBREVIATION}' AND contains(v.descr, 'rent'))", "base_rent"))
    for category, found in V.CHARGE_RULES_AFTER_RENT:
        also = (f" OR v.descr RLIKE {S.sql_text(V.STORAGE_DESCRIPTION)}"
                if category == "storage" else "")
        ladder.append((f"v.raw RLIKE {words(found)}{also}", category))
    rules = " ".join(f"WHEN {test} THEN '{category}'" for test, category in ladder)

    shape = S.sql_text(V.CODE_SPLIT)
    parts = (
        f"named_struct('raw', v, 'abbrev', regexp_extract(v, {shape}, 1), 'descr',"
        f" IF(v RLIKE {shape}, trim(regexp_extract(v, {shape}, 2)), v))")
    split = S.let_sql(code_text(code), parts)
    return S.let_sql(split, f"CASE WHEN v.raw IS NOT NULL THEN CASE {rules} ELSE 'other' END END")


def is_total_line(code) -> Column:
    return F.lower(F.trim(col(code))).rlike(V.CHARGE_TOTAL_LINE)


def is_rent_class(category) -> Column:
    return col(category).isin(*V.RENT_CLASS)


def is_ancillary(category) -> Column:
    """Known income on top of rent: neither rent, adjustment nor unknown."""
    return ~col(category).isin(*V.RENT_CLASS, *V.RENT_ADJUSTMENTS, "other")
