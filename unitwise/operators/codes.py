"""Charge lines: categories, summaries, vocabularies and proposal gates.

``charges`` holds one row per line: doc_id, unit_row_id, code, amount and, where
something upstream already knew it, category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitwise.functions import fixed_values as V
from unitwise.functions.charge_codes import (
    charge_category, is_ancillary, is_rent_class, is_total_line)
from unitwise.functions.scalars import MONEY, cents, clean_text
from unitwise.operators.stats import TOTAL


def drop_total_lines(charges: DataFrame) -> DataFrame:
    """Lines with a code and an amount that are not a printed block total."""
    code = clean_text("code")
    return charges.filter(
        code.isNotNull() & F.col("amount").isNotNull() & ~is_total_line(code)
    ).withColumn("code", code)


def code_categories(lines: DataFrame) -> DataFrame:
    """(code, keyword category) of the distinct codes of ``lines``; the rules run once for each."""
    codes = lines.groupBy("code").agg(F.count(F.lit(1)).alias("_n"))
    # Asking for the count keeps filters on the category above the aggregation, off the lines.
    return codes.select("code", F.when(F.col("_n") > 0, charge_category("code")).alias("_keyword"))


def categorize(charges: DataFrame) -> DataFrame:
    """Fill missing categories from the keyword rules; set ones stand.

    Distinct codes are classified in the same plan and joined back. The runtime knows how many there are
    when it picks the join, and splits a code that many lines share.
    """
    has = "category" in charges.columns
    own = F.col("category") if has else F.lit(None).cast("string")
    open_ = charges.filter("category IS NULL") if has else charges
    out = charges.join(code_categories(open_), "code", "left").withColumn("category", F.coalesce(own, "_keyword"))
    return out.select(*charges.columns, *([] if has else ["category"]))


def _per_code(charges: DataFrame) -> DataFrame:
    """Amount and number of lines by document, code and category; reduced before any line is joined."""
    keys = [c for c in ("doc_id", "code", "category") if c in charges.columns]
    return categorize(charges.groupBy(*keys).agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n_lines")))


def total_charges(charges: DataFrame) -> DataFrame:
    """Sum of kept lines per unit; units without lines do not appear."""
    return drop_total_lines(charges).groupBy("doc_id", "unit_row_id").agg(
        cents(F.sum("amount")).alias("total_charges"),
        F.count(F.lit(1)).alias("n_lines"))


def charge_summary(charges: DataFrame) -> DataFrame:
    """Per document and category: amount, units and number of codes (no rent)."""
    amounts = _per_code(charges).filter(~is_rent_class("category")).groupBy("doc_id", "category").agg(
        cents(F.sum("amount")).cast(TOTAL).alias("total_amount"),
        F.count_distinct("code").alias("n_codes"))
    # One row per unit and category before the count: its key spreads even a single huge document.
    narrow = [c for c in ("doc_id", "unit_row_id", "code", "category") if c in charges.columns]
    units = categorize(charges.select(*narrow)).filter(~is_rent_class("category")).select(
        "doc_id", "category", "unit_row_id").distinct().groupBy("doc_id", "category").agg(
        F.count(F.lit(1)).alias("unit_count"))
    return amounts.join(units, ["doc_id", "category"]).select(
        "doc_id", "category", "total_amount", "unit_count", "n_codes")


def charge_summary_sorted(charges: DataFrame) -> DataFrame:
    """Charge summary, largest amount (either sign) first within a document."""
    return charge_summary(charges).orderBy(
        "doc_id", F.desc(F.abs("total_amount")), "category")


def summary_codes(charges: DataFrame) -> DataFrame:
    """The codes behind each summary row, one row per code."""
    return _per_code(charges).filter(~is_rent_class("category")).select(
        "doc_id", "category", "code").distinct()


def ancillary_total(charges: DataFrame) -> DataFrame:
    """Identified income on top of rent per document."""
    return _per_code(charges).groupBy("doc_id").agg(
        F.coalesce(cents(F.sum(F.when(is_ancillary("category"), F.col("amount")))).cast(TOTAL),
                   F.lit(0).cast(TOTAL)).alias("total_charges_amount"),
        F.sum("n_lines").alias("n_lines"))


def top_categories(charges: DataFrame, n: int = 5) -> DataFrame:
    """The n largest summary rows of a document (there are at most 21)."""
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.abs("total_amount")), "category")
    return charge_summary(charges).withColumn("rank", F.row_number().over(w).cast("bigint")).filter(
        F.col("rank") <= n)


def code_vocabulary(charges: DataFrame) -> DataFrame:
    """Distinct codes with line counts and signed sums."""
    return charges.filter(F.col("code").isNotNull() & (F.col("code") != "")).groupBy(
        "doc_id", "code").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.coalesce("amount", F.lit(0))).cast(TOTAL).alias("signed_sum"))


def gate_code_proposal(current, proposed) -> Column:
    """accept, decline or noop for a proposed category of a code."""
    cur, new = F.col(current), F.col(proposed)
    pair = V.REDUCTION_PAIR
    return (F.when(cur == new, "noop")
            .when((cur == "other") | (cur.isin(*pair) & new.isin(*pair)), "accept")
            .otherwise("decline"))


def code_verdicts(charges: DataFrame, proposals: DataFrame) -> DataFrame:
    """Verdict per distinct code of a document that has a valid proposal."""
    valid = proposals.filter(F.col("category").isin(*V.CHARGE_CATEGORIES)).groupBy(
        "doc_id", "code").agg(F.max("category").alias("proposed"))
    words = code_vocabulary(charges)
    return (
        words.join(code_categories(words).withColumnRenamed("_keyword", "keyword"), "code")
        .select(*words.columns, "keyword")
        .join(valid, ["doc_id", "code"], "left")
        .withColumn("verdict", F.when(
            F.col("proposed").isNotNull(), gate_code_proposal("keyword", "proposed")))
        .withColumn("override", F.when(F.col("verdict") == "accept", F.col("proposed")).when(
            F.col("verdict").isNull() | (F.col("verdict") == "noop"),
            F.when(F.col("keyword").isin(*V.REDUCTION_PAIR), F.col("keyword")))))


def apply_code_proposals(charges: DataFrame, proposals: DataFrame) -> DataFrame:
    """Lines with accepted categories.

    Only lines still at "other", or moves inside the reduction pair, change. A
    document without a single valid proposal keeps its lines as they are. The
    verdict is found once per document and code, and the lines are joined to it.
    """
    valid = proposals.filter(F.col("category").isin(*V.CHARGE_CATEGORIES)).groupBy(
        "doc_id", "code").agg(F.max("category").alias("_proposed"))
    words = charges.select("doc_id", "code").distinct()
    # A proposal for a code the document does not print does not count.
    answered = words.join(valid, ["doc_id", "code"], "left_semi").select("doc_id").distinct()
    pair = V.REDUCTION_PAIR
    verdict = F.when(F.col("_proposed").isNotNull(), gate_code_proposal("_keyword", "_proposed"))
    override = F.when(verdict == "accept", F.col("_proposed")).when(
        (F.coalesce(verdict, F.lit("noop")) == "noop") & F.col("_keyword").isin(*pair), F.col("_keyword"))
    judged = words.join(code_categories(words), "code").join(valid, ["doc_id", "code"], "left").join(
        answered.withColumn("_answered", F.lit(True)), "doc_id", "left").select(
        "doc_id", "code", "_keyword", F.when(F.col("_answered"), override).alias("_override"))
    has = "category" in charges.columns
    own = F.coalesce(F.col("category") if has else F.lit(None).cast("string"), F.col("_keyword"))
    takes = F.col("_override").isNotNull() & (
        (own == "other") | (own.isin(*pair) & F.col("_override").isin(*pair)))
    return charges.join(judged, ["doc_id", "code"], "left").withColumn(
        "category", F.when(takes, F.col("_override")).otherwise(own)).select(
        *charges.columns, *([] if has else ["category"]))


def charge_columns(charges: DataFrame, pos: str = "unit_row_id") -> DataFrame:
    """The columns of a charge pivot: key, first printed form, units carrying it."""
    key = F.lower(F.trim("code"))
    lines = charges.withColumn("code_key", key).filter(F.col("code_key") != "")
    per_unit = lines.groupBy("doc_id", "code_key", "unit_row_id").agg(
        F.min(F.struct(F.col(pos).alias("p"), F.trim("code").alias("c"))).alias("first"))
    return per_unit.groupBy("doc_id", "code_key").agg(
        F.min("first")["c"].alias("display"), F.count(F.lit(1)).alias("unit_count"))


def charge_pivot(charges: DataFrame) -> DataFrame:
    """Amount per unit and code key: the pivot in long form."""
    return charges.withColumn("code_key", F.lower(F.trim("code"))).filter(
        F.col("code_key") != "").groupBy("doc_id", "unit_row_id", "code_key").agg(
        cents(F.sum("amount")).cast(MONEY).alias("amount"))


def charge_pivot_wide(charges: DataFrame, keys: list[str]) -> DataFrame:
    """One column per given code key, for a vocabulary known in advance."""
    return charges.withColumn("code_key", F.lower(F.trim("code"))).groupBy(
        "doc_id", "unit_row_id").pivot("code_key", keys).agg(cents(F.sum("amount")).cast(MONEY))


def nest_charges(units: DataFrame, charges: DataFrame) -> DataFrame:
    """Units with their own lines as an array ordered by line number.

    The array is as long as the printed block of one unit.
    """
    nested = charges.groupBy("doc_id", "unit_row_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "code", "amount", "category")))
        .alias("charges"))
    return units.join(nested, ["doc_id", "unit_row_id"], "left")
