"""Reconciling calculated figures with the totals a document prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitwise.functions.scalars import col, norm_rate_pct, unsentinel

WIDE = "decimal(28,2)"
STATED_FIELDS = (
    "stated_units", "stated_rent", "stated_market", "stated_sqft", "stated_rate",
    "stated_occupied", "stated_vacant")


def band(stated: Column, share: str = "0.005", floor: str = "5") -> Column:
    """Tolerance: a share of the stated figure, never below the floor."""
    return F.greatest(F.expr(f"{floor}.0"), stated * F.expr(share))


def unit_count(stated, total, counted, residential) -> Column:
    """Which reading of the unit count the document prints, or NULL."""
    s, t, c, r = (col(x) for x in (stated, total, counted, residential))
    return (F.when(t == s, "all").when(c == s, "counted_units")
            .when((r > 0) & (r < t) & (r == s), "residential_only"))


def _slack() -> Column:
    return F.col("model_units") + F.col("down_units") + F.col("applicant_units")


def occupied(stated) -> Column:
    """Struct of ok, physical, slack and diff for a stated occupied count."""
    s = col(stated)
    physical = F.col("occupied_units") + F.col("notice_units")
    diff = F.least(F.abs(s - physical), F.when(
        F.col("notice_units") > 0, F.abs(s - F.col("occupied_units"))))
    return F.when(s.isNotNull(), F.struct(
        (diff <= F.greatest(F.lit(1), _slack())).alias("ok"), physical.alias("physical"),
        _slack().alias("slack"), diff.alias("diff")))


def vacant(stated) -> Column:
    """Struct of ok, vacant, slack and diff for a stated vacant count."""
    s = col(stated)
    diff = F.abs(s - F.col("vacant_units"))
    return F.when(s.isNotNull(), F.struct(
        (diff <= F.greatest(F.lit(1), _slack())).alias("ok"),
        F.col("vacant_units").alias("vacant"), _slack().alias("slack"), diff.alias("diff")))


def rent(stated, tenant, non_tenant, reductions=None, subsidy=None) -> Column:
    """Why a stated rent total differs from the tenant rent, if it does.

    Exact, then rent on units without tenants, then the closest of three
    quoting conventions, then tolerance without a reason, then a mismatch.
    """
    zero = F.lit(0).cast(WIDE)
    s, t = col(stated).cast(WIDE), col(tenant).cast(WIDE)
    extra = F.coalesce(col(non_tenant).cast(WIDE), zero)
    cut = zero if reductions is None else F.coalesce(col(reductions).cast(WIDE), zero)
    sub = zero if subsidy is None else F.coalesce(col(subsidy).cast(WIDE), zero)
    diff = F.abs(s - t)
    tol = band(s)
    extra_gap = F.abs(s - (t + extra))

    part = lambda label, amount: F.struct(
        F.lit(label).alias("label"), amount.cast(WIDE).alias("amount"))
    added, removed = part("reductions added back", -cut), part("subsidy removed", -sub)
    variant = lambda no, value, *parts: F.struct(
        F.abs(s - value).cast(WIDE).alias("gap"), F.lit(no).alias("no"),
        (value != t).alias("differs"), F.array(*parts).alias("parts"))
    options = F.array(
        variant(1, t - cut, added), variant(2, t - sub, removed),
        variant(3, t - cut - sub, added, removed))
    best = F.array_min(F.filter(options, lambda v: v["differs"] & (v["gap"] <= tol)))

    def verdict(ok, basis, residual, parts=None):
        return F.struct(
            F.lit(ok).alias("ok"), F.lit(basis).alias("basis"),
            F.lit(basis == "exact").alias("exact"),
            F.lit(basis == "non_tenant_rent").alias("by_non_tenant"),
            diff.cast(WIDE).alias("diff"), residual.cast(WIDE).alias("residual"),
            (F.array().cast(f"array<struct<label:string,amount:{WIDE}>>")
             if parts is None else parts).alias("components"))

    return (
        F.when(s.isNull() | t.isNull(), None)
        .when(diff <= 1, verdict(True, "exact", zero))
        .when((extra > 0) & (extra_gap <= tol),
              verdict(True, "non_tenant_rent", extra_gap,
                      F.array(part("rent on units without tenants", extra))))
        .when(best.isNotNull(), verdict(True, "convention", best["gap"], best["parts"]))
        .when(diff <= s * F.expr("0.01"), verdict(True, "unexplained_in_tolerance", diff))
        .otherwise(verdict(False, "mismatch", diff)))


def stated_or_null(stated: DataFrame) -> DataFrame:
    """Negative sentinels become NULL, the rate a percentage; all-NULL rows go."""
    clean = stated.select("doc_id", *[unsentinel(f).alias(f) for f in STATED_FIELDS])
    return (clean.withColumn("stated_rate", norm_rate_pct("stated_rate").cast("decimal(12,4)"))
            .filter(F.coalesce(*[F.col(f).cast("string") for f in STATED_FIELDS]).isNotNull()))


def fill_stated(own: DataFrame, other: DataFrame) -> DataFrame:
    """Fill what a sheet does not state from totals harvested elsewhere."""
    o = other.select("doc_id", *[F.col(f).alias(f"_o_{f}") for f in STATED_FIELDS])
    return own.join(o, "doc_id", "left").select(
        "doc_id", *[F.coalesce(f, f"_o_{f}").alias(f) for f in STATED_FIELDS])


def merge_stated(sheets: DataFrame) -> DataFrame:
    """Stated totals of a document over its sheets; rates are not averaged."""
    sums = [f for f in STATED_FIELDS if f != "stated_rate"]
    return sheets.groupBy("doc_id").agg(
        *[F.sum(f).cast(WIDE).alias(f) for f in sums],
        F.when(F.count(F.lit(1)) == 1, F.max("stated_rate")).alias("stated_rate"))


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """First stated value of each field in chunk order."""
    return chunks.groupBy("doc_id").agg(*[
        F.min_by(f, F.when(F.col(f).isNotNull(), F.col("chunk"))).alias(f)
        for f in STATED_FIELDS])


def compare_stated(stated, calculated, percent: str = "0.01") -> Column:
    """Display match: within one percent of the stated figure or below one."""
    s, c = col(stated), col(calculated)
    gap = F.abs(s - c)
    return F.when(s.isNotNull() & c.isNotNull(), (gap <= s * F.expr(percent)) | (gap < 1)).otherwise(True)


def mismatch_hypotheses(profile: DataFrame) -> DataFrame:
    """Arithmetic tests of the usual reasons for a failed check."""
    extra = F.coalesce("non_tenant_rent", F.lit(0).cast(WIDE))
    return profile.select(
        "doc_id",
        F.coalesce(F.abs(F.col("stated_rent") - (F.col("total_monthly_rent") + extra)) <= 1,
                   F.lit(False)).alias("rent_includes_non_tenant"),
        F.coalesce(F.col("stated_occupied") == F.col("occupied_units") + F.col("notice_units"),
                   F.lit(False)).alias("occupied_includes_notice"),
        F.coalesce(F.col("stated_vacant") == F.col("vacant_units") + F.col("applicant_units"),
                   F.lit(False)).alias("vacant_includes_applicant"),
        "units_without_sqft")
