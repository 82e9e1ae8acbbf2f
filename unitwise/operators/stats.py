"""Document-level statistics over unit rows: one partial aggregation per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitwise.functions import fixed_values as V

TOTAL = "decimal(28,2)"


def tenanted() -> Column:
    return F.col("status").isin(*V.TENANT_STATUSES)


def pays_rent() -> Column:
    return tenanted() & (F.col("monthly_rent") > 0)


def _total(value, when: Column | None = None) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    if when is not None:
        v = F.when(when, v)
    return F.sum(v).cast(TOTAL)


def _ratio(top: str, bottom: str, digits: int, kind: str) -> Column:
    """top / bottom rounded half up, in whole-number arithmetic."""
    unit = 10 ** digits
    return F.expr(
        f"cast(((cast({top} as decimal(38,0)) * {2 * unit} + {bottom}) div (2 * {bottom}))"
        f" as {kind})") / F.lit(unit)


def status_counts(units: DataFrame) -> DataFrame:
    """Units per status; texts outside the closed set count nowhere."""
    out = units.groupBy("doc_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_units") for s in V.STATUSES])
    return out.withColumn("physical", F.col("occupied_units") + F.col("notice_units"))


def non_tenant_rent(units: DataFrame) -> DataFrame:
    """Rent booked to units without a tenant in place; NULL when none."""
    return units.groupBy("doc_id").agg(_non_tenant().alias("non_tenant_rent"))


def _non_tenant() -> Column:
    return F.nullif(
        _total("monthly_rent", ~tenanted() & (F.col("monthly_rent") > 0)), F.lit(0).cast(TOTAL))


def summary_stats(units: DataFrame, charges: DataFrame | None = None) -> DataFrame:
    """All property statistics per document; totals nothing adds to are NULL."""
    has_sqft = F.col("unit_sqft") > 0
    sqft = F.col("unit_sqft").cast("decimal(18,2)")
    agg = units.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_units"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_units") for s in V.STATUSES],
        _total(sqft, has_sqft).alias("total_sqft"),
        F.count_if(has_sqft).alias("_n_sqft"),
        _total("monthly_rent", pays_rent()).alias("total_monthly_rent"),
        F.count_if(pays_rent()).alias("_n_rent"),
        _non_tenant().alias("non_tenant_rent"),
        _total("market_rent").alias("total_market_rent"),
        _total("subsidy_rent", pays_rent()).alias("total_subsidy_rent"),
        _total("employee_discount").alias("total_employee_discount"),
        _total("concession").alias("total_concessions"),
        _total("monthly_rent", pays_rent() & has_sqft).alias("_rent_both"),
        _total(sqft, pays_rent() & has_sqft).alias("_sqft_both"),
        F.count_if(F.coalesce(F.col("category") == "residential", F.lit(False)))
        .alias("residential_units"),
        F.count_if(F.coalesce(F.col("include_in_unit_count"), F.lit(True)))
        .alias("counted_units"),
    )
    out = agg.withColumns({
        "_phys": F.col("occupied_units") + F.col("notice_units"),
        "_rent_c": F.col("total_monthly_rent") * 100,
        "_sqft_c": F.col("total_sqft") * 100,
        "_n_rent_c": F.nullif(F.col("_n_rent") * 100, F.lit(0)),
        "_n_sqft_c": F.nullif(F.col("_n_sqft") * 100, F.lit(0)),
        "_rb": F.col("_rent_both") * 100,
        "_sb": (F.col("_sqft_both") * 100).cast("decimal(38,0)"),
    }).withColumns({
        "physical_occupancy": _ratio("_phys * 100", "total_units", 2, "decimal(12,2)")
        .cast("decimal(12,2)"),
        "total_tenant_paid_rent": (
            F.col("total_monthly_rent") - F.coalesce("total_subsidy_rent", F.lit(0))).cast(TOTAL),
        "average_rent": _ratio("_rent_c", "_n_rent_c", 0, "bigint").cast("bigint"),
        "average_sqft": _ratio("_sqft_c", "_n_sqft_c", 0, "bigint").cast("bigint"),
        "average_rent_per_sqft": _ratio("_rb", "_sb", 2, "decimal(18,2)").cast("decimal(18,2)"),
    })
    names = [
        "doc_id", "total_units", *[f"{s}_units" for s in V.STATUSES],
        "physical_occupancy", "total_sqft", "total_monthly_rent", "non_tenant_rent",
        "total_market_rent", "total_subsidy_rent", "total_tenant_paid_rent",
        "total_employee_discount", "total_concessions", "average_rent", "average_sqft",
        "average_rent_per_sqft", "residential_units", "counted_units",
    ]
    out = out.select(*names)
    if charges is None:
        return out
    from unitwise.operators.codes import ancillary_total
    return (
        out.join(ancillary_total(charges), "doc_id", "left")
        .withColumn("has_itemized_charges", F.col("n_lines").isNotNull()).drop("n_lines"))


def status_rent_breakdown(units: DataFrame) -> DataFrame:
    """Count and rent per status, for explaining a difference."""
    return units.groupBy("doc_id", "status").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.sum(F.coalesce("monthly_rent", F.lit(0))).cast(TOTAL).alias("total_rent"))


def populated_fields(units: DataFrame, fields: tuple[str, ...] = V.OPTIONAL_FIELDS) -> DataFrame:
    """Which optional fields hold any value, per document."""
    present = [f for f in fields if f in units.columns]
    return units.groupBy("doc_id").agg(*[
        F.coalesce(F.bool_or(F.col(f).isNotNull() & (F.col(f).cast("string") != "")), F.lit(False))
        .alias(f"has_{f}") for f in present])


def typed_share(units: DataFrame, type_text: Column) -> DataFrame:
    """Typed rows per document, and whether a missing type means anything."""
    from unitwise.functions.scalars import is_blankish
    return units.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(~is_blankish(type_text)).alias("n_typed"),
    ).withColumn("contrast", (F.col("n_typed") >= 3) & (F.col("n_typed") * 4 >= F.col("n_units")))
