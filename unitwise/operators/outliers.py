"""Cell highlights: statistical outliers and implausible values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitwise.functions import fixed_values as V
from unitwise.functions.scan import order_statistics
from unitwise.operators.stats import pays_rent, tenanted


def quartiles(units: DataFrame, fields: dict[str, tuple[str, Column]]) -> DataFrame:
    """Quartiles (no interpolation), median and fences per document and field, all fields in one pass.

    ``fields`` maps a name to the column and the condition of the rows that count.
    """
    pool = units.select("doc_id", F.explode(F.array_compact(F.array(*[
        F.when(when, F.struct(F.lit(name).alias("name"), F.col(value).cast("decimal(18,2)").alias("v")))
        for name, (value, when) in fields.items()]))).alias("x")).select("doc_id", "x.name", "x.v")
    n = F.col("_n")
    q = order_statistics(pool, ["doc_id", "name"], "v", {
        "q1": F.floor(n * F.expr("0.25")), "q3": F.floor(n * F.expr("0.75")),
        "m1": F.floor((n - 1) / 2), "m2": F.floor(n / 2)}, levels=2)  # cents below 2^32 are 2^16 ranges
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        "doc_id", "name", "n", "q1", "q3", ((F.col("m1") + F.col("m2")) / 2).cast("decimal(18,3)")
        .alias("median"), iqr.cast("decimal(18,2)").alias("iqr"),
        (F.col("q1") - iqr * F.expr("1.5")).cast("decimal(18,3)").alias("lower"),
        (F.col("q3") + iqr * F.expr("1.5")).cast("decimal(18,3)").alias("upper"))


def iqr_bounds(units: DataFrame, value: str, when: Column) -> DataFrame:
    """:func:`quartiles` of one field, with total and standard deviation."""
    pool = units.filter(when).select("doc_id", F.col(value).cast("decimal(18,2)").alias("v"))
    mean = pool.filter("v IS NOT NULL").groupBy("doc_id").agg(
        F.sum("v").cast("decimal(28,2)").alias("total"),
        F.stddev_pop(F.col("v").cast("double")).alias("std_dev"))
    return quartiles(units, {value: (value, when)}).drop("name").join(mean, "doc_id")


def highlights(units: DataFrame, pos: str = "unit_row_id") -> DataFrame:
    """One row per highlighted field; the last matching rule of a field stands."""
    stats = quartiles(units, {"r": ("monthly_rent", pays_rent()), "s": ("unit_sqft", F.col("unit_sqft") > 0)})
    bounds = stats.groupBy("doc_id").agg(*[
        F.max(F.when(F.col("name") == k, F.col(c))).alias(f"{k}_{c}") for k in ("r", "s") for c in ("n", "iqr", "lower", "upper")])
    t = units.join(bounds, "doc_id", "left")
    rent, sqft = F.col("monthly_rent"), F.col("unit_sqft").cast("decimal(18,2)")
    outside = lambda v, p: (F.col(f"{p}_n") >= 5) & (F.col(f"{p}_iqr") > 0) & (
        (v < F.col(f"{p}_lower")) | (v > F.col(f"{p}_upper")))
    name = F.trim(F.coalesce("tenant_name", F.lit("")))
    rent_type = (
        F.when(rent > 10000, "warning")
        .when((rent > 0) & (rent < 100), "warning")
        .when(tenanted() & (F.coalesce(rent, F.lit(0)) == 0), "critical")
        .when(tenanted() & outside(rent, "r"), "outlier"))
    sqft_type = (
        F.when(sqft > 5000, "warning").when((sqft > 0) & (sqft < 200), "warning")
        .when(outside(sqft, "s"), "outlier"))
    name_type = (
        F.when((F.col("status") == "occupied") & (name == ""), "warning")
        .when(F.col("status").isin("vacant", "model", "down") & (name != "")
              & ~F.lower(name).isin(*V.HIGHLIGHT_PLACEHOLDER_NAMES), "warning"))
    cell = lambda field, kind: F.when(kind.isNotNull(), F.struct(
        F.lit(field).alias("field"), kind.alias("type")))
    found = F.array_compact(F.array(
        cell("monthlyRent", rent_type), cell("unitSqft", sqft_type),
        cell("tenantName", name_type)))
    return t.select("doc_id", pos, F.explode(found).alias("h")).select("doc_id", pos, "h.*")


def highlight_counts(marks: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("type") == k)
    return marks.groupBy("doc_id").agg(
        n("outlier").alias("outliers"), n("warning").alias("warnings"),
        n("critical").alias("critical"), F.count(F.lit(1)).alias("total"))


def issue_order(marks: DataFrame, pos: str = "unit_row_id") -> DataFrame:
    """Most severe first, then by row, for stepping through a document."""
    kind, field = F.col("type"), F.col("field")
    rank = F.when(kind == "critical", 0).when(kind == "warning", 1).otherwise(2)
    place = F.when(field == "monthlyRent", 0).when(field == "unitSqft", 1).otherwise(2)
    return marks.orderBy("doc_id", rank, pos, place)
