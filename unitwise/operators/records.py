"""Records, exports, review edits and usage costs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitwise import schema
from unitwise.functions import fixed_values as V
from unitwise.functions import scalars as S
from unitwise.operators.quality import count_match
from unitwise.operators.stats import summary_stats


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One record per job, with the fixed schema (no inference pass)."""
    return spark.read.schema(schema.RECORD).json(path)


def upsert_records(current: DataFrame, changes: DataFrame, key: str = "job_id",
                   set_fields: str | None = None, order: str | None = None) -> DataFrame:
    """Shallow merge: fields a change sets replace the stored ones.

    A change sets its non-NULL fields, or exactly those named in its array
    column ``set_fields``, which can also set NULL. Of several changes of a job to one
    field the one of greatest ``order`` counts (of greatest value without an order).
    Changes to unknown jobs are dropped.
    """
    fields = [c for c in current.columns if c != key]
    given = [c for c in fields if c in changes.columns]
    sets = lambda c: F.array_contains(set_fields, c) if set_fields else F.col(c).isNotNull()
    rank = lambda c: F.struct(*([order] if order else []), F.col(c).alias("_value"))
    new = changes.groupBy(key).agg(
        *[F.max_by(F.struct(F.col(c).alias("v")), F.when(sets(c), rank(c))).alias(f"_new_{c}") for c in given])
    out = current.join(new, key, "left")

    def merged(c: str) -> Column:
        if c not in given:
            return F.col(c)
        return F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}")["v"]).otherwise(F.col(c))

    return out.select(key, *[merged(c).alias(c) for c in fields])


def write_records(records: DataFrame, path: str, version: str) -> str:
    """Write a new version directory; readers switch when it is complete."""
    target = f"{path}/version={version}"
    records.write.mode("errorifexists").json(target)
    return target


def write_extractions(path: str, summary: DataFrame, stated: DataFrame, checks: DataFrame,
                      units: DataFrame, issues: DataFrame) -> None:
    """JSON output: one header per document, units and issues beside it.

    Checks number at most eight per document and are nested in the header. A
    document's units and issues have no such bound: they are JSON lines keyed
    by document, so a document of any size is written in parallel.
    """
    nested = checks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        *[F.col(c) for c in checks.columns if c != "doc_id"]))).alias("checks"))
    body = lambda df, name: df.select("doc_id", F.struct(
        *[F.col(c) for c in df.columns if c != "doc_id"]).alias(name))
    header = (
        body(summary, "summary").join(body(stated, "stated"), "doc_id", "full")
        .join(nested, "doc_id", "left"))
    header.write.mode("overwrite").json(f"{path}/documents")
    units.write.mode("overwrite").json(f"{path}/units")
    issues.write.mode("overwrite").json(f"{path}/issues")


def export_vendor(units: DataFrame) -> DataFrame:
    """The fifteen-column vendor layout; six columns are always empty."""
    status = F.when(F.col("status") == "occupied", "O").when(
        F.col("status").isin(*V.STATUSES), F.initcap("status")).otherwise(F.col("status"))
    filled = {
        "Unit #": F.col("unit_number"), "Unit Type": F.col("unit_type"),
        "Square Foot": F.col("unit_sqft"), "Status": status, "Tenant Name": F.col("tenant_name"),
        "Tenant Paid": F.col("monthly_rent"),
        "Move In Date": S.date_to_serial("move_in_date"),
        "Lease Start Date": S.date_to_serial("lease_start_date"),
        "Lease End Date": S.date_to_serial("lease_end_date"),
    }
    return units.select("doc_id", "unit_row_id", *[
        filled.get(h, F.lit(None).cast("string")).alias(h) for h in V.VENDOR_HEADERS])


def export_units(units: DataFrame) -> DataFrame:
    """The sixteen-column review layout, as texts.

    In some columns zero and empty both show as blank, in the others only a
    missing value does.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string")).otherwise("")
    known = set(units.columns)
    columns = dict(zip(V.REVIEW_HEADERS, (
        "unit_number", "building", "status", "unit_type", "unit_sqft", "monthly_rent",
        "market_rent", "subsidy_rent", "employee_discount", "concession", "tenant_name",
        "lease_start_date", "lease_end_date", "move_in_date", "move_out_date", "lease_status")))
    pick = {"Sqft": nonzero, "Monthly Rent": nonzero}
    return units.select("doc_id", "unit_row_id", *[
        (pick.get(h, text)(c) if c in known else F.lit("")).alias(h) for h, c in columns.items()])


def list_extractions(records: DataFrame, issues: DataFrame, tally: DataFrame) -> DataFrame:
    """Listing with critical issues and check counts, newest first."""
    critical = issues.filter(F.col("severity") == "critical").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("critical_issues"))
    return (
        records.join(critical, "doc_id", "left").join(tally, "doc_id", "left")
        .withColumns({
            "critical_issues": F.coalesce("critical_issues", F.lit(0).cast("bigint")),
            "count_match": count_match("stated_units", "extracted_units")})
        .orderBy(F.desc("uploaded_at"), "doc_id"))


def review_edits(units: DataFrame, edits: DataFrame, deletes: DataFrame,
                 added: DataFrame | None = None, key: str = "unit_row_id") -> DataFrame:
    """Cell edits, deleted and added units laid over the extracted ones.

    ``edits`` is long (doc_id, key, field, value, edit_no); the last edit of a
    field wins and its text is read as the field's type.
    """
    fields = [c for c in units.columns if c not in ("doc_id", key)]
    latest = edits.groupBy("doc_id", key).agg(*[
        F.max_by(F.struct("value"), F.when(F.col("field") == c, F.col("edit_no"))).alias(f"_e_{c}")
        for c in fields])
    types = dict(units.dtypes)
    kept = units.join(deletes.select("doc_id", key), ["doc_id", key], "left_anti").join(
        latest, ["doc_id", key], "left")
    out = kept.select("doc_id", key, *[
        F.when(F.col(f"_e_{c}").isNotNull(), F.col(f"_e_{c}.value").try_cast(types[c]))
        .otherwise(F.col(c)).alias(c) for c in fields])
    return out if added is None else out.unionByName(added, allowMissingColumns=True)


def reviewed_summary(units: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """Statistics after a review, with the approval state."""
    out = summary_stats(units)
    if approved is None:
        return out.withColumn("state", F.lit("review"))
    return out.join(approved.select("doc_id").distinct().withColumn("_a", F.lit(True)),
                    "doc_id", "left").withColumn(
        "state", F.when(F.col("_a"), "approved").otherwise("review")).drop("_a")


class Rate(NamedTuple):
    """Price per million tokens of models whose id contains ``match``."""

    match: str
    input: float
    cache_write: float
    cache_read: float
    output: float
    valid_from: str | None = None
    valid_to: str | None = None


def price_usage(usage: DataFrame, rates: list[Rate]) -> DataFrame:
    """Cost of each call; the first rate that matches model and day applies.

    The rates are a short configured list, so they become one CASE expression:
    nothing is joined and no call row is moved. Unknown models have NULL cost.
    """
    model, day = F.lower("model"), F.col("used_at")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)")
    price = lambda x: F.lit(str(x)).cast("decimal(10,4)")
    cost = None
    for r in rates:
        hit = model.contains(r.match.lower())
        if r.valid_from:
            hit = hit & (day >= F.to_timestamp(F.lit(r.valid_from)))
        if r.valid_to:
            hit = hit & (day < F.to_timestamp(F.lit(r.valid_to)))
        value = (
            n("input_tokens") * price(r.input) + n("cache_write_tokens") * price(r.cache_write)
            + n("cache_read_tokens") * price(r.cache_read) + n("output_tokens") * price(r.output)
        ) / F.lit(1000000)
        cost = F.when(hit, value) if cost is None else cost.when(hit, value)
    return usage.withColumn("cost", cost.cast("decimal(28,8)"))


def usage_totals(priced: DataFrame, key: str = "run_id") -> DataFrame:
    """Tokens, last model and cost per run; NULL cost when nothing had a price."""
    return priced.groupBy(key).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.max_by("model", "seq").alias("last_model"),
        F.sum("cost").cast("decimal(28,6)").alias("cost"))


def populated_only(units: DataFrame, present: list[str]) -> DataFrame:
    """Display form: optional columns nobody fills are left out."""
    hidden = [c for c in V.OPTIONAL_FIELDS if c in units.columns and c not in present]
    return units.drop(*hidden)
