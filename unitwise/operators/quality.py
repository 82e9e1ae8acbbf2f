"""Validation issues and verification checks, as long tables over all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitwise.functions import scalars as S
from unitwise.operators import reconcile as R
from unitwise.operators.stats import summary_stats

SEVERITY = {"critical": 0, "warning": 1, "info": 2}


def _key() -> Column:
    side = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return F.concat_ws("|", side("building"), side("unit_number"))


def _label() -> Column:
    return F.when(F.coalesce(F.col("building"), F.lit("")) != "",
                  F.concat_ws(" ", "building", "unit_number")).otherwise(F.col("unit_number"))


def duplicate_units(units: DataFrame, pos: str = "unit_row_id") -> DataFrame:
    """Building and unit pairs on more than one row, labelled by the first copy."""
    return (
        units.groupBy("doc_id", _key().alias("unit_key"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min_by(_label(), pos).alias("label"),
             F.min(pos).alias("first_row"))
        .filter(F.col("copies") > 1))


def duplicate_copies(units: DataFrame, pos: str = "unit_row_id") -> DataFrame:
    """Every row that shares its building and unit with another one."""
    keyed = units.withColumn("unit_key", _key())
    return keyed.join(
        duplicate_units(units, pos).select("doc_id", "unit_key", "copies"),
        ["doc_id", "unit_key"]).select("doc_id", "unit_key", pos, "copies")


def unit_gaps(units: DataFrame, most: int = 3) -> DataFrame:
    """Single missing numbers in densely numbered prefixes, the first few each.

    A number is missing when both neighbours exist and it does not: every
    number votes for the gap above, the gap below and itself, so the test is an
    aggregation on the number and needs no ordered pass over a document.
    """
    shaped = units.select(
        "doc_id", S.unit_prefix("unit_number").alias("prefix"),
        S.unit_serial("unit_number").alias("n")).filter(
        F.col("prefix").isNotNull() & F.col("n").isNotNull())
    numbers = shaped.groupBy("doc_id", "prefix", "n").agg(F.count(F.lit(1)).alias("_c"))
    dense = (
        numbers.groupBy("doc_id", "prefix")
        .agg(F.sum("_c").alias("rows"), F.count(F.lit(1)).alias("distinct_n"),
             (F.max("n") - F.min("n") + 1).alias("span"))
        .filter((F.col("rows") >= 10) & (F.col("distinct_n") * 5 >= F.col("span") * 4)))
    votes = numbers.select("doc_id", "prefix", F.explode(F.array(
        F.struct((F.col("n") - 1).alias("n"), F.lit(1).alias("bit")),
        F.struct(F.col("n").alias("n"), F.lit(2).alias("bit")),
        F.struct((F.col("n") + 1).alias("n"), F.lit(4).alias("bit")))).alias("v"))
    gaps = (votes.groupBy("doc_id", "prefix", F.col("v.n").alias("missing"))
            .agg(F.bit_or("v.bit").alias("bits")).filter(F.col("bits") == 5).drop("bits"))
    w = Window.partitionBy("doc_id", "prefix").orderBy("missing")
    return (
        gaps.join(dense.select("doc_id", "prefix"), ["doc_id", "prefix"], "left_semi")
        .withColumn("gap_no", F.row_number().over(w).cast("bigint"))
        .filter(F.col("gap_no") <= most)
        .withColumn("missing_unit", F.concat("prefix", F.col("missing").cast("string")))
        .select("doc_id", "prefix", "missing_unit", "gap_no"))


def suspicious_flags() -> dict[str, Column]:
    """Row-level suspicion tests."""
    kind = F.regexp_replace("unit_type", r"[$,\s]", "")
    as_number = F.when(kind == "", F.lit("0")).otherwise(kind).try_cast("double")
    return {
        "occupied_without_rent": (F.col("status") == "occupied")
        & (F.coalesce("monthly_rent", F.lit(0)) == 0),
        "type_equals_rent": F.coalesce(
            (F.col("monthly_rent") != 0)
            & (F.abs(as_number - F.col("monthly_rent").cast("double")) < 0.005), F.lit(False)),
        "number_above_9000": F.coalesce(S.unit_digits("unit_number") > 9000, F.lit(False)),
    }


def suspicious_units(units: DataFrame, pos: str = "unit_row_id") -> DataFrame:
    """Units behind each suspicion, one row per unit and rule."""
    flagged = units.select("doc_id", pos, "unit_number", F.explode(F.array_compact(F.array(*[
        F.when(test, F.lit(name)) for name, test in suspicious_flags().items()]))).alias("rule"))
    return flagged


def suspicious_patterns(units: DataFrame) -> DataFrame:
    """Suspicions that count as an issue of the document."""
    n = F.col("n_units")
    return (
        suspicious_units(units).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n_units"))
        .filter(F.when(F.col("rule") == "occupied_without_rent", n <= 3)
                .when(F.col("rule") == "type_equals_rent", n >= 3).otherwise(True))
        .withColumn("severity", F.when(F.col("rule") == "type_equals_rent", "critical")
                    .otherwise("warning")))


def missing_unit_numbers(units: DataFrame, pos: str = "unit_row_id") -> DataFrame:
    return units.filter(F.coalesce(F.trim("unit_number"), F.lit("")) == "").select("doc_id", pos)


def document_profile(units: DataFrame, stated: DataFrame, pos: str = "unit_row_id") -> DataFrame:
    """Everything document-level checks need, one row per document."""
    extra = units.groupBy("doc_id").agg(
        F.count_if(F.coalesce(F.trim("unit_number"), F.lit("")) == "").alias("missing_numbers"),
        F.count_if(F.col("unit_sqft").isNull()).alias("units_without_sqft"))
    dup = duplicate_units(units, pos).groupBy("doc_id").agg(
        F.sum(F.col("copies") - 1).alias("duplicate_rows"))
    counts = ["total_units", "occupied_units", "vacant_units", "notice_units", "model_units",
              "down_units", "applicant_units", "residential_units", "counted_units",
              "missing_numbers", "units_without_sqft", "duplicate_rows"]
    profile = (
        summary_stats(units).join(extra, "doc_id").join(dup, "doc_id", "left")
        .join(stated, "doc_id", "full"))
    return profile.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts})


def count_match(stated, extracted) -> Column:
    """Strict equality; NULL when the document states no count."""
    return F.col(stated) == F.col(extracted)


def _check(check_id: str, status: Column, stated, calculated, basis=None) -> Column:
    wide = lambda c: (F.lit(None) if c is None else S.col(c)).cast(R.WIDE)
    return F.struct(
        F.lit(check_id).alias("check_id"), status.alias("status"),
        wide(stated).alias("stated"), wide(calculated).alias("calculated"),
        (F.lit(None).cast("string") if basis is None else basis).alias("basis"))


def _verdict(ok: Column, when: Column | None = None) -> Column:
    passed = F.when(ok, "passed").otherwise("failed")
    return passed if when is None else F.when(~when, "skipped").otherwise(passed)


def _stated_and_nonzero(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.coalesce(F.col(c), F.lit(0)) != 0)
    return out


def verify_profile(profile: DataFrame) -> DataFrame:
    """The checks of a document, exploded from its profile row."""
    reading = R.unit_count("stated_units", "total_units", "counted_units", "residential_units")
    reductions = (F.coalesce("total_concessions", F.lit(0)) +
                  F.coalesce("total_employee_discount", F.lit(0)))
    rent = R.rent("stated_rent", "total_monthly_rent", "non_tenant_rent", reductions,
                  "total_subsidy_rent")
    sqft_gap = F.abs(F.col("stated_sqft") - F.col("total_sqft"))
    market_gap = F.abs(F.col("stated_market") - F.col("total_market_rent"))
    has_market = F.col("stated_market").isNotNull() & F.col("total_market_rent").isNotNull()
    any_market = F.col("stated_market").isNotNull() | F.col("total_market_rent").isNotNull()
    rent_known = _stated_and_nonzero("stated_rent", "total_monthly_rent")
    checks = F.array_compact(F.array(
        _check("unit-count", _verdict(reading.isNotNull(), F.col("stated_units").isNotNull()),
               "stated_units", "total_units", reading),
        _check("no-duplicates", _verdict(F.col("duplicate_rows") == 0), None, "duplicate_rows"),
        _check("no-missing-numbers", _verdict(F.col("missing_numbers") == 0), None,
               "missing_numbers"),
        _check("total-rent", _verdict(rent["ok"], rent_known), "stated_rent",
               "total_monthly_rent", F.when(rent_known, rent["basis"])),
        _check("occupied-count",
               _verdict(R.occupied("stated_occupied")["ok"], F.col("stated_occupied").isNotNull()),
               "stated_occupied", F.col("occupied_units") + F.col("notice_units")),
        _check("vacant-count",
               _verdict(R.vacant("stated_vacant")["ok"], F.col("stated_vacant").isNotNull()),
               "stated_vacant", "vacant_units"),
        _check("total-sqft",
               _verdict((sqft_gap <= F.col("stated_sqft") * F.expr("0.01")) | (sqft_gap <= 10),
                        _stated_and_nonzero("stated_sqft", "total_sqft")),
               "stated_sqft", "total_sqft"),
        F.when(any_market, _check(
            "total-market-rent",
            _verdict(market_gap <= R.band(F.col("stated_market")), has_market),
            "stated_market", "total_market_rent"))))
    return profile.select("doc_id", F.explode(checks).alias("c")).select("doc_id", "c.*")


def verify(units: DataFrame, stated: DataFrame, pos: str = "unit_row_id") -> DataFrame:
    """Seven or eight checks per document: passed, failed or skipped."""
    return verify_profile(document_profile(units, stated, pos))


def check_tally(checks: DataFrame) -> DataFrame:
    """Counts per document and the confidence they give."""
    n = lambda s: F.count_if(F.col("status") == s)
    t = checks.groupBy("doc_id").agg(
        n("passed").alias("passed"), n("failed").alias("failed"), n("skipped").alias("skipped"),
        F.count(F.lit(1)).alias("total"))
    return t.withColumn("confidence", F.when(
        (F.col("failed") == 0) & (F.col("skipped") <= 2), "high").when(
        (F.col("failed") <= 1) & (F.col("passed") >= 3), "medium").otherwise("low"))


_ISSUE = ("doc_id", "type", "severity", "rule", "label", "n", "stated", "calculated", "seq")


def _issue(df: DataFrame, kind, severity, rule, label, n, seq, stated=None, calculated=None):
    c = lambda x, t: (F.lit(None) if x is None else S.col(x)).cast(t)
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        "doc_id", lit(kind).alias("type"), lit(severity).alias("severity"),
        lit(rule).alias("rule"), c(label, "string").alias("label"), c(n, "bigint").alias("n"),
        c(stated, R.WIDE).alias("stated"), c(calculated, R.WIDE).alias("calculated"),
        F.lit(seq).alias("seq"))


def summary_mismatches(profile: DataFrame) -> DataFrame:
    """Stated against calculated figures; this reading knows no conventions."""
    rent = R.rent("stated_rent", "total_monthly_rent", "non_tenant_rent")
    occ, vac = R.occupied("stated_occupied"), R.vacant("stated_vacant")
    sqft_gap = F.abs(F.col("stated_sqft") - F.col("total_sqft"))
    rate = S.norm_rate_pct("stated_rate")
    entry = lambda field, severity, bad, stated, calculated: F.when(bad, F.struct(
        F.lit(field).alias("field"), F.lit(severity).alias("severity"),
        S.col(stated).cast(R.WIDE).alias("stated"),
        S.col(calculated).cast(R.WIDE).alias("calculated")))
    found = F.array_compact(F.array(
        entry("totalMonthlyRent", "warning", (F.col("total_monthly_rent") > 0) & ~rent["ok"],
              "stated_rent", "total_monthly_rent"),
        entry("totalSqft", "warning",
              (F.col("total_sqft") > 0) & (sqft_gap > F.col("stated_sqft") * F.expr("0.01"))
              & (sqft_gap > 10), "stated_sqft", "total_sqft"),
        entry("occupiedUnits", "warning", ~occ["ok"], "stated_occupied", occ["physical"]),
        entry("vacantUnits", "warning", ~vac["ok"], "stated_vacant", "vacant_units"),
        entry("occupancyRate", "info",
              (F.col("physical_occupancy") > 0) & (F.abs(rate - F.col("physical_occupancy")) > 1),
              rate, "physical_occupancy")))
    return profile.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


def validate(units: DataFrame, stated: DataFrame, pos: str = "unit_row_id") -> DataFrame:
    """All issues of all documents; order them with :func:`sorted_issues`."""
    profile = document_profile(units, stated, pos)
    reading = R.unit_count("stated_units", "total_units", "counted_units", "residential_units")
    counted = profile.filter(reading.isNull())
    mismatches = summary_mismatches(profile)
    parts = [
        _issue(missing_unit_numbers(units, pos), "missing_unit_number", "critical",
               "missing_unit_number", F.col(pos).cast("string"), F.lit(1), 1),
        _issue(duplicate_units(units, pos), "duplicate", "critical", "duplicate", "label",
               "copies", 2),
        _issue(counted, "count_mismatch",
               F.when(F.col("stated_units").isNull(), "warning").otherwise("critical"),
               "count_mismatch", None, None, 3, "stated_units", "total_units"),
        _issue(unit_gaps(units), "gap", "info", "gap", "missing_unit", F.lit(1), 4),
        _issue(suspicious_patterns(units), "suspicious", F.col("severity"), F.col("rule"),
               None, "n_units", 5),
        _issue(mismatches, "summary_mismatch", F.col("severity"), F.col("field"), None, None,
               6, "stated", "calculated"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def severity_rank(severity="severity") -> Column:
    s = F.col(severity)
    return F.when(s == "critical", 0).when(s == "warning", 1).otherwise(2)


def sorted_issues(issues: DataFrame) -> DataFrame:
    """Most severe first, in emission order within a severity."""
    return issues.orderBy("doc_id", severity_rank(), "seq", "rule", "label")
