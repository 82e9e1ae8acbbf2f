"""Gates over walked units: does the reading agree with what the sheet prints?

All gates work on any grouping of units (``keys``), usually document, sheet and
de-duplication convention, so both conventions are judged in the same jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitwise.functions import fixed_values as V
from unitwise.functions import scalars as S
from unitwise.functions.scan import running
from unitwise.operators import reconcile as R
from unitwise.operators.stats import TOTAL, tenanted
from unitwise.operators.walk import SHEET, Walk, dedupe_units
from unitwise.session import stage

FATIGUE_FIELDS = (
    "lease_start_date", "lease_end_date", "move_in_date", "move_out_date", "unit_sqft",
    "unit_type", "tenant_name")
CONVENTION = [*SHEET, "convention"]


def both_conventions(units: DataFrame) -> DataFrame:
    """Units de-duplicated under either convention, from one walk."""
    a, b = (dedupe_units(units, c) for c in V.CONVENTIONS)
    return a.unionByName(b)


def sheet_stated(structures: DataFrame) -> DataFrame:
    """What each sheet states, with sentinels removed."""
    s = F.col("stated_summary")
    money = lambda c: S.unsentinel(c).cast(TOTAL)
    return structures.select(
        *SHEET, S.unsentinel("stated_total_units").cast("bigint").alias("stated_units"),
        money(s["total_monthly_rent"]).alias("stated_rent"),
        money(s["total_market_rent"]).alias("stated_market"),
        money(s["total_sqft"]).alias("stated_sqft"),
        S.norm_rate_pct(S.unsentinel(s["occupancy_rate"])).cast("decimal(12,4)")
        .alias("stated_rate"),
        S.unsentinel(s["occupied_units"]).cast("bigint").alias("stated_occupied"),
        S.unsentinel(s["vacant_units"]).cast("bigint").alias("stated_vacant"))


def filled(field: str) -> Column:
    return F.col(field).isNotNull() & (F.col(field).cast("string") != "")


def fatigue_check(units: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Fields well filled in the first quarter of a document and not in the last.

    Quarters are the first and last ``floor(n / 4)`` units; the charge lines are
    judged over units with a tenant only.
    """
    keys = list(keys)
    sizes = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(tenanted()).alias("_t"))
    large = units.join(sizes.filter(F.col("_n") >= 60), keys)
    one = F.lit(1).cast("long")
    ranked = running(large, keys, pos, {"_r": one, "_tr": F.when(tenanted(), one).otherwise(0)},
                     levels=3)
    q, tq = F.floor(F.col("_n") / 4), F.floor(F.col("_t") / 4)
    first, last = F.col("_r") <= q, F.col("_r") > F.col("_n") - q
    tfirst = tenanted() & (F.col("_tr") <= tq)
    tlast = tenanted() & (F.col("_tr") > F.col("_t") - tq)
    has_lines = F.coalesce(F.col("n_lines") > 0, F.lit(False))
    agg = ranked.groupBy(*keys).agg(
        F.max(q).alias("q"), F.max(tq).alias("tq"), F.max("_t").alias("t"),
        *[F.count_if(first & filled(f)).alias(f"a_{f}") for f in FATIGUE_FIELDS],
        *[F.count_if(last & filled(f)).alias(f"b_{f}") for f in FATIGUE_FIELDS],
        F.count_if(tfirst & has_lines).alias("a_charges"),
        F.count_if(tlast & has_lines).alias("b_charges"))
    faded = lambda f, n: (F.col(f"a_{f}") * 2 >= F.col(n)) & (
        F.col(f"b_{f}") * 5 < F.col(f"a_{f}") * 2)
    found = [F.when(faded(f, "q"), F.lit(f)) for f in FATIGUE_FIELDS]
    found.append(F.when((F.col("t") >= 40) & faded("charges", "tq"), F.lit("charges")))
    return agg.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("field"))


class Verified:
    """Outcome of :func:`verify_against_stated`."""

    def __init__(self, outcome: DataFrame, issues: DataFrame):
        self.outcome, self.issues = outcome, issues


def verify_against_stated(units: DataFrame, stated: DataFrame, keys: Sequence[str],
                          pos: str) -> Verified:
    """Eight tests of extracted units against the totals the document states.

    Rent is summed over all units here. ``outcome`` has one row per key with
    ok, n_issues, has_anchors, the quoting convention that explains a rent gap
    and the stated totals after a misfiled market total moved to its place.
    """
    keys = list(keys)
    zero = F.lit(0)
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_units")
    dates = filled("lease_start_date") | filled("lease_end_date") | filled("move_in_date")
    sums = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(F.coalesce("include_in_unit_count", F.lit(True))).alias("counted"),
        F.count_if(F.coalesce(F.col("category") == "residential", F.lit(False))).alias("residential"),
        *[count(s) for s in V.STATUSES],
        F.sum(F.coalesce("monthly_rent", zero)).cast(TOTAL).alias("rent_sum"),
        F.sum(F.coalesce("market_rent", zero)).cast(TOTAL).alias("market_sum"),
        F.count("market_rent").alias("with_market"),
        F.sum(F.coalesce("concession", zero) + F.coalesce("employee_discount", zero))
        .cast(TOTAL).alias("reductions"),
        F.sum(F.coalesce("subsidy_rent", zero)).cast(TOTAL).alias("subsidy"),
        F.count_if(tenanted() & dates).alias("with_dates"))
    on = [k for k in keys if k in stated.columns]
    t = stated.join(sums, on, "left") if on == keys else sums.join(stated, on, "left")
    counts = ["n_units", "counted", "residential", "with_market", "with_dates",
              *[f"{s}_units" for s in V.STATUSES]]
    t = t.withColumns({c: F.coalesce(c, zero) for c in counts}).withColumns({
        c: F.coalesce(c, F.lit(0).cast(TOTAL)) for c in
        ("rent_sum", "market_sum", "reductions", "subsidy")})

    su, sr, sm = F.col("stated_units"), F.col("stated_rent"), F.col("stated_market")
    rent, market = F.col("rent_sum"), F.col("market_sum")
    count_ok = R.unit_count("stated_units", "n_units", "counted", "residential").isNotNull()
    off = F.abs(rent - sr) > R.band(sr)
    excused = (su > 0) & count_ok & (rent > sr) & (rent <= sr * F.expr("1.05"))
    misfiled = (sr > 0) & off & (market > 0) & (F.abs(market - sr) <= R.band(sr))
    fits = lambda v: (v != rent) & (F.abs(v - sr) <= R.band(sr))
    cut, sub = F.col("reductions"), F.col("subsidy")
    quoted = F.when((sr > 0) & off, F.when(fits(rent - cut), "gross")
                    .when(fits(rent - sub), "tenant_paid")
                    .when(fits(rent - cut - sub), "tenant_paid_gross"))
    tenant_units = F.col("occupied_units") + F.col("notice_units")
    occ = R.occupied("stated_occupied")
    false = F.lit(False)
    tests = {
        "unit_count": (su > 0) & ~count_ok,
        "total_rent": (sr > 0) & off & ~misfiled & quoted.isNull() & ~F.coalesce(excused, false),
        "market_rent": (sm > 0) & (F.col("with_market") * 5 >= F.col("n_units") * 4)
        & (F.abs(market - sm) > R.band(sm)),
        "no_dates": (F.col("n_units") >= 60) & (tenant_units >= 40)
        & (F.col("with_dates") * 20 < tenant_units),
        "occupied": ~occ["ok"] & (
            occ["diff"] > F.greatest(F.lit(1.0), F.col("stated_occupied") * 0.05)),
        "no_units": F.col("n_units") == 0,
    }
    t = t.withColumns({
        "_rules": F.array_compact(F.array(*[
            F.when(F.coalesce(c, false), F.lit(name)) for name, c in tests.items()])),
        "quoted": F.when(~F.coalesce(misfiled, false), quoted),
        "has_anchors": F.coalesce(su > 0, false) | F.coalesce(sr > 0, false)
        | F.coalesce(sm > 0, false) | F.col("stated_occupied").isNotNull(),
        "_misfiled": F.coalesce(misfiled, false),
    })
    tired = fatigue_check(units, keys, pos).select(
        *keys, F.concat(F.lit("fatigue:"), "field").alias("rule"))
    issues = t.select(*keys, F.explode("_rules").alias("rule")).unionByName(tired)
    n_tired = tired.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_tired"))
    outcome = t.join(n_tired, keys, "left").withColumns({
        "n_issues": F.size("_rules").cast("bigint") + F.coalesce("_n_tired", zero),
        "stated_market": F.when(F.col("_misfiled"), F.coalesce("stated_market", "stated_rent"))
        .otherwise(F.col("stated_market")),
        "stated_rent": F.when(~F.col("_misfiled"), F.col("stated_rent")),
    }).withColumn("ok", F.col("n_issues") == 0).select(
        *keys, "ok", "n_issues", "has_anchors", "quoted", "n_units", "rent_sum", "market_sum",
        *R.STATED_FIELDS)
    return Verified(outcome, issues)


def charge_total_gate(units: DataFrame, keys: Sequence[str],
                      by_columns: DataFrame | None = None) -> DataFrame:
    """Units whose charge lines miss their printed total, and whether too many do.

    ``by_columns`` names sheets with charge-code columns, which get more slack.
    """
    keys = list(keys)
    miss = F.abs(F.coalesce("charge_sum", F.lit(0)) - F.col("block_charge_total")) > F.expr("0.02")
    agg = units.groupBy(*keys).agg(
        F.count("block_charge_total").alias("n_totals"),
        F.count_if(F.coalesce(miss, F.lit(False))).alias("n_bad"))
    slack = F.lit(2)
    if by_columns is not None:
        agg = agg.join(by_columns.select(*SHEET, "audits"), SHEET, "left")
        slack = F.when(F.coalesce("audits", F.lit(False)), 10).otherwise(2)
    return agg.select(*keys, "n_totals", "n_bad", (
        (F.col("n_totals") < 10)
        | (F.col("n_bad") * 100 <= F.greatest(F.lit(100), F.col("n_totals") * slack))
    ).alias("charges_ok"))


def coverage_gate(units: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fields the header advertises but under a quarter of the units carry."""
    keys = list(keys)
    pools = {"tenanted": tenanted(), "all": F.lit(True)}
    agg = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(tenanted()).alias("n_tenanted"),
        *[F.count_if(pools[p] & filled(f)).alias(f"f_{f}") for f, _, p in V.COVERAGE_HINTS])
    sparse = F.array_compact(F.array(*[
        F.when(F.col("head").rlike(pattern) & (F.col(f"n_{p}") >= 10)
               & (F.col(f"f_{f}") * 4 < F.col(f"n_{p}")), F.lit(f))
        for f, pattern, p in V.COVERAGE_HINTS]))
    return agg.join(heads, SHEET, "left").select(*keys, F.explode(sparse).alias("field"))


def printed_grand_total(rows: DataFrame, units: DataFrame) -> DataFrame:
    """First number below the last unit in the total column.

    A unit-like row in between means another section, so the number is not the
    total of these units.
    """
    last = units.groupBy(*SHEET).agg(F.max("source_row").alias("last_unit"))
    below = rows.filter("audits").join(last, SHEET).filter(F.col("row") > F.col("last_unit"))
    value = F.col("m")[F.col("c_total")]["n"].try_cast(S.LINE)
    found = below.groupBy(*SHEET).agg(
        F.min(F.when(F.col("is_boundary"), F.col("row"))).alias("next_unit"),
        F.min(F.when(value.isNotNull(), F.struct("row", value.alias("v")))).alias("first"))
    return found.select(*SHEET, F.when(
        F.col("next_unit").isNull() | (F.col("first.row") < F.col("next_unit")),
        F.col("first.v")).alias("grand_total"))


def orphan_rows(rows: DataFrame) -> DataFrame:
    """Rows of the walked region with a unit-like id that became no unit."""
    inside = (F.col("row") >= F.col("start")) & (
        F.col("cut").isNull() | (F.col("row") < F.col("cut"))) & (F.col("txt") != "")
    return rows.filter(
        F.col("audits") & inside & ~F.col("is_skip") & F.col("clean_id") & ~F.col("is_boundary")
    ).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("orphans"))


def charge_column_anchor(walked: Walk) -> DataFrame:
    """Printed row totals and grand total of sheets with charge columns.

    Over all rows, repeated unit numbers included, as the printed total is.
    """
    total = F.col("block_charge_total")
    hit = F.abs(F.coalesce("charge_sum", F.lit(0)) - total) <= F.expr("0.02")
    audited = walked.plan.filter("audits").select(*SHEET)
    sums = walked.units.join(audited, SHEET, "left_semi").groupBy(*SHEET).agg(
        F.count("block_charge_total").alias("rows_with_totals"),
        F.count_if(F.coalesce(hit, F.lit(False))).alias("rows_reconciled"),
        F.coalesce(F.min(F.when(total > 0, total)), F.lit(0).cast(S.LINE)).alias("min_row_total"),
        F.coalesce(F.sum("block_charge_total"), F.lit(0)).cast("decimal(28,4)").alias("total_sum"))
    return (
        sums.join(printed_grand_total(walked.rows, walked.units), SHEET, "left")
        .join(orphan_rows(walked.rows), SHEET, "left")
        .withColumn("orphans", F.coalesce("orphans", F.lit(0).cast("bigint"))))


def prove_complete(units: DataFrame, outcome: DataFrame, anchors: DataFrame,
                   keys: Sequence[str]) -> DataFrame:
    """On what grounds the reading is known to hold every unit, or NULL.

    A stated unit count; else a market total matched within a hair, smaller
    than any single unit, with a second anchor; else the printed grand total of
    the charge column.
    """
    keys = list(keys)
    total = F.col("block_charge_total")
    agg = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count("market_rent").alias("_m"),
        F.min("market_rent").alias("_min"), F.count("block_charge_total").alias("_t"),
        F.count_if(F.coalesce(
            F.abs(F.coalesce("charge_sum", F.lit(0)) - total) <= F.expr("0.02"),
            F.lit(False))).alias("_hit"))
    t = outcome.join(agg, keys).join(anchors, SHEET, "left")
    hair = lambda c: F.greatest(F.expr("1.0"), c * F.expr("0.0002"))
    sm, gt = F.col("stated_market"), F.col("grand_total")
    market = (
        (sm > 0) & (F.col("_m") == F.col("_n")) & (F.abs(F.col("market_sum") - sm) <= hair(sm))
        & (F.col("_min") > hair(sm)))
    column = (
        (gt > 0) & (F.col("rows_with_totals") >= 10)
        & (F.abs(F.col("total_sum") - gt) <= hair(gt)) & (F.col("min_row_total") > hair(gt))
        & (F.col("rows_reconciled") * 10 >= F.col("rows_with_totals") * 9)
        & (F.col("orphans") == 0))
    basis = (
        F.when(F.col("stated_units").isNotNull(), "stated_unit_count")
        .when(market & (F.col("stated_rent") > 0), "market_total_and_rent_total")
        .when(market & (F.col("_t") >= 10) & (F.col("_hit") * 10 >= F.col("_n") * 9),
              "market_total_and_block_totals")
        .when(column, "charge_column_grand_total"))
    return t.select(*keys, basis.alias("basis"), "grand_total")


def choose_convention(walked: Walk, stated: DataFrame, heads: DataFrame) -> DataFrame:
    """Per sheet the first convention that passes every gate, with its stated totals.

    A sheet no convention passes does not appear: it needs another reading.
    """
    walked = walked._replace(units=stage(walked.units))
    units = stage(both_conventions(walked.units))
    checked = verify_against_stated(units, stated, CONVENTION, "place")
    proof = prove_complete(units, checked.outcome, charge_column_anchor(walked), CONVENTION)
    sparse = coverage_gate(units, heads, CONVENTION).select(*CONVENTION).distinct()
    charges = charge_total_gate(units, CONVENTION, walked.plan)
    order = F.array_position(F.array(*[F.lit(c) for c in V.CONVENTIONS]), F.col("convention"))
    passed = (
        checked.outcome.filter("ok").join(proof.filter(F.col("basis").isNotNull()), CONVENTION)
        .join(charges.filter("charges_ok").select(*CONVENTION), CONVENTION, "left_semi")
        .join(sparse, CONVENTION, "left_anti"))
    first = passed.groupBy(*SHEET).agg(F.min_by(
        F.struct(*[F.col(c) for c in passed.columns if c not in SHEET]), order).alias("p"))
    out = first.select(*SHEET, "p.*")
    # A grand total the rents themselves add up to is the stated rent total.
    return out.withColumn("stated_rent", F.coalesce("stated_rent", F.when(
        F.abs(F.col("rent_sum") - F.col("grand_total")) <= R.band(F.col("grand_total")),
        F.col("grand_total").cast(TOTAL))))


def suspect_codes(plan: DataFrame) -> DataFrame:
    """Rent codes that do not say rent and are no declared subsidy."""
    suspects = F.array_except(
        F.filter("rent_codes", lambda c: ~F.contains(c, F.lit("rent"))), F.col("subsidy_codes"))
    return plan.filter((F.col("layout") == "block") & (F.size("rent_codes") > 0)).select(
        *SHEET, "rent_codes", F.array_union("discount_codes", "concession_codes").alias("borne"),
        F.explode(suspects).alias("code"))


def narrow_fee_codes(units: DataFrame, lines: DataFrame, plan: DataFrame,
                     accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take fee codes out of rent where the stated total holds without them.

    Walking again without a code changes a unit's rent by the sum of that
    code's lines, so the what-if runs are sums per unit and code. Returns
    (units, dropped codes); ``units`` and ``accepted`` are per sheet, already
    de-duplicated under the accepted convention.
    """
    units, accepted = stage(units), stage(accepted)
    arbiter = accepted.filter(F.col("stated_rent") > 0).select(*SHEET, "stated_rent")
    suspects = stage(suspect_codes(plan).join(arbiter, SHEET))
    kept = units.select(*SHEET, "source_row", "monthly_rent")
    coded = lines.withColumn("code", F.lower("code")).join(
        kept.select(*SHEET, "source_row"), [*SHEET, "source_row"], "left_semi")
    sheets = suspects.select(*SHEET, "rent_codes", "borne").distinct()
    latching = coded.join(sheets, SHEET).filter(
        F.array_contains("rent_codes", F.col("code")) | F.array_contains("borne", F.col("code")))
    latches = latching.groupBy(*SHEET, "source_row").agg(F.count(F.lit(1)).alias("_latches"))
    per_code = (
        coded.join(suspects.select(*SHEET, "code", F.array_contains(
            "borne", F.col("code")).alias("_borne"), F.size("rent_codes").alias("_n_codes")),
            [*SHEET, "code"])
        .groupBy(*SHEET, "source_row", "code", "_borne", "_n_codes").agg(
            F.sum("amount").cast("decimal(24,4)").alias("_sum"), F.count(F.lit(1)).alias("_lines"))
        .join(latches, [*SHEET, "source_row"]))
    left = F.col("_latches") - F.when(F.col("_borne"), 0).otherwise(F.col("_lines"))
    # A suspect no unit carries changes nothing and so never fails the test.
    per_code = stage(per_code)
    verdict = per_code.groupBy(*SHEET, "code").agg(
        F.bool_and((F.col("_sum") >= 0) & (left > 0)).alias("fee"))
    dropped = suspects.filter(F.size("rent_codes") > 1).join(
        verdict, [*SHEET, "code"], "left").filter(F.coalesce("fee", F.lit(True))).select(
        *SHEET, "code", "rent_codes", "stated_rent")
    remaining = dropped.groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("_gone"), F.max(F.size("rent_codes")).alias("_codes"),
        F.max("stated_rent").alias("_stated")).filter(F.col("_gone") < F.col("_codes"))
    change = per_code.join(dropped.select(*SHEET, "code"), [*SHEET, "code"], "left_semi").groupBy(
        *SHEET, "source_row").agg(
        F.sum("_sum").alias("_less"),
        F.sum(F.when(F.col("_borne"), 0).otherwise(F.col("_lines"))).alias("_off"),
        F.max("_latches").alias("_latches"))
    trial = kept.join(remaining, SHEET).join(change, [*SHEET, "source_row"], "left").withColumn(
        "narrowed", F.when(F.col("_less").isNull(), F.col("monthly_rent")).when(
            F.col("_latches") > F.col("_off"),
            S.cents(F.col("monthly_rent") - F.col("_less"))))
    trial = stage(trial)
    judged = trial.groupBy(*SHEET).agg(
        F.bool_and(F.col("monthly_rent").isNull() | (
            F.coalesce(F.col("narrowed") <= F.col("monthly_rent"), F.lit(False)))).alias("lower"),
        F.bool_or(F.coalesce("narrowed", F.lit(0)) != F.coalesce("monthly_rent", F.lit(0)))
        .alias("changed"),
        F.sum(F.coalesce("narrowed", F.lit(0))).cast(TOTAL).alias("rent_sum"),
        F.max("_stated").alias("_stated"))
    good = judged.filter(
        F.col("lower") & F.col("changed")
        & (F.abs(F.col("rent_sum") - F.col("_stated")) <= R.band(F.col("_stated")))).select(*SHEET)
    proposal = units.join(good, SHEET, "left_semi").join(
        trial.select(*SHEET, "source_row", "narrowed"), [*SHEET, "source_row"], "left"
    ).withColumn("monthly_rent", F.col("narrowed")).drop("narrowed")
    proposal = stage(proposal)
    fields = accepted.select(*SHEET, *R.STATED_FIELDS)
    still_ok = verify_against_stated(proposal, fields, SHEET, "place").outcome.filter("ok").join(
        good, SHEET, "left_semi").select(*SHEET)
    final = proposal.join(still_ok, SHEET, "left_semi").unionByName(
        units.join(still_ok, SHEET, "left_anti"))
    return final, dropped.select(*SHEET, "code").join(still_ok, SHEET, "left_semi")


def accepted_units(walked: Walk, chosen: DataFrame) -> DataFrame:
    """Units of the chosen convention of each accepted sheet."""
    return both_conventions(walked.units).join(
        chosen.select(*CONVENTION), CONVENTION, "left_semi")
