"""Queries over units, charges and stated totals, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import functions as F

from unitwise.functions import fixed_values as V
from unitwise.functions import scalars as S
from unitwise.functions.charge_codes import charge_category
from unitwise.operators import codes, outliers, quality, reconcile, records, stats
from unitwise.operators import cells as C
from unitwise.operators import units as U
from unitwise.registry import sqltext as Q
from unitwise.registry.base import register
from unitwise.sources import tables as T
from unitwise.sources.tables import with_views

u, c, s = T.units, T.charges, T.stated
W = "DECIMAL(28,2)"

register("status_counts", lambda sp, d: stats.status_counts(u(sp, d)), with_views(
    "SELECT doc_id, " + ", ".join(
        f"CAST(count(*) FILTER (status = '{x}') AS BIGINT) AS {x}_units" for x in V.STATUSES)
    + ", CAST(count(*) FILTER (status IN ('occupied','notice')) AS BIGINT) AS physical"
    " FROM rr_units GROUP BY doc_id", "rr_units"))

register("non_tenant_rent", lambda sp, d: stats.non_tenant_rent(u(sp, d)), with_views(
    f"SELECT doc_id, CAST(nullif({T._OTHER_RENT}, 0) AS {W}) AS non_tenant_rent"
    " FROM rr_units GROUP BY doc_id", "rr_units"))

register("summary_stats", lambda sp, d: stats.summary_stats(u(sp, d), c(sp, d)), with_views(
    "SELECT st.*, a.total_charges_amount, (a.doc_id IS NOT NULL) AS has_itemized_charges"
    " FROM stats st LEFT JOIN anc a ON a.doc_id = st.doc_id", "rr_units", "rr_charges",
    extra={"stats": Q.STATS, "cat": Q.CATEGORIZED, "anc": Q.ANCILLARY}))

register("status_rent_breakdown", lambda sp, d: stats.status_rent_breakdown(u(sp, d)), with_views(
    f"SELECT doc_id, status, count(*) AS n_units, CAST(sum(coalesce(monthly_rent,0)) AS {W})"
    " AS total_rent FROM rr_units GROUP BY 1, 2", "rr_units"))

_opt = [f for f in V.OPTIONAL_FIELDS if f in T.UNIT_COLUMNS]
register("populated_fields", lambda sp, d: stats.populated_fields(u(sp, d)), with_views(
    "SELECT doc_id, " + ", ".join(
        f"coalesce(bool_or({f} IS NOT NULL AND CAST({f} AS VARCHAR) <> ''), false) AS has_{f}"
        for f in _opt) + " FROM rr_units GROUP BY doc_id", "rr_units"))

register("typed_share", lambda sp, d: stats.typed_share(u(sp, d), S.type_text("unit_type")),
         with_views("SELECT doc_id, count(*) AS n_units, CAST(count(*) FILTER (unit_type <> '--/--')"
                    " AS BIGINT) AS n_typed, (count(*) FILTER (unit_type <> '--/--') >= 3 AND"
                    " count(*) FILTER (unit_type <> '--/--') * 4 >= count(*)) AS contrast"
                    " FROM rr_units GROUP BY doc_id", "rr_units"))

# --- charge lines ------------------------------------------------------------
_cat = {"cat": Q.CATEGORIZED}
_summary = {
    **_cat, "per_unit": "SELECT doc_id, category, unit_row_id, sum(amount) AS amount FROM cat"
    " WHERE category NOT IN ('base_rent','subsidy') GROUP BY 1, 2, 3",
    "summary": f"SELECT doc_id, category, CAST(sum(amount) AS {W}) AS total_amount,"
    " count(*) AS unit_count, (SELECT count(DISTINCT code) FROM cat c2 WHERE c2.doc_id ="
    " p.doc_id AND c2.category = p.category) AS n_codes FROM per_unit p GROUP BY 1, 2"}
register("charge_category", lambda sp, d: codes.categorize(c(sp, d)).groupBy(
    "code", "category").agg(F.count(F.lit(1)).alias("lines")), with_views(
    "SELECT code, category, count(*) AS lines FROM cat GROUP BY 1, 2", "rr_charges", extra=_cat))
register("charge_category_of_names", lambda sp, d: T.table(sp, d, "part").select(
    F.expr(Q.CODE_TEXT).alias("code")).distinct().withColumn(
    "category", charge_category("code")), Q.CODE_NAMES_SQL)
register("drop_total_lines", lambda sp, d: codes.drop_total_lines(c(sp, d).withColumn(
    "code", F.expr(Q.WITH_TOTALS))).groupBy("doc_id", "code").agg(
    F.count(F.lit(1)).alias("lines"), F.sum("amount").cast(W.lower()).alias("amount")), with_views(
    f"SELECT doc_id, code, count(*) AS lines, CAST(sum(amount) AS {W}) AS amount FROM"
    f" (SELECT doc_id, amount, trim({Q.WITH_TOTALS}) AS code FROM rr_charges) WHERE code <> ''"
    " AND NOT regexp_matches(lower(code), '^([a-z]+\\s+)?totals?:?$') GROUP BY 1, 2",
    "rr_charges"))
register("total_charges", lambda sp, d: codes.total_charges(c(sp, d)), with_views(
    "SELECT doc_id, unit_row_id, CAST(sum(amount) AS DECIMAL(18,2)) AS total_charges,"
    " count(*) AS n_lines FROM rr_charges GROUP BY 1, 2", "rr_charges"))
register("charge_summary", lambda sp, d: codes.charge_summary(c(sp, d)), with_views(
    "SELECT * FROM summary", "rr_charges", extra=_summary))
register("charge_summary_sorted", lambda sp, d: codes.charge_summary_sorted(c(sp, d)), with_views(
    "SELECT * FROM summary ORDER BY doc_id, abs(total_amount) DESC, category", "rr_charges",
    extra=_summary))
register("top_categories", lambda sp, d: codes.top_categories(c(sp, d)), with_views(
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(total_amount)"
    " DESC, category) AS rank FROM summary) WHERE rank <= 5", "rr_charges", extra=_summary))
register("summary_codes", lambda sp, d: codes.summary_codes(c(sp, d)), with_views(
    "SELECT DISTINCT doc_id, category, code FROM cat WHERE category NOT IN"
    " ('base_rent','subsidy')", "rr_charges", extra=_cat))
register("ancillary_total", lambda sp, d: codes.ancillary_total(c(sp, d)), with_views(
    "SELECT doc_id, total_charges_amount, n_lines FROM anc", "rr_charges",
    extra={**_cat, "anc": Q.ANCILLARY}))
register("code_vocabulary", lambda sp, d: codes.code_vocabulary(c(sp, d)), with_views(
    f"SELECT doc_id, code, count(*) AS lines, CAST(sum(amount) AS {W}) AS signed_sum"
    " FROM rr_charges GROUP BY 1, 2", "rr_charges"))
register("charge_columns", lambda sp, d: codes.charge_columns(c(sp, d)), with_views(
    "SELECT doc_id, lower(trim(code)) AS code_key, arg_min(trim(code), unit_row_id) AS display,"
    " count(DISTINCT unit_row_id) AS unit_count FROM rr_charges GROUP BY 1, 2", "rr_charges"))
register("charge_pivot", lambda sp, d: codes.charge_pivot(c(sp, d)), with_views(
    "SELECT doc_id, unit_row_id, lower(trim(code)) AS code_key, CAST(sum(amount) AS"
    " DECIMAL(18,2)) AS amount FROM rr_charges GROUP BY 1, 2, 3", "rr_charges"))
_wide = {k: k.split("-")[0] + "_amount" for k in (
    "rent-rent", "hap-housing assistance payment", "petrent", "conc-concession", "scrie", "vtrash",
    "mliw-mandatory liability insurance waiver", "ltol-loss to lease", "como")}
register("charge_pivot_wide", lambda sp, d: codes.charge_pivot_wide(
    c(sp, d), list(_wide)).withColumnsRenamed(_wide), with_views(
    "SELECT doc_id, unit_row_id, " + ", ".join(
        f"CAST(sum(amount) FILTER (lower(code) = '{k}') AS DECIMAL(18,2)) AS {_wide[k]}"
        for k in _wide) + " FROM rr_charges GROUP BY 1, 2", "rr_charges"))


def _code_proposals(sp, d):
    return codes.code_vocabulary(c(sp, d)).selectExpr("doc_id", "code", Q.PROPOSED + " AS category"
                                                      ).filter("category IS NOT NULL")


_prop = {**_cat, "props": "SELECT DISTINCT doc_id, code, " + Q.PROPOSED
         + " AS proposed FROM rr_charges"}
register("code_verdicts", lambda sp, d: codes.code_verdicts(c(sp, d), _code_proposals(sp, d)).select(
    "doc_id", "code", "lines", "signed_sum", "keyword", "proposed", "verdict", "override"),
    with_views(
    f"SELECT k.doc_id, k.code, count(*) AS lines, CAST(sum(amount) AS {W}) AS signed_sum,"
    f" category AS keyword, proposed, {Q.VERDICT} AS verdict, {Q.OVERRIDE} AS override"
    " FROM cat k JOIN props p ON p.doc_id = k.doc_id AND p.code = k.code"
    " GROUP BY k.doc_id, k.code, category, proposed", "rr_charges", extra=_prop))
register("apply_code_proposals", lambda sp, d: codes.apply_code_proposals(
    c(sp, d), _code_proposals(sp, d)).groupBy("doc_id", "code", "category").agg(
    F.count(F.lit(1)).alias("lines"), F.sum("amount").cast(W.lower()).alias("amount")), with_views(
    f"SELECT doc_id, code, CASE WHEN ov IS NOT NULL AND (category = 'other' OR (category IN"
    " ('concession','reimbursed_credit') AND ov IN ('concession','reimbursed_credit'))) THEN ov"
    f" ELSE category END AS category, count(*) AS lines, CAST(sum(amount) AS {W}) AS amount FROM"
    f" (SELECT k.doc_id, k.code, category, amount, {Q.OVERRIDE} AS ov FROM cat k JOIN props p"
    " ON p.doc_id = k.doc_id AND p.code = k.code) GROUP BY 1, 2, 3", "rr_charges", extra=_prop))

# --- reconciliation ----------------------------------------------------------
_profile = {"stats": Q.STATS, "prof": Q.PROFILE}


def profile(sp, d):
    return quality.document_profile(u(sp, d), s(sp, d))


register("reconcile_unit_count", lambda sp, d: profile(sp, d).select(
    "doc_id", "stated_units", "total_units", reconcile.unit_count(
        "stated_units", "total_units", "counted_units", "residential_units").alias("reading")),
    with_views(f"SELECT doc_id, stated_units, total_units, {Q.READING} AS reading FROM prof",
               "rr_units", "rr_stated", extra=_profile))
register("reconcile_occupied", lambda sp, d: profile(sp, d).select(
    "doc_id", reconcile.occupied("stated_occupied").alias("r")).select("doc_id", "r.*"), with_views(
    f"SELECT doc_id, {Q.OCC_OK} AS ok, occupied_units + notice_units AS physical,"
    f" {Q.SLACK} AS slack, {Q.OCC_DIFF} AS diff FROM prof", "rr_units", "rr_stated", extra=_profile))
register("reconcile_vacant", lambda sp, d: profile(sp, d).select(
    "doc_id", reconcile.vacant("stated_vacant").alias("r")).select("doc_id", "r.*"), with_views(
    f"SELECT doc_id, {Q.VAC_OK} AS ok, CASE WHEN stated_vacant IS NOT NULL THEN vacant_units END"
    f" AS vacant, CASE WHEN stated_vacant IS NOT NULL THEN {Q.SLACK} END AS slack,"
    " abs(stated_vacant - vacant_units) AS diff FROM prof", "rr_units", "rr_stated", extra=_profile))


def reconcile_rent(sp, d):
    """Flagship: does each document's tenant rent reconcile, and on what basis?"""
    calc = stats.summary_stats(u(sp, d))
    cut = (F.coalesce("total_concessions", F.lit(0))
           + F.coalesce("total_employee_discount", F.lit(0)))
    return calc.join(s(sp, d).select("doc_id", "stated_rent"), "doc_id").select(
        "doc_id", "stated_rent", "total_monthly_rent", reconcile.rent(
            "stated_rent", "total_monthly_rent", "non_tenant_rent", cut,
            "total_subsidy_rent").alias("r")).select(
        "doc_id", "stated_rent", "total_monthly_rent", "r.ok", "r.basis", "r.exact",
        "r.by_non_tenant", "r.diff", "r.residual")


register("reconcile_rent", reconcile_rent, with_views(
    "SELECT doc_id, stated_rent, total_monthly_rent, basis <> 'mismatch' AS ok, basis,"
    " basis = 'exact' AS exact, basis = 'non_tenant_rent' AS by_non_tenant, diff, residual"
    " FROM rec", "rr_units", "rr_stated", extra={**_profile, "rec": Q.RENT_BASIS}))
register("rent_components", lambda sp, d: stats.summary_stats(u(sp, d)).join(
    s(sp, d).select("doc_id", "stated_rent"), "doc_id").select("doc_id", F.explode(reconcile.rent(
        "stated_rent", "total_monthly_rent", "non_tenant_rent",
        F.coalesce("total_concessions", F.lit(0)) + F.coalesce("total_employee_discount", F.lit(0)),
        "total_subsidy_rent")["components"]).alias("p")).select("doc_id", "p.*"), with_views(
    Q.COMPONENTS, "rr_units", "rr_stated", extra={**_profile, "rec": Q.RENT_BASIS}))
register("count_match", lambda sp, d: profile(sp, d).select(
    "doc_id", quality.count_match("stated_units", "total_units").alias("count_match")), with_views(
    "SELECT doc_id, stated_units = total_units AS count_match FROM prof", "rr_units", "rr_stated",
    extra=_profile))


def _sentinels(sp, d):
    return s(sp, d).withColumns({f: F.when(F.col("doc_id") % 11 < 3, F.lit(-1).cast(t)).otherwise(
        F.col(f)) for f, t in s(sp, d).drop("doc_id").dtypes})


_sent = ", ".join(f"CASE WHEN doc_id % 11 < 3 THEN NULL ELSE {f} END AS {f}"
                  for f in reconcile.STATED_FIELDS if f != "stated_rate")
_rate = ("CAST(CASE WHEN doc_id % 11 < 3 THEN NULL WHEN stated_rate > 0 AND stated_rate <= 1"
         " THEN stated_rate * 100 ELSE stated_rate END AS DECIMAL(12,4)) AS stated_rate")
register("stated_or_null", lambda sp, d: reconcile.stated_or_null(_sentinels(sp, d)), with_views(
    f"SELECT doc_id, {_sent}, {_rate} FROM rr_stated WHERE doc_id % 11 >= 3", "rr_stated"))
register("fill_stated", lambda sp, d: reconcile.fill_stated(
    s(sp, d), s(sp, d).withColumn("doc_id", F.col("doc_id") + 1)), with_views(
    "SELECT a.doc_id, " + ", ".join(
        f"coalesce(a.{f}, b.{f}) AS {f}" for f in reconcile.STATED_FIELDS)
    + " FROM rr_stated a LEFT JOIN rr_stated b ON b.doc_id + 1 = a.doc_id", "rr_stated"))


def _sheets_of_two(sp, d):
    return s(sp, d).withColumn("doc_id", F.floor(F.col("doc_id") / 3).cast("long"))


_sum3 = ", ".join(f"CAST(sum({f}) AS {W}) AS {f}" for f in reconcile.STATED_FIELDS
                  if f != "stated_rate")
register("merge_stated", lambda sp, d: reconcile.merge_stated(_sheets_of_two(sp, d)), with_views(
    f"SELECT doc_id // 3 AS doc_id, {_sum3}, CASE WHEN count(*) = 1 THEN max(stated_rate) END"
    " AS stated_rate FROM rr_stated GROUP BY 1", "rr_stated"))
register("merge_chunks", lambda sp, d: reconcile.merge_chunks(s(sp, d).withColumn(
    "chunk", F.col("doc_id") % 3).withColumn("doc_id", F.floor(F.col("doc_id") / 3).cast("long"))),
    with_views("SELECT doc_id // 3 AS doc_id, " + ", ".join(
        f"arg_min({f}, doc_id) FILTER ({f} IS NOT NULL) AS {f}" for f in reconcile.STATED_FIELDS)
        + " FROM rr_stated GROUP BY 1", "rr_stated"))
register("compare_stated", lambda sp, d: profile(sp, d).select("doc_id", *[
    reconcile.compare_stated(a, b).alias(n) for n, a, b in Q.COMPARED]), with_views(
    "SELECT doc_id, " + ", ".join(
        f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN (abs({a} - {b}) <= {a} * 0.01 OR"
        f" abs({a} - {b}) < 1) ELSE true END AS {n}" for n, a, b in Q.COMPARED) + " FROM prof",
    "rr_units", "rr_stated", extra=_profile))
register("mismatch_hypotheses", lambda sp, d: reconcile.mismatch_hypotheses(profile(sp, d)),
         with_views(
    "SELECT doc_id, coalesce(abs(stated_rent - (total_monthly_rent + coalesce(non_tenant_rent,0)))"
    " <= 1, false) AS rent_includes_non_tenant, coalesce(stated_occupied = occupied_units +"
    " notice_units, false) AS occupied_includes_notice, coalesce(stated_vacant = vacant_units +"
    " applicant_units, false) AS vacant_includes_applicant, units_without_sqft FROM prof",
    "rr_units", "rr_stated", extra=_profile))

# --- validation and verification ---------------------------------------------
register("duplicate_units", lambda sp, d: quality.duplicate_units(u(sp, d)), with_views(
    "SELECT * FROM dup", "rr_units", extra={"dup": Q.DUPLICATES}))
register("duplicate_copies", lambda sp, d: quality.duplicate_copies(u(sp, d)), with_views(
    "SELECT r.doc_id, r.unit_key, r.unit_row_id, d.copies FROM (SELECT *, "
    f"{Q.UNIT_KEY} AS unit_key FROM rr_units) r JOIN dup d ON d.doc_id = r.doc_id AND"
    " d.unit_key = r.unit_key", "rr_units", extra={"dup": Q.DUPLICATES}))
register("unit_gaps", lambda sp, d: quality.unit_gaps(u(sp, d)), with_views(
    "SELECT * FROM gaps", "rr_units", extra={"gaps": Q.GAPS}))
register("suspicious_patterns", lambda sp, d: quality.suspicious_patterns(
    _odd_units(sp, d)), with_views(Q.SUSPICIOUS, "rr_units"))


def _odd_units(sp, d):
    return u(sp, d).withColumns({
        "unit_number": F.expr(Q.ODD_NUMBER), "unit_type": F.expr(Q.ODD_TYPE),
        "monthly_rent": F.expr(Q.ODD_RENT)})


register("suspicious_units", lambda sp, d: quality.suspicious_units(_odd_units(sp, d)).select(
    "doc_id", "unit_row_id", "rule"), with_views(Q.SUSPICIOUS_UNITS, "rr_units"))
register("missing_unit_numbers", lambda sp, d: quality.missing_unit_numbers(
    u(sp, d).withColumn("unit_number", F.expr(
        "CASE WHEN unit_row_id % 90 = 0 THEN ' ' ELSE unit_number END"))), with_views(
    "SELECT doc_id, unit_row_id FROM rr_units WHERE unit_row_id % 90 = 0", "rr_units"))
_checks = {**_profile, "dupn": Q.DUPLICATE_ROWS, "rec": Q.RENT_BASIS, "checks": Q.CHECKS}
register("verify", lambda sp, d: quality.verify(u(sp, d), s(sp, d)), with_views(
    "SELECT * FROM checks", "rr_units", "rr_stated", extra=_checks))
register("check_tally", lambda sp, d: quality.check_tally(quality.verify(u(sp, d), s(sp, d))),
         with_views(Q.TALLY, "rr_units", "rr_stated", extra=_checks))
register("summary_mismatches", lambda sp, d: quality.summary_mismatches(profile(sp, d)), with_views(
    "SELECT * FROM mism", "rr_units", "rr_stated", extra={**_profile, "mism": Q.MISMATCHES}))
_issues = {**_profile, "mism": Q.MISMATCHES, "dup": Q.DUPLICATES, "gaps": Q.GAPS,
           "issues": Q.ISSUES}
register("validate", lambda sp, d: quality.validate(u(sp, d), s(sp, d)), with_views(
    "SELECT * FROM issues", "rr_units", "rr_stated", extra=_issues))
register("sorted_issues", lambda sp, d: quality.sorted_issues(quality.validate(
    u(sp, d), s(sp, d))), with_views(
    "SELECT * FROM issues ORDER BY doc_id, CASE severity WHEN 'critical' THEN 0 WHEN 'warning'"
    " THEN 1 ELSE 2 END, seq, rule, label", "rr_units", "rr_stated", extra=_issues))

# --- outliers ----------------------------------------------------------------
_bounds = {"rent_b": Q.bounds("monthly_rent", "status IN ('occupied','notice') AND monthly_rent > 0"),
           "sqft_b": Q.bounds("unit_sqft", "unit_sqft > 0")}
register("iqr_bounds_rent", lambda sp, d: outliers.iqr_bounds(
    u(sp, d), "monthly_rent", stats.pays_rent()).withColumn(
    "std_dev", F.round("std_dev", 2)), with_views(
    "SELECT doc_id, n, q1, q3, median, iqr, lower, upper, total, round(std_dev, 2) AS std_dev"
    " FROM rent_b", "rr_units", extra=_bounds))
register("iqr_bounds_sqft", lambda sp, d: outliers.iqr_bounds(
    u(sp, d), "unit_sqft", F.col("unit_sqft") > 0).drop("std_dev"), with_views(
    "SELECT doc_id, n, q1, q3, median, iqr, lower, upper, total FROM sqft_b", "rr_units",
    extra=_bounds))
_marks = {**_bounds, "marks": Q.MARKS}
register("highlights", lambda sp, d: outliers.highlights(_marked_units(sp, d)), with_views(
    "SELECT * FROM marks", "rr_units", extra=_marks))


def _marked_units(sp, d):
    return u(sp, d).withColumns({
        "monthly_rent": F.expr(Q.MARK_RENT), "unit_sqft": F.expr(Q.MARK_SQFT)})


register("highlight_counts", lambda sp, d: outliers.highlight_counts(outliers.highlights(
    _marked_units(sp, d))), with_views(
    "SELECT doc_id, count(*) FILTER (type = 'outlier') AS outliers, count(*) FILTER"
    " (type = 'warning') AS warnings, count(*) FILTER (type = 'critical') AS critical,"
    " count(*) AS total FROM marks GROUP BY doc_id", "rr_units", extra=_marks))
register("issue_order", lambda sp, d: outliers.issue_order(outliers.highlights(
    _marked_units(sp, d))), with_views(
    "SELECT * FROM marks ORDER BY doc_id, CASE type WHEN 'critical' THEN 0 WHEN 'warning' THEN 1"
    " ELSE 2 END, unit_row_id, CASE field WHEN 'monthlyRent' THEN 0 WHEN 'unitSqft' THEN 1 ELSE 2"
    " END", "rr_units", extra=_marks))

# --- canonical units ----------------------------------------------------------
register("normalize_units", lambda sp, d: U.normalize_units(u(sp, d).withColumns({
    "unit_number": F.concat(F.lit(" "), "unit_number", F.lit("\t")),
    "raw_status": F.expr(Q.RAW_STATUS)}), "raw_status").select(
    "doc_id", "unit_row_id", "unit_number", "building", "status", "tenant_name", "unit_type"),
    with_views(
    f"SELECT doc_id, unit_row_id, unit_number, building, {Q.NORM_STATUS} AS status, tenant_name,"
    f" nullif(unit_type, '--/--') AS unit_type FROM (SELECT * EXCLUDE (status), {Q.RAW_STATUS}"
    " AS raw_status FROM rr_units)", "rr_units"))
register("with_total_charges", lambda sp, d: U.with_total_charges(u(sp, d), c(sp, d)).select(
    "doc_id", "unit_row_id", "total_charges"), with_views(
    "SELECT u.doc_id, u.unit_row_id, t.total_charges FROM rr_units u LEFT JOIN (SELECT doc_id,"
    " unit_row_id, CAST(sum(amount) AS DECIMAL(18,2)) AS total_charges FROM rr_charges GROUP BY"
    " 1, 2) t ON t.unit_row_id = u.unit_row_id AND t.doc_id = u.doc_id", "rr_units", "rr_charges"))
register("normalize_lines", lambda sp, d: U.normalize_lines(c(sp, d)).groupBy("category").agg(
    F.count(F.lit(1)).alias("lines"), F.sum("amount").cast(W.lower()).alias("amount")), with_views(
    f"SELECT category, count(*) AS lines, CAST(sum(amount) AS {W}) AS amount FROM cat GROUP BY 1",
    "rr_charges", extra=_cat))

# --- category review -----------------------------------------------------------
_shapes = {"rowz": Q.SHAPE_ROWS, "cand": Q.CANDIDATES}
register("category_candidates", lambda sp, d: C.category_candidates(u(sp, d)), with_views(
    "SELECT * FROM cand", "rr_units", extra=_shapes))
register("shape_samples", lambda sp, d: C.shape_samples(u(sp, d)), with_views(
    "SELECT doc_id, shape_key, sample_no, unit_number FROM (SELECT *, row_number() OVER (PARTITION"
    " BY doc_id, shape_key ORDER BY unit_row_id) AS sample_no FROM rowz) WHERE sample_no <= 6",
    "rr_units", extra=_shapes))
register("dwelling_vocabulary", lambda sp, d: C.dwelling_vocabulary(u(sp, d)), with_views(
    "SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS word_no,"
    " unit_type AS type_text FROM (SELECT doc_id, unit_type, min(unit_row_id) AS f FROM rr_units"
    " WHERE unit_type <> '--/--' GROUP BY 1, 2)) WHERE word_no <= 12", "rr_units"))


def _category_proposals(sp, d):
    return C.category_candidates(u(sp, d)).selectExpr(
        "doc_id", "shape_key", Q.CAT_PROPOSED + " AS category", Q.CAT_EVIDENCE + " AS evidence")


register("category_verdicts", lambda sp, d: C.category_candidates(u(sp, d)).selectExpr(
    "*", Q.CAT_PROPOSED + " AS proposed", Q.CAT_EVIDENCE + " AS evidence").select(
    "doc_id", "shape_key", "prior", "proposed", "evidence",
    C.gate_category_proposal("prior", "proposed", "evidence").alias("verdict"),
    C.coherent("proposed", "evidence").alias("coherent")), with_views(
    "SELECT doc_id, shape_key, prior, proposed, evidence, "
    f"{Q.CAT_VERDICT} AS verdict, {Q.COHERENT} AS coherent FROM (SELECT *, {Q.CAT_PROPOSED} AS"
    f" proposed, {Q.CAT_EVIDENCE} AS evidence FROM cand)", "rr_units", extra=_shapes))
register("apply_category_proposals", lambda sp, d: C.apply_category_proposals(
    u(sp, d), _category_proposals(sp, d)).select(
    "doc_id", "unit_row_id", "category", "include_in_unit_count"), with_views(
    "SELECT r.doc_id, r.unit_row_id, coalesce(p.proposed, r.prior) AS category, CASE WHEN"
    " p.proposed IS NOT NULL THEN p.proposed <> 'non_unit_income' ELSE r.include_in_unit_count END"
    " AS include_in_unit_count FROM rowz r LEFT JOIN (SELECT doc_id, shape_key, proposed FROM"
    f" (SELECT *, {Q.CAT_PROPOSED} AS proposed, {Q.CAT_EVIDENCE} AS evidence FROM cand) WHERE"
    f" {Q.CAT_VERDICT} = 'accept') p ON p.doc_id = r.doc_id AND p.shape_key = r.shape_key",
    "rr_units", extra=_shapes))

# --- dates in words -------------------------------------------------------------
_WORDED = ("MMMM d, yyyy", "MMM d yyyy", "d MMMM yyyy", "d-MMM-yyyy", "EEE MMM dd yyyy", "EEEE, d MMM yyyy",
           "MMM yyyy", "MMMM, yyyy", "M/d/yyyy H:mm", "yyyy-MM-dd'T'HH:mm:ss'Z'")
register("parse_date_free", lambda sp, d: T.table(sp, d, "orders").select(
    "o_orderkey", S.parse_date(F.expr("CASE o_orderkey % 10 " + " ".join(
        "WHEN {} THEN date_format(o_orderdate, '{}')".format(i, p.replace("'", "\\'")) for i, p in enumerate(_WORDED))
        + " END")).cast("string").alias("day")),
    "SELECT o_orderkey, CAST(CAST(CASE WHEN o_orderkey % 10 IN (6, 7) THEN date_trunc('month', o_orderdate)"
    " ELSE o_orderdate END AS DATE) AS VARCHAR) AS day FROM orders")
