"""Scoring, export, review and cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from unitwise.functions import fixed_values as V
from unitwise.functions import scalars as S
from unitwise.operators import codes, quality, records, score
from unitwise.operators import cells as C
from unitwise.registry import sqltext as Q
from unitwise.registry.base import register
from unitwise.registry.core import _checks, _issues
from unitwise.sources import sheets as G
from unitwise.sources import tables as T
from unitwise.sources.tables import with_views

M = "DECIMAL(18,2)"
_K = "unit_row_id"
FOUND = {
    "unit_number": f"CASE WHEN {_K} % 31 = 0 THEN concat('Apt #', unit_number) WHEN {_K} % 37 = 0"
                   f" THEN lower(unit_number) WHEN {_K} % 53 = 0 THEN concat('B-', unit_number) ELSE"
                   " unit_number END",
    "status": f"CASE WHEN {_K} % 41 = 0 THEN 'applicant' ELSE status END",
    "monthly_rent": f"CASE WHEN {_K} % 43 = 0 THEN CAST(monthly_rent + 100 AS {M}) WHEN {_K} % 47 = 0"
                    f" THEN CAST(monthly_rent * 1.004 AS {M}) ELSE monthly_rent END",
    "tenant_name": f"CASE WHEN tenant_name IS NULL THEN NULL WHEN {_K} % 23 = 0 THEN concat(tenant_name, 'x') WHEN {_K} % 29 = 0 THEN"
                   " 'Somebody, Else' ELSE tenant_name END",
    "unit_sqft": "unit_sqft",
    "unit_type": f"CASE WHEN {_K} % 17 = 0 THEN concat(CAST({_K} % 4 AS STRING), 'BR/1BA') ELSE"
                 " unit_type END",
    "lease_start_date": f"CASE WHEN {_K} % 59 <> 0 THEN lease_start_date END",
    "lease_end_date": f"CASE WHEN {_K} % 61 <> 0 THEN lease_end_date END",
    "move_in_date": f"CASE WHEN {_K} % 67 = 0 THEN CAST(move_in_date + INTERVAL '1' DAY AS DATE) ELSE move_in_date END",
    "move_out_date": f"CASE WHEN {_K} % 71 <> 0 THEN move_out_date ELSE lease_start_date END",
    "category": "category",
}
_TRUTH = [f for f in FOUND]
def truth(sp, d):
    return T.units(sp, d).selectExpr("doc_id", f"{_K} * 2 AS pos", *_TRUTH)


def found(sp, d):
    """The truth with dropped, renamed and altered units, and a few invented ones."""
    u = T.units(sp, d)
    kept = u.filter(f"{_K} % 97 <> 0").selectExpr(
        "doc_id", f"{_K} * 2 AS pos", *[f"{e} AS {n}" for n, e in FOUND.items()])
    extra = u.filter(f"{_K} % 89 = 0").selectExpr(
        "doc_id", f"{_K} * 2 + 1 AS pos", "concat('ZZ9', unit_number) AS unit_number",
        *[n for n in _TRUTH if n != "unit_number"])
    return kept.unionByName(extra)


def graded_truth(sp, d):
    """The truth with what the other fields need: acceptable rents, printed regulation, itemized charges."""
    return truth(sp, d).selectExpr(
        "*", "CASE WHEN pos DIV 2 % 6 = 0 THEN array(monthly_rent + 100) END AS acceptable_rents",
        "CASE pos DIV 2 % 4 WHEN 1 THEN 'Rent Stabilized' WHEN 2 THEN concat('Type ', unit_type) WHEN 3 THEN '' END"
        " AS regulation",
        "CASE WHEN monthly_rent IS NOT NULL THEN array(named_struct('code', 'RENT', 'amount', CAST(monthly_rent AS"
        " DECIMAL(18,4)), 'category', 'base_rent'), named_struct('code', 'PARK', 'amount', CAST(45 AS"
        " DECIMAL(18,4)), 'category', 'parking')) END AS charges")


def graded_found(sp, d):
    """The extraction with captured columns and lines, of which some are named, priced or classed otherwise."""
    return found(sp, d).selectExpr(
        "*", "array(named_struct('header', 'Program', 'value', CASE pos DIV 2 % 5 WHEN 1 THEN 'STABILIZED' WHEN 2"
        " THEN NULL ELSE concat('type-', unit_type) END)) AS source_columns",
        "CASE WHEN monthly_rent IS NOT NULL THEN array(named_struct('code', CASE WHEN pos DIV 2 % 3 = 0 THEN 'Rent-1'"
        " ELSE 'RENT' END, 'amount', CAST(monthly_rent AS DECIMAL(18,4)), 'category', CASE WHEN pos DIV 2 % 7 = 2"
        " THEN 'other' ELSE 'base_rent' END), named_struct('code', 'PARK', 'amount', CAST(CASE WHEN pos DIV 2 % 10 ="
        " 3 THEN 46 ELSE 45 END AS DECIMAL(18,4)), 'category', 'parking')) END AS charges")


_FOUND_SQL = (
    f"SELECT doc_id, {_K} * 2 AS pos, {', '.join(f'{e} AS {n}' for n, e in FOUND.items())} FROM"
    f" rr_units WHERE {_K} % 97 <> 0 UNION ALL SELECT doc_id, {_K} * 2 + 1, concat('ZZ9',"
    f" unit_number), {', '.join(n for n in _TRUTH if n != 'unit_number')} FROM rr_units WHERE {_K} %"
    " 89 = 0")
_NORM = ("regexp_replace(regexp_replace(upper(trim(unit_number)),"
         " '^(UNIT|APT|APARTMENT)\\s*[#:.]?\\s*', ''), '[#\\s.,_/\\\\-]+', '', 'g')")
_side = lambda src: (
    f"SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY pos) AS k FROM (SELECT *, {_NORM}"
    f" AS id FROM {src}) WHERE id <> ''")
_scored = {
    "gt": f"SELECT doc_id, {_K} * 2 AS pos, {', '.join(_TRUTH)} FROM rr_units", "ex": _FOUND_SQL,
    "gk": _side("gt"), "ek": _side("ex"),
    "pairs": "SELECT g.doc_id, g.pos AS gt_pos, e.pos AS ex_pos FROM gk g JOIN ek e ON e.doc_id ="
             " g.doc_id AND e.id = g.id AND e.k = g.k"}
_name = lambda c: (f"nullif(trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]+', ' ', 'g'),"  # noqa: E731
                   " '\\s+', ' ', 'g')), '')")
_sim = "(1.0 - levenshtein(gn, an) / greatest(length(gn), length(an)) >= 0.85)"
_al = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', '', 'g')"
_bb = lambda c: (f"regexp_replace(regexp_replace(lower({c}), 'br', ''), 'ba', '')")
_close = ("(abs(g.{f} - e.{f}) <= greatest(1.0, abs(g.{f}) * 0.005) OR (coalesce(g.{f}, 0) = 0 AND"
          " coalesce(e.{f}, 0) = 0))")
_RULE = {
    "presence": "true",
    "status": "(g.status = e.status OR (g.status IN ('applicant','vacant') AND e.status IN"
              " ('applicant','vacant')))",
    "monthlyRent": _close.format(f="monthly_rent") + " OR (g.pos // 2 % 6 = 0 AND abs(g.monthly_rent + 100 -"
                   " e.monthly_rent) <= greatest(1.0, abs(g.monthly_rent + 100) * 0.005))",
    "tenantName": "CASE WHEN gn IS NULL AND an IS NULL THEN true WHEN gn IS NULL OR an IS NULL THEN"
                  f" false ELSE gn = an OR {_sim} END",
    "unitSqft": _close.format(f="unit_sqft"),
    "unitType": f"CASE WHEN {_al('g.unit_type')} = '' AND {_al('e.unit_type')} = '' THEN true WHEN"
                f" {_al('g.unit_type')} = '' OR {_al('e.unit_type')} = '' THEN false ELSE"
                f" contains({_al('g.unit_type')}, {_al('e.unit_type')}) OR"
                f" contains({_al('e.unit_type')}, {_al('g.unit_type')}) OR"
                f" {_bb('g.unit_type')} = {_bb('e.unit_type')} END",
    "leaseStartDate": "g.lease_start_date IS NOT DISTINCT FROM e.lease_start_date",
    "leaseEndDate": "g.lease_end_date IS NOT DISTINCT FROM e.lease_end_date",
    "moveInDate": "g.move_in_date IS NOT DISTINCT FROM e.move_in_date",
    "moveOutDate": "g.move_out_date IS NOT DISTINCT FROM e.move_out_date",
    "category": "g.category = e.category",
    "regulation": f"CASE g.pos // 2 % 4 WHEN 1 THEN e.pos // 2 % 5 = 1 WHEN 2 THEN e.pos // 2 % 5 NOT IN (1, 2) AND"
                  f" (contains({_al("concat('type', e.unit_type)")}, {_al("concat('type', g.unit_type)")}) OR"
                  f" contains({_al("concat('type', g.unit_type)")}, {_al("concat('type', e.unit_type)")}))"
                  " ELSE true END",
    "charges": "g.monthly_rent IS NULL OR (abs(g.monthly_rent - e.monthly_rent) <= 0.02 AND e.pos // 2 % 10 <> 3)",
    "chargeCategories": "abs(g.monthly_rent - e.monthly_rent) <= 0.02 AND e.pos // 2 % 7 <> 2",
}
_scored["joined"] = (
    "SELECT g.doc_id, g.pos, p.ex_pos IS NOT NULL AS hit, g.monthly_rent IS NULL AS bare, " + ", ".join(
        f"coalesce({r}, false) AS \"{f}\"" for f, r in _RULE.items())
    + f" FROM (SELECT *, {_name('tenant_name')} AS gn FROM gt) g LEFT JOIN pairs p ON p.doc_id ="
    f" g.doc_id AND p.gt_pos = g.pos LEFT JOIN (SELECT *, {_name('tenant_name')} AS an FROM ex) e ON"
    " e.doc_id = p.doc_id AND e.pos = p.ex_pos")
_scored["cells"] = " UNION ALL ".join(
    f"SELECT doc_id, pos, '{f}' AS field, hit AND \"{f}\" AS correct FROM joined"
    + (" WHERE NOT (hit AND bare)" if f == "chargeCategories" else "") for f in _RULE
) + (" UNION ALL SELECT e.doc_id, e.pos, 'hallucinated', false FROM ex e LEFT JOIN pairs p ON p.doc_id"
     " = e.doc_id AND p.ex_pos = e.pos WHERE p.ex_pos IS NULL")


def _sql(body: str) -> str:
    return with_views(body, "rr_units", extra=_scored)


def pairs(sp, d):
    return score.align_exact(truth(sp, d), found(sp, d))


def cells(sp, d):
    return score.score_cells(graded_truth(sp, d), graded_found(sp, d))


register("align_exact", pairs, _sql("SELECT * FROM pairs"))
_FILES = ("SELECT doc_id, count(*) FILTER (correct) AS correct, count(*) AS total, count(*) FILTER"
          " (correct) / count(*) AS accuracy FROM cells GROUP BY doc_id")
# What is left over after the exact match goes by affix, row by row in document order.
_scored_affix = _scored | {
    "gl": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM gk WHERE NOT EXISTS (SELECT 1 FROM"
          " pairs p WHERE p.doc_id = gk.doc_id AND p.gt_pos = gk.pos)",
    "el": "SELECT * FROM ek WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = ek.doc_id AND p.ex_pos = ek.pos)",
    "near": "SELECT g.doc_id, g.n, g.pos, coalesce(list(e.pos) FILTER (e.pos IS NOT NULL), []) AS near FROM gl g LEFT"
            " JOIN el e ON e.doc_id = g.doc_id AND least(length(e.id), length(g.id)) >= 2 AND (suffix(e.id, g.id) OR"
            " suffix(g.id, e.id)) GROUP BY g.doc_id, g.n, g.pos",
    "taken": "SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS gt_pos, CAST([] AS BIGINT[]) AS used,"
             " CAST([] AS BIGINT[]) AS free FROM near WHERE n = 1 UNION ALL SELECT doc_id, n, gt_pos, CASE WHEN"
             " len(free) = 1 THEN list_concat(used, free) ELSE used END, free FROM (SELECT x.doc_id, x.n, x.pos AS"
             " gt_pos, t.used, list_filter(x.near, lambda y: NOT list_contains(t.used, y)) AS free FROM taken t JOIN"
             " near x ON x.doc_id = t.doc_id AND x.n = t.n + 1)",
    "aligned": "SELECT * FROM pairs UNION ALL SELECT doc_id, gt_pos, free[1] FROM taken WHERE len(free) = 1"}


def _affix_sql(body: str, **more: str) -> str:
    first = {k: v for k, v in _scored_affix.items() if k not in ("joined", "cells")}
    return with_views(body, "rr_units", extra=first | more).replace("WITH", "WITH RECURSIVE", 1)


register("align", lambda sp, d: score.align(truth(sp, d), found(sp, d)), _affix_sql("SELECT * FROM aligned"))
# Ids of few letters and digits, so that many end with one another and takings wait for each other.
_FAMILY = "concat(substr('AB', CAST({k} % 2 + 1 AS INT), CAST({k} % 3 AS INT)), CAST({k} % {m} AS STRING))"
_families = {"gt": (f"SELECT doc_id * 4 + {_K} % 4 AS doc_id, {_K} AS pos, " + _FAMILY.format(k=_K, m=113)
                    + f" AS unit_number FROM rr_units WHERE {_K} % 5 <> 0"),
             "ex": (f"SELECT doc_id * 4 + {_K} % 4 AS doc_id, {_K} AS pos, " + _FAMILY.format(k=f"({_K} * 7)", m=131)
                    + f" AS unit_number FROM rr_units WHERE {_K} % 3 <> 0")}


def _family(sp, d, side):
    T.units(sp, d).createOrReplaceTempView("rr_units")
    return sp.sql(_families[side])


register("align_families", lambda sp, d: score.align(_family(sp, d, "gt"), _family(sp, d, "ex")),
         _affix_sql("SELECT * FROM aligned").replace(_scored["gt"], _families["gt"].replace("AS STRING", "AS VARCHAR")).replace(
             _FOUND_SQL.replace("AS STRING", "AS VARCHAR"), _families["ex"].replace("AS STRING", "AS VARCHAR")))
register("missed_units", lambda sp, d: score.missed_units(truth(sp, d), pairs(sp, d)).select(
    "doc_id", "pos", "unit_number"), _sql(
    "SELECT doc_id, pos, unit_number FROM gt WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id ="
    " gt.doc_id AND p.gt_pos = gt.pos)"))
register("hallucinated_units", lambda sp, d: score.hallucinated_units(
    found(sp, d), pairs(sp, d)).select("doc_id", "pos", "unit_number"), _sql(
    "SELECT doc_id, pos, unit_number FROM ex WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id ="
    " ex.doc_id AND p.ex_pos = ex.pos)"))
register("score_cells", cells, _sql("SELECT * FROM cells"))
register("score_cells_aligned", lambda sp, d: score.file_scores(score.score_cells(
    graded_truth(sp, d), graded_found(sp, d), score.align(truth(sp, d), found(sp, d)))).withColumn(
    "accuracy", F.round("accuracy", 6)), _affix_sql(
    f"SELECT doc_id, correct, total, round(accuracy, 6) AS accuracy FROM ({_FILES})",
    joined=_scored["joined"].replace("JOIN pairs p", "JOIN aligned p"),
    cells=_scored["cells"].replace("JOIN pairs p", "JOIN aligned p")))
register("score_rollup", lambda sp, d: score.score_rollup(cells(sp, d)), _sql(
    "SELECT doc_id, field, count(*) FILTER (correct) AS correct, count(*) AS total FROM cells GROUP"
    " BY ROLLUP (doc_id, field)"))
register("field_breakdown", lambda sp, d: score.field_breakdown(cells(sp, d)), _sql(
    "SELECT field, count(*) FILTER (correct) AS correct, count(*) AS total FROM cells GROUP BY field"))
register("file_scores", lambda sp, d: score.file_scores(cells(sp, d)).withColumn(
    "accuracy", F.round("accuracy", 6)), _sql(
    f"SELECT doc_id, correct, total, round(accuracy, 6) AS accuracy FROM ({_FILES})"))
register("score_report", lambda sp, d: score.score_report(score.file_scores(cells(sp, d))), _sql(
    "SELECT round(avg(accuracy), 6) AS macro, round(sum(correct) / sum(total), 6) AS micro, count(*)"
    f" FILTER (correct * 20 >= total * 19) AS files_at_95, count(*) AS files FROM ({_FILES})"))
register("worst_fields", lambda sp, d: score.worst_fields(cells(sp, d)), _sql(
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY correct / total, field)"
    " AS rank FROM (SELECT doc_id, field, count(*) FILTER (correct) AS correct, count(*) AS total FROM"
    " cells GROUP BY 1, 2) WHERE correct < total) WHERE rank <= 3"))
register("eval_subset", lambda sp, d: score.eval_subset(
    T.table(sp, d, "customer").select("c_custkey", F.lpad(
        F.col("c_custkey").cast("string"), 6, "0").alias("corpus_id")),
    T.table(sp, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias(
        "corpus_id")), ["00001", "00002", "0001"]),
    "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS corpus_id FROM customer WHERE"
    " (starts_with(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '00001') OR"
    " starts_with(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '00002') OR"
    " starts_with(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '0001')) AND c_custkey IN (SELECT o_custkey"
    " FROM orders)")
register("count_scorecard", lambda sp, d: score.count_scorecard(
    quality.document_profile(T.units(sp, d), T.stated(sp, d)).select(
        "doc_id", F.col("total_units").alias("n_units"), "stated_units"),
    T.units(sp, d).filter("doc_id % 2 = 0").groupBy("doc_id").agg(
        (F.count(F.lit(1)) + F.max(F.col("doc_id") % 3)).alias("expected_count"))), with_views(
    "SELECT u.doc_id, n_units, stated_units, CASE WHEN u.doc_id % 2 = 0 THEN n_units + u.doc_id % 3"
    " END AS expected_count, CASE WHEN u.doc_id % 2 = 0 THEN u.doc_id % 3 = 0 END AS matches_expected,"
    " stated_units = n_units AS matches_stated FROM (SELECT doc_id, count(*) AS n_units FROM rr_units"
    " GROUP BY 1) u JOIN rr_stated s ON s.doc_id = u.doc_id", "rr_units", "rr_stated"))


def _line_arrays(sp, d):
    """Printed and captured lines of each unit; some amounts and categories differ."""
    lines = codes.categorize(G.lease_lines(sp, d))
    pack = lambda amount, category: F.array_sort(F.collect_list(F.struct(
        "line_no", "code", F.expr(amount).cast("decimal(18,4)").alias("amount"),
        F.expr(category).alias("category"))))
    return lines.groupBy("doc_id", "unit_row_id").agg(
        pack("amount", "category").alias("want"),
        pack("CASE WHEN unit_row_id % 10 = 3 AND line_no = 2 THEN amount + 1 ELSE amount END",
             "CASE WHEN unit_row_id % 7 = 2 AND line_no = 1 THEN 'other' ELSE category END")
        .alias("got"))


_LINES_SQL = {"rr_lines": G.LEASE_LINES}
register("charges_captured", lambda sp, d: _line_arrays(sp, d).select(
    "doc_id", "unit_row_id", score.charges_captured("want", "got").alias("captured"),
    score.charge_categories_match("want", "got").alias("categories")), with_views(
    "SELECT doc_id, unit_row_id, NOT (unit_row_id % 10 = 3 AND bool_or(line_no = 2)) AS captured, CASE"
    " WHEN bool_or(line_no IN (1, 2, 4, 5)) THEN NOT (unit_row_id % 10 = 3 AND bool_or(line_no = 2))"
    " AND NOT (unit_row_id % 7 = 2 AND bool_or(line_no = 1)) END AS categories FROM rr_lines GROUP BY"
    " doc_id, unit_row_id", extra=_LINES_SQL))
register("regulation_captured", lambda sp, d: T.table(sp, d, "part").select(
    "p_partkey", score.regulation_captured(
        F.expr("CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_brand WHEN 2 THEN 'Rent Stabilized'"
               " ELSE 'x' END"),
        F.expr("array(named_struct('header', 'a', 'value', upper(p_brand)), named_struct('header',"
               " 'b', 'value', CASE WHEN p_partkey % 8 = 2 THEN 'STABILIZED' ELSE p_type END))"))
    .alias("captured")),
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN p_partkey % 8 ="
    " 2 ELSE false END AS captured FROM part")

# --- exports ---------------------------------------------------------------------
_serial = lambda c: f"CAST(datediff('day', DATE '1899-12-30', {c}) AS INT)"
_vendor = {
    "Unit #": "unit_number", "Unit Type": "unit_type", "Square Foot": "unit_sqft",
    "Status": "CASE status WHEN 'occupied' THEN 'O' ELSE concat(upper(substr(status, 1, 1)),"
              " substr(status, 2)) END",
    "Tenant Name": "tenant_name", "Tenant Paid": "monthly_rent",
    "Move In Date": _serial("move_in_date"), "Lease Start Date": _serial("lease_start_date"),
    "Lease End Date": _serial("lease_end_date")}
register("export_vendor", lambda sp, d: records.export_vendor(T.units(sp, d)), with_views(
    "SELECT doc_id, unit_row_id, " + ", ".join(
        f"{_vendor.get(h, 'CAST(NULL AS VARCHAR)')} AS \"{h}\"" for h in V.VENDOR_HEADERS)
    + " FROM rr_units", "rr_units"))
_txt = lambda c: f"coalesce(CAST({c} AS VARCHAR), '')"
_review = dict(zip(V.REVIEW_HEADERS, (
    "unit_number", "building", "status", "unit_type", "unit_sqft", "monthly_rent", "market_rent",
    "subsidy_rent", "employee_discount", "concession", "tenant_name", "lease_start_date",
    "lease_end_date", "move_in_date", "move_out_date", "lease_status")))
register("export_units", lambda sp, d: records.export_units(T.units(sp, d)), with_views(
    "SELECT doc_id, unit_row_id, " + ", ".join(
        (f"'' AS \"{h}\"" if c == "lease_status" else
         f"CASE WHEN {c} <> 0 THEN CAST({c} AS VARCHAR) ELSE '' END AS \"{h}\""
         if h in ("Sqft", "Monthly Rent") else f"{_txt(c)} AS \"{h}\"")
        for h, c in _review.items()) + " FROM rr_units", "rr_units"))


def _listing(sp, d):
    u, st = T.units(sp, d), T.stated(sp, d)
    recs = u.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("extracted_units"),
        F.max("lease_start_date").cast("string").alias("uploaded_at")).join(
        st.select("doc_id", "stated_units"), "doc_id")
    return records.list_extractions(
        recs, quality.validate(u, st), quality.check_tally(quality.verify(u, st)))


register("list_extractions", _listing, with_views(
    "SELECT u.doc_id, extracted_units, uploaded_at, stated_units, coalesce(c, 0) AS critical_issues,"
    " passed, failed, skipped, total, confidence, stated_units = extracted_units AS count_match FROM"
    " (SELECT doc_id, count(*) AS extracted_units, CAST(max(lease_start_date) AS VARCHAR) AS"
    " uploaded_at FROM rr_units GROUP BY 1) u JOIN rr_stated s ON s.doc_id = u.doc_id LEFT JOIN (SELECT"
    " doc_id, count(*) AS c FROM issues WHERE severity = 'critical' GROUP BY 1) i ON i.doc_id ="
    f" u.doc_id JOIN ({Q.TALLY}) t ON t.doc_id = u.doc_id", "rr_units", "rr_stated",
    extra={**_checks, **_issues}))


def _reviewed(sp, d):
    u = T.units(sp, d).select("doc_id", "unit_row_id", "unit_number", "status", "monthly_rent")
    edits = u.filter("unit_row_id % 13 = 0").selectExpr(
        "doc_id", "unit_row_id", "inline(array(struct('monthly_rent' AS field, '100.5' AS value,"
        " 1 AS edit_no), struct('monthly_rent' AS field, '200.25' AS value, 2 AS edit_no),"
        " struct('status' AS field, 'vacant' AS value, 3 AS edit_no)))")
    added = u.filter("unit_row_id % 301 = 0").selectExpr(
        "doc_id", "-unit_row_id - 1 AS unit_row_id", "'NEW' AS unit_number", "'vacant' AS status",
        "CAST(NULL AS DECIMAL(18,2)) AS monthly_rent")
    return records.review_edits(u, edits, u.filter("unit_row_id % 17 = 0"), added)


register("review_edits", _reviewed, with_views(
    "SELECT doc_id, unit_row_id, unit_number, CASE WHEN unit_row_id % 13 = 0 THEN 'vacant' ELSE status"
    f" END AS status, CASE WHEN unit_row_id % 13 = 0 THEN CAST(200.25 AS {M}) ELSE monthly_rent END AS"
    " monthly_rent FROM rr_units WHERE unit_row_id % 17 <> 0 UNION ALL SELECT doc_id, -unit_row_id - 1,"
    f" 'NEW', 'vacant', CAST(NULL AS {M}) FROM rr_units WHERE unit_row_id % 301 = 0", "rr_units"))
register("reviewed_summary", lambda sp, d: records.reviewed_summary(
    T.units(sp, d), T.units(sp, d).filter("doc_id % 2 = 0").select("doc_id")).select(
    "doc_id", "total_units", "total_monthly_rent", "state"), with_views(
    "SELECT doc_id, total_units, total_monthly_rent, CASE WHEN doc_id % 2 = 0 THEN 'approved' ELSE"
    " 'review' END AS state FROM stats", "rr_units", extra={"stats": Q.STATS}))


def _records(sp, d):
    return T.table(sp, d, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS job_id", "c_name AS file_name", "c_mktsegment AS status",
        "CAST(NULL AS STRING) AS error")


def _changes(sp, d):
    return T.table(sp, d, "customer").filter("c_custkey % 5 = 0").selectExpr(
        "CAST(c_custkey AS STRING) AS job_id", "CASE WHEN c_custkey % 2 = 0 THEN 'review' END AS status",
        "'late' AS error")


register("upsert_records", lambda sp, d: records.upsert_records(_records(sp, d), _changes(sp, d)),
         "SELECT CAST(c_custkey AS VARCHAR) AS job_id, c_name AS file_name, CASE WHEN c_custkey % 10 = 0"
         " THEN 'review' ELSE c_mktsegment END AS status, CASE WHEN c_custkey % 5 = 0 THEN 'late' END AS"
         " error FROM customer")

# --- usage costs -------------------------------------------------------------------
RATES = [
    records.Rate("large-2", 5, 6.25, 0.5, 25), records.Rate("small", 2, 2.5, 0.2, 10,
                                                            valid_to="2024-01-15"),
    records.Rate("small", 3, 3.75, 0.3, 15, valid_from="2024-01-15"),
    records.Rate("tiny", 1, 1.25, 0.1, 5)]
_USAGE = {
    "run_id": "user_id", "seq": "event_id", "used_at": "ts",
    "model": "CASE event_type WHEN 'view' THEN 'Large-2-x' WHEN 'click' THEN 'small-9' WHEN 'error'"
             " THEN 'tiny' ELSE 'unknown' END",
    "input_tokens": "CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT)",
    "output_tokens": "CAST(event_id % 1000 AS BIGINT)",
    "cache_write_tokens": "CAST(event_id % 77 AS BIGINT)",
    "cache_read_tokens": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 55 AS BIGINT) END"}


def usage(sp, d):
    return T.table(sp, d, "events").selectExpr(*[f"{e} AS {n}" for n, e in _USAGE.items()])


_COST = (
    "SELECT *, CASE WHEN model = 'Large-2-x' THEN i * 5 + w * 6.25 + r * 0.5 + o * 25 WHEN model ="
    " 'small-9' AND used_at < TIMESTAMP '2024-01-15' THEN i * 2 + w * 2.5 + r * 0.2 + o * 10 WHEN model"
    " = 'small-9' THEN i * 3 + w * 3.75 + r * 0.3 + o * 15 WHEN model = 'tiny' THEN i + w * 1.25 + r *"
    " 0.1 + o * 5 END AS micro FROM (SELECT *, input_tokens AS i, output_tokens AS o, cache_write_tokens"
    f" AS w, coalesce(cache_read_tokens, 0) AS r FROM (SELECT"
    f" {', '.join(f'{e} AS {n}' for n, e in _USAGE.items())} FROM events))")
register("price_usage", lambda sp, d: records.price_usage(usage(sp, d), RATES).select(
    "seq", "cost"), f"SELECT seq, CAST(CAST(micro AS DECIMAL(24,4)) * 0.000001 AS DECIMAL(28,8)) AS cost"
                    f" FROM ({_COST})")
register("usage_totals", lambda sp, d: records.usage_totals(records.price_usage(
    usage(sp, d), RATES)),
    "SELECT run_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT)"
    " AS output_tokens, arg_max(model, seq) AS last_model, CAST(sum(CAST(CAST(micro AS DECIMAL(24,4)) *"
    f" 0.000001 AS DECIMAL(28,8))) AS DECIMAL(28,6)) AS cost FROM ({_COST}) GROUP BY run_id")
register("format_money", lambda sp, d: T.table(sp, d, "part").select("p_partkey", S.format_money(
    F.expr("CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0.0042 ELSE CAST(p_partkey AS DOUBLE) + 0.25"
           " END")).alias("shown")),
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '—' WHEN 1 THEN '$0.0042' ELSE concat('$',"
    " CAST(p_partkey AS VARCHAR), '.25') END AS shown FROM part")
