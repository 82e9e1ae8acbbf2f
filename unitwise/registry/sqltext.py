"""SQL fragments of the checks over units, charges and stated totals."""

from __future__ import annotations

from unitwise.functions import fixed_values as V

W = "DECIMAL(28,2)"
PAYS = "status IN ('occupied','notice') AND monthly_rent > 0"


def _count(cond: str, name: str) -> str:
    return f"CAST(count(*) FILTER ({cond}) AS BIGINT) AS {name}"


def _sum(expr: str, name: str, cond: str | None = None) -> str:
    f = f" FILTER ({cond})" if cond else ""
    return f"CAST(sum({expr}){f} AS {W}) AS {name}"


def _half_up(top: str, bottom: str) -> str:
    return f"((CAST({top} AS HUGEINT) * 2 + ({bottom})) // (2 * ({bottom})))"


_SQ = "CAST(unit_sqft AS DECIMAL(18,2))"
_BASE = (
    "SELECT doc_id, count(*) AS total_units, "
    + ", ".join(_count(f"status = '{s}'", f"{s}_units") for s in V.STATUSES) + ", "
    + ", ".join([
        _sum(_SQ, "total_sqft", "unit_sqft > 0"), _count("unit_sqft > 0", "n_sqft"),
        _sum("monthly_rent", "total_monthly_rent", PAYS), _count(PAYS, "n_rent"),
        f"CAST(nullif(sum(monthly_rent) FILTER (status NOT IN ('occupied','notice') AND"
        f" monthly_rent > 0), 0) AS {W}) AS non_tenant_rent",
        _sum("market_rent", "total_market_rent"), _sum("subsidy_rent", "total_subsidy_rent", PAYS),
        _sum("employee_discount", "total_employee_discount"),
        _sum("concession", "total_concessions"),
        _sum("monthly_rent", "rb", f"{PAYS} AND unit_sqft > 0"),
        _sum(_SQ, "sb", f"{PAYS} AND unit_sqft > 0"),
        _count("category = 'residential'", "residential_units"),
        _count("include_in_unit_count", "counted_units")])
    + " FROM rr_units GROUP BY doc_id")
STATS = (
    "SELECT doc_id, total_units, " + ", ".join(f"{s}_units" for s in V.STATUSES)
    + f", CAST({_half_up('(occupied_units + notice_units) * 10000', 'total_units')} / 100"
    " AS DECIMAL(12,2)) AS physical_occupancy, total_sqft, total_monthly_rent, non_tenant_rent,"
    " total_market_rent, total_subsidy_rent, CAST(total_monthly_rent - coalesce(total_subsidy_rent,"
    f" 0) AS {W}) AS total_tenant_paid_rent, total_employee_discount, total_concessions,"
    f" CAST({_half_up('total_monthly_rent * 100', 'n_rent * 100')} AS BIGINT) AS average_rent,"
    f" CAST({_half_up('total_sqft * 100', 'n_sqft * 100')} AS BIGINT) AS average_sqft,"
    f" CAST({_half_up('rb * 10000', 'CAST(sb * 100 AS HUGEINT)')} / 100 AS DECIMAL(18,2))"
    f" AS average_rent_per_sqft, residential_units, counted_units FROM ({_BASE})")


def category_sql(raw: str, abbrev: str, desc: str) -> str:
    words = lambda ws: "|".join(ws)
    out = ["CASE"]
    for category, ws, abbreviations in V.CHARGE_RULES_BEFORE_RENT:
        listed = ", ".join(f"'{a}'" for a in abbreviations)
        out.append(f"WHEN regexp_matches({raw}, '{words(ws)}') OR {abbrev} IN ({listed})"
                   f" THEN '{category}'")
    listed = ", ".join(f"'{a}'" for a in V.BASE_RENT_DESCRIPTIONS)
    out.append(f"WHEN {desc} IN ({listed}) OR ({abbrev} = 'rent' AND contains({desc}, 'rent'))"
               " THEN 'base_rent'")
    for category, ws in V.CHARGE_RULES_AFTER_RENT:
        extra = (f" OR regexp_matches({desc}, '{V.STORAGE_DESCRIPTION}')"
                 if category == "storage" else "")
        out.append(f"WHEN regexp_matches({raw}, '{words(ws)}'){extra} THEN '{category}'")
    return " ".join(out) + " ELSE 'other' END"


def split_sql(source: str, keep: str = "*") -> str:
    shape = V.CODE_SPLIT
    return (
        f"SELECT *, regexp_extract(raw, '{shape}', 1) AS abbrev, CASE WHEN regexp_matches(raw,"
        f" '{shape}') THEN trim(regexp_extract(raw, '{shape}', 2)) ELSE raw END AS descr FROM"
        f" (SELECT {keep}, regexp_replace(lower(trim(code)), '\\s+', ' ', 'g') AS raw"
        f" FROM {source})")


CATEGORIZED = (
    "SELECT r.unit_row_id, r.doc_id, r.code, r.amount, k.category FROM rr_charges r JOIN"
    f" (SELECT code, {category_sql('raw', 'abbrev', 'descr')} AS category FROM"
    f" ({split_sql('(SELECT DISTINCT code FROM rr_charges)')})) k ON k.code = r.code")
_INCOME = ", ".join(f"'{x}'" for x in (*V.RENT_CLASS, *V.RENT_ADJUSTMENTS, "other"))
ANCILLARY = (
    f"SELECT doc_id, CAST(coalesce(sum(amount) FILTER (category NOT IN ({_INCOME})), 0) AS {W})"
    " AS total_charges_amount, count(*) AS n_lines FROM cat GROUP BY doc_id")
_CODES = (
    "RENT-Rent", "RENT-HUD", "Rent-Refunded", "rent:market rent", "PACK-Parcel Locker", "st12",
    "Month-to-Month Fee", "trash-pu", "PDLW", "Credit Builder", "Tax Abatement Credit",
    "J-51 credit", "Courtesy Credit", "VAC", "gtl-x", "Wi-Fi", "Service Fee", "rhino",
    "Charge Back", "Property Tax", "GARAGE", "sewer", "rnt", "Scheduled Rent")
CODE_TEXT = ("CASE p_partkey % 24 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END")
CODE_TEXT = f"CASE WHEN p_partkey % 2 = 0 THEN {CODE_TEXT} ELSE concat({CODE_TEXT}, '  ', p_name) END"
CODE_NAMES_SQL = (
    f"SELECT code, {category_sql('raw', 'abbrev', 'descr')} AS category FROM"
    f" ({split_sql(f'(SELECT DISTINCT {CODE_TEXT} AS code FROM part)')})")
WITH_TOTALS = (
    "CASE WHEN unit_row_id % 9 = 0 THEN 'Resident Totals' WHEN unit_row_id % 9 = 1 THEN"
    " 'Total:' WHEN unit_row_id % 9 = 2 THEN ' Grand old total ' WHEN unit_row_id % 9 = 3 THEN"
    " ' ' ELSE code END")
PROPOSED = (
    "CASE code WHEN 'como' THEN 'base_rent' WHEN 'SCRIE' THEN 'concession' WHEN 'VTRASH' THEN"
    " 'utility' WHEN 'CONC-Concession' THEN CASE WHEN doc_id % 2 = 0 THEN 'reimbursed_credit'"
    " ELSE 'concession' END END")
_PAIR = "('concession','reimbursed_credit')"
VERDICT = (
    "CASE WHEN proposed IS NULL THEN NULL WHEN category = proposed THEN 'noop' WHEN category ="
    f" 'other' OR (category IN {_PAIR} AND proposed IN {_PAIR}) THEN 'accept' ELSE 'decline' END")
OVERRIDE = (
    f"CASE WHEN {VERDICT} = 'accept' THEN proposed WHEN coalesce({VERDICT}, 'noop') = 'noop' AND"
    f" category IN {_PAIR} THEN category END")

# --- reconciliation ------------------------------------------------------------
PROFILE = (
    "SELECT st.*, t.stated_units, t.stated_rent, t.stated_market, t.stated_sqft, t.stated_rate,"
    " t.stated_occupied, t.stated_vacant, x.units_without_sqft FROM stats st"
    " JOIN rr_stated t ON t.doc_id = st.doc_id JOIN (SELECT doc_id,"
    " CAST(count(*) FILTER (unit_sqft IS NULL) AS BIGINT) AS units_without_sqft FROM rr_units"
    " GROUP BY doc_id) x ON x.doc_id = st.doc_id")
READING = (
    "CASE WHEN total_units = stated_units THEN 'all' WHEN counted_units = stated_units THEN"
    " 'counted_units' WHEN residential_units > 0 AND residential_units < total_units AND"
    " residential_units = stated_units THEN 'residential_only' END")
SLACK = "(model_units + down_units + applicant_units)"
OCC_DIFF = (
    "least(abs(stated_occupied - (occupied_units + notice_units)), CASE WHEN notice_units > 0"
    " THEN abs(stated_occupied - occupied_units) END)")
OCC_OK = f"({OCC_DIFF} <= greatest(1, {SLACK}))"
VAC_OK = f"(abs(stated_vacant - vacant_units) <= greatest(1, {SLACK}))"
_RENT = (
    "SELECT doc_id, stated_rent, total_monthly_rent, s, t, nt, cut, sub, abs(s - t) AS diff,"
    " greatest(5.0, s * 0.005) AS tol, abs(s - (t + nt)) AS ntgap,"
    " CASE WHEN cut <> 0 AND abs(s - (t - cut)) <= greatest(5.0, s * 0.005) THEN abs(s - (t - cut)) END AS g1,"
    " CASE WHEN sub <> 0 AND abs(s - (t - sub)) <= greatest(5.0, s * 0.005) THEN abs(s - (t - sub)) END AS g2,"
    " CASE WHEN cut + sub <> 0 AND abs(s - (t - cut - sub)) <= greatest(5.0, s * 0.005)"
    " THEN abs(s - (t - cut - sub)) END AS g3 FROM (SELECT doc_id, stated_rent,"
    " total_monthly_rent, stated_rent AS s, total_monthly_rent AS t,"
    " coalesce(non_tenant_rent, 0) AS nt, coalesce(total_concessions, 0) +"
    " coalesce(total_employee_discount, 0) AS cut, coalesce(total_subsidy_rent, 0) AS sub FROM prof)")
RENT_BASIS = (
    f"SELECT doc_id, stated_rent, total_monthly_rent, nt, cut, sub, CAST(diff AS {W}) AS diff, basis,"
    f" CAST(CASE basis WHEN 'exact' THEN 0 WHEN 'non_tenant_rent' THEN ntgap WHEN 'convention' THEN"
    f" least(g1, g2, g3) ELSE diff END AS {W}) AS residual, CASE WHEN g1 = least(g1, g2, g3) THEN 1"
    " WHEN g2 = least(g1, g2, g3) THEN 2 ELSE 3 END AS variant FROM (SELECT *, CASE WHEN diff <= 1"
    " THEN 'exact' WHEN nt > 0 AND ntgap <= tol THEN 'non_tenant_rent' WHEN coalesce(g1, g2, g3) IS"
    " NOT NULL THEN 'convention' WHEN diff <= s * 0.01 THEN 'unexplained_in_tolerance' ELSE"
    f" 'mismatch' END AS basis FROM ({_RENT}))")
COMPONENTS = (
    "SELECT doc_id, 'rent on units without tenants' AS label, CAST(nt AS DECIMAL(28,2)) AS amount"
    " FROM rec WHERE basis = 'non_tenant_rent' UNION ALL SELECT doc_id, 'reductions added back',"
    " CAST(-cut AS DECIMAL(28,2)) FROM rec WHERE basis = 'convention' AND variant IN (1, 3)"
    " UNION ALL SELECT doc_id, 'subsidy removed', CAST(-sub AS DECIMAL(28,2)) FROM rec"
    " WHERE basis = 'convention' AND variant IN (2, 3)")
COMPARED = (
    ("rent_matches", "stated_rent", "total_monthly_rent"),
    ("sqft_matches", "stated_sqft", "total_sqft"),
    ("occupied_matches", "stated_occupied", "occupied_units"),
    ("vacant_matches", "stated_vacant", "vacant_units"),
    ("market_matches", "stated_market", "total_market_rent"))

# --- validation ------------------------------------------------------------------
UNIT_KEY = "concat(upper(trim(coalesce(building, ''))), '|', upper(trim(unit_number)))"
_LABEL = ("CASE WHEN coalesce(building, '') <> '' THEN concat(building, ' ', unit_number)"
          " ELSE unit_number END")
DUPLICATES = (
    f"SELECT doc_id, {UNIT_KEY} AS unit_key, count(*) AS copies, arg_min({_LABEL}, unit_row_id)"
    " AS label, min(unit_row_id) AS first_row FROM rr_units GROUP BY 1, 2 HAVING count(*) > 1")
DUPLICATE_ROWS = (
    f"SELECT doc_id, CAST(count(*) - count(DISTINCT {UNIT_KEY}) AS BIGINT) AS duplicate_rows"
    " FROM rr_units GROUP BY doc_id")
_SHAPE = "^([A-Za-z-]*)([0-9]+)([A-Za-z]*)$"
GAPS = (
    "SELECT doc_id, prefix, concat(prefix, CAST(m AS VARCHAR)) AS missing_unit, gap_no FROM"
    " (SELECT doc_id, prefix, n - 1 AS m, row_number() OVER (PARTITION BY doc_id, prefix ORDER BY n)"
    " AS gap_no FROM (SELECT doc_id, prefix, n, lag(n) OVER (PARTITION BY doc_id, prefix ORDER BY n)"
    " AS p, sum(c) OVER w AS total, count(*) OVER w AS d, max(n) OVER w - min(n) OVER w + 1 AS span"
    f" FROM (SELECT doc_id, regexp_extract(unit_number, '{_SHAPE}', 1) AS prefix,"
    f" CAST(regexp_extract(unit_number, '{_SHAPE}', 2) AS BIGINT) AS n, count(*) AS c"
    " FROM rr_units GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY doc_id, prefix))"
    " WHERE n - p = 2 AND total >= 10 AND d * 5 >= span * 4) WHERE gap_no <= 3")
ODD_NUMBER = "CASE WHEN unit_row_id % 500 = 3 THEN concat(unit_number, '99') ELSE unit_number END"
ODD_TYPE = ("CASE WHEN unit_row_id % 40 = 1 THEN concat('$', CAST(monthly_rent AS STRING))"
            " ELSE unit_type END")
ODD_RENT = ("CASE WHEN unit_row_id % 700 = 9 THEN CAST(0 AS DECIMAL(18,2)) ELSE monthly_rent END")
_ODD = (
    f"(SELECT doc_id, unit_row_id, status, {ODD_NUMBER} AS unit_number, {ODD_TYPE} AS unit_type,"
    f" {ODD_RENT} AS monthly_rent FROM rr_units)")
SUSPICIOUS_UNITS = (
    f"SELECT doc_id, unit_row_id, 'occupied_without_rent' AS rule FROM {_ODD} WHERE status ="
    f" 'occupied' AND coalesce(monthly_rent, 0) = 0 UNION ALL SELECT doc_id, unit_row_id,"
    f" 'type_equals_rent' FROM {_ODD} WHERE monthly_rent <> 0 AND abs(TRY_CAST(regexp_replace("
    "unit_type, '[$,\\s]', '', 'g') AS DOUBLE) - CAST(monthly_rent AS DOUBLE)) < 0.005 UNION ALL"
    f" SELECT doc_id, unit_row_id, 'number_above_9000' FROM {_ODD} WHERE"
    " CAST(regexp_replace(unit_number, '[^0-9]', '', 'g') AS BIGINT) > 9000")
SUSPICIOUS = (
    "SELECT doc_id, rule, count(*) AS n_units, CASE WHEN rule = 'type_equals_rent' THEN 'critical'"
    f" ELSE 'warning' END AS severity FROM ({SUSPICIOUS_UNITS}) GROUP BY doc_id, rule HAVING CASE"
    " rule WHEN 'occupied_without_rent' THEN count(*) <= 3 WHEN 'type_equals_rent' THEN"
    " count(*) >= 3 ELSE true END")
_SUS_PLAIN = SUSPICIOUS.replace(_ODD, "rr_units")


def _check(name, status, stated, calculated, basis="CAST(NULL AS VARCHAR)", where=""):
    return (
        f"SELECT p.doc_id, '{name}' AS check_id, {status} AS status, CAST({stated} AS {W}) AS"
        f" stated, CAST({calculated} AS {W}) AS calculated, {basis} AS basis FROM prof p JOIN dupn d"
        f" ON d.doc_id = p.doc_id JOIN rec r ON r.doc_id = p.doc_id {where}")


def _pf(cond, known="true"):
    return f"CASE WHEN NOT ({known}) THEN 'skipped' WHEN {cond} THEN 'passed' ELSE 'failed' END"


_SQGAP = "abs(stated_sqft - total_sqft)"
CHECKS = " UNION ALL ".join([
    _check("unit-count", _pf(f"{READING} IS NOT NULL", "stated_units IS NOT NULL"), "stated_units",
           "total_units", READING),
    _check("no-duplicates", _pf("duplicate_rows = 0"), "NULL", "duplicate_rows"),
    _check("no-missing-numbers", _pf("true"), "NULL", "0"),
    _check("total-rent", _pf("r.basis <> 'mismatch'", "coalesce(p.stated_rent, 0) <> 0 AND"
           " coalesce(p.total_monthly_rent, 0) <> 0"), "p.stated_rent", "p.total_monthly_rent",
           "r.basis"),
    _check("occupied-count", _pf(OCC_OK, "stated_occupied IS NOT NULL"), "stated_occupied",
           "occupied_units + notice_units"),
    _check("vacant-count", _pf(VAC_OK, "stated_vacant IS NOT NULL"), "stated_vacant",
           "vacant_units"),
    _check("total-sqft", _pf(f"{_SQGAP} <= stated_sqft * 0.01 OR {_SQGAP} <= 10",
           "coalesce(stated_sqft, 0) <> 0 AND coalesce(total_sqft, 0) <> 0"), "stated_sqft",
           "total_sqft"),
    _check("total-market-rent", _pf("abs(stated_market - total_market_rent) <= greatest(5.0,"
           " stated_market * 0.005)", "stated_market IS NOT NULL AND total_market_rent IS NOT NULL"),
           "stated_market", "total_market_rent", where="WHERE stated_market IS NOT NULL OR"
           " total_market_rent IS NOT NULL"),
])
TALLY = (
    "SELECT doc_id, passed, failed, skipped, total, CASE WHEN failed = 0 AND skipped <= 2 THEN"
    " 'high' WHEN failed <= 1 AND passed >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM"
    " (SELECT doc_id, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status ="
    " 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) AS total"
    " FROM checks GROUP BY doc_id)")
_RATE = "(CASE WHEN stated_rate > 0 AND stated_rate <= 1 THEN stated_rate * 100 ELSE stated_rate END)"


def _mism(field, severity, bad, stated, calculated):
    return (
        f"SELECT doc_id, '{field}' AS field, '{severity}' AS severity, CAST({stated} AS {W}) AS"
        f" stated, CAST({calculated} AS {W}) AS calculated FROM prof WHERE {bad}")


_GAP = "abs(stated_rent - total_monthly_rent)"
MISMATCHES = " UNION ALL ".join([
    _mism("totalMonthlyRent", "warning",
          f"total_monthly_rent > 0 AND NOT ({_GAP} <= 1 OR (coalesce(non_tenant_rent, 0) > 0 AND"
          " abs(stated_rent - (total_monthly_rent + non_tenant_rent)) <= greatest(5.0, stated_rent *"
          f" 0.005)) OR {_GAP} <= stated_rent * 0.01)", "stated_rent", "total_monthly_rent"),
    _mism("totalSqft", "warning", f"total_sqft > 0 AND {_SQGAP} > stated_sqft * 0.01 AND"
          f" {_SQGAP} > 10", "stated_sqft", "total_sqft"),
    _mism("occupiedUnits", "warning", f"NOT {OCC_OK}", "stated_occupied",
          "occupied_units + notice_units"),
    _mism("vacantUnits", "warning", f"NOT {VAC_OK}", "stated_vacant", "vacant_units"),
    _mism("occupancyRate", "info", f"physical_occupancy > 0 AND abs({_RATE} - physical_occupancy)"
          " > 1", _RATE, "physical_occupancy"),
])


def _issue(kind, severity, rule, label, n, seq, source, stated="NULL", calculated="NULL"):
    return (
        f"SELECT doc_id, '{kind}' AS type, {severity} AS severity, {rule} AS rule, CAST({label} AS"
        f" VARCHAR) AS label, CAST({n} AS BIGINT) AS n, CAST({stated} AS {W}) AS stated,"
        f" CAST({calculated} AS {W}) AS calculated, {seq} AS seq FROM {source}")


ISSUES = " UNION ALL ".join([
    _issue("duplicate", "'critical'", "'duplicate'", "label", "copies", 2, "dup"),
    _issue("count_mismatch", "CASE WHEN stated_units IS NULL THEN 'warning' ELSE 'critical' END",
           "'count_mismatch'", "NULL", "NULL", 3, f"prof WHERE {READING} IS NULL", "stated_units",
           "total_units"),
    _issue("gap", "'info'", "'gap'", "missing_unit", "1", 4, "gaps"),
    _issue("suspicious", "severity", "rule", "NULL", "n_units", 5, f"({_SUS_PLAIN})"),
    _issue("summary_mismatch", "severity", "field", "NULL", "NULL", 6, "mism", "stated",
           "calculated"),
])

# --- outliers ----------------------------------------------------------------------
MARK_RENT = (
    "CASE WHEN unit_row_id % 101 = 0 THEN CAST(50 AS DECIMAL(18,2)) WHEN unit_row_id % 103 = 0 THEN"
    " CAST(12000 AS DECIMAL(18,2)) WHEN unit_row_id % 107 = 0 THEN CAST(0 AS DECIMAL(18,2))"
    " ELSE monthly_rent END")
MARK_SQFT = (
    "CASE WHEN unit_row_id % 109 = 0 THEN CAST(150 AS DOUBLE) WHEN unit_row_id % 113 = 0 THEN"
    " CAST(6000 AS DOUBLE) ELSE unit_sqft END")
MARKED = (
    f"(SELECT doc_id, unit_row_id, status, tenant_name, {MARK_RENT} AS monthly_rent,"
    f" CAST({MARK_SQFT} AS DECIMAL(18,2)) AS unit_sqft FROM rr_units)")


def bounds(value: str, when: str, view: str = "rr_units") -> str:
    at = lambda k, name: f"max(v) FILTER (rn - 1 = {k}) AS {name}"
    return (
        "SELECT doc_id, n, q1, q3, CAST((m1 + m2) / 2 AS DECIMAL(18,3)) AS median,"
        " CAST(q3 - q1 AS DECIMAL(18,2)) AS iqr, CAST(q1 - (q3 - q1) * 1.5 AS DECIMAL(18,3)) AS"
        f" lower, CAST(q3 + (q3 - q1) * 1.5 AS DECIMAL(18,3)) AS upper, CAST(total AS {W}) AS total,"
        " std_dev FROM (SELECT doc_id, n, "
        + ", ".join([at("floor(n * 0.25)", "q1"), at("floor(n * 0.75)", "q3"),
                     at("floor((n - 1) / 2)", "m1"), at("floor(n / 2)", "m2")])
        + ", sum(v) AS total, stddev_pop(CAST(v AS DOUBLE)) AS std_dev FROM (SELECT doc_id, v,"
        " row_number() OVER (PARTITION BY doc_id ORDER BY v) AS rn, count(*) OVER (PARTITION BY"
        f" doc_id) AS n FROM (SELECT doc_id, CAST({value} AS DECIMAL(18,2)) AS v FROM {view} WHERE"
        f" {when})) GROUP BY doc_id, n)")


_TEN = "status IN ('occupied','notice')"
_MB = (
    f"WITH rb AS ({bounds('monthly_rent', PAYS, MARKED)}), sb AS"
    f" ({bounds('unit_sqft', 'unit_sqft > 0', MARKED)}) SELECT m.*, rb.n AS rn, rb.iqr AS ri,"
    " rb.lower AS rl, rb.upper AS ru, sb.n AS sn, sb.iqr AS si, sb.lower AS sl, sb.upper AS su"
    f" FROM {MARKED} m LEFT JOIN rb ON rb.doc_id = m.doc_id LEFT JOIN sb ON sb.doc_id = m.doc_id")
MARKS = (
    "SELECT doc_id, unit_row_id, field, type FROM (SELECT doc_id, unit_row_id, 'monthlyRent' AS"
    " field, CASE WHEN monthly_rent > 10000 THEN 'warning' WHEN monthly_rent > 0 AND monthly_rent <"
    f" 100 THEN 'warning' WHEN {_TEN} AND coalesce(monthly_rent, 0) = 0 THEN 'critical' WHEN {_TEN}"
    " AND rn >= 5 AND ri > 0 AND (monthly_rent < rl OR monthly_rent > ru) THEN 'outlier' END AS"
    f" type FROM ({_MB}) UNION ALL SELECT doc_id, unit_row_id, 'unitSqft', CASE WHEN unit_sqft >"
    " 5000 THEN 'warning' WHEN unit_sqft > 0 AND unit_sqft < 200 THEN 'warning' WHEN sn >= 5 AND"
    " si > 0 AND (unit_sqft < sl OR unit_sqft > su) THEN 'outlier' END FROM"
    f" ({_MB}) UNION ALL SELECT doc_id, unit_row_id, 'tenantName', CASE WHEN status = 'occupied' AND"
    " trim(coalesce(tenant_name, '')) = '' THEN 'warning' WHEN status IN ('vacant','model','down')"
    " AND trim(coalesce(tenant_name, '')) <> '' THEN 'warning' END FROM"
    f" ({_MB})) WHERE type IS NOT NULL")

# --- units --------------------------------------------------------------------------
_RAW = ("Occupied", "Occupied No Notice", " NTV ", "Vacant Unrented Ready", "vacant-leased",
        "Model", "Admin Unit", "Future Resident", "Eviction", "", None, "C", "Notice Unrented",
        "xyz")
_WORD = ("occupied", "occupied", "notice", "vacant", "vacant", "model", "down", "applicant",
         "occupied", "vacant", "vacant", "occupied", "notice", "occupied")
RAW_STATUS = "CASE unit_row_id % 14 " + " ".join(
    f"WHEN {i} THEN '{t}'" for i, t in enumerate(_RAW) if t is not None) + " END"
NORM_STATUS = "CASE unit_row_id % 14 " + " ".join(
    f"WHEN {i} THEN '{t}'" for i, t in enumerate(_WORD)) + " END"
SHAPE_ROWS = (
    "SELECT *, category AS prior, unit_type = '--/--' AS blank, concat(category, '|',"
    " upper(regexp_extract(unit_number, '^[A-Za-z]+')), '|', CASE WHEN unit_type = '--/--' THEN"
    " '(blank)' ELSE unit_type END) AS shape_key FROM rr_units")
CANDIDATES = (
    "SELECT g.doc_id, shape_key, prior, n_rows, n_typed, n_units FROM (SELECT doc_id, shape_key,"
    " prior, blank, count(*) AS n_rows FROM rowz GROUP BY 1, 2, 3, 4) g JOIN (SELECT doc_id,"
    " count(*) AS n_units, count(*) FILTER (NOT blank) AS n_typed FROM rowz GROUP BY 1) t ON"
    " t.doc_id = g.doc_id WHERE prior = 'commercial' OR (prior = 'residential' AND blank AND"
    " n_typed >= 3 AND n_typed * 4 >= n_units AND n_typed >= n_rows)")
CAT_PROPOSED = (
    "CASE WHEN prior = 'commercial' THEN 'residential' WHEN doc_id % 2 = 0 THEN 'commercial'"
    " ELSE 'non_unit_income' END")
CAT_EVIDENCE = (
    "CASE doc_id % 4 WHEN 0 THEN 'no_bed_bath' WHEN 1 THEN 'dwelling_markers' WHEN 2 THEN 'unsure'"
    " ELSE 'unit_label' END")
_SUPPORT = " OR ".join(
    f"(proposed = '{c}' AND evidence IN ({', '.join(repr(e) for e in es)}))"
    for c, es in V.EVIDENCE_SUPPORT.items())
_UNGROUNDED = ", ".join(f"'{e}'" for e in V.UNGROUNDED_EVIDENCE)
COHERENT = f"(evidence IN ({_UNGROUNDED}) OR {_SUPPORT})"
CAT_VERDICT = (
    f"CASE WHEN prior = proposed THEN 'noop' WHEN evidence IN ({_UNGROUNDED}) THEN 'decline' WHEN"
    f" {_SUPPORT} THEN 'accept' ELSE 'decline' END")
