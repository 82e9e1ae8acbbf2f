"""Queries over sheets: inventories, the walk and its gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitwise.functions import fixed_values as V
from unitwise.functions import scalars as S
from unitwise.operators import cells as C
from unitwise.operators import prove as P
from unitwise.operators import walk as W
from unitwise.registry.base import register
from unitwise.session import stage
from unitwise.sources import corpus
from unitwise.sources import sheets as G
from unitwise.sources import tables as T
from unitwise.sources.tables import with_views

M, WIDE = "DECIMAL(18,2)", "DECIMAL(28,2)"


def cells_of(*sheets):
    return lambda sp, d: G.cells(sp, d, *sheets)


def duck(body: str, *sheets: str, **extra: str) -> str:
    names = ["rr_units"]
    return with_views(body, *names, extra={**G.duck_views(*sheets), **extra})


both, roll, lease = cells_of("roll", "lease"), cells_of("roll"), cells_of("lease")
everything = cells_of("roll", "lease", "summary")

# --- sheets as text ------------------------------------------------------------
_RANGE = ("SELECT doc_id, sheet, min(row) AS first_row, max(row) AS last_row, min(col) AS first_col,"
          " max(col) AS last_col FROM rr_cells WHERE trim(text) <> '' GROUP BY 1, 2")
_SHOWN = ("CASE WHEN num_fmt = 'mm/dd/yyyy' THEN CAST(DATE '1899-12-30' + CAST(num AS INT) AS"
          " VARCHAR) ELSE trim(text) END")
_GRID = (
    "SELECT doc_id, sheet, row, concat('R', CAST(row + 1 AS VARCHAR), ': ', string_agg(coalesce(t, ''),"
    " ' | ' ORDER BY col)) AS line FROM (SELECT w.doc_id, w.sheet, w.row, g.col, c.t FROM (SELECT"
    " c.doc_id, c.sheet, c.row, first_col, max(col) AS row_last FROM rr_cells c JOIN rng r ON"
    " r.doc_id = c.doc_id AND r.sheet = c.sheet GROUP BY 1, 2, 3, 4) w JOIN (SELECT"
    " unnest(range(0, 20)) AS col) g ON g.col >= w.first_col AND g.col <= w.row_last LEFT JOIN"
    f" (SELECT doc_id, sheet, row, col, {_SHOWN} AS t FROM rr_cells) c ON c.doc_id = w.doc_id AND"
    " c.sheet = w.sheet AND c.row = w.row AND c.col = g.col) GROUP BY doc_id, sheet, row")
_text = {"rng": _RANGE, "grid": _GRID}

register("used_range", lambda sp, d: W.used_range(both(sp, d)),
         duck(_RANGE, "roll", "lease"))
register("row_text", lambda sp, d: W.sheet_rows(roll(sp, d)).select(
    "doc_id", "sheet", "row", W.row_text(F.col("m")).alias("txt")), duck(
    "SELECT doc_id, sheet, row, coalesce(lower(string_agg(trim(text), ' ' ORDER BY col)"
    " FILTER (col <= 12 AND trim(text) <> '')), '') AS txt FROM rr_cells GROUP BY 1, 2, 3", "roll"))
register("sheet_grid", lambda sp, d: C.sheet_grid(both(sp, d)),
         duck("SELECT * FROM grid", "roll", "lease", **_text))
register("sheet_inventory", lambda sp, d: C.sheet_inventory(both(sp, d)), duck(
    "SELECT doc_id, sheet, last_row - first_row + 1 AS n_rows, CAST(last_col - first_col + 1 AS"
    f" BIGINT) AS n_cols FROM ({_RANGE})", "roll", "lease"))
register("text_inventory", lambda sp, d: C.text_inventory(T.table(sp, d, "documents")),
         "SELECT doc_id, n AS n_chars, n < 100 AS likely_scanned FROM (SELECT doc_id,"
         " length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS n FROM documents)")
register("vendor_tags", lambda sp, d: T.table(sp, d, "documents").select(
    "doc_id", S.vendor_tag(F.expr(
        "concat(text, CASE doc_id % 5 WHEN 0 THEN ' RealPage' WHEN 1 THEN ' YARDI' WHEN 2 THEN"
        " ' resman yardi' ELSE '' END)")).alias("vendor")),
    "SELECT doc_id, CASE WHEN contains(t, 'onesite') OR contains(t, 'realpage') THEN 'onesite' WHEN"
    " contains(t, 'resman') THEN 'resman' WHEN contains(t, 'yardi') THEN 'yardi' ELSE 'unknown' END"
    " AS vendor FROM (SELECT doc_id, lower(concat(text, CASE doc_id % 5 WHEN 0 THEN ' RealPage'"
    " WHEN 1 THEN ' YARDI' WHEN 2 THEN ' resman yardi' ELSE '' END)) AS t FROM documents)")


def _scores(sp, d):
    cells = everything(sp, d)
    return C.sheet_scores(C.sheet_grid(cells), C.sheet_inventory(cells))


_has = lambda ws: ("bool_or(row - first_row < 14 AND regexp_matches(lower(line), '"
                   + "|".join(ws) + "'))")
_SCORES = (
    "SELECT doc_id, sheet, CASE WHEN n_rows < 3 THEN 0 ELSE CASE WHEN uw THEN 2 ELSE 0 END + CASE"
    " WHEN mw THEN 2 ELSE 0 END + CASE WHEN nums >= 5 THEN 1 ELSE 0 END END AS score FROM (SELECT"
    f" g.doc_id, g.sheet, last_row - first_row + 1 AS n_rows, {_has(V.SHEET_UNIT_WORDS)} AS uw,"
    f" {_has(V.SHEET_MONEY_WORDS)} AS mw, sum(len(regexp_extract_all(line,"
    " '\\b\\d{3,5}(\\.\\d{2})?\\b'))) AS nums FROM grid g JOIN rng r ON r.doc_id = g.doc_id AND"
    " r.sheet = g.sheet GROUP BY 1, 2, 3)")
register("sheet_scores", _scores, duck(_SCORES, "roll", "lease", "summary", **_text))

_NO = "CASE sheet WHEN 'roll' THEN 1 WHEN 'lease' THEN 2 ELSE 3 END"
def _selected(sp, d):
    """The scores, one row a sheet, are staged: the selection reads them several times."""
    scores = stage(_scores(sp, d))
    return C.select_sheets(scores.withColumn("sheet_no", F.expr(_NO)), scores.select("doc_id", "sheet", F.expr(
        "doc_id % 3 = 1 OR (doc_id % 3 = 0 AND sheet = 'lease')").alias("is_unit_level")))


register("select_sheets", _selected, duck(
    "SELECT doc_id, sheet FROM sc WHERE score > 0 AND n > 1 AND (doc_id % 3 = 1 OR (doc_id % 3 = 0"
    " AND sheet = 'lease')) UNION ALL SELECT doc_id, arg_min(sheet, no) FROM sc WHERE score > 0 AND"
    " NOT (n > 1 AND ok) GROUP BY doc_id UNION ALL SELECT doc_id, arg_max(sheet, score * 10 - no)"
    " FROM sc WHERE n = 0 GROUP BY doc_id", "roll", "lease", "summary", **_text, sc=(
        f"SELECT *, {_NO} AS no, count(*) FILTER (score > 0) OVER (PARTITION BY doc_id) AS n,"
        " bool_or(score > 0 AND (doc_id % 3 = 1 OR (doc_id % 3 = 0 AND sheet = 'lease'))) OVER"
        f" (PARTITION BY doc_id) AS ok FROM ({_SCORES})")))
register("sample_rows", lambda sp, d: C.sample_rows(C.sheet_grid(roll(sp, d))), duck(
    "SELECT doc_id, sheet, row, line, line_no, part FROM (SELECT *, CASE WHEN n <= 130 THEN 'whole'"
    " WHEN line_no <= 50 THEN 'first' WHEN line_no > n - 60 THEN 'last' WHEN line_no > n // 2 - 8"
    " AND line_no <= n // 2 + 8 THEN 'middle' END AS part FROM (SELECT *, row_number() OVER"
    " (PARTITION BY doc_id, sheet ORDER BY row) AS line_no, count(*) OVER (PARTITION BY doc_id,"
    " sheet) AS n FROM grid)) WHERE part IS NOT NULL", "roll", **_text))
register("sample_rows_older", lambda sp, d: C.sample_rows_older(C.sheet_grid(both(sp, d))), duck(
    "SELECT g.* FROM grid g JOIN rng r ON r.doc_id = g.doc_id AND r.sheet = g.sheet WHERE row <"
    " first_row + 35 OR (last_row - 69 > first_row + 35 AND row > last_row - 70)", "roll", "lease",
    **_text))
_HEAD = ("SELECT doc_id, sheet, lower(substr(string_agg(line, chr(10) ORDER BY row), 1, 8000)) AS"
         " head FROM grid GROUP BY 1, 2")
register("column_hints", lambda sp, d: C.column_hints(C.sheet_grid(both(sp, d))), duck(
    "SELECT doc_id, sheet, concat_ws(',', " + ", ".join(
        f"CASE WHEN regexp_matches(head, '{p}') THEN '{n}' END" for n, p in V.COLUMN_HINTS)
    + f") AS hints FROM ({_HEAD})", "roll", "lease", **_text))
register("summary_sheets", lambda sp, d: C.summary_sheets(
    C.sheet_grid(everything(sp, d)), C.sheet_inventory(everything(sp, d)),
    everything(sp, d).filter("sheet = 'roll'").select("doc_id", "sheet").distinct()), duck(
    "SELECT g.doc_id, g.sheet FROM grid g JOIN rng r ON r.doc_id = g.doc_id AND r.sheet = g.sheet"
    " WHERE g.sheet <> 'roll' AND last_row - first_row + 1 <= 80 GROUP BY 1, 2 HAVING"
    " bool_or(regexp_matches(line, '(?i)total|summar|occupan|#\\s*units|unit\\s*status|averages'))",
    "roll", "lease", "summary", **_text))
register("column_inventory", lambda sp, d: C.column_inventory(both(sp, d)), duck(
    "SELECT doc_id, sheet, col, value, n, CASE WHEN ns * 5 >= n * 3 THEN CAST(sm AS DECIMAL(18,2))"
    " END AS next_sum FROM (SELECT *, count(*) OVER w AS vals, sum(n) OVER w AS occ FROM (SELECT"
    " c.doc_id, c.sheet, c.col, trim(c.text) AS value, count(*) AS n, count(x.amt) AS ns,"
    " sum(x.amt) AS sm FROM rr_cells c LEFT JOIN (SELECT doc_id, sheet, row, col, CASE WHEN ctype ="
    " 'n' THEN CAST(num AS DECIMAL(18,4)) ELSE CAST(TRY_CAST(nullif(regexp_extract(regexp_replace("
    "text, '[$,\\s]', '', 'g'), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?', 0), '') AS"
    " DOUBLE) AS DECIMAL(18,4)) END AS amt FROM rr_cells) x ON x.doc_id = c.doc_id AND x.sheet ="
    " c.sheet AND x.row = c.row AND x.col = c.col + 1 WHERE c.ctype = 's' AND trim(c.text) <> '' AND"
    " length(trim(c.text)) <= 25 AND NOT regexp_matches(c.text, '[0-9]{3,}') GROUP BY 1, 2, 3, 4)"
    " WINDOW w AS (PARTITION BY doc_id, sheet, col)) WHERE vals BETWEEN 2 AND 25 AND occ >= 10",
    "roll", "lease"))
register("nonstandard_layout", lambda sp, d: C.detect_nonstandard_layout(everything(sp, d)))

# --- the walk ----------------------------------------------------------------------


def walk_of(sp, d, *sheets, **how) -> W.Walk:
    return W.walk(G.cells(sp, d, *sheets), G.structures(sp, d, *sheets), **how)


_n = lambda c: f"coalesce({c}, 0)"
_ROLL_UNITS = (
    "SELECT doc_id, 'roll' AS sheet, unit_row_id + 3 AS source_row, unit_number, status,"
    " 'residential' AS category, true AS include_in_unit_count,"
    f" CAST({_n('monthly_rent')} + {_n('concession')} + {_n('subsidy_rent')} AS {M}) AS monthly_rent,"
    f" market_rent, nullif({_n('subsidy_rent')}, 0) AS subsidy_rent, nullif({_n('concession')}, 0)"
    " AS concession, tenant_name, unit_sqft, unit_type,"
    f" {G.STATUS_TEXT} AS lease_status, CAST(lease_start_date AS VARCHAR) AS lease_start_date,"
    " CAST(lease_end_date AS VARCHAR) AS lease_end_date,"
    f" CAST({G.TOTAL} AS DECIMAL(18,4)) AS block_charge_total, CASE WHEN nl > 0 THEN"
    f" CAST({G.TOTAL} AS DECIMAL(24,4)) END AS charge_sum, nl AS n_lines FROM (SELECT *, CAST("
    + " + ".join(f"CASE WHEN {_n(c)} <> 0 THEN 1 ELSE 0 END" for c in (
        "monthly_rent", "concession", "subsidy_rent", "employee_discount"))
    + " + CASE WHEN unit_row_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS nl FROM rr_units)"
    " WHERE status <> 'down'")
_cols_roll = ["doc_id", "sheet", "source_row", "unit_number", "status", "category",
              "include_in_unit_count", "monthly_rent", "market_rent", "subsidy_rent", "concession",
              "tenant_name", "unit_sqft", "unit_type", "lease_status",
              "CAST(lease_start_date AS STRING) AS lease_start_date",
              "CAST(lease_end_date AS STRING) AS lease_end_date",
              "block_charge_total", "charge_sum", "n_lines"]
register("walk_row_layout", lambda sp, d: walk_of(sp, d, "roll").units.selectExpr(*_cols_roll),
         duck(_ROLL_UNITS, "roll"))
_at = lambda k: f"max(amount) FILTER (line_no = {k})"
_LEASE_UNITS = (
    "SELECT u.doc_id, 'lease' AS sheet, u.unit_row_id * 16 + 2 AS source_row, unit_number, CASE WHEN"
    " tenant_name IS NULL THEN 'vacant' ELSE 'occupied' END AS status, CASE WHEN a1 IS NULL AND a2"
    f" IS NULL AND a7 IS NULL AND a4 IS NULL THEN NULL ELSE CAST({_n('a1')} + {_n('a2')} +"
    f" {_n('a7')} + {_n('a4')} AS {M}) END AS monthly_rent, CASE WHEN a1 IS NOT NULL AND"
    f" u.unit_row_id % 4 <> 3 THEN CAST(1000 + u.unit_row_id % 500 AS {M}) END AS market_rent,"
    " a2 AS subsidy_rent, a4 AS concession, tenant_name, unit_sqft, CAST(total AS DECIMAL(18,4)) AS"
    " block_charge_total, CAST(total AS DECIMAL(24,4)) AS charge_sum, coalesce(nl, 0) AS n_lines,"
    " a1, a2, a4, a7 FROM rr_units u LEFT JOIN (SELECT unit_row_id, "
    + ", ".join(f"{_at(k)} AS a{k}" for k in (1, 2, 4, 7))
    + ", sum(amount) AS total, count(*) AS nl FROM rr_lines GROUP BY 1) l ON l.unit_row_id ="
    " u.unit_row_id")
_cols_lease = ["doc_id", "sheet", "source_row", "unit_number", "status", "monthly_rent",
               "market_rent", "subsidy_rent", "concession", "tenant_name", "unit_sqft",
               "block_charge_total", "charge_sum", "n_lines"]
register("walk_block_layout", lambda sp, d: walk_of(sp, d, "lease").units.select(*_cols_lease),
         duck("SELECT " + ", ".join(_cols_lease) + f" FROM ({_LEASE_UNITS})", "lease"))
def _moved(sp, d) -> W.Walk:
    """The roll with everything from the sixth column on printed a hundred columns further right."""
    far, first = G.ROLL_FIRST_COL + 5, lambda i: F.when(i >= 5, i + 100).otherwise(i)
    cells = roll(sp, d).withColumn("col", F.when(F.col("col") >= far, F.col("col") + 100).otherwise(F.col("col")))
    plans = G.structures(sp, d, "roll")
    columns = F.struct(*[first(F.col(f"columns.{c}")).alias(c) for c in V.UNIT_COLUMNS])
    return W.walk(cells, plans.withColumns({
        "columns": columns, "charge_total_column": first(F.col("charge_total_column")),
        "charge_columns": F.transform("charge_columns", lambda c: c.withField("index", first(c["index"])))}))


def _irregular(sp, d) -> W.Walk:
    """Cells listed twice, a header index named twice, and a scalar mapped on the amount column."""
    cells, plans = both(sp, d), G.structures(sp, d, "roll", "lease")
    twice = cells.withColumn("_n", F.explode(F.expr("sequence(0, IF(col % 2 = 0, 1, 0))"))).drop("_n")
    return W.walk(twice, plans.withColumns({
        "extra_columns": F.concat("extra_columns", "extra_columns"),
        "columns": F.when(F.col("sheet") == "lease", F.col("columns").withField("market_rent", F.lit(5)))
        .otherwise(F.col("columns"))}))


register("walk_wide_sheet", lambda sp, d: _moved(sp, d).units.selectExpr(*_cols_roll), duck(_ROLL_UNITS, "roll"))
register("walk_irregular", lambda sp, d: _irregular(sp, d).units.select(*_cols_lease), duck(
    "SELECT " + ", ".join(_cols_lease) + f" FROM ({_ROLL_UNITS}) UNION ALL SELECT "
    + ", ".join(f"CAST(NULL AS {M}) AS market_rent" if c == "market_rent" else c for c in _cols_lease)
    + f" FROM ({_LEASE_UNITS})", "roll", "lease"))
_ROLL_LINES = " UNION ALL ".join(
    f"SELECT doc_id, 'roll' AS sheet, unit_row_id + 3 AS source_row, CAST({i} AS BIGINT) AS line_no,"
    f" '{code}' AS code, CAST({v} AS DECIMAL(18,4)) AS amount, {cat} AS category FROM rr_units WHERE"
    f" status <> 'down' AND {v} <> 0"
    for i, (code, v, cat) in enumerate((
        ("RC", "monthly_rent", "'base_rent'"), ("PREF", "concession", "'concession'"),
        ("S8", "subsidy_rent", "'subsidy'"), ("SCRIE", "employee_discount", "'reimbursed_credit'"),
        ("PETFEE", G.PET, "CAST(NULL AS VARCHAR)"))))
_LEASE_CAT = (
    "CASE line_no WHEN 1 THEN 'base_rent' WHEN 2 THEN 'subsidy' WHEN 4 THEN 'concession' WHEN 5 THEN"
    " 'reimbursed_credit' WHEN 7 THEN 'base_rent' END")
register("charge_lines", lambda sp, d: walk_of(sp, d, "roll", "lease").lines, duck(
    f"{_ROLL_LINES} UNION ALL SELECT doc_id, 'lease', unit_row_id * 16 + 2, line_no, code,"
    f" CAST(amount AS DECIMAL(18,4)), {_LEASE_CAT} FROM rr_lines", "roll", "lease"))
_captured = (("Status", G.STATUS_TEXT), ("Tenant", "tenant_name"), ("Unit Type", "unit_type"),
             ("Square Feet", "CAST(CAST(unit_sqft AS BIGINT) AS VARCHAR)"),
             ("Market Rent", "CAST(market_rent AS VARCHAR)"),
             ("Total Charged", f"CAST({G.TOTAL} AS VARCHAR)"),
             ("Lease Start", f"CAST({G.SERIAL} AS VARCHAR)"),
             ("Lease End", f"CASE WHEN lease_end_date IS NOT NULL THEN {G.US_DATE} END"))
register("source_columns", lambda sp, d: walk_of(sp, d, "roll").units.select(
    "doc_id", "source_row", F.array_join(F.transform("source_columns", lambda c: F.concat_ws(
        "=", c["header"], c["value"])), ";").alias("captured")), duck(
    "SELECT doc_id, unit_row_id + 3 AS source_row, concat_ws(';', " + ", ".join(
        f"CASE WHEN {v} IS NOT NULL THEN concat('{h}=', {v}) END" for h, v in _captured)
    + ") AS captured FROM rr_units WHERE status <> 'down'", "roll"))
register("column_stats", lambda sp, d: W.column_stats(W.sheet_rows(roll(sp, d)).withColumn(
    "start", F.lit(3))).select("doc_id", "sheet", "col", "filled", "numeric", F.col("total").cast(
        "decimal(28,4)").alias("total")), duck(
    "SELECT doc_id, sheet, col, count(*) AS filled, count(x) AS numeric, CAST(sum(CAST(x AS"
    " DECIMAL(18,4))) AS DECIMAL(28,4)) AS total FROM (SELECT *, CASE WHEN ctype = 'n' THEN num ELSE"
    " TRY_CAST(nullif(regexp_extract(regexp_replace(text, '[$,\\s]', '', 'g'),"
    " '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?', 0), '') AS DOUBLE) END AS x FROM"
    " rr_cells WHERE row >= 3 AND trim(text) <> '') GROUP BY 1, 2, 3", "roll"))
register("column_roles", lambda sp, d: walk_of(sp, d, "roll").plan.select(
    "doc_id", F.explode("charge_columns").alias("c")).select(
    "doc_id", "c.header", "c.index", "c.role"), duck(
    "SELECT doc_id, h AS header, CAST(i AS INT) AS index, r AS role FROM rr_docs CROSS JOIN (VALUES"
    " ('RC', 7, 'rent_component'), ('PREF', 8, 'owner_reduction'), ('S8', 9, 'subsidy'),"
    " ('SCRIE', 10, 'reimbursed_credit'), ('PETFEE', 11, 'fee')) v(h, i, r)", "roll"))


def _dedupe_sql(source: str, convention: str) -> str:
    rank = "CASE status " + " ".join(
        f"WHEN '{k}' THEN {v}" for k, v in V.CONVENTIONS[convention].items()) + " ELSE 0 END"
    return (
        f"SELECT *, '{convention}' AS convention FROM (SELECT *, row_number() OVER (PARTITION BY"
        f" doc_id, upper(unit_number) ORDER BY {rank} DESC, source_row) AS rn, min(source_row) OVER"
        f" (PARTITION BY doc_id, upper(unit_number)) AS place FROM ({source})) WHERE rn = 1")


_dd = ["doc_id", "source_row", "unit_number", "status", "monthly_rent", "place", "convention"]
_DEDUPED = " UNION ALL ".join(_dedupe_sql(_ROLL_UNITS, c) for c in V.CONVENTIONS)
register("dedupe_units", lambda sp, d: P.both_conventions(walk_of(sp, d, "roll").units).select(*_dd),
         duck(f"SELECT {', '.join(_dd)} FROM ({_DEDUPED})", "roll"))
_older = "CASE status " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in V.OLDER_PRIORITY.items()) + " END"
register("dedupe_units_older", lambda sp, d: W.dedupe_units_older(T.units(sp, d).withColumns(
    {"sheet": F.lit("s"), "source_row": F.col("unit_row_id")})).select(
    "doc_id", "source_row", "unit_number", "status", "place"), with_views(
    "SELECT doc_id, unit_row_id AS source_row, unit_number, status, place FROM (SELECT *,"
    " row_number() OVER (PARTITION BY doc_id, upper(unit_number) ORDER BY"
    f" {_older} DESC, (tenant_name IS NULL), unit_row_id) AS rn, min(unit_row_id) OVER (PARTITION BY"
    " doc_id, upper(unit_number)) AS place FROM rr_units) WHERE rn = 1", "rr_units"))
_SHEET_NO = "CASE coalesce(building, '') WHEN '' THEN 0 WHEN 'North' THEN 1 ELSE 2 END"
register("renumber_rows", lambda sp, d: W.renumber_rows(T.units(sp, d).withColumn(
    "sheet_no", F.expr(_SHEET_NO)), "sheet_no", "unit_row_id").select(
    "doc_id", "unit_row_id", "row_no"), with_views(
    f"SELECT doc_id, unit_row_id, row_number() OVER (PARTITION BY doc_id ORDER BY {_SHEET_NO},"
    " unit_row_id) AS row_no FROM rr_units", "rr_units"))

# --- gates ---------------------------------------------------------------------------
_POS = ("(CAST(datediff('day', DATE '1970-01-01', lease_start_date) AS BIGINT) * 100000000"
        " + unit_row_id)")
_LATE = "lease_start_date >= DATE '1997-06-01'"


def tired_units(sp, d) -> DataFrame:
    """Units in lease order, some documents losing fields towards the end."""
    late = F.expr(_LATE)
    u = T.units(sp, d)
    return u.withColumns({
        "pos": F.datediff("lease_start_date", F.lit("1970-01-01").cast("date")).cast("long")
        * 100000000 + F.col("unit_row_id"),
        "unit_type": F.when(~(late & (F.col("doc_id") % 3 == 0)), F.col("unit_type")),
        "tenant_name": F.when(~(late & (F.col("doc_id") % 5 == 0)), F.col("tenant_name")),
        "n_lines": F.when(late & (F.col("doc_id") % 4 == 0), 0).otherwise(2)})


_TIRED = (
    f"SELECT * EXCLUDE (unit_type, tenant_name), {_POS} AS pos, CASE WHEN NOT ({_LATE} AND doc_id % 3"
    f" = 0) THEN unit_type END AS unit_type, CASE WHEN NOT ({_LATE} AND doc_id % 5 = 0) THEN"
    f" tenant_name END AS tenant_name, CASE WHEN {_LATE} AND doc_id % 4 = 0 THEN 0 ELSE 2 END AS"
    " n_lines FROM rr_units")
_TEN = "status IN ('occupied','notice')"
_fat = ", ".join(
    f"count({f}) FILTER (r <= n // 4) AS a_{f}, count({f}) FILTER (r > n - n // 4) AS b_{f}"
    for f in P.FATIGUE_FIELDS)
_FATIGUE = (
    "SELECT doc_id, field FROM (SELECT doc_id, unnest([" + ", ".join(
        f"CASE WHEN a_{f} * 2 >= q AND b_{f} * 5 < a_{f} * 2 THEN '{f}' END" for f in P.FATIGUE_FIELDS)
    + ", CASE WHEN t >= 40 AND ac * 2 >= tq AND bc * 5 < ac * 2 THEN 'charges' END]) AS field FROM"
    f" (SELECT doc_id, n // 4 AS q, t // 4 AS tq, t, {_fat}, count(*) FILTER ({_TEN} AND tr <= t // 4"
    f" AND n_lines > 0) AS ac, count(*) FILTER ({_TEN} AND tr > t - t // 4 AND n_lines > 0) AS bc FROM"
    " (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r, count(*) FILTER"
    f" ({_TEN}) OVER (PARTITION BY doc_id ORDER BY pos) AS tr, count(*) OVER (PARTITION BY doc_id) AS"
    f" n, count(*) FILTER ({_TEN}) OVER (PARTITION BY doc_id) AS t FROM tired) WHERE n >= 60"
    " GROUP BY doc_id, n, t)) WHERE field IS NOT NULL")
register("fatigue_check", lambda sp, d: P.fatigue_check(tired_units(sp, d), ["doc_id"], "pos"),
         with_views(_FATIGUE, "rr_units", extra={"tired": _TIRED}))

_READ = ("(n = stated_units OR counted = stated_units OR (res > 0 AND res < n AND res ="
         " stated_units))")
_OFF = "abs(rs - stated_rent) > greatest(5.0, stated_rent * 0.005)"
_FIT = lambda v: f"({v} <> rs AND abs({v} - stated_rent) <= greatest(5.0, stated_rent * 0.005))"
_MISFILED = (f"(stated_rent > 0 AND {_OFF} AND ms > 0 AND abs(ms - stated_rent) <= greatest(5.0,"
             " stated_rent * 0.005))")
_QUOTED = (f"CASE WHEN stated_rent > 0 AND {_OFF} THEN CASE WHEN {_FIT('(rs - cut)')} THEN 'gross' WHEN"
           f" {_FIT('(rs - sub)')} THEN 'tenant_paid' WHEN {_FIT('(rs - cut - sub)')} THEN"
           " 'tenant_paid_gross' END END")
_OD = ("least(abs(stated_occupied - (occ + ntc)), CASE WHEN ntc > 0 THEN abs(stated_occupied - occ)"
       " END)")
_VSUM = (
    "SELECT s.*, n, counted, res, occ, ntc, slack, rs, ms, wm, cut, sub, wd FROM rr_stated s JOIN"
    " (SELECT doc_id, count(*) AS n, count(*) FILTER (include_in_unit_count) AS counted, count(*)"
    " FILTER (category = 'residential') AS res, count(*) FILTER (status = 'occupied') AS occ,"
    " count(*) FILTER (status = 'notice') AS ntc, count(*) FILTER (status IN"
    f" ('model','down','applicant')) AS slack, CAST(sum(coalesce(monthly_rent, 0)) AS {WIDE}) AS rs,"
    f" CAST(sum(coalesce(market_rent, 0)) AS {WIDE}) AS ms, count(market_rent) AS wm,"
    " sum(coalesce(concession, 0) + coalesce(employee_discount, 0)) AS cut,"
    " sum(coalesce(subsidy_rent, 0)) AS sub, count(*) FILTER"
    f" ({_TEN} AND (lease_start_date IS NOT NULL OR lease_end_date IS NOT NULL OR move_in_date IS NOT"
    " NULL)) AS wd FROM tired GROUP BY doc_id) u ON u.doc_id = s.doc_id")
_RULES = {
    "unit_count": f"stated_units > 0 AND NOT {_READ}",
    "total_rent": f"stated_rent > 0 AND {_OFF} AND NOT {_MISFILED} AND ({_QUOTED}) IS NULL AND NOT"
                  f" (stated_units > 0 AND {_READ} AND rs > stated_rent AND rs <= stated_rent * 1.05)",
    "market_rent": "stated_market > 0 AND wm * 5 >= n * 4 AND abs(ms - stated_market) >"
                   " greatest(5.0, stated_market * 0.005)",
    "no_dates": "n >= 60 AND occ + ntc >= 40 AND wd * 20 < occ + ntc",
    "occupied": f"NOT ({_OD} <= greatest(1, slack)) AND {_OD} > greatest(1.0, stated_occupied * 0.05)",
}
_VISSUES = " UNION ALL ".join(
    f"SELECT doc_id, '{r}' AS rule FROM vs WHERE {c}" for r, c in _RULES.items()
) + f" UNION ALL SELECT doc_id, concat('fatigue:', field) FROM ({_FATIGUE})"
_verify = {"tired": _TIRED, "vs": _VSUM, "vi": _VISSUES}


def _against_stated(sp, d):
    return P.verify_against_stated(tired_units(sp, d), T.stated(sp, d), ["doc_id"], "pos")


register("verify_against_stated", lambda sp, d: _against_stated(sp, d).issues, with_views(
    "SELECT * FROM vi", "rr_stated", extra=_verify))
register("verify_outcome", lambda sp, d: _against_stated(sp, d).outcome.select(
    "doc_id", "ok", "n_issues", "has_anchors", "quoted", "stated_rent", "stated_market"), with_views(
    "SELECT v.doc_id, coalesce(i.k, 0) = 0 AS ok, coalesce(i.k, 0) AS n_issues, true AS has_anchors,"
    f" CASE WHEN NOT coalesce({_MISFILED}, false) THEN {_QUOTED} END AS quoted, CASE WHEN NOT"
    f" coalesce({_MISFILED}, false) THEN stated_rent END AS stated_rent, CASE WHEN {_MISFILED} THEN"
    " coalesce(stated_market, stated_rent) ELSE stated_market END AS stated_market FROM vs v LEFT"
    " JOIN (SELECT doc_id, count(*) AS k FROM vi GROUP BY 1) i ON i.doc_id = v.doc_id", "rr_stated",
    extra=_verify))


def _heads(sp, d, *sheets):
    return C.header_text(C.sheet_grid(G.cells(sp, d, *sheets)))


def _tired_sheet(sp, d):
    return T.units(sp, d).withColumn("sheet", F.lit("roll")).withColumn(
        "lease_end_date", F.when(F.col("unit_row_id") % 9 == 1, F.col("lease_end_date")))


register("coverage_gate", lambda sp, d: P.coverage_gate(
    _tired_sheet(sp, d), _heads(sp, d, "roll"), W.SHEET), duck(
    "SELECT doc_id, 'roll' AS sheet, 'lease_end_date' AS field FROM rr_units WHERE"
    f" {_TEN} GROUP BY 1 HAVING count(*) >= 10 AND count(*) FILTER (unit_row_id % 9 = 1 AND"
    " lease_end_date IS NOT NULL) * 4 < count(*)", "roll"))
_LT = f"(SELECT * FROM ({_LEASE_UNITS}))"
register("charge_total_gate", lambda sp, d: P.charge_total_gate(
    walk_of(sp, d, "lease").units.withColumn("charge_sum", F.when(
        F.col("doc_id") % 3 == 0, F.col("charge_sum") - F.col("source_row") % 7).otherwise(
        F.col("charge_sum"))), W.SHEET), duck(
    "SELECT doc_id, sheet, n_totals, n_bad, (n_totals < 10 OR n_bad * 100 <= greatest(100, n_totals *"
    " 2)) AS charges_ok FROM (SELECT doc_id, sheet, count(block_charge_total) AS n_totals, count(*)"
    " FILTER (block_charge_total IS NOT NULL AND doc_id % 3 = 0 AND source_row % 7 <> 0) AS n_bad"
    f" FROM {_LT} GROUP BY 1, 2)", "lease"))
_ANCHOR = (
    "SELECT u.doc_id, 'roll' AS sheet, count(*) AS rows_with_totals, count(*) AS rows_reconciled,"
    " coalesce(min(CASE WHEN block_charge_total > 0 THEN block_charge_total END), 0) AS"
    " min_row_total, CAST(sum(block_charge_total) AS DECIMAL(28,4)) AS total_sum, CASE WHEN"
    " max(source_row) = max(last_id) + 3 THEN CAST(max(total_charged) AS DECIMAL(18,4)) END AS"
    f" grand_total, CAST(0 AS BIGINT) AS orphans FROM ({_ROLL_UNITS}) u JOIN rr_docs d ON d.doc_id ="
    " u.doc_id GROUP BY 1, 2")
register("charge_column_anchor", lambda sp, d: P.charge_column_anchor(walk_of(sp, d, "roll")),
         duck(f"SELECT doc_id, sheet, rows_with_totals, rows_reconciled, CAST(min_row_total AS"
              f" DECIMAL(18,4)) AS min_row_total, total_sum, grand_total, orphans FROM ({_ANCHOR})",
              "roll"))
register("printed_grand_total", lambda sp, d: (lambda w: P.printed_grand_total(w.rows, w.units))(
    walk_of(sp, d, "roll")), duck(f"SELECT doc_id, sheet, grand_total FROM ({_ANCHOR})", "roll"))


def _proof(sp, d):
    w = walk_of(sp, d, "roll")
    w = w._replace(units=stage(w.units))
    units = stage(P.both_conventions(w.units))
    stated = P.sheet_stated(G.structures(sp, d, "roll"))
    checked = P.verify_against_stated(units, stated, P.CONVENTION, "place")
    return P.prove_complete(units, checked.outcome, P.charge_column_anchor(w), P.CONVENTION)


_PROOF = (
    "SELECT a.doc_id, a.sheet, c.convention, CASE WHEN a.doc_id % 2 = 0 THEN 'stated_unit_count' WHEN"
    " grand_total > 0 AND rows_with_totals >= 10 AND abs(total_sum - grand_total) <= greatest(1.0,"
    " grand_total * 0.0002) AND min_row_total > greatest(1.0, grand_total * 0.0002) THEN"
    f" 'charge_column_grand_total' END AS basis, grand_total FROM ({_ANCHOR}) a CROSS JOIN (SELECT"
    " unnest(['applicant-over-vacant', 'current-occupancy']) AS convention) c")
register("prove_complete", _proof, duck(_PROOF, "roll"))


def _chosen(sp, d, w=None):
    return P.choose_convention(
        w or walk_of(sp, d, "roll"), P.sheet_stated(G.structures(sp, d, "roll")), _heads(sp, d, "roll"))


register("choose_convention", lambda sp, d: _chosen(sp, d).select(
    "doc_id", "sheet", "convention", "basis", "n_units", "rent_sum", "stated_units", "stated_rent"),
    duck(
    "SELECT p.doc_id, p.sheet, p.convention, p.basis, u.n_units, rent_sum, CASE WHEN p.doc_id % 2 = 0"
    " THEN n_roll_ids END AS stated_units, CASE WHEN abs(rent_sum - grand_total) <= greatest(5.0,"
    f" grand_total * 0.005) THEN CAST(grand_total AS {WIDE}) END AS stated_rent FROM ({_PROOF}) p JOIN"
    f" rr_docs d ON d.doc_id = p.doc_id JOIN (SELECT doc_id, count(*) AS n_units,"
    f" CAST(sum(monthly_rent) AS {WIDE}) AS rent_sum FROM"
    f" ({_dedupe_sql(_ROLL_UNITS, 'applicant-over-vacant')}) GROUP BY 1) u ON u.doc_id = p.doc_id"
    " WHERE p.basis IS NOT NULL AND p.convention = 'applicant-over-vacant'", "roll"))
def _accepted(sp, d):
    w = walk_of(sp, d, "roll")
    w = w._replace(units=stage(w.units))
    return P.accepted_units(w, _chosen(sp, d, w)).select(*_dd)


register("accepted_units", _accepted, duck(
    f"SELECT {', '.join('u.' + c for c in _dd)} FROM"
    f" ({_dedupe_sql(_ROLL_UNITS, 'applicant-over-vacant')}) u JOIN ({_PROOF}) p ON p.doc_id ="
    " u.doc_id AND p.convention = u.convention WHERE p.basis IS NOT NULL", "roll"))


def _narrow_input(sp, d):
    w = walk_of(sp, d, "lease", keep_blocks=True)
    w = w._replace(lines=stage(w.lines))
    units = stage(W.dedupe_units(w.units))
    fees = w.lines.filter(F.col("code") == "como").groupBy(*W.SHEET, "source_row").agg(
        F.sum("amount").alias("fee"))
    stated = units.join(fees, [*W.SHEET, "source_row"], "left").groupBy(*W.SHEET).agg(
        F.sum(F.coalesce("monthly_rent", F.lit(0)) - F.coalesce("fee", F.lit(0)))
        .cast(WIDE.lower()).alias("stated_rent"))
    none = lambda t: F.lit(None).cast(t)
    accepted = stated.withColumns({
        "stated_units": none("bigint"), "stated_market": none(WIDE.lower()),
        "stated_sqft": none(WIDE.lower()), "stated_rate": none("decimal(12,4)"),
        "stated_occupied": none("bigint"), "stated_vacant": none("bigint")})
    return w, units, accepted


def _narrowed(sp, d):
    w, units, accepted = _narrow_input(sp, d)
    out, _ = P.narrow_fee_codes(units, w.lines, w.plan, accepted)
    return out.select("doc_id", "source_row", "monthly_rent")


# A code that is some unit's only rent line may not go: then nothing changes.
_ONE = (f"SELECT *, bool_and(a7 IS NULL OR (a7 >= 0 AND (a1 IS NOT NULL OR a2 IS NOT NULL OR a4 IS NOT"
        " NULL))) OVER (PARTITION BY doc_id) AS fee, count(*) OVER (PARTITION BY doc_id) AS n,"
        " count(*) FILTER (status = 'occupied') OVER (PARTITION BY doc_id) AS occ FROM"
        f" ({_dedupe_sql(_LEASE_UNITS, 'applicant-over-vacant')})")
register("narrow_fee_codes", _narrowed, duck(
    "SELECT doc_id, source_row, CASE WHEN fee AND NOT (n >= 60 AND occ >= 40) THEN CASE WHEN"
    f" monthly_rent IS NOT NULL THEN CAST(monthly_rent - coalesce(a7, 0) AS {M}) END ELSE"
    f" monthly_rent END AS monthly_rent FROM ({_ONE})", "lease"))
register("suspect_codes", lambda sp, d: P.suspect_codes(walk_of(sp, d, "lease").plan).select(
    "doc_id", "sheet", "code"), duck("SELECT doc_id, 'lease' AS sheet, 'como' AS code FROM rr_docs",
                                     "lease"))

# --- documents and attempts ------------------------------------------------------------


def _attempt_units(sp, d):
    """Two readings per document; some lose a unit in the second."""
    u = T.units(sp, d)
    a = u.withColumn("attempt_no", F.lit(1))
    b = u.filter(~((F.col("doc_id") % 4 == 0) & (F.col("unit_row_id") % 50 == 7))).withColumn(
        "attempt_no", F.lit(2))
    return a.unionByName(b)


register("attempts_agree", lambda sp, d: C.attempts_agree(_attempt_units(sp, d)), with_views(
    "SELECT doc_id, NOT (doc_id % 4 = 0 AND count(*) FILTER (unit_row_id % 50 = 7) > 0) AS agree"
    " FROM rr_units GROUP BY doc_id", "rr_units"))
_ATTEMPT = ("SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY m) AS INT) AS attempt_no FROM (SELECT"
            " o_custkey AS doc_id, o_orderkey % 3 AS m, max(o_orderkey % 4 = 0) AS ok, CAST(max(o_orderkey % 5)"
            " AS BIGINT) AS n_issues, CAST(max(o_orderkey % 7) AS BIGINT) AS n_units, (o_custkey % 2 = 0) AS"
            " has_anchors FROM orders GROUP BY 1, 2, 6)")


def _attempts(sp, d):
    k = F.col("o_orderkey")
    a = T.table(sp, d, "orders").groupBy(F.col("o_custkey").alias("doc_id"), (k % 3).alias("m")).agg(
        F.max(k % 4 == 0).alias("ok"), F.max(k % 5).cast("long").alias("n_issues"),
        F.max(k % 7).cast("long").alias("n_units"))
    # At most three attempts of a document, numbered in their order.
    return a.withColumn("has_anchors", F.col("doc_id") % 2 == 0).withColumn(
        "attempt_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("m"))).drop("m")


def _better(a: str, b: str) -> str:
    """Number of the better attempt of two, by suffix; a is the earlier one."""
    return (
        f"CASE WHEN ok{b} IS NULL THEN {a} WHEN ok{a} AND NOT ok{b} THEN {a} WHEN ok{b} AND NOT"
        f" ok{a} THEN {b} WHEN i{a} < i{b} THEN {a} WHEN i{b} < i{a} THEN {b} WHEN u{b} >= u{a} THEN"
        f" {b} ELSE {a} END")


_WIDE_ATT = "SELECT doc_id, any_value(has_anchors) AS anch, " + ", ".join(
    f"max(ok) FILTER (attempt_no = {i}) AS ok{i}, max(n_issues) FILTER (attempt_no = {i}) AS i{i},"
    f" max(n_units) FILTER (attempt_no = {i}) AS u{i}" for i in (1, 2, 3)
) + f" FROM ({_ATTEMPT}) GROUP BY doc_id"
register("best_attempt", lambda sp, d: C.best_attempt(_attempts(sp, d), _attempts(sp, d).select(
    "doc_id").distinct().withColumn("agree", F.col("doc_id") % 3 == 0)), (
    "SELECT doc_id, CAST(CASE WHEN NOT ok1 THEN CASE WHEN two = 1 AND NOT ok1 AND anch THEN"
    f" {_better('1', '3')} WHEN two = 2 AND NOT ok2 AND anch THEN {_better('2', '3')} ELSE two END WHEN"
    " NOT anch AND ok2 IS NOT NULL AND i2 <= i1 AND doc_id % 3 <> 0 THEN 2 ELSE 1 END AS INT) AS"
    f" attempt_no FROM (SELECT *, {_better('1', '2')} AS two FROM ({_WIDE_ATT}) WHERE ok1 IS NOT NULL)"))


def _chunked(sp, d):
    """Units in eight chunks; every fifth is read again at the start of the next, one in ten with another rent."""
    u = T.units(sp, d).select("doc_id", "building", "unit_number", "unit_row_id", "tenant_name", "monthly_rent",
                              (F.col("unit_row_id") % 8).alias("chunk"))
    k = F.col("unit_row_id")
    again = u.filter(k % 5 == 0).withColumns({
        "chunk": F.col("chunk") + 1, "unit_number": F.lower("unit_number"),
        "monthly_rent": F.when(k % 10 == 0, F.col("monthly_rent") + 1).otherwise(F.col("monthly_rent")).cast(M)})
    return u.unionByName(again)


register("dedupe_chunks", lambda sp, d: C.dedupe_chunks(_chunked(sp, d), "unit_row_id").select(
    "doc_id", "unit_row_id", "chunk", F.col("monthly_rent").cast("string").alias("rent")), with_views(
    "SELECT doc_id, unit_row_id, chunk, CAST(monthly_rent AS VARCHAR) AS rent FROM (SELECT *, row_number() OVER"
    " (PARTITION BY doc_id, upper(coalesce(building, '')), upper(unit_number), upper(coalesce(tenant_name, '')),"
    f" monthly_rent ORDER BY chunk, unit_row_id) AS rn FROM (SELECT doc_id, building, unit_number, tenant_name,"
    f" unit_row_id, CAST(monthly_rent AS {M}) AS monthly_rent, unit_row_id % 8 AS chunk FROM rr_units UNION ALL"
    " SELECT doc_id, building, lower(unit_number), tenant_name, unit_row_id, CAST(monthly_rent + CASE WHEN"
    f" unit_row_id % 10 = 0 THEN 1 ELSE 0 END AS {M}), unit_row_id % 8 + 1 FROM rr_units WHERE unit_row_id % 5 = 0))"
    " WHERE rn = 1", "rr_units"))


def _views_of_units(sp, d):
    """Three sheets per document: the roll, a log of part of it, a sibling building."""
    u = T.units(sp, d).select("doc_id", "unit_number", "tenant_name", "unit_row_id")
    sheet = lambda no, name, df: df.withColumns(
        {"sheet_no": F.lit(no), "sheet": F.lit(name)})
    k = F.col("unit_row_id")
    return (sheet(1, "log", u.filter(k % 5 == 0)).unionByName(sheet(2, "roll", u))
            .unionByName(sheet(3, "copy", u.filter(F.col("doc_id") % 2 == 0)))
            .unionByName(sheet(4, "sibling", u.filter(k % 5 == 1).withColumn(
                "tenant_name", F.concat("tenant_name", F.lit("x"))))))


register("drop_duplicate_views", lambda sp, d: C.drop_duplicate_views(_views_of_units(sp, d)),
         with_views("SELECT DISTINCT doc_id, 'roll' AS sheet, 2 AS sheet_no FROM rr_units UNION ALL"
                    " SELECT DISTINCT doc_id, 'sibling', 4 FROM rr_units WHERE unit_row_id % 5 = 1",
                    "rr_units"))

# --- corpus ------------------------------------------------------------------------------
register("content_dedupe", lambda sp, d: corpus.content_dedupe(
    T.table(sp, d, "documents").select("doc_id", "text"), "doc_id", "text"),
    "SELECT doc_id, h AS sha256, f AS first_arrival, CASE WHEN doc_id <> f THEN f END AS duplicate_of"
    " FROM (SELECT doc_id, sha256(text) AS h, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM"
    " documents)")


def _manifest(sp, d):
    return T.table(sp, d, "documents").filter("source = 'src0'").select(
        F.sha2("text", 256).alias("sha256"),
        F.concat(F.col("doc_id").cast("string"), F.lit("__old")).alias("corpus_id"))


register("new_content", lambda sp, d: corpus.new_content(
    T.table(sp, d, "documents").select("doc_id", "text", "source"), _manifest(sp, d), "doc_id",
    "text").select("doc_id", "sha256"),
    "SELECT min(doc_id) AS doc_id, h AS sha256 FROM (SELECT doc_id, sha256(text) AS h FROM documents)"
    " WHERE h NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0') GROUP BY h")
_FILE = ("concat('Rolls & ', c_mktsegment, ' ', CAST(c_custkey AS STRING), CASE c_custkey % 6 WHEN 0"
         " THEN '.pdf' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.doc' WHEN 3 THEN '.xlsm' WHEN 4 THEN"
         " ' dhcr.xls' ELSE '.csv' END)")
_NOTE = ("CASE WHEN c_custkey % 9 = 0 THEN 'a Blank owner template' WHEN c_custkey % 10 = 0 THEN"
         " 'Registration Rent Roll' END")
register("inclusion_rules", lambda sp, d: corpus.inclusion_rules(
    T.table(sp, d, "customer").select("c_custkey", F.expr(_FILE).alias("file_name"), F.expr(
        _NOTE).alias("note"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN array('lease') ELSE"
                                     " array('lease', 'rent-roll') END").alias("types"))).select(
    "c_custkey", "excluded"),
    "SELECT c_custkey, CASE WHEN c_custkey % 6 = 4 OR c_custkey % 10 = 0 AND c_custkey % 9 <> 0 THEN"
    " 'registration' WHEN c_custkey % 9 = 0 THEN 'blank template' END AS excluded FROM customer WHERE"
    " c_custkey % 7 <> 0 AND c_custkey % 6 IN (0, 1, 3, 4)")
register("assign_corpus_ids", lambda sp, d: corpus.assign_corpus_ids(
    T.table(sp, d, "customer").select("c_custkey", F.expr(_FILE).alias("file_name")), "c_custkey",
    "file_name", _manifest(sp, d)).select("c_custkey", "corpus_id"),
    "SELECT c_custkey, concat(CASE WHEN n < 10 THEN '0' ELSE '' END, CAST(n AS VARCHAR), '__',"
    f" regexp_replace({_FILE}, '[^a-zA-Z0-9._-]+', '_', 'g')) AS corpus_id FROM (SELECT *,"
    " row_number() OVER (ORDER BY c_custkey) - 1 + 1 + (SELECT max(doc_id) FROM documents WHERE source"
    " = 'src0') AS n FROM customer)")

# --- scalar rules ---------------------------------------------------------------------------
_NUM_TEXT = (
    "CASE o_orderkey % 8 WHEN 0 THEN concat('$', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING))"
    " WHEN 1 THEN concat('(1,', CAST(100 + o_orderkey % 900 AS STRING), '.50)') WHEN 2 THEN"
    " concat(' ', CAST(o_orderkey % 97 AS STRING), 'BR / 1') WHEN 3 THEN 'n/a' WHEN 4 THEN '' WHEN 5"
    " THEN concat('-.', CAST(o_orderkey % 10 AS STRING)) WHEN 6 THEN '1 2 3' ELSE '1e2x' END")
_NUM = (
    "CASE o_orderkey % 8 WHEN 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) WHEN 1 THEN"
    " -1000.5 - (100 + o_orderkey % 900) WHEN 2 THEN CAST(o_orderkey % 97 AS DOUBLE) WHEN 5 THEN"
    " -CAST(o_orderkey % 10 AS DOUBLE) / 10 WHEN 6 THEN 123.0 WHEN 7 THEN 100.0 END")
register("parse_number", lambda sp, d: T.table(sp, d, "orders").select(
    "o_orderkey", F.round(S.parse_number(F.expr(_NUM_TEXT)), 4).alias("n")),
    f"SELECT o_orderkey, round(CASE WHEN o_orderkey % 8 = 1 THEN -(1000 + 100 + o_orderkey % 900 + 0.5)"
    f" ELSE {_NUM} END, 4) AS n FROM orders")
_DT = "CAST(o_orderdate AS DATE)"
_DAY_TEXT = (
    f"CASE o_orderkey % 6 WHEN 0 THEN concat(CAST(month({_DT}) AS STRING), '/', CAST(day({_DT}) AS"
    f" STRING), '/', CAST(year({_DT}) AS STRING)) WHEN 1 THEN concat(CAST(month({_DT}) AS STRING),"
    f" '-', CAST(day({_DT}) AS STRING), '-', CAST(year({_DT}) % 100 AS STRING)) WHEN 2 THEN"
    f" CAST({_DT} AS STRING) WHEN 3 THEN concat('2/31/', CAST(year({_DT}) AS STRING)) WHEN 4 THEN"
    f" concat('13/5/', CAST(year({_DT}) AS STRING)) ELSE 'upon request' END")
register("parse_date", lambda sp, d: T.table(sp, d, "orders").select(
    "o_orderkey", S.parse_date(F.expr(_DAY_TEXT)).cast("string").alias("day")),
    f"SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN {_DT} WHEN 1 THEN CASE WHEN year({_DT})"
    f" % 100 < 10 THEN NULL ELSE {_DT} END WHEN 2 THEN {_DT} WHEN 3 THEN last_day(make_date(year({_DT}),"
    f" 2, 1)) WHEN 4 THEN make_date(year({_DT}) + 1, 1, 5) END AS VARCHAR) AS day FROM orders")
_RANGE_TEXT = (
    f"concat(CAST(month({_DT}) AS STRING), '/', CAST(day({_DT}) AS STRING), '/', CAST(year({_DT}) AS"
    f" STRING), CASE o_orderkey % 4 WHEN 0 THEN ' to ' WHEN 1 THEN ' - ' WHEN 2 THEN ' through ' ELSE"
    f" '–' END, '12/31/', CAST(year({_DT}) AS STRING))")
register("parse_date_range", lambda sp, d: T.table(sp, d, "orders").select(
    "o_orderkey", S.parse_date_range(F.expr(_RANGE_TEXT), "start").cast("string").alias("first_day"),
    S.parse_date_range(F.expr(_RANGE_TEXT), "end").cast("string").alias("last_day")),
    f"SELECT o_orderkey, CAST({_DT} AS VARCHAR) AS first_day, concat(CAST(year({_DT}) AS VARCHAR),"
    " '-12-31') AS last_day FROM orders")
register("serial_dates", lambda sp, d: T.table(sp, d, "orders").select(
    "o_orderkey", S.serial_to_date(F.col("o_orderkey") + F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 0.5"
                                                                " ELSE 0.25 END").cast("double"))
    .cast("string").alias("day"), S.date_to_serial(F.to_date("o_orderdate")).alias("serial")),
    "SELECT o_orderkey, CASE WHEN o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.25 END"
    " BETWEEN 1000 AND 80000 THEN CAST(DATE '1899-12-30' + CAST(o_orderkey + CASE WHEN o_orderkey % 2"
    " = 0 THEN 1 ELSE 0 END AS INT) AS VARCHAR) END AS day, CAST(datediff('day', DATE '1899-12-30',"
    f" {_DT}) AS INT) AS serial FROM orders")
_FMT = ("CASE p_partkey % 6 WHEN 0 THEN 'mm/dd/yyyy' WHEN 1 THEN '0.00' WHEN 2 THEN '[$-409]d-mmm'"
        " WHEN 3 THEN 'General' WHEN 4 THEN 'D.M.YY' ELSE NULL END")
register("date_formats", lambda sp, d: T.table(sp, d, "part").select(
    "p_partkey", S.is_date_format(F.expr(_FMT)).alias("is_date"),
    S.col_letter(F.col("p_partkey") % 81).alias("letter")),
    "SELECT p_partkey, p_partkey % 6 IN (0, 4) AS is_date, CASE WHEN i < 26 THEN chr(CAST(65 + i AS"
    " INT)) ELSE concat(chr(CAST(64 + i // 26 AS INT)), chr(CAST(65 + i % 26 AS INT))) END AS letter"
    " FROM (SELECT p_partkey, p_partkey % 81 AS i FROM part)")
_UNIT_TEXT = ("CASE p_partkey % 10 WHEN 0 THEN 'STORE 1' WHEN 1 THEN 'C1' WHEN 2 THEN 'Comm2' WHEN 3"
              " THEN 'P-12' WHEN 4 THEN 'CM 1' ELSE concat('1', CAST(p_partkey % 50 AS STRING)) END")
_TYPE_TEXT = ("CASE p_partkey % 10 WHEN 3 THEN 'Parking' WHEN 5 THEN 'cell  tower' WHEN 6 THEN"
              " 'Office' WHEN 7 THEN 'design studio' WHEN 8 THEN NULL ELSE '1/1' END")
register("unit_category", lambda sp, d: T.table(sp, d, "part").select(
    "p_partkey", S.unit_category(F.expr(_UNIT_TEXT), F.expr(_TYPE_TEXT)).alias("category")),
    "SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'commercial' WHEN 2 THEN 'commercial' WHEN 3"
    " THEN 'non_unit_income' WHEN 4 THEN 'commercial' WHEN 5 THEN 'non_unit_income' WHEN 6 THEN"
    " 'commercial' ELSE 'residential' END AS category FROM part")
_BLANK = ("CASE p_partkey % 8 WHEN 0 THEN '--/--' WHEN 1 THEN ' N/A ' WHEN 2 THEN 'tbd' WHEN 3 THEN"
          " '' WHEN 4 THEN NULL WHEN 5 THEN '…' ELSE p_name END")
register("text_cleaning", lambda sp, d: T.table(sp, d, "part").select(
    "p_partkey", S.clean_text(F.expr(_BLANK)).alias("cleaned"),
    S.clean_placeholder(F.expr(_BLANK)).alias("placeholder_free"),
    S.is_blankish(F.expr(_BLANK)).alias("blankish"),
    S.join_name_parts("p_name", F.expr(_BLANK)).alias("joined")),
    f"SELECT p_partkey, nullif(trim(b), '') AS cleaned, CASE WHEN p_partkey % 8 IN (0, 3, 4) THEN NULL"
    " ELSE trim(b) END AS placeholder_free, p_partkey % 8 < 6 AS blankish, concat_ws(' ', p_name,"
    f" nullif(trim(b), '')) AS joined FROM (SELECT *, {_BLANK} AS b FROM part)")
_STATUS = ("occupied", "Vacant-Unrented", " NTV", "bogus", "", "resident", "approved", "Notice Rented")
_STX = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_STATUS)) + " END"
_pick = lambda words: "CASE p_partkey % 8 " + " ".join(
    f"WHEN {i} THEN '{t}'" for i, t in enumerate(words)) + " END"
register("status_profiles", lambda sp, d: T.table(sp, d, "part").select(
    "p_partkey", S.norm_status(F.expr(_STX)).alias("current"),
    S.norm_status_exact(F.expr(_STX)).alias("older"),
    S.norm_status_exact(F.expr(_STX), V.STATUS_TEXTS_PRINTED).alias("printed")),
    "SELECT p_partkey, " + ", ".join(f"{_pick(w)} AS {n}" for n, w in (
        ("current", ("occupied", "vacant", "notice", "occupied", "vacant", "occupied", "applicant",
                     "notice")),
        ("older", ("occupied", "occupied", "notice", "occupied", "vacant", "occupied", "applicant",
                   "occupied")),
        ("printed", ("occupied", "occupied", "notice", "occupied", "vacant", "occupied", "occupied",
                     "occupied")))) + " FROM part")
_TEN_TXT = ("CASE p_partkey % 7 WHEN 0 THEN 'VACANT unit' WHEN 1 THEN 'Model' WHEN 2 THEN"
            " 'Office use' WHEN 3 THEN 'Future tenant' WHEN 4 THEN NULL ELSE p_name END")


def _from_tenant(sp, d):
    p = T.table(sp, d, "part").select("p_partkey", F.expr(_TEN_TXT).alias("t"), F.lit(None).cast(
        "string").alias("st"))
    status, tenant = S.status_or_from_tenant("st", "t")
    return p.select("p_partkey", status.alias("status"), tenant.alias("tenant"))


register("status_from_tenant", _from_tenant,
         "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'vacant' WHEN 1 THEN 'model' WHEN 2 THEN"
         " 'down' WHEN 3 THEN 'applicant' WHEN 4 THEN 'vacant' ELSE 'occupied' END AS status, CASE WHEN"
         " p_partkey % 7 > 4 THEN p_name END AS tenant FROM part")
register("unit_numbers", lambda sp, d: T.units(sp, d).select(
    "unit_row_id", S.unit_prefix("unit_number").alias("prefix"),
    S.unit_serial("unit_number").cast("bigint").alias("serial"),
    S.unit_digits("unit_number").cast("bigint").alias("digits"),
    S.label_prefix("unit_number").alias("label"),
    S.norm_unit(F.concat(F.lit("Apt # 0"), "unit_number")).alias("norm"),
    S.norm_unit_plain(F.concat(F.lit("a-"), "unit_number")).alias("plain")), with_views(
    "SELECT unit_row_id, substr(unit_number, 1, 1) AS prefix, CAST(substr(unit_number, 2) AS BIGINT)"
    " AS serial, CAST(substr(unit_number, 2) AS BIGINT) AS digits, substr(unit_number, 1, 1) AS label,"
    " concat('0', unit_number) AS norm, concat('A', unit_number) AS plain FROM rr_units", "rr_units"))
