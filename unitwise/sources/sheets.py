"""Sheets derived from the order tables: one row layout, one block layout.

Each fragment is SQL both engines read the same way; the cell table is the
union of the fragments, so the grids grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitwise import schema
from unitwise.functions.fixed_values import UNIT_COLUMNS
from unitwise.sources import tables as T

_M = "DECIMAL(18,2)"
STATUS_TEXT = (
    "CASE status WHEN 'occupied' THEN 'Occupied No Notice' WHEN 'notice' THEN 'Occupied-NTV'"
    " WHEN 'vacant' THEN 'Vacant Unrented Ready' WHEN 'model' THEN 'Model'"
    " WHEN 'down' THEN 'Admin/Down' ELSE 'Pending Approval' END")
PET = f"CAST(CASE WHEN unit_row_id % 3 = 0 THEN 35 ELSE 0 END AS {_M})"
TOTAL = (
    f"CAST(coalesce(monthly_rent, 0) + coalesce(concession, 0) + coalesce(subsidy_rent, 0)"
    f" + coalesce(employee_discount, 0) + {PET} AS {_M})")
US_DATE = (
    "concat(CAST(month(lease_end_date) AS STRING), '/', CAST(day(lease_end_date) AS STRING),"
    " '/', CAST(year(lease_end_date) AS STRING))")
SERIAL = "datediff('day', DATE '1899-12-30', lease_start_date)"
SERIAL_SPARK = "datediff(lease_start_date, DATE '1899-12-30')"

# header, kind, value as SQL over the unit table
ROLL = (
    ("Unit", "s", "unit_number"), ("Status", "s", STATUS_TEXT), ("Tenant", "s", "tenant_name"),
    ("Unit Type", "s", "unit_type"), ("Sq Ft", "n", "CAST(unit_sqft AS BIGINT)"),
    ("Market Rent", "n", "market_rent"), ("RC", "n", "monthly_rent"),
    ("PREF", "n", f"CAST(coalesce(concession, 0) AS {_M})"),
    ("S8", "n", f"CAST(coalesce(subsidy_rent, 0) AS {_M})"),
    ("SCRIE", "n", f"CAST(coalesce(employee_discount, 0) AS {_M})"),
    ("PETFEE", "n", PET), ("Total Charged", "n", TOTAL),
    ("Lease Start", "d", SERIAL), ("Lease End", "s", f"CASE WHEN lease_end_date IS NOT NULL THEN {US_DATE} END"),
)
ROLL_FIRST_COL = 1
LINE_CODES = (
    "CASE l_linenumber WHEN 1 THEN 'RENT-Rent' WHEN 2 THEN 'HAP-Housing Assistance Payment'"
    " WHEN 3 THEN 'petrent' WHEN 4 THEN 'CONC-Concession' WHEN 5 THEN 'SCRIE'"
    " WHEN 6 THEN 'VTRASH' ELSE 'como' END")
LEASE_LINES = (
    f"SELECT l_orderkey AS unit_row_id, CAST(o_custkey % 40 AS BIGINT) AS doc_id,"
    f" CAST(l_linenumber AS BIGINT) AS line_no, {LINE_CODES} AS code,"
    f" CAST(sum(CASE WHEN l_linenumber IN (4, 5) THEN -1 ELSE 1 END"
    f" * CAST(l_extendedprice AS {_M})) AS {_M}) AS amount"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4")


def _cell(view, sheet, row, col, kind, value, fmt=None):
    """One SELECT that places a value of every row of a view in a sheet."""
    num = f"CAST({value} AS DOUBLE)" if kind != "s" else "CAST(NULL AS DOUBLE)"
    style = f"'{fmt}'" if fmt else "CAST(NULL AS STRING)"
    return (
        f"SELECT doc_id, '{sheet}' AS sheet, CAST({row} AS BIGINT) AS \"row\","
        f" CAST({col} AS INT) AS col, '{'s' if kind == 's' else 'n'}' AS ctype,"
        f" CAST({value} AS STRING) AS text, {num} AS num, {style} AS num_fmt"
        f" FROM {view} WHERE {value} IS NOT NULL")


def roll_selects() -> list[str]:
    out = []
    for i, (header, kind, value) in enumerate(ROLL):
        fmt = "mm/dd/yyyy" if kind == "d" else None
        out.append(_cell("rr_units", "roll", "unit_row_id + 3", i + ROLL_FIRST_COL, kind, value, fmt))
        out.append(_cell("rr_docs", "roll", "1", i + ROLL_FIRST_COL, "s", f"'{header}'"))
    out.append(_cell("rr_docs", "roll", "0", ROLL_FIRST_COL, "s", "'Rent Roll'"))
    out.append(_cell("rr_docs", "roll", "last_id + 8", ROLL_FIRST_COL, "s", "'Grand Total'"))
    out.append(_cell("rr_docs", "roll", "last_id + 8", 11 + ROLL_FIRST_COL, "n", "total_charged"))
    return out


SUMMARY = (("s", "'Property Summary'", 0, 0), ("s", "'Total Units'", 1, 0), ("n", "n_units", 1, 1),
           ("s", "'Occupancy'", 2, 0), ("n", "total_charged", 3, 1))


def summary_selects() -> list[str]:
    return [_cell("rr_docs", "summary", str(r), c, kind, value) for kind, value, r, c in SUMMARY]


def lease_selects() -> list[str]:
    out = []
    for i, h in enumerate(("Unit", "Tenant", "Market Rent", "Sq Ft", "Charge", "Amount")):
        out.append(_cell("rr_docs", "lease", "0", i, "s", f"'{h}'"))
    at = "unit_row_id * 16 + 2"
    out.append(_cell("rr_units", "lease", at, 0, "s", "unit_number"))
    out.append(_cell("rr_units", "lease", at, 1, "s", "tenant_name"))
    out.append(_cell("rr_units", "lease", at, 3, "n", "CAST(unit_sqft AS BIGINT)"))
    out.append(_cell("rr_lines", "lease", f"{at} + line_no", 4, "s", "code"))
    out.append(_cell("rr_lines", "lease", f"{at} + line_no", 5, "n", "amount"))
    market = f"CASE WHEN line_no = 1 AND unit_row_id % 4 <> 3 THEN CAST(1000 + unit_row_id % 500 AS {_M}) END"
    out.append(_cell("rr_lines", "lease", f"{at} + line_no", 2, "n", market))
    out.append(_cell("rr_line_sums", "lease", f"{at} + 8", 4, "s", "'Charge Total'"))
    out.append(_cell("rr_line_sums", "lease", f"{at} + 8", 5, "n", "amount"))
    out.append(_cell("rr_docs", "lease", "last_id * 16 + 40", 0, "s", "'Grand Total'"))
    return out


DOC_COLUMNS = {
    "last_id": "max(unit_row_id)",
    "total_charged": f"CAST(sum(CASE WHEN status <> 'down' THEN {TOTAL} ELSE 0 END) AS {_M})",
    "n_units": "count(*)",
    "n_ids": "count(DISTINCT unit_number)",
    "n_roll_ids": "count(DISTINCT CASE WHEN status <> 'down' THEN unit_number END)",
}
DOCS = ("SELECT doc_id, " + ", ".join(f"{e} AS {n}" for n, e in DOC_COLUMNS.items())
        + " FROM rr_units GROUP BY doc_id")
LINE_SUMS = (
    f"SELECT unit_row_id, doc_id, CAST(sum(amount) AS {_M}) AS amount FROM rr_lines"
    " GROUP BY unit_row_id, doc_id")


def duck_views(*sheets: str) -> dict[str, str]:
    """The WITH entries of the cell table for the checks."""
    selects = (roll_selects() if "roll" in sheets else []) + (
        lease_selects() if "lease" in sheets else []) + (
        summary_selects() if "summary" in sheets else [])
    return {"rr_docs": DOCS, "rr_lines": LEASE_LINES, "rr_line_sums": LINE_SUMS,
            "rr_cells": " UNION ALL ".join(selects)}


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    units = T.units(spark, sf_dir)
    docs = units.groupBy("doc_id").agg(*[F.expr(e).alias(n) for n, e in DOC_COLUMNS.items()])
    lines = lease_lines(spark, sf_dir)
    return {"rr_units": units, "rr_docs": docs, "rr_lines": lines,
            "rr_line_sums": lines.groupBy("unit_row_id", "doc_id").agg(
                F.sum("amount").cast(_M).alias("amount"))}


def lease_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The code follows from the line number, so it need not be a key.
    return T.ordered_lines(spark, sf_dir).groupBy(
        F.col("l_orderkey").alias("unit_row_id"),
        F.expr("CAST(o_custkey % 40 AS BIGINT)").alias("doc_id"), "l_linenumber").agg(
        F.expr(f"CAST(sum(CASE WHEN l_linenumber IN (4, 5) THEN -1 ELSE 1 END"
               f" * CAST(l_extendedprice AS {_M})) AS {_M})").alias("amount")).select(
        "unit_row_id", "doc_id", F.col("l_linenumber").cast("long").alias("line_no"),
        F.expr(LINE_CODES).alias("code"), "amount")


def _spread(view: DataFrame, placed: list[tuple]) -> DataFrame:
    """All cells a view's rows make, in one pass over the view."""
    entries = [F.expr(
        f"named_struct('sheet', '{sheet}', 'row', CAST({row} AS BIGINT), 'col', {col},"
        f" 'ctype', '{'s' if kind == 's' else 'n'}', 'text', CAST({value} AS STRING),"
        f" 'num', CAST({'NULL' if kind == 's' else value} AS DOUBLE),"
        f" 'num_fmt', CAST({repr(fmt) if fmt else 'NULL'} AS STRING))")
        for sheet, row, col, kind, value, fmt in placed]
    # A column of their own, as a generator evaluates its argument without compiled code; never empty, so taken as
    # "outer", which spares a filter that would build them a second time.
    return view.select("doc_id", F.array(*entries).alias("e")).select("doc_id", F.explode_outer("e").alias("c")).select(
        "doc_id", "c.*").filter(F.col("text").isNotNull())


def cells(spark: SparkSession, sf_dir: str, *sheets: str) -> DataFrame:
    """The cell table of the named sheets ("roll", "lease")."""
    v = _views(spark, sf_dir)
    at = "unit_row_id * 16 + 2"
    by_view: dict[str, list[tuple]] = {k: [] for k in v}
    if "roll" in sheets:
        for i, (header, kind, value) in enumerate(ROLL):
            value = value.replace(SERIAL, SERIAL_SPARK)
            by_view["rr_units"].append(("roll", "unit_row_id + 3", i + ROLL_FIRST_COL, kind, value,
                                        "mm/dd/yyyy" if kind == "d" else None))
            by_view["rr_docs"].append(("roll", "1", i + ROLL_FIRST_COL, "s", f"'{header}'", None))
        by_view["rr_docs"] += [
            ("roll", "0", ROLL_FIRST_COL, "s", "'Rent Roll'", None),
            ("roll", "last_id + 8", ROLL_FIRST_COL, "s", "'Grand Total'", None),
            ("roll", "last_id + 8", 11 + ROLL_FIRST_COL, "n", "total_charged", None)]
    if "lease" in sheets:
        for i, h in enumerate(("Unit", "Tenant", "Market Rent", "Sq Ft", "Charge", "Amount")):
            by_view["rr_docs"].append(("lease", "0", i, "s", f"'{h}'", None))
        by_view["rr_docs"].append(("lease", "last_id * 16 + 40", 0, "s", "'Grand Total'", None))
        by_view["rr_units"] += [
            ("lease", at, 0, "s", "unit_number", None), ("lease", at, 1, "s", "tenant_name", None),
            ("lease", at, 3, "n", "CAST(unit_sqft AS BIGINT)", None)]
        market = ("CASE WHEN line_no = 1 AND unit_row_id % 4 <> 3 THEN"
                  f" CAST(1000 + unit_row_id % 500 AS {_M}) END")
        by_view["rr_lines"] += [
            ("lease", f"{at} + line_no", 4, "s", "code", None),
            ("lease", f"{at} + line_no", 5, "n", "amount", None),
            ("lease", f"{at} + line_no", 2, "n", market, None)]
        by_view["rr_line_sums"] += [
            ("lease", f"{at} + 8", 4, "s", "'Charge Total'", None),
            ("lease", f"{at} + 8", 5, "n", "amount", None)]
    if "summary" in sheets:
        by_view["rr_docs"] += [("summary", str(r), c, kind, value, None)
                               for kind, value, r, c in SUMMARY]
    # A unit becomes fourteen cells: spread the narrow rows before they grow, so
    # a table that lies in one file is not expanded by one task.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v["rr_units"] = v["rr_units"].repartition(n, "unit_row_id")
    parts = [_spread(v[name], placed) for name, placed in by_view.items() if placed]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def structures(spark: SparkSession, sf_dir: str, *sheets: str) -> DataFrame:
    """Structure rows of the sheets, with the totals the documents state."""
    docs = _views(spark, sf_dir)["rr_docs"]
    cols = lambda **at: "named_struct(" + ", ".join(
        f"'{c}', {at.get(c, -1)}" for c in UNIT_COLUMNS) + ")"
    roll = {
        "sheet": "'roll'", "layout": "'row'", "data_start_row": "4L", "header_row": "2L",
        "columns": cols(unit_number=0, status=1, tenant_name=2, unit_type=3, unit_sqft=4,
                        market_rent=5, lease_start_date=12, lease_end_date=13),
        "block": f"CAST(NULL AS {schema.BLOCK_STRUCT})",
        "charge_columns": "array(" + ", ".join(
            f"named_struct('header', '{h}', 'index', {i}, 'kind', '{k}')" for h, i, k in (
                ("RC", 6, "rent"), ("PREF", 7, "concession"), ("S8", 8, "subsidy"),
                ("SCRIE", 9, "subsidy"), ("PETFEE", 10, "fee"))) + ")",
        "charge_total_column": "11", "skip_patterns": "array('admin/down')",
        "stop_markers": "array('grand total')", "stated_total_units": "CASE WHEN doc_id % 2 = 0 THEN n_roll_ids ELSE -1L END",
        "stated_summary": f"CAST(NULL AS {schema.STATED_SUMMARY_STRUCT})",
        "extra_columns": "array(named_struct('header', 'Square Feet', 'index', 4))"}
    lease = {
        "sheet": "'lease'", "layout": "'block'", "data_start_row": "2L", "header_row": "1L",
        "columns": cols(unit_number=0, tenant_name=1, market_rent=2, unit_sqft=3),
        "block": "named_struct('charge_desc_col', 4, 'charge_amt_col', 5, 'rent_codes',"
                 " array('RENT-Rent', 'HAP-Housing Assistance Payment', 'como'),"
                 " 'subsidy_codes', array('hap-housing assistance payment'),"
                 " 'discount_codes', CAST(array() AS array<string>),"
                 " 'concession_codes', array('conc-concession', 'scrie'),"
                 " 'reimbursed_codes', CAST(array() AS array<string>))",
        "charge_columns": "CAST(array() AS array<struct<header:string,index:int,kind:string>>)",
        "charge_total_column": "CAST(NULL AS INT)", "skip_patterns": "CAST(array() AS array<string>)",
        "stop_markers": "array('total')", "stated_total_units": "n_ids",
        "stated_summary": f"CAST(NULL AS {schema.STATED_SUMMARY_STRUCT})",
        "extra_columns": "CAST(array() AS array<struct<header:string,index:int>>)"}
    out = None
    for name, fields in (("roll", roll), ("lease", lease)):
        if name in sheets:
            part = docs.select("doc_id", *[F.expr(e).alias(c) for c, e in fields.items()])
            out = part if out is None else out.unionByName(part)
    return out
