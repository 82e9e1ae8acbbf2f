from decimal import Decimal as D

import grids as G
from unitwise.operators import walk as W

ROLL = [
    ["Unit", "Tenant", "Regulation", "Legal Rent", "RC", "PREF", "S8", "SCRIE", "Total Charged", ""],
    ["C19", "Tenant One", "RS", 854.35, 854.35, 0, 0, -122.23, 732.12, ""],
    ["C20", "Tenant Two", "RS", 2444.28, 1278.01, -402.01, 1166.27, 0, 2042.27, ""],
]
BLOCK = [
    ["Unit", "Charge", "Amount"],
    ["2B", "", ""],
    ["", "SRR Stabilized Rent", 3432.90],
    ["", "PRD Preferred Rent Discount", -887.77],
    ["", "Resident Totals", 2545.13],
    ["4C", "", ""],
    ["", "RT", 957.44],
    ["", "SCR", -273.42],
    ["", "Charge Total", 684.02],
]
CODES = (1, 2, ["srr stabilized rent", "rt"], [], [], ["prd preferred rent discount"], ["scr"])


def walked(spark, shift=0):
    cells = G.cells(
        spark, G.cell_rows(1, "roll", ROLL, shift), G.cell_rows(1, "block", BLOCK, shift))
    plans = G.structures(
        spark,
        G.structure(1, "roll", columns={"unit_number": 0, "tenant_name": 1}, charge_columns=[
            ("RC", 4, "rent"), ("PREF", 5, "concession"), ("S8", 6, "subsidy"),
            ("SCRIE", 7, "subsidy")], total=8, extra=[("Regulation", 2)]),
        G.structure(1, "block", "block", columns={"unit_number": 0}, block=CODES))
    return W.walk(cells, plans)


def by_unit(df):
    return {r["unit_number"]: r for r in df.collect()}


def test_owner_collected_rent(spark):
    for shift in (0, 2):
        w = walked(spark, shift)
        u = by_unit(w.units)
        assert (u["C19"].monthly_rent, u["C19"].subsidy_rent, u["C19"].concession) == (
            D("854.35"), None, None)
        assert (u["C20"].monthly_rent, u["C20"].subsidy_rent, u["C20"].concession) == (
            D("2042.27"), D("1166.27"), D("-402.01"))
        assert u["2B"].monthly_rent == D("2545.13")
        assert u["4C"].monthly_rent == D("957.44")
        assert u["2B"].block_charge_total == D("2545.13")
        lines = {(r.source_row, r.code): r for r in w.lines.collect()}
        cat = {k[1]: v.category for k, v in lines.items()}
        assert cat["SCRIE"] == "reimbursed_credit" and cat["PREF"] == "concession"
        assert cat["S8"] == "subsidy" and cat["SCR"] == "reimbursed_credit"
        assert cat["PRD Preferred Rent Discount"] == "concession"
        assert lines[(1, "SCRIE")].amount == D("-122.23")
        assert "Resident Totals" not in cat and "Charge Total" not in cat


def test_capture(spark):
    u = by_unit(walked(spark).units)["C19"]
    got = {c.header: c.value for c in u.source_columns}
    assert got["Legal Rent"] == "854.35" and got["Regulation"] == "RS"
    assert got["Tenant"] == "Tenant One"
    assert not {"RC", "PREF", "S8", "SCRIE", "Unit"} & set(got)
    assert not [h for h in got if h.startswith("Column")]


def test_stop_skip_and_first_in_block(spark):
    grid = [
        ["Unit", "Market", "Charge", "Amount", "Sqft"],
        ["101", None, "storage", 20, None],
        [None, 1500, "rent", 1400, None],
        [None, None, "Charge Total:", 1420, None],
        ["102", None, "rent", 900, 700],
        [None, None, None, None, None],
        [None, 9999, "rent", 50, None],
        ["subtotal row 103", None, None, None, None],
        [None, None, "rent", 77, None],
        ["104", None, "rent", 800, None],
        ["Grand Total", 1, "rent", 5, None],
        ["105", None, "rent", 800, None],
    ]
    cells = G.cells(spark, G.cell_rows(1, "s", grid))
    plans = G.structures(spark, G.structure(
        1, "s", "block", columns={"unit_number": 0, "market_rent": 1, "unit_sqft": 4},
        block=(2, 3, ["rent"], [], [], [], []), skip=["subtotal"], stop=["grand total", "charge total"]))
    u = by_unit(W.walk(cells, plans).units)
    assert set(u) == {"101", "102", "104"}
    assert u["101"].market_rent == D("1500.00") and u["101"].monthly_rent == D("1400.00")
    assert u["101"].block_charge_total == D("1420")
    # The blank row ends the scan for scalars, not the charge lines.
    assert u["102"].market_rent is None and u["102"].unit_sqft == 700.0
    # "subtotal" is in the unit cell, so the row is no boundary: its rent counts for 102.
    assert u["102"].monthly_rent == D("1027.00")


def test_dedupe_conventions(spark):
    data = [(1, "s", 5, "1a", "vacant"), (1, "s", 6, "1A", "applicant"), (1, "s", 7, "2B", "down")]
    df = spark.createDataFrame(data, "doc_id long, sheet string, source_row long, unit_number string, status string")
    a = {r.place: r.status for r in W.dedupe_units(df).collect()}
    b = {r.place: r.status for r in W.dedupe_units(df, "current-occupancy").collect()}
    assert a == {5: "applicant", 7: "down"} and b == {5: "vacant", 7: "down"}


def test_mapped_columns_beyond_the_capture_limit(spark):
    for shift in (0, 5):
        wide = [None] * 90
        grid = [["Unit"] + wide[1:85] + ["Rent", "PET", "Total", "Note"],
                ["1A"] + wide[1:85] + [1200, 35, 1235, "far"], ["1B"] + wide[1:85] + [900, 0, 900, None]]
        cells = G.cells(spark, G.cell_rows(1, "s", grid, shift))
        plans = G.structures(spark, G.structure(
            1, "s", columns={"unit_number": 0, "monthly_rent": 85}, charge_columns=[("PET", 86, "fee")], total=87))
        w = W.walk(cells, plans)
        u = by_unit(w.units)
        assert (u["1A"].monthly_rent, u["1B"].monthly_rent) == (D("1200.00"), D("900.00"))
        assert u["1A"].block_charge_total == D("1235") and u["1A"].charge_sum == D("35")
        assert not u["1A"].source_columns
        assert {(r.code, r.amount) for r in w.lines.collect()} == {("PET", D("35"))}


def test_a_bad_sheet_costs_only_itself(spark):
    grid = [["Unit", "Rent", "Extra"], ["1A", 1200, "x"], ["1B", 900, "y"]]
    good = list(G.cell_rows(1, "s", grid))
    bad = list(G.cell_rows(2, "s", grid))
    cells = G.cells(spark, good, bad, bad, [(2, "s", 1, 2, "s", "z", None, None)])
    plan = lambda doc, **k: G.structure(doc, "s", columns={"unit_number": 0}, **k)
    plans = G.structures(
        spark, plan(1, charge_columns=[("R", 1, "rent")], extra=[("E", 2)]),
        plan(2, charge_columns=[("R", 1, "rent"), ("S", 1, "rent")], extra=[("E", 2), ("F", 2)]))
    found = {(r.doc_id, r.unit_number): r for r in W.walk(cells, plans).units.collect()}
    assert set(found) == {(d, u) for d in (1, 2) for u in ("1A", "1B")}
    assert found[1, "1A"].monthly_rent == D("1200.00")
    # The last header named for a column counts, and of two contents of a cell the greater.
    assert [tuple(c) for c in found[2, "1A"].source_columns] == [("F", "z")]


def test_charge_columns_are_read_from_the_anchor_row_only(spark):
    grid = [["Unit", "Charge", "Amount"], ["1A", None, None], [None, "rent", 900], ["1B", "rent", 800]]
    plans = G.structures(spark, G.structure(
        1, "s", "block", columns={"unit_number": 0, "market_rent": 2, "unit_type": 1},
        block=(1, 2, ["rent"], [], [], [], [])))
    u = by_unit(W.walk(G.cells(spark, G.cell_rows(1, "s", grid)), plans).units)
    assert (u["1A"].market_rent, u["1A"].unit_type, u["1A"].monthly_rent) == (None, None, D("900.00"))
    assert (u["1B"].market_rent, u["1B"].unit_type) == (D("800.00"), "rent")
