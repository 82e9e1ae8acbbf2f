"""Steps that must not run again for every use of their result, as the plans show them."""

import re

import grids as G
import pytest
from pyspark.sql import functions as F
from unitwise.functions import scalars as S
from unitwise.operators import cells as C
from unitwise.operators import score
from unitwise.operators import walk as W
from unitwise.registry import all_queries
from unitwise.registry import sheets as R
from unitwise.sources import sheets
from unitwise.sources import tables as T

GRID = [["Rent Roll"], ["Unit", "Tenant", "Rent"], ["A1", None, 900], ["B2", "Ann", None], [None, None, "x"]]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_cells_are_sorted_once(spark):
    rows = list(G.cell_rows(1, "s", [["a", "b", 3]]))
    again = [(1, "s", 0, 1, "s", "z", None, None), (1, "s", 0, 90, "s", "far", None, None)]
    df = W.sheet_rows(G.cells(spark, rows, rows, again))
    row = df.collect()[0]
    assert {k: v.s for k, v in row.m.items()} == {0: "a", 1: "z", 2: "3"}
    assert {k: v.s for k, v in row.far.items()} == {90: "far"}
    assert plan(df).count("sort") == 2  # one for each map


def test_last_map_binds_its_entries(spark):
    entries = F.expr("reverse(array(named_struct('k', 1, 'v', 'a'), named_struct('k', 2, 'v', 'b'), named_struct('k', 1,"
                     " 'v', 'c')))")
    df = spark.range(1, 2).select(S.last_map(F.when(F.col("id") > 0, entries)).alias("m"))
    assert df.collect()[0].m == {1: "a", 2: "b"}


def test_grid_lines_with_gaps_and_repeated_cells(spark):
    rows = list(G.cell_rows(1, "s", GRID, 2))
    lines = {r.row: r.line for r in C.sheet_grid(G.cells(spark, rows, rows, [
        (1, "s", 3, 3, "s", "Zoe", None, None)])).collect()}
    assert lines == {0: "R1: Rent Roll", 1: "R2: Unit | Tenant | Rent", 2: "R3: A1 |  | 900", 3: "R4: B2 | Zoe",
                     4: "R5:  |  | x"}


def test_grid_lines_of_dates_left_of_the_used_range(spark):
    day = lambda row, col, serial: (1, "s", row, col, "n", "", float(serial), "mm/dd/yyyy")
    lines = {r.row: r.line for r in C.sheet_grid(G.cells(spark, [
        day(0, 0, 45000), day(0, 1, 45001), (1, "s", 0, 2, "s", "a", None, None), (1, "s", 0, 4, "s", "b", None, None),
        day(1, 0, 45000), day(1, 0, 45001), day(2, 0, 45000), day(2, 1, 45001)])).collect()}
    assert lines == {0: "R1: a |  | b", 1: "R2:  |  | 2023-03-16", 2: "R3:  | 2023-03-16"}


def test_scores_read_the_grid_once(spark):
    cells = G.cells(spark, list(G.cell_rows(1, "s", GRID)), list(G.cell_rows(2, "t", [["x"]] * 14 + [["unit rent"]])),
                    list(G.cell_rows(3, "t", [["x"]] * 13 + [["unit rent"]])))
    grid = C.sheet_grid(cells)
    scores = C.sheet_scores(grid, C.sheet_inventory(cells))
    found = {r.doc_id: r.score for r in scores.collect()}
    assert (found[1], found[2], found[3]) == (4, 0, 4)
    assert plan(scores).count("Generate") + plan(scores).count("Join") == plan(grid).count("Join") + 1


@pytest.mark.parametrize("name,most", [("select_sheets", 0), ("sample_rows_older", 0)])
def test_sheets_are_not_read_again_to_select_from_them(spark, sf_dir, name, most):
    files = all_queries()[name](spark, sf_dir).inputFiles()
    assert sum("lineitem" in f for f in files) == most


def test_layout_signals_read_staged_rows(spark):
    rows = [[100 + i, "Total Units", 5] for i in range(70)]
    out = C.detect_nonstandard_layout(G.cells(spark, list(G.cell_rows(1, "s", rows))))
    assert out.collect()[0].row_ids and len(out.inputFiles()) > 0
    assert "LogicalRDD" not in plan(out) and "LocalRelation" not in plan(out)


def test_order_lines_keep_their_partitions(spark, sf_dir):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (sheets.lease_lines(spark, sf_dir), T.charges(spark, sf_dir)):
        assert "RepartitionByExpression [l_orderkey" in plan(df) and f"], {n}" in plan(df)


def test_grading_looks_for_a_line_once(spark):
    lines = lambda *parts: F.array(*[F.struct(F.lit(c).alias("code"), F.lit(a).cast("decimal(18,4)").alias("amount"),
                                              F.lit("base_rent").alias("category")) for c, a in parts])
    df = spark.range(1).select(lines(("RENT", 5), ("RENT", 5)).alias("e"), lines(("Rent-1", 5), ("x", 7)).alias("a"),
                               lines(("rent", 5), ("RENT", 5)).alias("b"), F.lit("Ann Lee").alias("n"))
    out = df.select(score.charges_captured("e", "a").alias("one"), score.charges_captured("e", "b").alias("two"),
                    S.names_match("n", F.lit("lee, ann")).alias("named")).collect()[0]
    assert (out.one, out.two, out.named) == (False, True, True)
    text = str(score.charges_captured("e", "a")._jc.toString())
    assert text.count("array_position") == 1


def test_only_texts_that_start_like_numbers_are_cast(spark):
    texts = ["(5)", "(5", "-.5", "abc", "", "1e3x", "$( 7 )", "(+5)", "()", ".", "-", "1,200.50", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(S.parse_number("t").alias("n"))
    assert [r.n for r in df.collect()] == [-5, None, -0.5, None, None, 1000, -7, None, None, None, None, 1200.5, None]
    assert "RLIKE" in plan(df)


def test_the_scan_for_blocks_leaves_the_plan_behind(spark, sf_dir):
    cells, plans = sheets.cells(spark, sf_dir, "lease"), sheets.structures(spark, sf_dir, "lease")
    walked = W.walk(cells, plans)
    _, blocks = W.assign_blocks(walked.rows)
    assert not {"rent_codes", "captured", "c_unit_number"} & set(blocks.columns)
    assert walked.units.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_methods_too_long_to_compile_are_cut(spark, sf_dir):
    T.table(spark, sf_dir, "orders")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_cells_are_gathered_in_one_pass_over_sorted_rows(spark):
    cells = G.cells(spark, list(G.cell_rows(1, "s", GRID)), list(G.cell_rows(2, "s", GRID, 75)), list(G.cell_rows(
        3, "t", [[None] * 79 + ["a", "b", "c", "d"]])), [(3, "t", 0, 81, "s", "x", None, None)])
    df = W.sheet_rows(cells.unionByName(cells))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate(") == 1 and "ObjectHashAggregate" not in plan
    found = {(r.doc_id, r.row): r for r in df.collect()}
    assert len(found) == 11 and [found[3, 0].lo, found[3, 0].hi] == [79, 82]
    assert {k: v.s for k, v in found[3, 0].m.items()} == {79: "a", 80: "b"}
    assert {k: v.s for k, v in found[3, 0].far.items()} == {81: "x", 82: "d"}
    assert list(found[1, 3].m) == [0, 1] and found[1, 2].m[2].n == 900 and found[2, 2].far == {}


def test_blocks_over_bucket_borders_and_below_a_stop(spark):
    """Bucket totals come with the column statistics, which know no cut: boundaries below it change nothing above."""
    edge = 2 ** 16
    grid = {0: ["Unit", "Charge", "Amount"], 1: ["1A", "rent", 5], edge - 2: ["2B", "rent", 10], edge - 1: [None, "rent", 20],
            edge: [None, "rent", 30], edge + 1: ["3C", "rent", 7], 3 * edge: [None, "rent", 8], 3 * edge + 4: ["Stop here"],
            3 * edge + 5: ["4D", "rent", 9], 5 * edge: [None, "rent", 1]}
    rows = [(1, "s", at, c, k, t, n, f) for at, line in grid.items() for _, _, _, c, k, t, n, f in G.cell_rows(1, "s", [line])]
    plans = G.structures(spark, G.structure(
        1, "s", "block", columns={"unit_number": 0}, block=(1, 2, ["rent"], [], [], [], []), stop=["stop here"]))
    w = W.walk(G.cells(spark, rows), plans)
    assert {r.unit_number: int(r.monthly_rent) for r in w.units.collect()} == {"1A": 5, "2B": 60, "3C": 15}
    assert {(r.source_row, r.line_no) for r in w.lines.collect()} == {
        (1, 0), (edge - 2, 0), (edge - 2, 1), (edge - 2, 2), (edge + 1, 0), (edge + 1, 2 * edge - 1)}
    rows_read = [line for line in w.lines.select("*")._jdf.queryExecution().executedPlan().toString().splitlines()
                 if "FileScan" in line and re.search(r"m#\d+,far", line)]
    assert len(rows_read) == 2  # by the row layouts and by the scan, not again for the totals
    kept = W.walk(G.cells(spark, rows), plans, keep_blocks=True)
    assert kept.units.exceptAll(w.units).isEmpty() and kept.lines.exceptAll(w.lines).isEmpty()
    assert kept.units.count() == 3 and "Window" not in kept.lines._jdf.queryExecution().executedPlan().toString()

def test_cells_are_built_once_for_all_their_copies(spark, sf_dir, monkeypatch):
    given = []
    monkeypatch.setattr(R.W, "walk", lambda cells, plans: given.append(cells))
    R._irregular(spark, sf_dir)
    cells = sheets.cells(spark, sf_dir, "roll", "lease")
    assert plan(given[0]).count("Generate") == plan(cells).count("Generate") + 1
    assert "explode(array(" not in plan(cells)
    twice = cells.unionByName(cells.filter("col % 2 = 0"))
    assert given[0].exceptAll(twice).isEmpty() and twice.exceptAll(given[0]).isEmpty()
