import re

import grids as G
from pyspark.sql import functions as F
from unitwise.operators import codes
from unitwise.plans.portfolio import read_sheets, score_portfolio, verify_portfolio
from unitwise.registry import scoring, sheets
from unitwise.sources import tables as T


def test_verify_portfolio(spark, sf_dir):
    v = verify_portfolio(T.units(spark, sf_dir), T.charges(spark, sf_dir), T.stated(spark, sf_dir))
    assert v.summary.count() == v.tally.count() == 40
    assert v.issues.filter("severity = 'critical'").count() > 0


def test_score_portfolio_of_itself(spark, sf_dir):
    t = scoring.truth(spark, sf_dir).filter("doc_id < 3").selectExpr(
        "*", "CAST(NULL AS STRING) AS regulation",
        "CAST(NULL AS array<struct<header:string,value:string>>) AS source_columns",
        "CAST(NULL AS array<struct<code:string,amount:decimal(18,4),category:string>>) AS charges")
    s = score_portfolio(t, t)
    r = s.report.first()
    assert r.macro == 1.0 and r.files == 3 and s.worst.count() == 0


def test_read_sheets(spark):
    grid = [["Unit", "Tenant", "Rent", "Lease Start"]]
    grid += [[f"1{i:02d}", f"T{i}", 1000 + i, "1/1/2024"] for i in range(12)]
    grid += [["Total", None, sum(1000 + i for i in range(12)), None]]
    cells = G.cells(spark, G.cell_rows(1, "ok", grid), G.cell_rows(2, "bad", grid))
    cols = {"unit_number": 0, "tenant_name": 1, "monthly_rent": 2, "lease_start_date": 3}
    plans = G.structures(
        spark, G.structure(1, "ok", columns=cols, stop=["total"], stated=12),
        G.structure(2, "bad", columns=cols, stop=["total"], stated=30))
    r = read_sheets(cells, plans)
    assert [(a.doc_id, a.basis) for a in r.accepted.collect()] == [(1, "stated_unit_count")]
    assert r.units.count() == 12 and [x.doc_id for x in r.rejected.collect()] == [2]


def _plan(spark, df):
    """Physical plan as if nothing were small enough to broadcast."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return re.sub(r"#\d+L?", "", df.select("*")._jdf.queryExecution().executedPlan().toString()).splitlines()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_walk_exchanges_rows_once_and_by_bucket(spark, sf_dir):
    """Gathered rows are read and dealt once for all branches; only bucket totals are dealt by sheet."""
    walk = sheets.walk_of(spark, sf_dir, "roll", "lease")
    for df in (walk.units, walk.lines):
        plan = _plan(spark, df)
        rows = [line for line in plan if "FileScan" in line and "m,far" in line]
        assert len(rows) == 1 and any("ReusedExchange [doc_id, sheet, bucket, row, m, far]" in line for line in plan)
        for k, line in enumerate(plan):
            if re.search(r"Exchange hashpartitioning\(doc_id, sheet, \d+\)", line):
                assert "keys=[doc_id, sheet, bucket]" in plan[k + 1]


def test_rules_run_once_per_code(spark, sf_dir):
    """The keyword is an output of an aggregation by code; no filter or projection of lines holds a rule."""
    charges = T.charges(spark, sf_dir)
    for df in (codes.charge_summary(charges), codes.ancillary_total(charges), codes.categorize(charges).filter(
            "category = 'pet'"), codes.apply_code_proposals(charges, charges.select(
                "doc_id", "code", F.lit("pet").alias("category")))):
        plan = _plan(spark, df)
        assert any("HashAggregate(keys=[code]" in line and "output=[code, _keyword]" in line for line in plan)
        assert not any("RLIKE" in line for line in plan)
