"""Unit registers derived from the order tables of the test data.

Orders become units (forty documents), their items become charge lines. Each
fragment is plain SQL both engines read the same way, so the checks share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unitwise.session import configure

MONEY = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2))"

UNIT_COLUMNS = {
    "unit_row_id": "o_orderkey",
    "doc_id": "CAST(o_custkey % 40 AS BIGINT)",
    "building": "CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN 'North'"
                " ELSE 'South' END",
    "unit_number": "concat(substring('ABCD', CAST(1 + o_custkey % 4 AS INT), 1),"
                   " CAST(100 + o_orderkey % 150 AS STRING))",
    "status": "CASE o_orderpriority WHEN '1-URGENT' THEN 'notice' WHEN '2-HIGH' THEN 'occupied'"
              " WHEN '3-MEDIUM' THEN 'occupied' WHEN '5-LOW' THEN 'vacant' ELSE"
              " CASE o_orderstatus WHEN 'F' THEN 'model' WHEN 'O' THEN 'down'"
              " ELSE 'applicant' END END",
    "monthly_rent": "CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 2 = 0 THEN NULL"
                    f" ELSE {MONEY} END",
    "market_rent": f"CASE WHEN o_custkey % 4 = 3 THEN NULL ELSE CAST({MONEY} + 150 AS DECIMAL(18,2)) END",
    "concession": "CASE WHEN o_orderkey % 10 = 0 THEN CAST(-75 AS DECIMAL(18,2)) END",
    "employee_discount": "CASE WHEN o_orderkey % 25 = 0 THEN CAST(-40 AS DECIMAL(18,2)) END",
    "subsidy_rent": "CASE WHEN o_orderkey % 8 = 0 AND o_orderpriority IN"
                    " ('1-URGENT','2-HIGH','3-MEDIUM') THEN CAST(300 AS DECIMAL(18,2)) END",
    "tenant_name": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE"
                   " concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0')) END",
    "unit_sqft": "CASE WHEN o_orderkey % 7 = 0 THEN NULL"
                 " ELSE CAST(400 + o_orderkey % 900 AS DOUBLE) END",
    "unit_type": "CASE WHEN o_orderkey % 6 = 0 THEN '--/--'"
                 " ELSE concat(CAST(o_orderkey % 4 AS STRING), '/1') END",
    "category": "CASE WHEN o_orderkey % 50 = 0 THEN 'non_unit_income'"
                " WHEN o_orderkey % 20 = 0 THEN 'commercial' ELSE 'residential' END",
    "include_in_unit_count": "(o_orderkey % 50 <> 0)",
    "lease_start_date": "CAST(o_orderdate AS DATE)",
    "lease_end_date": "CASE WHEN o_orderkey % 9 <> 0 THEN"
                      " CAST(CAST(o_orderdate AS DATE) + INTERVAL '365' DAY AS DATE) END",
    "move_in_date": "CASE WHEN o_orderkey % 11 <> 0 THEN"
                    " CAST(CAST(o_orderdate AS DATE) - INTERVAL '3' DAY AS DATE) END",
    "move_out_date": "CASE WHEN o_orderpriority = '1-URGENT' THEN"
                     " CAST(CAST(o_orderdate AS DATE) + INTERVAL '400' DAY AS DATE) END",
}

CHARGE_CODE = (
    "CASE l_linenumber WHEN 1 THEN 'RENT-Rent' WHEN 2 THEN 'HAP-Housing Assistance Payment'"
    " WHEN 3 THEN 'petrent' WHEN 4 THEN 'CONC-Concession' WHEN 5 THEN 'SCRIE'"
    " WHEN 6 THEN 'VTRASH' ELSE CASE l_returnflag"
    " WHEN 'A' THEN 'MLIW-Mandatory Liability Insurance Waiver'"
    " WHEN 'N' THEN 'LTOL-Loss to Lease' ELSE 'como' END END")
CHARGE_COLUMNS = {
    "unit_row_id": "l_orderkey",
    "doc_id": "CAST(o_custkey % 40 AS BIGINT)",
    "code": CHARGE_CODE,
    "amount": "CAST(CASE WHEN l_linenumber IN (4, 5) THEN -1 ELSE 1 END"
              " * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,2))",
}

_TENANT_RENT = ("sum(CASE WHEN status IN ('occupied','notice') AND monthly_rent > 0"
                " THEN monthly_rent ELSE 0 END)")
_OTHER_RENT = ("sum(CASE WHEN status NOT IN ('occupied','notice') AND monthly_rent > 0"
               " THEN monthly_rent ELSE 0 END)")
_PHYSICAL = "sum(CASE WHEN status IN ('occupied','notice') THEN 1 ELSE 0 END)"
_SQFT = "sum(CAST(unit_sqft AS DECIMAL(18,2)))"
STATED_COLUMNS = {
    "stated_units": "CAST(count(*) + CASE WHEN doc_id % 7 = 6 THEN 1 ELSE 0 END AS BIGINT)",
    "stated_rent": f"CAST({_TENANT_RENT} + CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN {_OTHER_RENT}"
                   " WHEN 2 THEN -sum(coalesce(concession,0) + coalesce(employee_discount,0))"
                   f" WHEN 3 THEN CAST(-0.0020 * {_TENANT_RENT} AS DECIMAL(18,2))"
                   " ELSE 99999.00 END AS DECIMAL(28,2))",
    "stated_market": "CAST(CASE doc_id % 3 WHEN 0 THEN sum(market_rent)"
                     " WHEN 1 THEN CAST(sum(market_rent) * 1.02 AS DECIMAL(28,2)) END"
                     " AS DECIMAL(28,2))",
    "stated_sqft": f"CAST(CASE doc_id % 4 WHEN 0 THEN {_SQFT}"
                   f" WHEN 1 THEN CAST({_SQFT} * 1.05 AS DECIMAL(28,2))"
                   f" WHEN 3 THEN CAST({_SQFT} * 1.005 AS DECIMAL(28,2)) END AS DECIMAL(28,2))",
    "stated_rate": "CAST(CASE doc_id % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 40 WHEN 3 THEN 60 END"
                   " AS DECIMAL(12,4))",
    "stated_occupied": "CAST(sum(CASE WHEN status = 'occupied' THEN 1 ELSE 0 END)"
                       " + CASE WHEN doc_id % 6 = 5 THEN 200 ELSE 0 END AS BIGINT)",
    "stated_vacant": "CAST(CASE WHEN doc_id % 9 = 8 THEN NULL ELSE"
                     " sum(CASE WHEN status = 'vacant' THEN 1 ELSE 0 END) END AS BIGINT)",
}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    # The JVM compiles no method of more than 8,000 bytes of code: a longer one would run interpreted for every
    # row, so such a stage is run as separate operators, whose code is cut into short methods.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_select(UNIT_COLUMNS))


def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order, dealt by order.

    The number of partitions is given, so the runtime does not merge partitions that are small on disk but
    grow many times over in the tables of a sum by order and line.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.repartition(n, "l_orderkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_lines(spark, sf_dir).selectExpr(*_select(CHARGE_COLUMNS))


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    return units(spark, sf_dir).groupBy("doc_id").agg(
        *[F.expr(sql).alias(name) for name, sql in STATED_COLUMNS.items()])


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_select(PROGRESS_COLUMNS))


PROGRESS_COLUMNS = {
    "event_id": "event_id",
    "event_at": "CAST(ts AS TIMESTAMP)",
    "job_id": "user_id",
    "stage": "CASE WHEN event_id % 7 < 5 THEN 'extracting' ELSE 'validating' END",
    "detail": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('step ', CAST(event_id AS STRING)) END",
    "kind": "CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN NULL"
            " WHEN 'signup' THEN 'verify_pass' WHEN 'error' THEN 'verify_fail'"
            " ELSE 'decision' END",
}


def _duck(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text: the wanted derived tables as WITH entries, then ``body``."""
    needed = list(names)
    if "rr_stated" in needed and "rr_units" not in needed:
        needed.insert(0, "rr_units")
    texts = {
        "rr_units": f"SELECT {', '.join(_select(UNIT_COLUMNS))} FROM orders",
        "rr_charges": f"SELECT {', '.join(_select(CHARGE_COLUMNS))}"
                      " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "rr_stated": f"SELECT doc_id, {', '.join(_select(STATED_COLUMNS))}"
                     " FROM rr_units GROUP BY doc_id",
        "rr_progress": f"SELECT {', '.join(_select(PROGRESS_COLUMNS))} FROM events",
    }
    texts = {k: _duck(v) for k, v in texts.items()}
    order = [n for n in ("rr_units", "rr_charges", "rr_stated", "rr_progress") if n in needed]
    entries = [f"{n} AS ({texts[n]})" for n in order]
    entries += [f"{n} AS ({_duck(t)})" for n, t in (extra or {}).items()]
    return f"WITH {', '.join(entries)} {body}" if entries else body
