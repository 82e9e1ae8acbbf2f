"""Sheets to units: a structure table says which column means what, the walk is joins.

Cells are gathered per sheet row once (at most 81 columns, so a bounded group);
everything the walk asks about a row is then an expression on that row and its
sheet's plan. Documents of any length are handled by bucketed scans.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitwise.functions import fixed_values as V
from unitwise.functions import scalars as S
from unitwise.functions.charge_codes import charge_category, is_total_line
from unitwise.functions.scan import BITS, running
from unitwise.session import over_sorted_rows, stage

SHEET = ["doc_id", "sheet"]
#: Rows of a sheet are dealt in buckets of ``2 ** BITS`` consecutive ones.
BUCKET = "bucket"
CODE_SETS = ("rent_codes", "subsidy_codes", "discount_codes", "concession_codes", "reimbursed_codes")


class Walk(NamedTuple):
    """Results of a walk; ``units`` still holds repeated unit numbers."""

    plan: DataFrame
    rows: DataFrame
    units: DataFrame
    lines: DataFrame


def used_range(cells: DataFrame) -> DataFrame:
    """First and last populated row and column of each sheet."""
    return cells.filter(S.clean_text("text").isNotNull()).groupBy(*SHEET).agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row"),
        F.min("col").alias("first_col"), F.max("col").alias("last_col"))


def sheet_rows(cells: DataFrame, max_col: int = V.MAX_COLUMNS) -> DataFrame:
    """One row per sheet row: its bucket, populated columns, and maps of column to (s text, n number, serial).

    ``m`` holds the columns up to ``max_col``, ``far`` those right of it, of which a walk keeps what a
    structure names; both list their columns left to right. Of a cell listed several times the greatest content
    counts. All cells are read and exchanged once, by sheet and row, so that no sheet is one task's. They are
    sorted as bytes and gathered from runs of equal keys: a hash aggregation of lists sorts them on either side
    of its exchange.
    """
    over_sorted_rows(cells.sparkSession)
    numeric = F.col("ctype") == "n"
    read = cells.select(*SHEET, "row", F.struct(
        F.col("col").alias("k"), S.clean_text("text").alias("s"),
        F.when(numeric, F.col("num")).otherwise(S.parse_number("text")).alias("n"),
        F.when(numeric, F.col("num")).alias("serial")).alias("c"))
    full = F.when(F.col("c.s").isNotNull(), F.col("c.k"))
    rows = read.repartition(*SHEET, "row").sortWithinPartitions("row", *SHEET, "c.k").groupBy("row", *SHEET).agg(
        F.min(full).alias("lo"), F.max(full).alias("hi"), F.max("c.k").alias("end"),
        F.collect_list(F.when(F.col("c.k").isNotNull(), F.col("c"))).alias("e"))
    # Most rows end before the far columns: their list is not searched for them.
    wide = F.coalesce(F.col("end") > max_col, F.lit(False))
    near = F.when(wide, F.filter("e", lambda c: c["k"] <= max_col)).otherwise(F.col("e"))
    far = S.let(F.sort_array(F.filter("e", lambda c: c["k"] > max_col)), lambda e: S.let(_last_of_each(e), _cell_map))
    return rows.withColumn("near", F.sort_array(near)).withColumn("near", _last_of_each(F.col("near"))).select(
        *SHEET, F.shiftright(F.col("row").cast("long"), BITS).alias(BUCKET), "row", "lo", "hi",
        _cell_map(F.col("near")).alias("m"), F.when(wide, far).otherwise(
            F.create_map().cast("map<int,struct<s:string,n:double,serial:double>>")).alias("far"))


def _last_of_each(entries: Column) -> Column:
    """Of sorted entries the greatest of each column; flat ones are compared without a nested order for each pair."""
    same = lambda x, i: F.get(entries, i + 1)["k"] == x["k"]
    return F.when(F.size(F.array_distinct(entries["k"])) == F.size(entries), entries).otherwise(
        F.filter(entries, lambda x, i: ~F.coalesce(same(x, i), F.lit(False))))


def _cell_map(entries: Column) -> Column:
    return F.map_from_arrays(entries["k"], F.arrays_zip(entries["s"], entries["n"], entries["serial"]).cast(
        "array<struct<s:string,n:double,serial:double>>"))


def row_ranges(rows: DataFrame) -> DataFrame:
    """:func:`used_range` from gathered rows."""
    return rows.filter("lo IS NOT NULL").groupBy(*SHEET).agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row"),
        F.min("lo").alias("first_col"), F.max("hi").alias("last_col"))


def _dealt(plan: DataFrame) -> DataFrame:
    """The plan once for every bucket of its sheet."""
    first, last = (F.shiftright(F.col(c).cast("long"), BITS) for c in ("first_row", "last_row"))
    return plan.withColumn(BUCKET, F.explode(F.sequence(first, last)))


def planned_rows(rows: DataFrame, plan: DataFrame, max_col: int = V.MAX_COLUMNS) -> DataFrame:
    """Rows with their sheet's plan, and with the far columns it names.

    The plan is repeated for every bucket of its sheet, so rows of one sheet meet it in many tasks.
    """
    none = F.array().cast("array<int>")
    named = F.array_distinct(F.concat(
        F.array(*[f"c_{c}" for c in V.UNIT_COLUMNS], "c_desc", "c_amt", "c_total"),
        F.coalesce(F.transform("mapped_columns", lambda c: c["index"]), none)))
    dealt = _dealt(plan).withColumn("_far", F.filter(named, lambda c: c > max_col))
    kept = F.map_filter("far", lambda k, _: F.array_contains("_far", k))
    return rows.drop("lo", "hi").join(dealt, [*SHEET, BUCKET]).withColumn(
        "m", F.when(F.size("_far") > 0, F.map_concat("m", kept)).otherwise(F.col("m"))).drop("far", "_far")


def row_text(m: Column, max_col: int = V.MAX_TEXT_COLUMN) -> Column:
    """Lower-case texts of the first columns, left to right as gathered rows list them."""
    first = F.filter(F.map_entries(m), lambda e: e["key"] <= max_col)
    return F.lower(F.array_join(first["value"]["s"], " "))


def _lowered(codes: Column) -> Column:
    return F.array_distinct(F.transform(
        F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.trim(F.lower(c))))


def code_sets(block: Column) -> dict[str, Column]:
    """Role sets of a block layout.

    A code listed both as owner-borne and reimbursed is owner-borne, unless it
    names an exemption programme outright.
    """
    rent, subsidy = _lowered(block["rent_codes"]), _lowered(block["subsidy_codes"])
    discount, concession = _lowered(block["discount_codes"]), _lowered(block["concession_codes"])
    borne = F.array_union(concession, discount)
    named = F.filter(borne, lambda c: charge_category(c) == "reimbursed_credit")
    return {
        "rent_codes": rent, "subsidy_codes": subsidy,
        "discount_codes": F.array_except(discount, named),
        "concession_codes": F.array_except(concession, named),
        "reimbursed_codes": F.array_union(
            F.array_except(_lowered(block["reimbursed_codes"]), borne), named),
    }


def sheet_plan(structures: DataFrame, ranges: DataFrame) -> DataFrame:
    """Usable structures with all indices shifted to sheet columns."""
    block_ok = (
        F.col("block.charge_desc_col").isNotNull() & F.col("block.charge_amt_col").isNotNull()
        & (F.size("block.rent_codes") > 0))
    usable = structures.withColumns({
        "block": F.col("block").withField("charge_desc_col", S.unsentinel("block.charge_desc_col"))
        .withField("charge_amt_col", S.unsentinel("block.charge_amt_col")),
    }).filter((S.unsentinel("columns.unit_number")).isNotNull() & (
        (F.col("layout") == "row") | ((F.col("layout") == "block") & block_ok)))
    shift = lambda c: S.unsentinel(c) + F.col("first_col")
    none = F.array().cast("array<string>")
    return usable.join(ranges, SHEET).select(
        *SHEET, "layout", "first_row", "last_row", "first_col", "last_col",
        F.greatest(F.col("first_row"), F.col("data_start_row") - 1).alias("start"),
        F.when((F.col("header_row") > 0) & (
            F.col("header_row") - 1 < F.greatest(F.col("first_row"), F.col("data_start_row") - 1)),
            F.col("header_row") - 1).alias("header_idx"),
        *[shift(f"columns.{c}").alias(f"c_{c}") for c in V.UNIT_COLUMNS],
        shift("block.charge_desc_col").alias("c_desc"),
        shift("block.charge_amt_col").alias("c_amt"),
        *[s.alias(n) for n, s in code_sets(F.col("block")).items()],
        F.when(F.col("layout") == "row", F.transform(
            F.filter("charge_columns", lambda c: (c["index"] >= 0) & (c["header"] != "")),
            lambda c: F.struct(F.trim(c["header"]).alias("header"),
                               (c["index"] + F.col("first_col")).alias("index"),
                               c["kind"].alias("kind")))).alias("mapped_columns"),
        F.when(F.col("layout") == "row", shift("charge_total_column")).alias("c_total"),
        F.filter(F.transform(F.coalesce("skip_patterns", none), lambda p: F.lower(p)),
                 lambda p: p != "").alias("skips"),
        F.filter(F.transform(F.coalesce("stop_markers", none), lambda p: F.lower(p)),
                 lambda p: p != "").alias("stops"),
        S.last_map(F.transform(
            F.filter("extra_columns", lambda c: (c["index"] >= 0) & (c["header"] != "")),
            lambda c: F.struct((c["index"] + F.col("first_col")).alias("k"),
                               F.trim(c["header"]).alias("v")))).alias("mapper_headers"),
        "stated_total_units", "stated_summary")


def _s(column: str, m: str = "m") -> Column:
    return F.col(m)[F.col(column)]["s"]


def _n(column: str, m: str = "m") -> Column:
    return F.col(m)[F.col(column)]["n"]


def row_flags(rows: DataFrame) -> DataFrame:
    """Stop, skip, boundary and orphan tests of each row of a planned sheet."""
    out = rows.withColumn("txt", row_text(F.col("m")))
    total_row = F.coalesce(
        (F.col("layout") == "block") & is_total_line(_s("c_desc")) & _n("c_amt").isNotNull(),
        F.lit(False))
    unit = _s("c_unit_number")
    contains = lambda text, patterns: F.exists(patterns, lambda p: F.contains(text, p))
    lower = F.lower(unit)
    clean_id = (
        unit.isNotNull() & (F.length(unit) <= V.MAX_UNIT_ID)
        & ~F.coalesce(contains(lower, F.col("skips")), F.lit(False))
        & ~F.coalesce(contains(lower, F.col("stops")), F.lit(False)))
    context = (_s("c_status").isNotNull() | _s("c_tenant_name").isNotNull()
               | _n("c_monthly_rent").isNotNull())
    return out.withColumns({
        "shown": F.col("txt") != "",
        "is_stop": F.coalesce(contains(F.col("txt"), F.col("stops")), F.lit(False)) & ~total_row,
        "is_skip": F.coalesce(contains(F.col("txt"), F.col("skips")), F.lit(False)),
        "clean_id": clean_id,
    }).withColumn("is_boundary", F.col("clean_id") & (
        unit.rlike(r"[0-9]") | lower.rlike(V.WORD_IDS) | F.coalesce(context, F.lit(False))))


def column_stats(rows: DataFrame) -> DataFrame:
    """Per column at or below the first data row: filled, numeric, signed sum."""
    return (
        rows.filter(F.col("row") >= F.col("start"))
        .select(*SHEET, F.explode("m").alias("col", "cell"))
        .filter(F.col("cell.s").isNotNull())
        .groupBy(*SHEET, "col")
        .agg(F.count(F.lit(1)).alias("filled"),
             F.count("cell.n").alias("numeric"),
             F.sum(F.col("cell.n").try_cast(S.LINE)).alias("total")))


def column_role(kind: Column, total: Column, header: Column) -> Column:
    """What a charge column does to rent: a named programme wins, then its sign."""
    return (
        F.when(charge_category(header) == "reimbursed_credit", "reimbursed_credit")
        .when(kind == "rent", "rent_component")
        .when(kind == "subsidy", F.when(total < 0, "reimbursed_credit").otherwise("subsidy"))
        .when(kind.isin("employee_discount", "concession"), "owner_reduction")
        .otherwise("fee"))


def bucket_stats(flagged: DataFrame) -> DataFrame:
    """What a sheet's columns hold, by bucket: :func:`column_stats`, first stop row, last boundary mark.

    Only charge columns are summed up, as only their sign is asked for.
    A stop row and a boundary have a text, so the cells of a row tell of them and one pass over the rows will do.
    """
    read = flagged.filter(F.col("row") >= F.col("start")).select(
        *SHEET, BUCKET, F.when(F.col("is_stop") & F.col("shown"), F.col("row")).alias("stop"), _mark().alias("mark"),
        F.col("mapped_columns.index").alias("charged"), "m")
    cells = read.select(*SHEET, BUCKET, "stop", "mark", "charged", F.explode_outer("m").alias("col", "cell")).filter(
        F.col("cell.s").isNotNull())
    charged = F.array_contains("charged", F.col("col"))
    return cells.groupBy(*SHEET, BUCKET, "col").agg(
        F.count(F.lit(1)).alias("filled"), F.count("cell.n").alias("numeric"),
        F.sum(F.when(charged, F.col("cell.n").try_cast(S.LINE))).alias("total"),
        F.min("stop").alias("stop"), F.max("mark").alias("mark"))


def full_plan(plan: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """Plan plus header texts, charge column roles, captured columns and the cut.

    ``found`` is :func:`bucket_stats` of the planned rows. Only the rows above the last start of any sheet are read
    for the headers; the files of gathered rows are sorted by row, so the others are skipped.
    """
    stats = found.groupBy(*SHEET, "col").agg(
        F.sum("filled").alias("filled"), F.sum("numeric").alias("numeric"), F.sum("total").alias("total"),
        F.min("stop").alias("stop")).groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct(
            "col", F.struct("filled", "numeric", "total")))).alias("stats"), F.min("stop").alias("cut"))
    lowest = plan.agg(F.max("start")).first()[0]
    top = planned_rows(rows.filter(F.col("row") < F.lit(lowest)), plan)
    filled = F.size(F.map_filter("m", lambda k, v: (k <= V.MAX_COLUMNS) & v["s"].isNotNull()))
    sheet = top.filter((F.col("row") < F.col("start")) & F.when(
        F.col("header_idx").isNotNull(), F.col("row") == F.col("header_idx")).otherwise(filled >= 2)).groupBy(
        *SHEET).agg(F.max_by("m", "row").alias("header_cells"))
    numeric = lambda c: F.coalesce(
        F.col("stats")[c["index"]]["numeric"] * 2 >= F.col("stats")[c["index"]]["filled"],
        F.lit(True))
    none = F.array().cast("array<struct<header:string,index:int,kind:string>>")
    out = (
        plan.join(stats, SHEET, "left").join(sheet, SHEET, "left")
        .withColumn("charge_columns", F.transform(
            F.filter(F.coalesce("mapped_columns", none), numeric), lambda c: F.struct(
                c["header"].alias("header"), c["index"].alias("index"), c["kind"].alias("kind"),
                column_role(c["kind"], F.col("stats")[c["index"]]["total"], c["header"])
                .alias("role"))))
        .withColumn("audits", (F.size("charge_columns") > 0) & F.col("c_total").isNotNull()))
    own_header = S.last_map(F.transform(
        F.coalesce("mapped_columns", none),
        lambda c: F.struct(c["index"].alias("k"), c["header"].alias("v"))))
    taken = F.array_compact(F.array("c_unit_number", "c_desc", "c_amt"))
    captured = F.array_sort(F.map_keys(F.coalesce(
        "stats", F.create_map().cast("map<int,struct<filled:bigint,numeric:bigint,total:decimal(38,4)>>"))))
    captured = F.filter(captured, lambda c: c <= V.MAX_COLUMNS)
    captured = F.array_except(F.array_except(captured, taken),
                              F.transform("charge_columns", lambda c: c["index"]))
    return out.withColumn("own_header", own_header).withColumn("captured", F.transform(
        captured, lambda c: F.struct(c.alias("index"), F.coalesce(
            F.col("own_header")[c], F.col("mapper_headers")[c], F.col("header_cells")[c]["s"],
            F.concat(F.lit("Column "), S.col_letter(c))).alias("header")))
    ).drop("own_header", "stats", "header_cells")


def _mark() -> Column:
    """Twice the row of a boundary, and one more where a unit begins."""
    return F.when(F.col("is_boundary"), F.col("row") * 2 + F.when(_anchor(), 1).otherwise(0))


def _anchor() -> Column:
    """A boundary that begins a unit; its unit id is a text, so most often it need not be looked for one."""
    shown = (F.col("c_unit_number") <= V.MAX_TEXT_COLUMN) | F.col("shown")
    return F.col("is_boundary") & shown & ~F.col("is_skip")


def _beside(cells: str = "m") -> Column:
    """Cells a row below the anchor may give its unit: there unit id, charge code and amount belong to the next line."""
    return F.map_filter(cells, lambda c, _: ~F.coalesce(
        (c == F.col("c_unit_number")) | (c == F.col("c_desc")) | (c == F.col("c_amt")), F.lit(False)))


def assign_blocks(flagged: DataFrame, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Unit rows of row layouts, and all rows of block layouts with their block and its code sets' verdict.

    ``block_row`` is the last boundary row at or above a row.

    Boundaries the walk skips still end the block before them; their own rows
    belong to no unit. ``found`` is :func:`bucket_stats`, which has the last boundary of every bucket; boundaries
    at or below the cut, which it has as well, are in no bucket above a walked row's.
    """
    walked = flagged.filter(
        (F.col("row") >= F.col("start")) & (F.col("cut").isNull() | (F.col("row") < F.col("cut"))))
    # In a row layout each row stands for itself: no scan, no exchange.
    rows = walked.filter((F.col("layout") == "row") & _anchor()).withColumn("block_row", F.col("row"))
    # The scan exchanges rows: what they need of their plan is read before, the plan stays behind.
    code = F.lower(_s("c_desc"))
    read = walked.filter(F.col("layout") == "block").select(
        *SHEET, BUCKET, "row", "shown", _mark().alias("at"), F.when(_anchor(), F.col("m")).otherwise(_beside()).alias("m"),
        _s("c_desc").alias("desc"), _amount(_n("c_amt")).alias("amt"),
        *[F.array_contains(name, code).alias(f"in_{name}") for name in CODE_SETS])
    last = None if found is None else found.groupBy(*SHEET, BUCKET).agg(F.max("mark").alias("mark"))
    blocks = (
        running(read, SHEET, "row", {"mark": F.col("at")}, "max", bucket=BUCKET, totals=last)
        .filter(F.col("mark") % 2 == 1)
        .withColumn("block_row", F.shiftright("mark", 1)).drop("mark"))
    return rows, blocks


def _money(x: Column) -> Column:
    return S.cents(x.try_cast(S.LINE))


def _amount(x: Column) -> Column:
    return x.try_cast(S.LINE)


def _fold(lines: Column, keep) -> Column:
    """Sum of the amounts of the kept lines of a bounded array."""
    return F.aggregate(
        lines, F.lit(0).cast("decimal(24,4)"),
        lambda acc, x: (acc + F.when(keep(x), x["amt"]).otherwise(0)).cast("decimal(24,4)"))


def _saw(lines: Column, keep) -> Column:
    return F.exists(lines, keep)


def _block_units(blocks: DataFrame) -> DataFrame:
    """Money of block layouts: sums over all rows of a block, by code set."""
    desc, amt = F.col("desc"), F.col("amt")
    line = desc.isNotNull() & amt.isNotNull()
    total = line & is_total_line(desc)
    of = lambda name: line & F.col(f"in_{name}")
    reduces = of("discount_codes") | of("concession_codes")
    # A code in both reduction sets is counted once per set, as printed.
    rent = (
        F.when(of("rent_codes"), amt).otherwise(0) + F.when(of("discount_codes"), amt).otherwise(0)
        + F.when(of("concession_codes"), amt).otherwise(0))
    near = (F.col("row") - F.col("block_row")).cast("int")
    inside = (near <= V.SCALAR_SCAN_ROWS) & F.col("shown")
    summed = lambda name: F.sum(F.when(of(name), amt))
    # Dealt and sorted as rows; lists aggregated before the exchange would be sorted on either side of it.
    dealt = blocks.withColumn("near", F.when(inside, F.struct(near.alias("k"), "m"))).drop("m", "shown").repartition(
        *SHEET, "block_row").sortWithinPartitions("block_row", *SHEET)
    return dealt.groupBy("block_row", *SHEET).agg(
        F.map_from_entries(F.collect_list("near")).alias("near"),
        F.min_by(amt, F.when(total, F.col("row"))).alias("block_charge_total"),
        F.sum(F.when(of("rent_codes") | reduces, rent)).alias("b_rent"),
        summed("subsidy_codes").alias("b_subsidy"),
        summed("discount_codes").alias("b_discount"),
        summed("concession_codes").alias("b_concession"),
        F.sum(F.when(line & ~total, amt)).alias("charge_sum"),
        F.count_if(line & ~total).alias("n_lines"))


def _first_cells(near: Column) -> Column:
    """First cell present per column over the unbroken rows from the anchor."""
    unbroken = F.filter(F.array_sort(F.map_keys(near)), lambda k, i: (k == i) & (k > 0))
    more = F.filter(unbroken, lambda k: F.size(near[k]) > 0)
    return F.when(F.size(near) == 1, near[F.lit(0)]).otherwise(F.aggregate(
        more, near[F.lit(0)], lambda acc, k: F.map_concat(
            acc, F.map_filter(near[k], lambda c, _: ~F.map_contains_key(acc, c)))))


def _row_money(df: DataFrame) -> DataFrame:
    """Money of row layouts from mapped columns and charge-code columns."""
    read = F.filter(F.transform("charge_columns", lambda c: F.struct(
        c["role"].alias("role"), c["kind"].alias("kind"),
        _amount(F.col("m")[c["index"]]["n"]).alias("amt"))), lambda x: x["amt"].isNotNull())
    rent = lambda x: x["role"].isin("rent_component", "subsidy") | (
        (x["role"] == "owner_reduction") & (x["amt"] != 0))
    subsidy = lambda x: (x["role"] == "subsidy") & (x["amt"] != 0)
    discount = lambda x: (x["role"] == "owner_reduction") & (x["amt"] != 0) & (
        x["kind"] == "employee_discount")
    concession = lambda x: (x["role"] == "owner_reduction") & (x["amt"] != 0) & (
        x["kind"] != "employee_discount")
    any_line = lambda x: x["amt"] != 0
    lines = F.col("_lines")
    sums = lambda keep: F.when(_saw(lines, keep), S.cents(_fold(lines, keep)))
    with_columns = F.size("charge_columns") > 0
    mapped = lambda c: _money(_n(f"c_{c}"))
    no_zero = lambda c: F.when(~(with_columns & (c == 0)), c)
    out = df.withColumn("_lines", read).withColumns({
        "n_lines": F.size(F.filter(lines, any_line)).cast("bigint"),
        "charge_sum": _fold(lines, any_line),
        "block_charge_total": F.when(with_columns, _amount(_n("c_total"))),
    })
    rent_value = F.coalesce(mapped("monthly_rent"), sums(rent))
    return out.withColumns({
        "monthly_rent": F.when(
            with_columns & F.col("c_monthly_rent").isNull() & (F.col("n_lines") == 0)
            & (F.coalesce(rent_value, F.lit(0)) == 0) & (F.col("block_charge_total") != 0),
            S.cents(F.col("block_charge_total"))).otherwise(rent_value),
        "subsidy_rent": no_zero(F.coalesce(mapped("subsidy_rent"), sums(subsidy))),
        "employee_discount": no_zero(F.coalesce(mapped("employee_discount"), sums(discount))),
        "concession": no_zero(F.coalesce(mapped("concession"), sums(concession))),
        "charge_sum": F.when(F.col("n_lines") > 0, F.col("charge_sum")),
    }).drop("_lines")


def _unit_fields(df: DataFrame) -> DataFrame:
    """Scalar fields of a unit from its first cells ``f`` and anchor row ``m``."""
    text = lambda c: _s(f"c_{c}", "f")
    number = lambda c: _n(f"c_{c}", "f")
    serial = lambda c: F.col("f")[F.col(f"c_{c}")]["serial"]
    day = lambda c: S.parse_date(text(c), serial(c))
    shared = F.col("c_lease_start_date") == F.col("c_lease_end_date")
    lease = lambda c, part: F.when(
        shared, S.parse_date_range(text(c), part, serial(c))).otherwise(day(c))
    out = df.withColumns({
        "unit_number": _s("c_unit_number"),
        "lease_status": text("status"),
        "_tenant": S.join_name_parts(text("tenant_name"), text("tenant_name2")),
        "unit_type": text("unit_type"),
    })
    status, tenant = S.status_or_from_tenant("lease_status", "_tenant")
    category = S.unit_category("unit_number", "unit_type")
    return out.withColumns({
        "status": status, "tenant_name": tenant, "category": category,
        "market_rent": _money(number("market_rent")),
        "unit_sqft": number("unit_sqft"),
        "move_in_date": day("move_in_date"), "move_out_date": day("move_out_date"),
        "lease_start_date": lease("lease_start_date", "start"),
        "lease_end_date": lease("lease_end_date", "end"),
        "source_columns": F.filter(F.transform("captured", lambda c: F.struct(
            c["header"].alias("header"), F.col("f")[c["index"]]["s"].alias("value"))),
            lambda x: x["value"].isNotNull()),
    }).withColumn("include_in_unit_count", S.is_counted("category"))


UNIT_FIELDS = (
    *SHEET, "source_row", "unit_number", "status", "category", "include_in_unit_count",
    "monthly_rent", "market_rent", "subsidy_rent", "employee_discount", "concession",
    "tenant_name", "unit_sqft", "unit_type", "lease_status", "move_in_date", "move_out_date",
    "lease_start_date", "lease_end_date", "block_charge_total", "charge_sum", "n_lines",
    "source_columns")

_PLAN_FOR_UNITS = [f"c_{c}" for c in V.UNIT_COLUMNS] + ["c_desc", "c_amt", "captured"]


def _units(rows: DataFrame, blocks: DataFrame, plan: DataFrame) -> DataFrame:
    row_units = _row_money(rows).withColumns(
        {"source_row": F.col("block_row"), "f": F.col("m")})
    block_units = (
        _block_units(blocks)
        .withColumn(BUCKET, F.shiftright(F.col("block_row").cast("long"), BITS))
        .join(_dealt(plan.select(*SHEET, "first_row", "last_row", *_PLAN_FOR_UNITS)), [*SHEET, BUCKET])
        .withColumns({
            "source_row": F.col("block_row"), "m": F.col("near")[F.lit(0)],
            "f": _first_cells(F.col("near")),
            "monthly_rent": S.cents(F.col("b_rent")), "subsidy_rent": S.cents(F.col("b_subsidy")),
            "employee_discount": S.cents(F.col("b_discount")),
            "concession": S.cents(F.col("b_concession")),
        }))
    kinds = {"block_charge_total": S.LINE, "charge_sum": "decimal(24,4)"}
    shared = [*SHEET, "source_row", "m", "f", *[f"c_{c}" for c in V.UNIT_COLUMNS], "captured", "monthly_rent",
              "subsidy_rent", "employee_discount", "concession", "block_charge_total", "charge_sum", "n_lines"]
    pick = lambda df: df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in shared])
    return _unit_fields(pick(row_units).unionByName(pick(block_units))).select(*UNIT_FIELDS)


def _lines(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Charge lines of all units, one row each, in printed order."""
    desc, amt = F.col("desc"), F.col("amt")
    has = lambda name: F.col(f"in_{name}")
    stamp = (
        F.when(has("reimbursed_codes"), "reimbursed_credit")
        .when(has("concession_codes") | has("discount_codes"), "concession")
        .when(has("subsidy_codes"), "subsidy").when(has("rent_codes"), "base_rent"))
    block = blocks.filter(
        desc.isNotNull() & amt.isNotNull() & ~is_total_line(desc)
    ).select(*SHEET, F.col("block_row").alias("source_row"),
             (F.col("row") - F.col("block_row")).alias("line_no"), desc.alias("code"),
             amt.alias("amount"), stamp.alias("category"))
    cells = rows.select(
        *SHEET, F.col("block_row").alias("source_row"), "m",
        F.posexplode("charge_columns").alias("line_no", "c"))
    row = cells.select(
        *SHEET, "source_row", F.col("line_no").cast("long").alias("line_no"),
        F.col("c.header").alias("code"), _amount(F.col("m")[F.col("c.index")]["n"]).alias("amount"),
        S.lookup(V.ROLE_CATEGORY, F.col("c.role")).alias("category")
    ).filter(F.col("amount") != 0)
    return row.unionByName(block)


def walk(cells: DataFrame, structures: DataFrame, keep_blocks: bool = False) -> Walk:
    """Walk every planned sheet.

    The cells are read once. The gathered rows, from which ranges, plans and units come, and the plan (one
    row per sheet) are staged, so every branch has a short lineage and prunes what it reads. With ``keep_blocks``
    the rows with their blocks are staged as well, for callers who read units and lines.
    """
    rows = stage(sheet_rows(cells))
    plan0 = stage(sheet_plan(structures, row_ranges(rows)))
    found = stage(bucket_stats(row_flags(planned_rows(rows, plan0))))
    plan = stage(full_plan(plan0, rows, found))
    flagged = row_flags(planned_rows(rows, plan))
    alone, blocks = assign_blocks(flagged, found)
    if keep_blocks:
        blocks = stage(blocks)
    return Walk(plan, flagged, _units(alone, blocks, plan), _lines(alone, blocks))


def dedupe_units(units: DataFrame, convention: str = "applicant-over-vacant") -> DataFrame:
    """One row per unit number of a sheet; the first occurrence gives the place.

    Done as an aggregation, so a number repeated millions of times is reduced
    before it is exchanged.
    """
    rank = S.lookup({k: str(v) for k, v in V.CONVENTIONS[convention].items()},
                    F.col("status")).cast("int")
    best = F.struct((-F.coalesce(rank, F.lit(0))).alias("p"), F.col("source_row").alias("r"))
    body = F.struct(*[F.col(c) for c in units.columns])
    out = units.groupBy(*SHEET, F.upper("unit_number").alias("_id")).agg(
        F.min_by(body, best).alias("u"), F.min("source_row").alias("place"))
    return out.select("u.*", "place").withColumn("convention", F.lit(convention))


def dedupe_units_older(units: DataFrame) -> DataFrame:
    """Older profile: higher status rank, then a tenant where there was none."""
    rank = S.lookup({k: str(v) for k, v in V.OLDER_PRIORITY.items()}, F.col("status")).cast("int")
    named = F.coalesce(F.col("tenant_name"), F.lit("")) != ""
    best = F.struct((-F.coalesce(rank, F.lit(0))).alias("p"),
                    F.when(named, 0).otherwise(1).alias("t"), F.col("source_row").alias("r"))
    body = F.struct(*[F.col(c) for c in units.columns])
    return units.groupBy(*SHEET, F.upper("unit_number").alias("_id")).agg(
        F.min_by(body, best).alias("u"), F.min("source_row").alias("place")).select("u.*", "place")


def renumber_rows(units: DataFrame, sheet_no: str, place: str = "source_row") -> DataFrame:
    """1-based order of a document's units over its sheets."""
    from unitwise.functions.scan import numbered
    sizes = units.groupBy("doc_id", sheet_no).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running(sizes, ["doc_id"], sheet_no, {"_upto": F.col("_n")}, levels=2).select(
        "doc_id", sheet_no, (F.col("_upto") - F.col("_n")).alias("_offset"))
    inside = numbered(units, ["doc_id", sheet_no], place, "_in_sheet")
    return inside.join(offsets, ["doc_id", sheet_no]).withColumn(
        "row_no", F.col("_in_sheet") + F.col("_offset")).drop("_in_sheet", "_offset")
