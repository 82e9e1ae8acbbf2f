"""Sheet-level operators over the long cell table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitwise.functions import fixed_values as V
from unitwise.functions import scalars as S
from unitwise.functions.scan import numbered
from unitwise.operators.walk import SHEET, used_range
from unitwise.session import stage


def sheet_grid(cells: DataFrame, max_rows: int | None = None) -> DataFrame:
    """One text line per non-empty row: ``R<n>: a | b | c``, dates as ISO days."""
    ranges = used_range(cells).select(*SHEET, "first_row", "first_col", "last_col")
    serial = (F.col("ctype") == "n") & S.is_date_format("num_fmt")
    text = F.coalesce(
        F.when(serial, S.serial_to_date("num").cast("string")), S.clean_text("text"))
    shown = cells.withColumn("shown", text).filter(F.col("shown").isNotNull()).join(
        ranges, SHEET).filter(F.col("col") < F.col("first_col") + V.MAX_COLUMNS)
    if max_rows is not None:
        shown = shown.filter(F.col("row") < F.col("first_row") + max_rows)
    rows = shown.groupBy(*SHEET, "row", "first_col").agg(F.sort_array(F.collect_list(F.struct(
        F.col("col").alias("k"), F.col("shown").alias("v")))).alias("e"))
    # A cell brings the bars between it and the one before; of a column listed twice the last text is printed.
    # A date without a text may stand left of the used range: it is printed only as the last cell of its row.
    at, first = lambda i: F.get("e", i)["k"], F.col("first_col")
    line = F.array_join(F.transform("e", lambda c, i: F.when((c["k"] < first) & at(i + 1).isNotNull(), "").otherwise(
        F.concat(F.repeat(F.lit(" | "), F.abs(c["k"] - F.greatest(at(i - 1), first))),
                 F.when(F.coalesce(at(i + 1) == c["k"], F.lit(False)), "").otherwise(c["v"])))), "")
    return rows.select(*SHEET, "row", F.concat(
        F.lit("R"), (F.col("row") + 1).cast("string"), F.lit(": "), line).alias("line"))


def sheet_inventory(cells: DataFrame) -> DataFrame:
    """Rows and columns of each sheet."""
    return used_range(cells).select(
        *SHEET, (F.col("last_row") - F.col("first_row") + 1).alias("n_rows"),
        (F.col("last_col") - F.col("first_col") + 1).cast("long").alias("n_cols"))


def text_inventory(documents: DataFrame, text: str = "text") -> DataFrame:
    """Non-blank characters of a document, and whether it is likely a scan."""
    n = F.length(F.regexp_replace(F.col(text), r"\s", "")).cast("long")
    return documents.select("doc_id", n.alias("n_chars")).withColumn(
        "likely_scanned", F.col("n_chars") < V.SCANNED_BELOW_CHARS)


def sheet_scores(grid: DataFrame, inventory: DataFrame) -> DataFrame:
    """How much a sheet looks like a unit table."""
    first = inventory.select(*SHEET, "n_rows")
    text = F.lower("line")
    # The first row with a word says whether the preview has it, so the lines are read once.
    worded = lambda words: F.min(F.when(text.rlike("|".join(words)), F.col("row"))) - F.min("row")
    has = lambda words: F.coalesce(worded(words) < V.PREVIEW_ROWS, F.lit(False))
    agg = grid.groupBy(*SHEET).agg(
        has(V.SHEET_UNIT_WORDS).alias("unit_words"), has(V.SHEET_MONEY_WORDS).alias("money_words"),
        F.sum(F.size(F.regexp_extract_all("line", F.lit(V.SHEET_NUMBERS), F.lit(0)))
              .cast("long")).alias("numbers"))
    name = F.col("sheet")
    score = (
        F.when(F.col("unit_words"), 2).otherwise(0) + F.when(F.col("money_words"), 2).otherwise(0)
        + F.when(F.col("numbers") >= 5, 1).otherwise(0)
        - F.when(name.rlike(V.SHEET_LOOKUP_NAMES), 5).otherwise(0)
        - F.when(name.rlike(V.SHEET_MARKET_NAMES), 5).otherwise(0))
    return agg.join(first, SHEET).select(
        *SHEET, F.when(F.col("n_rows") < 3, 0).otherwise(score).alias("score"))


def select_sheets(scores: DataFrame, triage: DataFrame, order: str = "sheet_no") -> DataFrame:
    """Sheets to read: one candidate by itself, else what triage confirms.

    ``scores`` carries the sheet order; ``triage`` has doc_id, sheet and
    is_unit_level. Without a positive score the best sheet is the candidate;
    without a confirmation the first candidate is taken.
    """
    best = scores.groupBy("doc_id").agg(
        F.count_if(F.col("score") > 0).alias("n_candidates"),
        F.min_by("sheet", F.when(F.col("score") > 0, F.col(order))).alias("first_candidate"),
        F.max_by("sheet", F.struct(F.col("score").alias("a"), (-F.col(order)).alias("b")))
        .alias("best_sheet"))
    confirmed = triage.filter("is_unit_level").select(*SHEET).distinct()
    candidates = scores.filter(F.col("score") > 0).join(confirmed, SHEET, "left_semi")
    any_confirmed = candidates.select("doc_id").distinct().withColumn("_confirmed", F.lit(True))
    single = best.join(any_confirmed, "doc_id", "left").filter(
        (F.col("n_candidates") <= 1) | F.col("_confirmed").isNull()
    ).select("doc_id", F.when(F.col("n_candidates") == 0, F.col("best_sheet"))
             .otherwise(F.col("first_candidate")).alias("sheet"))
    many = candidates.join(
        best.filter(F.col("n_candidates") > 1).select("doc_id"), "doc_id", "left_semi")
    return single.unionByName(many.select(*SHEET))


def sample_rows(grid: DataFrame) -> DataFrame:
    """The lines of a sheet, or its beginning, middle and end when it is long."""
    ranked = numbered(grid, SHEET, "row", "line_no")
    sizes = grid.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_lines"))
    i, n = F.col("line_no") - 1, F.col("n_lines")
    middle = F.floor(n / 2) - V.SAMPLE_MIDDLE // 2
    part = (
        F.when(n <= V.SAMPLE_WHOLE, "whole").when(i < V.SAMPLE_FIRST, "first")
        .when(i >= n - V.SAMPLE_LAST, "last")
        .when((i >= middle) & (i < middle + V.SAMPLE_MIDDLE), "middle"))
    return ranked.join(sizes, SHEET).withColumn("part", part).filter(
        F.col("part").isNotNull()).drop("n_lines")


def sample_rows_older(grid: DataFrame, first: int = 35, last: int = 70) -> DataFrame:
    """Older profile: the first and the last rows of the used range."""
    # The lines are put together once, not again to find the span.
    grid = stage(grid)
    span = grid.groupBy(*SHEET).agg(F.min("row").alias("_a"), F.max("row").alias("_b"))
    return grid.join(span, SHEET).filter(
        (F.col("row") < F.col("_a") + first) | (
            (F.col("_b") - last + 1 > F.col("_a") + first) & (F.col("row") > F.col("_b") - last))
    ).drop("_a", "_b")


def header_text(grid: DataFrame, chars: int = V.HEADER_CHARS) -> DataFrame:
    """Lower-case text of the header region of each sheet.

    A line is at least five characters with its break, so the region never
    reaches past ``chars / 5`` lines and the group stays bounded.
    """
    w = Window.partitionBy(*SHEET).orderBy("row")
    top = grid.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= chars // 5 + 1)
    return top.groupBy(*SHEET).agg(
        F.array_sort(F.collect_list(F.struct("_i", "line"))).alias("_l")
    ).select(*SHEET, F.lower(F.substring(F.array_join(
        F.transform("_l", lambda x: x["line"]), "\n"), 1, chars)).alias("head"))


def column_hints(grid: DataFrame) -> DataFrame:
    """Optional fields the header region of a sheet advertises."""
    hints = F.array_compact(F.array(*[
        F.when(F.col("head").rlike(p), name) for name, p in V.COLUMN_HINTS]))
    return header_text(grid).select(*SHEET, F.array_join(hints, ",").alias("hints"))


def summary_sheets(grid: DataFrame, inventory: DataFrame, selected: DataFrame) -> DataFrame:
    """Small unselected sheets that speak of totals or occupancy."""
    one = selected.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    small = inventory.filter(F.col("n_rows") <= V.SUMMARY_MAX_ROWS).select(*SHEET)
    worded = grid.filter(F.col("line").rlike(V.SUMMARY_WORDS)).select(*SHEET).distinct()
    return (small.join(worded, SHEET, "left_semi").join(selected, SHEET, "left_anti")
            .join(one, "doc_id", "left_semi"))


def column_inventory(cells: DataFrame) -> DataFrame:
    """Repeated short texts per column, with the sum of the cell to their right."""
    # Each cell offers its number to its left neighbour: one aggregation on the
    # cell address pairs them, without gathering whole rows.
    text = S.clean_text("text")
    number = F.when(F.col("ctype") == "n", F.col("num")).otherwise(S.parse_number("text"))
    code = F.when((F.col("ctype") == "s") & (F.length(text) <= 25)
                  & ~text.rlike("[0-9]{3,}"), text)
    offers = cells.filter(F.col("col") <= V.MAX_INVENTORY_COLUMN + 1).select(
        *SHEET, "row", F.explode(F.array(
            F.struct(F.col("col").alias("col"), code.alias("value"),
                     F.lit(None).cast("double").alias("amount")),
            F.struct((F.col("col") - 1).alias("col"), F.lit(None).cast("string").alias("value"),
                     number.alias("amount")))).alias("o")).select(*SHEET, "row", "o.*").filter(
        F.col("value").isNotNull() | F.col("amount").isNotNull())
    seen = offers.groupBy(*SHEET, "row", "col").agg(
        F.max("value").alias("value"), F.max("amount").alias("amount")).filter(
        F.col("value").isNotNull() & (F.col("col") <= V.MAX_INVENTORY_COLUMN))
    values = seen.groupBy(*SHEET, "col", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count("amount").alias("n_sums"),
        F.sum(F.col("amount").try_cast(S.LINE)).alias("_sum"))
    columns = values.groupBy(*SHEET, "col").agg(
        F.count(F.lit(1)).alias("_values"), F.sum("n").alias("_rows"))
    keep = columns.filter(F.col("_values").between(2, 25) & (F.col("_rows") >= 10))
    return values.join(keep.select(*SHEET, "col"), [*SHEET, "col"], "left_semi").select(
        *SHEET, "col", "value", "n",
        F.when(F.col("n_sums") * 5 >= F.col("n") * 3, S.cents(F.col("_sum"))).alias("next_sum"))


def detect_nonstandard_layout(cells: DataFrame) -> DataFrame:
    """Four signals of a layout the column mapping does not fit.

    Looks at the first sixty rows of a sheet, so every group here is bounded. Ranges and these rows are
    staged: the cells are read twice, not once for every signal.
    """
    ranges = stage(used_range(cells))
    head = stage(cells.filter(S.clean_text("text").isNotNull()).join(ranges, SHEET).withColumns({
        "i": F.col("row") - F.col("first_row"),
        "n_rows": F.col("last_row") - F.col("first_row") + 1,
    }).filter(F.col("i") < 60))
    sample = F.least(F.lit(60), F.col("n_rows"))

    ids = head.filter((F.col("col") == 0) & (F.col("ctype") == "n") & (F.col("num") >= 100))
    w = Window.partitionBy(*SHEET).orderBy("num")
    steps = ids.withColumn("step", F.col("num") - F.lag("num").over(w)).groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("step") <= 20).alias("near"),
        F.max(sample).alias("sample"))
    row_ids = steps.select(*SHEET, (
        (F.col("n_ids") > F.col("sample") * 0.4) & (F.col("n_ids") > 1)
        & (F.col("near") > F.col("n_ids") * 0.6)).alias("row_ids"))

    text_rows = head.filter((F.col("i") >= 5) & (F.col("col") <= 6)).groupBy(
        *SHEET, "row", "last_row").agg(F.array_sort(F.collect_list(F.struct("col", "text")))
                                       .alias("c"))
    text = F.array_join(F.transform("c", lambda x: x["text"]), " ")
    flag = lambda c: F.when(c, 1).otherwise(0)
    units = text.rlike(V.SUBTOTAL_UNITS) & ~text.rlike(V.NOT_SUBTOTAL_UNITS)
    worded = text_rows.groupBy(*SHEET).agg(
        F.sum(flag(text.rlike(V.STREET_HEADER)) + flag(F.trim(text).rlike(V.BUILDING_HEADER)))
        .alias("headers"),
        F.sum(flag((F.col("row") < F.col("last_row") - 3)
                   & (units | text.rlike(V.SUBTOTAL_OCCUPIED)))).alias("subtotals"))

    wide = head.filter((F.col("i") < 20) & (F.col("col") >= 5)).groupBy(*SHEET).agg(
        F.count_distinct("col").alias("used"))
    signals = (
        ranges.join(row_ids, SHEET, "left").join(worded, SHEET, "left").join(wide, SHEET, "left")
        .select(
            *SHEET, F.coalesce("row_ids", F.lit(False)).alias("row_ids"),
            (F.coalesce("headers", F.lit(0)) >= 2).alias("section_headers"),
            (F.coalesce("subtotals", F.lit(0)) >= 2).alias("subtotals"),
            ((F.col("last_col") > 20) & (
                (F.col("last_col") - 4 - F.coalesce("used", F.lit(0)))
                > (F.col("last_col") - 5) * 0.5)).alias("sparse")))
    n = sum((F.col(c).cast("int") for c in ("section_headers", "subtotals", "sparse")),
            F.col("row_ids").cast("int"))
    return signals.withColumn("nonstandard", F.col("row_ids") | (n >= 2))


def drop_duplicate_views(units: DataFrame, order: str = "sheet_no") -> DataFrame:
    """Sheets that only re-list units, tenants included, of a larger sheet.

    A sheet goes when another one of at least its size (the earlier one at
    equal size) holds all its unit and tenant pairs. Containment is transitive
    and the size order strict, so testing against any such sheet is the same as
    testing in sequence. Sheets with the very same pairs are compared with one
    representative only; the rest meet candidates through their rarest pair.
    """
    pair = F.concat_ws("::", S.norm_unit_plain("unit_number"), S.norm_tenant("tenant_name"))
    rows = units.select("doc_id", order, "sheet", pair.alias("pair"),
                        (S.norm_tenant("tenant_name") != "").alias("named"))
    pairs = rows.groupBy("doc_id", order, "sheet", "pair").agg(
        F.count(F.lit(1)).alias("c"), F.bool_or("named").alias("named"))
    sheets = pairs.groupBy("doc_id", order, "sheet").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_pairs"),
        F.bool_or("named").alias("named"),
        F.bit_xor(F.xxhash64("pair")).alias("sig1"),
        F.bit_xor(F.xxhash64("pair", F.lit(7))).alias("sig2"))
    rank = F.struct((-F.col("n")).alias("a"), F.col(order).alias("b"))
    same = ["doc_id", "n_pairs", "sig1", "sig2"]
    leads = sheets.groupBy(*same).agg(F.min_by(order, rank).alias("lead"))
    tagged = sheets.join(leads, same)
    a, b = "_a", "_b"
    to_lead = tagged.filter(F.col(order) != F.col("lead")).select(
        "doc_id", F.col(order).alias(b), F.col("lead").alias(a))

    heads = tagged.filter(F.col(order) == F.col("lead")).select("doc_id", order)
    head_pairs = pairs.join(heads, ["doc_id", order], "left_semi")
    spread = head_pairs.groupBy("doc_id", "pair").agg(F.count(F.lit(1)).alias("df"))
    rarest = head_pairs.join(spread, ["doc_id", "pair"]).groupBy("doc_id", order).agg(
        F.min_by("pair", F.struct("df", "pair")).alias("pair"))
    holders = head_pairs.select("doc_id", "pair", F.col(order).alias(a))
    met = rarest.withColumnRenamed(order, b).join(holders, ["doc_id", "pair"]).filter(
        F.col(a) != F.col(b)).select("doc_id", b, a)

    size = lambda side: sheets.select(
        "doc_id", F.col(order).alias(side), F.col("n").alias(f"n{side}"),
        F.col("n_pairs").alias(f"p{side}"), F.col("named").alias(f"named{side}"))
    asked = (
        to_lead.unionByName(met).join(size(a), ["doc_id", a]).join(size(b), ["doc_id", b])
        .filter(F.col("named_b") & ((F.col("n_b") < F.col("n_a")) | (
            (F.col("n_b") == F.col("n_a")) & (F.col(a) < F.col(b)))))
        .select("doc_id", a, b, "p_b"))
    mine = pairs.select("doc_id", F.col(order).alias(b), "pair")
    theirs = pairs.select("doc_id", F.col(order).alias(a), "pair")
    found = asked.join(mine, ["doc_id", b]).join(theirs, ["doc_id", a, "pair"]).groupBy(
        "doc_id", a, b, "p_b").agg(F.count(F.lit(1)).alias("hit"))
    gone = found.filter(F.col("hit") == F.col("p_b")).select(
        "doc_id", F.col(b).alias(order)).distinct()
    return sheets.join(gone, ["doc_id", order], "left_anti").select("doc_id", "sheet", order)


def dedupe_chunks(units: DataFrame, pos: str = "pos") -> DataFrame:
    """Drop repeats of (building, unit, tenant, rent) across adjoining chunks."""
    key = F.struct(
        F.upper(F.trim(F.coalesce("building", F.lit("")))).alias("b"),
        S.norm_unit_plain("unit_number").alias("u"),
        F.upper(F.trim(F.coalesce("tenant_name", F.lit("")))).alias("t"),
        F.coalesce(F.col("monthly_rent").cast("string"), F.lit("")).alias("r"))
    body = F.struct(*[F.col(c) for c in units.columns])
    return units.groupBy("doc_id", key.alias("_k")).agg(
        F.min_by(body, F.struct("chunk", pos)).alias("u")).select("u.*")


def attempts_agree(units: DataFrame) -> DataFrame:
    """Do attempts one and two of a document list the same units?"""
    counts = units.filter(F.col("attempt_no").isin(1, 2)).groupBy(
        "doc_id", S.norm_unit_plain("unit_number").alias("id")).agg(
        F.count_if(F.col("attempt_no") == 1).alias("a"),
        F.count_if(F.col("attempt_no") == 2).alias("b"))
    return counts.groupBy("doc_id").agg(F.bool_and(F.col("a") == F.col("b")).alias("agree"))


def best_attempt(attempts: DataFrame, agreement: DataFrame | None = None) -> DataFrame:
    """Which of up to three attempts the ladder keeps.

    A verified first attempt with anchors stands. Without anchors the second
    opinion wins when the unit lists differ and it has no more issues. A third
    attempt counts only after a failed best with anchors.
    """
    body = F.struct("attempt_no", "ok", "n_issues", "n_units", "has_anchors")
    wide = attempts.groupBy("doc_id").agg(*[
        F.max(F.when(F.col("attempt_no") == i, body)).alias(f"t{i}") for i in (1, 2, 3)])
    if agreement is not None:
        wide = wide.join(agreement, "doc_id", "left")
    else:
        wide = wide.withColumn("agree", F.lit(None).cast("boolean"))

    def better(x: Column, y: Column) -> Column:
        return (
            F.when(y.isNull(), x).when(x["ok"] & ~y["ok"], x).when(y["ok"] & ~x["ok"], y)
            .when(x["n_issues"] < y["n_issues"], x).when(y["n_issues"] < x["n_issues"], y)
            .when(y["n_units"] >= x["n_units"], y).otherwise(x))

    t1, t2, t3 = F.col("t1"), F.col("t2"), F.col("t3")
    two = better(t1, t2)
    three = S.let(two, lambda b: F.when(~b["ok"] & b["has_anchors"], better(b, t3)).otherwise(b))
    opinion = F.when(
        t2.isNotNull() & ~F.coalesce("agree", F.lit(False)) & (t2["n_issues"] <= t1["n_issues"]), t2
    ).otherwise(t1)
    kept = F.when(~t1["ok"], three).when(~t1["has_anchors"], opinion).otherwise(t1)
    return wide.select("doc_id", kept["attempt_no"].alias("attempt_no"))


def category_candidates(units: DataFrame, pos: str = "unit_row_id",
                        text: Column | None = None) -> DataFrame:
    """Row shapes whose category deserves a second look.

    The shape is (category, letters of the id, unit type or blank): commercial
    shapes always, blank residential ones where the document types its units.
    """
    typed = S.type_text("unit_type") if text is None else text
    rows = units.select(
        "doc_id", pos, "unit_number", F.coalesce("category", F.lit("residential")).alias("prior"),
        typed.alias("type_text"), S.is_blankish(typed).alias("blank"))
    rows = rows.withColumn("shape_key", shape_key("prior", "unit_number", "type_text", "blank"))
    shapes = rows.groupBy("doc_id", "shape_key", "prior", "blank").agg(
        F.count(F.lit(1)).alias("n_rows"))
    totals = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if(~F.col("blank")).alias("n_typed"))
    contrast = (F.col("n_typed") >= 3) & (F.col("n_typed") * 4 >= F.col("n_units"))
    return shapes.join(totals, "doc_id").filter(
        (F.col("prior") == "commercial") | (
            (F.col("prior") == "residential") & F.col("blank") & contrast
            & (F.col("n_typed") >= F.col("n_rows")))
    ).select("doc_id", "shape_key", "prior", "n_rows", "n_typed", "n_units")


def shape_key(prior, unit_number, type_text, blank) -> Column:
    return F.concat_ws("|", F.col(prior), S.label_prefix(unit_number),
                       F.when(F.col(blank), "(blank)").otherwise(F.col(type_text)))


def shape_samples(units: DataFrame, pos: str = "unit_row_id", most: int = 6) -> DataFrame:
    """The first few unit ids of each shape, one row each."""
    typed = S.type_text("unit_type")
    rows = units.select(
        "doc_id", pos, "unit_number", F.coalesce("category", F.lit("residential")).alias("prior"),
        typed.alias("type_text"), S.is_blankish(typed).alias("blank"))
    w = Window.partitionBy("doc_id", "shape_key").orderBy(pos)
    return (
        rows.withColumn("shape_key", shape_key("prior", "unit_number", "type_text", "blank"))
        .withColumn("sample_no", F.row_number().over(w).cast("bigint"))
        .filter(F.col("sample_no") <= most)
        .select("doc_id", "shape_key", "sample_no", "unit_number"))


def dwelling_vocabulary(units: DataFrame, pos: str = "unit_row_id", most: int = 12) -> DataFrame:
    """First distinct unit types of a document, in order of appearance."""
    typed = S.type_text("unit_type")
    first = units.filter(~S.is_blankish(typed)).groupBy("doc_id", typed.alias("type_text")).agg(
        F.min(pos).alias("first_row"))
    w = Window.partitionBy("doc_id").orderBy("first_row")
    return first.withColumn("word_no", F.row_number().over(w).cast("bigint")).filter(
        F.col("word_no") <= most).select("doc_id", "word_no", "type_text")


def coherent(category, evidence) -> Column:
    """Does the evidence support the category it is given for?"""
    e = F.col(evidence)
    out = F.when(e.isin(*V.UNGROUNDED_EVIDENCE), True)
    for name, kinds in V.EVIDENCE_SUPPORT.items():
        out = out.when((F.col(category) == name) & e.isin(*kinds), True)
    return out.otherwise(False)


def gate_category_proposal(prior, proposed, evidence) -> Column:
    p, t = F.col(prior), F.col(proposed)
    return (F.when(p == t, "noop").when(F.col(evidence).isin(*V.UNGROUNDED_EVIDENCE), "decline")
            .when(coherent(proposed, evidence), "accept").otherwise("decline"))


def apply_category_proposals(units: DataFrame, proposals: DataFrame,
                             pos: str = "unit_row_id") -> DataFrame:
    """Units with accepted categories; only ancillary lines leave the unit count."""
    valid = proposals.filter(F.col("category").isin(*V.UNIT_CATEGORIES)).groupBy(
        "doc_id", "shape_key").agg(F.max(F.struct("category", "evidence")).alias("p")).select(
        "doc_id", "shape_key", F.col("p.category").alias("proposed"), "p.evidence")
    accepted = category_candidates(units, pos).join(valid, ["doc_id", "shape_key"]).filter(
        gate_category_proposal("prior", "proposed", "evidence") == "accept"
    ).select("doc_id", "shape_key", "proposed")
    typed = S.type_text("unit_type")
    keyed = units.withColumns({
        "_prior": F.coalesce("category", F.lit("residential")), "_type": typed,
        "_blank": S.is_blankish(typed),
    }).withColumn("shape_key", shape_key("_prior", "unit_number", "_type", "_blank"))
    return keyed.join(accepted, ["doc_id", "shape_key"], "left").withColumns({
        "include_in_unit_count": F.when(
            F.col("proposed").isNotNull(), F.col("proposed") != "non_unit_income"
        ).otherwise(F.col("include_in_unit_count")),
        "category": F.coalesce("proposed", "category"),
    }).drop("_prior", "_type", "_blank", "shape_key", "proposed")
