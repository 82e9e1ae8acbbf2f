"""Scoring extracted units against ground truth, cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitwise.functions import fixed_values as V
from unitwise.functions import scalars as S
from unitwise.functions.scan import numbered
from unitwise.session import stage


def occurrence_number(df: DataFrame, keys: list[str], pos: str, out: str = "k") -> DataFrame:
    """Which copy of its key a row is, in document order."""
    return numbered(df, keys, pos, out, levels=3)


def pair_units(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Matched, missed and invented units together: doc_id, gt_pos, ex_pos, g, a.

    Both sides have doc_id, pos and unit_number; ``g`` and ``a`` hold a side's columns, NULL where it has no
    partner, as does its position. The k-th copy of a normalized id in the truth meets the k-th in the
    extraction; a row without an id meets nothing. Both sides are read once and staged together; only ids
    with copies are numbered, and one aggregation brings the sides together.
    """
    def side(df, name, other):
        own = F.struct(*[F.col(c) for c in df.columns])
        none = F.lit(None).cast(other.select(F.struct(*other.columns)).schema[0].dataType)
        g, a = (own, none) if name == "g" else (none, own)
        unit = S.norm_unit("unit_number")
        return df.select("doc_id", "pos", F.lit(name).alias("side"), F.when(unit != "", unit).otherwise(
            F.concat_ws("\0", F.lit(""), F.lit(name), "pos")).alias("id"), g.alias("g"), a.alias("a"))

    rows = stage(side(truth, "g", found).unionByName(side(found, "a", truth)))
    copied = rows.groupBy("doc_id", "id").agg(
        F.count_if(F.col("side") == "g").alias("n_g"), F.count_if(F.col("side") == "a").alias("n_a")).filter(
        "n_g > 1 OR n_a > 1").select("doc_id", "id")
    single = rows.join(copied, ["doc_id", "id"], "left_anti").withColumn("k", F.lit(1).cast("long"))
    several = numbered(rows.join(copied, ["doc_id", "id"], "left_semi"), ["doc_id", "id", "side"], "pos", "k")
    place = lambda name: F.max(F.when(F.col("side") == name, F.col("pos")))
    return single.unionByName(several).groupBy("doc_id", "id", "k").agg(
        place("g").alias("gt_pos"), place("a").alias("ex_pos"), F.first("g", ignorenulls=True).alias("g"),
        F.first("a", ignorenulls=True).alias("a")).drop("id", "k")


def align_exact(truth: DataFrame, found: DataFrame) -> DataFrame:
    """k-th copy of a normalized id in the truth to the k-th in the extraction.

    Both sides have doc_id, pos and unit_number; the result pairs positions.
    """
    side = lambda df, name: occurrence_number(
        df.select("doc_id", F.col("pos").alias(name), S.norm_unit("unit_number").alias("id"))
        .filter(F.col("id") != ""), ["doc_id", "id"], name)
    return side(truth, "gt_pos").join(side(found, "ex_pos"), ["doc_id", "id", "k"]).select(
        "doc_id", "gt_pos", "ex_pos")


def _affix_links(gt: DataFrame, ex: DataFrame) -> DataFrame:
    """(doc_id, g, e) distinct ids of which one ends with the other, both two characters or longer.

    They meet through the shorter one, as a suffix of the longer. Ids that cannot match are left out: an
    extracted id on several rows is never the only candidate, so neither is any other of its truth ids; and
    a truth id with two candidates nothing else can take keeps both.
    """
    ids = lambda df: df.filter(F.length("id") >= 2).groupBy("doc_id", "id").agg(
        F.count(F.lit(1)).alias("copies"))
    g, e = ids(gt), ids(ex)
    suffixes = lambda df, name, least: df.select("*", F.explode(F.transform(
        F.filter(F.sequence(F.lit(2), F.length("id")), lambda n: n <= F.length("id") - least),
        lambda n: F.right("id", n))).alias("suffix")).withColumnRenamed("id", name)
    longer_g = suffixes(g.drop("copies"), "g", 0).join(
        e.withColumnRenamed("id", "suffix"), ["doc_id", "suffix"]).select(
        "doc_id", "g", F.col("suffix").alias("e"), "copies")
    longer_e = suffixes(e, "e", 1).join(
        g.select("doc_id", F.col("id").alias("suffix")), ["doc_id", "suffix"]).select(
        "doc_id", F.col("suffix").alias("g"), "e", "copies")
    links = stage(longer_g.unionByName(longer_e))
    takers = links.groupBy("doc_id", "e").agg(F.count(F.lit(1)).alias("takers"))
    able = links.join(takers, ["doc_id", "e"]).groupBy("doc_id", "g").agg(
        F.max("copies").alias("copies"), F.count_if(F.col("takers") == 1).alias("own"),
        F.count(F.lit(1)).alias("n")).filter("copies = 1 AND own <= 1").select("doc_id", "g", "n")
    return links.drop("copies").join(able, ["doc_id", "g"])


def align_affix(truth: DataFrame, found: DataFrame, exact: DataFrame) -> DataFrame:
    """Leftover ids that end with one another, when exactly one is free.

    Truth rows take in document order: a row takes an id if that is its only free candidate. So a truth id
    can take from its first row after all its candidates but one are gone, and an extracted id goes to the
    least row that can take it. Rounds apply these two rules to all ids at once, each with the times (row
    positions) of the round before, until no time changes. A taking depends on earlier ones only, so round k
    has every taking right that depends on fewer than k others, and times that stay are the sequential
    result. Rounds are joins and aggregations; there are as many as the longest chain of takings.
    """
    left = lambda df, name: df.select(
        "doc_id", "pos", S.norm_unit("unit_number").alias("id")).filter(
        F.col("id") != "").join(exact.select("doc_id", F.col(name).alias("pos")),
                                ["doc_id", "pos"], "left_anti")
    gt, ex = stage(left(truth, "gt_pos")), stage(left(found, "ex_pos"))
    links = stage(_affix_links(gt, ex))
    rows = stage(gt.withColumnRenamed("id", "g").join(
        links.select("doc_id", "g").distinct(), ["doc_id", "g"], "left_semi"))
    last = Window.partitionBy("doc_id", "g").orderBy(F.desc_nulls_first("at"), "e")
    taken, n_taken = None, 0
    while True:
        # A candidate that is not gone has no time and comes first; the second one says when the first is alone.
        timed = links.withColumn("at", F.lit(None).cast("long")) if taken is None else links.join(
            taken, ["doc_id", "e"], "left")
        alone = timed.withColumn("nth", F.row_number().over(last)).filter("nth <= 2").groupBy("doc_id", "g").agg(
            F.max("n").alias("n"), F.max(F.when(F.col("nth") == 1, F.col("e"))).alias("e"),
            F.max(F.when(F.col("nth") == 1, F.col("at"))).alias("gone"),
            F.max(F.when(F.col("nth") == 2, F.col("at"))).alias("since")).filter("n = 1 OR since IS NOT NULL")
        takes = rows.join(alone, ["doc_id", "g"]).filter(
            (F.col("since").isNull() | (F.col("pos") > F.col("since")))
            & (F.col("gone").isNull() | (F.col("pos") <= F.col("gone"))))
        new = stage(takes.groupBy("doc_id", "e").agg(F.min("pos").alias("at")))
        n_new = new.count()
        if n_new == n_taken and (taken is None or new.join(taken, ["doc_id", "e", "at"], "left_semi").count() == n_new):
            break
        taken, n_taken = new, n_new
    place = ex.groupBy("doc_id", F.col("id").alias("e")).agg(F.min("pos").alias("ex_pos"))
    return new.join(place, ["doc_id", "e"]).select("doc_id", F.col("at").alias("gt_pos"), "ex_pos")


def align(truth: DataFrame, found: DataFrame) -> DataFrame:
    exact = stage(align_exact(truth, found))
    return exact.unionByName(align_affix(truth, found, exact))


def missed_units(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    return truth.join(pairs.select("doc_id", F.col("gt_pos").alias("pos")), ["doc_id", "pos"],
                      "left_anti")


def hallucinated_units(found: DataFrame, pairs: DataFrame) -> DataFrame:
    return found.join(pairs.select("doc_id", F.col("ex_pos").alias("pos")), ["doc_id", "pos"],
                      "left_anti")


def _alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "")


def regulation_captured(expected, source_columns) -> Column:
    """Is the printed regulation label among the captured columns of the unit?"""
    values = F.transform(S.col(source_columns), lambda c: _alnum(c["value"]))
    hit = lambda want: F.exists(values, lambda v: (v != "") & (
        (v == want) | ((F.length(want) >= 2) & (v.contains(want) | want.contains(v)))))
    return S.let(_alnum(S.col(expected)), lambda want: (want == "") | F.coalesce(hit(want), F.lit(False)))


_POOL = "array<struct<code:string,amount:decimal(18,4),category:string>>"


def _match_lines(expected: Column, actual: Column, grade_category: bool) -> Column:
    """Use-once match of expected lines, in order, against the actual ones.

    The fold carries the unused lines of one unit and whether all matched.
    """
    tidy = lambda lines: F.transform(lines, lambda c: F.struct(
        _alnum(c["code"]).alias("code"), c["amount"].cast("decimal(18,4)").alias("amount"),
        c["category"].cast("string").alias("category")))
    none = F.array().cast(_POOL)
    start = F.struct(F.coalesce(tidy(actual), none).cast(_POOL).alias("pool"),
                     F.lit(True).alias("ok"))

    def step(state, want):
        fits = lambda p: (F.abs(p["amount"] - want["amount"]) <= F.expr("0.02")) & (
            (p["code"] == want["code"]) | ((F.length(want["code"]) >= 3) & (
                p["code"].contains(want["code"]) | want["code"].contains(p["code"]))))

        def taken(at):
            good = at > 0
            if grade_category:
                good = good & F.coalesce(
                    F.get(state["pool"], at - 1)["category"] == want["category"], F.lit(False))
            rest = F.filter(state["pool"], lambda _, i: i != at - 1)
            return F.struct(F.when(at > 0, rest).otherwise(state["pool"]).cast(_POOL).alias("pool"),
                            (state["ok"] & good).alias("ok"))

        # Bound once: the filter would look for the place again for every line of the pool.
        return S.let(F.array_position(F.transform(state["pool"], lambda p: F.coalesce(
            fits(p), F.lit(False))), F.lit(True)).cast("int"), taken)

    return F.aggregate(tidy(expected), start, step)["ok"]


def charges_captured(expected, actual) -> Column:
    """Every expected line has its own captured line; extra lines do not matter."""
    e = S.col(expected)
    return F.when(e.isNull() | (F.size(e) == 0), True).otherwise(
        _match_lines(e, S.col(actual), False))


def charge_categories_match(expected, actual) -> Column:
    """Categories of the rent-deciding expected lines; NULL when there are none."""
    graded = F.filter(S.col(expected), lambda c: c["category"].isin(*V.RENT_DECIDING))
    return F.when(F.size(graded) > 0, _match_lines(graded, S.col(actual), True))


_FIELD_COLUMN = {
    "status": "status", "monthlyRent": "monthly_rent", "tenantName": "tenant_name",
    "unitSqft": "unit_sqft", "unitType": "unit_type", "leaseStartDate": "lease_start_date",
    "leaseEndDate": "lease_end_date", "moveInDate": "move_in_date",
    "moveOutDate": "move_out_date", "category": "category",
}


def _grade(field: str, has: set[str]) -> Column:
    c = _FIELD_COLUMN.get(field)
    g, a = f"g_{c}", f"a_{c}"
    if field == "status":
        return S.status_match(g, a)
    if field == "monthlyRent":
        return S.numbers_match(g, a, "g_acceptable_rents" if "g_acceptable_rents" in has else None)
    if field == "unitSqft":
        return S.numbers_match(F.col(g).cast("decimal(18,4)"), F.col(a).cast("decimal(18,4)"))
    if field == "tenantName":
        return S.names_match(g, a)
    if field == "unitType":
        return S.types_match(g, a)
    if field == "category":
        return S.category_match(g, a)
    if field == "regulation":
        return regulation_captured("g_regulation", "a_source_columns")
    if field == "charges":
        return charges_captured("g_charges", "a_charges")
    if field == "chargeCategories":
        return charge_categories_match("g_charges", "a_charges")
    return S.dates_match(g, a)


def _sides(truth: DataFrame, found: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """doc_id, gt_pos, ex_pos and the columns of both sides as ``g_*`` and ``a_*``."""
    names = lambda df: [c for c in df.columns if c not in ("doc_id", "pos")]
    if pairs is None:
        return pair_units(truth, found).select(
            "doc_id", "gt_pos", "ex_pos", *[F.col("g")[c].alias(f"g_{c}") for c in names(truth)],
            *[F.col("a")[c].alias(f"a_{c}") for c in names(found)])
    side = lambda df, pos, p: df.select(
        "doc_id", F.col("pos").alias(pos), *[F.col(c).alias(f"{p}_{c}") for c in names(df)])
    return side(truth, "gt_pos", "g").join(pairs, ["doc_id", "gt_pos"], "left").join(
        side(found, "ex_pos", "a"), ["doc_id", "ex_pos"], "full")


def score_cells(truth: DataFrame, found: DataFrame, pairs: DataFrame | None = None,
                fields: DataFrame | None = None,
                gradable: tuple[str, ...] = V.FIELD_ORDER) -> DataFrame:
    """One row per graded cell: doc_id, pos, field, correct.

    Units pair by ``pairs``, or without it by :func:`pair_units`. ``fields`` (doc_id, document_fields) says
    what a document shows; without it all of ``gradable`` count. A missed unit has every field wrong, an
    extracted unit without a partner is one wrong cell. ``acceptable_rents`` of the truth, if it has that
    column, are rents that also count as right.
    """
    t = _sides(truth, found, pairs)
    shown = lambda f: F.lit(True)
    if fields is not None:
        t = t.join(fields, "doc_id", "left")
        base = lambda f: "charges" if f == "chargeCategories" else f
        shown = lambda f: F.coalesce(
            F.array_contains("document_fields", f) | F.array_contains("document_fields", base(f)),
            F.lit(False))
    matched = F.col("ex_pos").isNotNull()
    has = set(t.columns)
    cell = lambda name, ok: F.struct(F.lit(name).alias("field"), ok.alias("correct"))
    # A column of its own for every grade: a rule used twice in one expression would run twice.
    t = t.select("doc_id", "gt_pos", "ex_pos", *[F.when(shown(f), F.when(matched, _grade(f, has)).otherwise(
        False)).alias(f"_{f}") for f in gradable])
    cells = [cell("presence", matched)]
    cells += [F.when(F.col(f"_{f}").isNotNull(), cell(f, F.col(f"_{f}"))) for f in gradable]
    graded = F.when(F.col("gt_pos").isNotNull(), F.array_compact(F.array(*cells))).otherwise(
        F.array(cell("hallucinated", F.lit(False))))
    return t.select("doc_id", F.coalesce("gt_pos", "ex_pos").alias("pos"), F.explode(graded).alias("c")).select(
        "doc_id", "pos", "c.*")


def score_rollup(cells: DataFrame) -> DataFrame:
    """Correct and total cells per document, per field and overall, in one pass."""
    return cells.rollup("doc_id", "field").agg(
        F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"))


def field_breakdown(cells: DataFrame) -> DataFrame:
    return cells.groupBy("field").agg(
        F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"))


def file_scores(cells: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Accuracy per document; a document without a cell scores one."""
    s = cells.groupBy("doc_id").agg(
        F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"))
    if files is not None:
        s = files.select("doc_id").distinct().join(s, "doc_id", "left").fillna(
            0, ["correct", "total"])
    return s.withColumn("accuracy", F.when(F.col("total") == 0, F.lit(1.0)).otherwise(
        F.col("correct") / F.col("total")))


def score_report(files: DataFrame) -> DataFrame:
    """Macro and micro accuracy and the number of documents at 95 percent."""
    return files.agg(
        F.round(F.avg("accuracy"), 6).alias("macro"),
        F.round(F.sum("correct") / F.sum("total"), 6).alias("micro"),
        F.count_if(F.col("correct") * 20 >= F.col("total") * 19).alias("files_at_95"),
        F.count(F.lit(1)).alias("files"))


def worst_fields(cells: DataFrame, most: int = 3) -> DataFrame:
    """The least accurate imperfect fields of each document (of at most fifteen)."""
    per = cells.groupBy("doc_id", "field").agg(
        F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("doc_id").orderBy(F.col("correct") / F.col("total"), "field")
    return per.filter(F.col("correct") < F.col("total")).withColumn(
        "rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= most)


def eval_subset(truth_files: DataFrame, documents: DataFrame, prefixes: list[str],
                name: str = "corpus_id") -> DataFrame:
    """Documents with truth and a file whose id starts with a listed prefix."""
    hit = F.lit(not prefixes)
    for p in prefixes:
        hit = hit | F.col(name).startswith(p)
    return truth_files.filter(hit).join(documents.select(name), name, "left_semi")


def count_scorecard(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Older harness: extracted against expected and stated counts."""
    t = results.join(expected, "doc_id", "left")
    return t.withColumns({
        "matches_expected": F.when(F.col("expected_count").isNotNull(),
                                   F.col("expected_count") == F.col("n_units")),
        "matches_stated": F.when(F.col("stated_units").isNotNull(),
                                 F.col("stated_units") == F.col("n_units"))})
