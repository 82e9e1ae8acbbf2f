"""Scalar rules as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unitwise.functions import fixed_values as V

MONEY = "decimal(18,2)"
LINE = "decimal(18,4)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind a computed value once; ``body`` may then use it many times.

    Plain reuse of a Column repeats its whole expression inside every branch
    of a CASE, which the optimizer does not share.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_sql(value: Column, body: str) -> Column:
    """Like :func:`let`, with the body as SQL over the variable ``v``.

    Long CASE ladders are handed over as one text instead of hundreds of calls.
    """
    bound = F.call_function("transform", F.array(value), F.expr(f"v -> {body}"))
    return F.get(bound, F.lit(0))


def last_map(entries: Column) -> Column:
    """Map of an array of (key, value) structs in which a repeated key keeps its last value."""
    keys = F.transform(entries, lambda e: e.getField("k"))
    later = lambda bound, e, i: F.exists(
        F.slice(bound, i + 2, F.size(bound)), lambda o: o.getField("k") == e.getField("k"))
    return F.when(F.size(F.array_distinct(keys)) == F.size(entries), F.map_from_entries(entries)).otherwise(
        let(entries, lambda bound: F.map_from_entries(F.filter(bound, lambda e, i: ~later(bound, e, i)))))


def greatest_map(entries: Column) -> Column:
    """Map of an array of (key, value) structs in which a repeated key keeps its greatest value.

    The entries are sorted once and each looks at the next one only.
    """
    return let(F.sort_array(entries), lambda bound: F.map_from_entries(F.filter(
        bound, lambda e, i: ~F.coalesce(F.get(bound, i + 1).getField("k") == e.getField("k"), F.lit(False)))))


def sql_text(value: str) -> str:
    """A raw SQL string literal; rules hold no single quotes of both kinds."""
    return f"r'{value}'"


def sql_list(values) -> str:
    return ", ".join(sql_text(v) for v in values)


def clean_text(text) -> Column:
    """Trim all white space; nothing left means NULL."""
    return F.nullif(F.btrim(col(text), F.lit(V.WHITE_SPACE)), F.lit(""))


def clean_placeholder(text) -> Column:
    """Dashes, slashes, dots and spaces alone carry no information."""
    trimmed = clean_text(text)
    return F.when(~trimmed.rlike(V.PLACEHOLDER_ONLY), trimmed)


def half_up(x: Column) -> Column:
    """Round half towards plus infinity (``round`` would go away from zero)."""
    return F.floor(x + F.lit(0.5).cast("decimal(2,1)"))


def cents(x: Column) -> Column:
    """Money rounded to cents, halves towards plus infinity."""
    scaled = x.cast("decimal(28,6)") * F.lit(100)
    return (half_up(scaled).cast("decimal(28,2)") / F.lit(100)).cast(MONEY)


def sql_lookup(pairs: dict[str, str]) -> str:
    entries = ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in pairs.items())
    return f"try_element_at(map({entries}), v)"


def lookup(pairs: dict[str, str], key: Column) -> Column:
    return let_sql(key, sql_lookup(pairs))


def norm_status(text) -> Column:
    """Status word of a status text; blank is vacant, unknown is occupied."""
    raw = col(text)

    by_word = " ".join(
        f"WHEN v RLIKE {sql_text(pattern)}"
        + (f" AND NOT v RLIKE {sql_text(unless)}" if unless else "") + f" THEN '{status}'"
        for status, pattern, unless in V.STATUS_KEYWORDS)
    body = f"coalesce({sql_lookup(V.STATUS_TEXTS)}, CASE {by_word} ELSE '{V.STATUS_DEFAULT}' END)"
    known = let_sql(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), body)
    return F.when(raw.isNull() | (raw == ""), V.STATUS_WHEN_BLANK).otherwise(known)


def norm_status_exact(text, table: dict[str, str] = V.STATUS_TEXTS_OLDER) -> Column:
    """Status of the two older profiles: known words only, else occupied."""
    raw = col(text)
    body = f"coalesce({sql_lookup(table)}, '{V.STATUS_DEFAULT}')"
    known = let_sql(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), body)
    return F.when(raw.isNull() | (raw == ""), V.STATUS_WHEN_BLANK).otherwise(known)


def status_or_from_tenant(status_text, tenant) -> tuple[Column, Column]:
    """(status, tenant): without a status text the tenant text decides."""
    has_status = clean_text(status_text).isNotNull()
    name = F.lower(F.coalesce(col(tenant), F.lit("")))
    placeholder = None
    for status, pattern in V.TENANT_PLACEHOLDERS:
        hit = name.rlike(pattern)
        placeholder = F.when(hit, status) if placeholder is None else placeholder.when(hit, status)
    placeholder = placeholder.otherwise(F.lit(None).cast("string"))
    status = (
        F.when(has_status, norm_status(status_text))
        .when(placeholder.isNotNull(), placeholder)
        .when(col(tenant).isNotNull() & (col(tenant) != ""), "occupied")
        .otherwise("vacant"))
    return status, F.when(has_status | placeholder.isNull(), col(tenant))


def parse_number(text) -> Column:
    """Number at the start of a money text; ``(x)`` is negative."""
    squeezed = F.translate(col(text), "$," + V.WHITE_SPACE, "")
    signed = F.when(squeezed.startswith("(") & squeezed.endswith(")"), F.concat(
        F.lit("-"), F.substr(squeezed, F.lit(2), F.length(squeezed) - 2))).otherwise(squeezed)
    # A failed cast throws and is caught for every text: only what starts like a number is cast.
    return F.when(squeezed.rlike(r"^\(?[+-]?\.?[0-9]"), F.regexp_extract(signed, V.NUMBER_PREFIX, 0).try_cast("double"))


def parse_number_older(text) -> Column:
    """Older profile: every parenthesis becomes a minus, inner spaces stay."""
    signed = F.trim(F.regexp_replace(F.regexp_replace(col(text), r"[$,]", ""), r"[()]", "-"))
    return F.regexp_extract(signed, V.NUMBER_PREFIX, 0).try_cast("double")


def serial_to_date(serial) -> Column:
    """Day of a spreadsheet serial; noon and later belong to the next day."""
    n = col(serial)
    low, high = V.SERIAL_RANGE
    return F.when(
        n.between(low, high),
        F.date_add(F.to_date(F.lit(V.SERIAL_EPOCH)), F.floor(n + 0.5).cast("int")))


def date_to_serial(day) -> Column:
    return F.datediff(col(day), F.to_date(F.lit(V.SERIAL_EPOCH)))


def is_date_format(num_fmt) -> Column:
    fmt = F.coalesce(col(num_fmt), F.lit(""))
    return fmt.rlike(V.DATE_FORMAT_LETTERS) & ~fmt.rlike(V.NOT_A_DATE_FORMAT)


def _date_rule() -> str:
    """Date of a trimmed text ``v``: month/day/year, an ISO-like text, or a date in words.

    Dates in words are read without commas, weekdays and the dashes between their parts;
    without a day they mean the first of the month.
    """
    part = lambda i: f"try_cast(regexp_extract(v, {sql_text(V.MONTH_DAY_YEAR)}, {i}) AS INT)"
    digits = f"regexp_extract(v, {sql_text(V.MONTH_DAY_YEAR)}, 3)"
    year = (f"CASE WHEN length({digits}) = 2 THEN {part(3)} + IF({part(3)} > 50, 1900, 2000)"
            f" ELSE {part(3)} END")
    # Months outside 1..12 run over into the neighbouring years.
    first = f"add_months(make_date({year}, 1, 1), {part(1)} - 1)"
    mdy = f"date_add({first}, least({part(2)}, day(last_day({first}))) - 1)"
    free = ", ".join(f"try_to_date(v, '{p}')" for p in (
        "yyyy-MM-dd", "yyyy/MM/dd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy"))
    plain = (r"regexp_replace(regexp_replace(v, r'(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*[., ]+', ''),"
             r" r'[-., ]+', ' ')")
    in_words = ", ".join(f"try_to_date({plain}, '{p}')" for p in (
        "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "d MMM yy", "MMM yyyy", "MMMM yyyy"))
    clock = ", ".join(f"CAST(try_to_timestamp(v, '{p}') AS DATE)" for p in ("M/d/yyyy H:mm", "M/d/yyyy h:mm a"))
    return (f"CASE WHEN v RLIKE {sql_text(V.MONTH_DAY_YEAR)} THEN IF({part(3)} > 0 OR"
            f" length({digits}) = 2, {mdy}, NULL)"
            f" ELSE coalesce({free}, CAST(try_to_timestamp(v) AS DATE), {in_words}, {clock}) END")


def parse_date(text, serial=None) -> Column:
    """Date of a cell: serial number, month/day/year, an ISO-like text, or a date in words."""
    from_text = let_sql(clean_text(text), _date_rule())
    if serial is None:
        return from_text
    return F.when(col(serial).isNotNull(), serial_to_date(serial)).otherwise(from_text)


def parse_date_range(text, part: str, serial=None) -> Column:
    """First or last date of a cell that holds both ends of a lease."""
    t = clean_text(text)
    pieces = F.filter(F.split(t, V.RANGE_SEPARATOR), lambda p: p != "")
    piece = F.get(pieces, F.lit(0)) if part == "start" else F.get(pieces, F.size(pieces) - 1)
    return (F.when(F.size(pieces) >= 2, parse_date(piece))
            .otherwise(parse_date(text, serial)))


def join_name_parts(first, second) -> Column:
    return F.nullif(F.concat_ws(" ", clean_text(first), clean_text(second)), F.lit(""))


def unit_category(unit_number, unit_type) -> Column:
    text = F.lower(F.concat_ws(" ", col(unit_number), F.coalesce(col(unit_type), F.lit(""))))
    return (
        F.when(text.rlike(V.ANCILLARY_WORDS), "non_unit_income")
        .when(text.rlike(V.COMMERCIAL_WORDS)
              | F.lower(col(unit_number)).rlike(V.COMMERCIAL_IDS), "commercial")
        .otherwise("residential"))


def is_counted(category) -> Column:
    """Ancillary income lines are the only rows outside the unit count."""
    return col(category) != "non_unit_income"


def is_blankish(text) -> Column:
    t = clean_text(text)
    return (t.isNull() | F.lower(t).rlike(V.NOT_APPLICABLE)
            | ~F.regexp_replace(t, r"[-–—_/.\s]", "").rlike(r"[0-9a-zA-Z]"))


def type_text(unit_type, source_columns=None) -> Column:
    """Unit type, else the first captured column whose header says what it is."""
    own = clean_text(unit_type)
    if source_columns is None:
        return own
    use = F.filter(col(source_columns), lambda c: F.lower(c["header"]).rlike(V.USE_COLUMN))
    return F.coalesce(own, F.trim(F.get(use, F.lit(0))["value"]))


def label_prefix(unit_number) -> Column:
    return F.upper(F.regexp_extract(col(unit_number), r"^[A-Za-z]+", 0))


def norm_unit(unit_number) -> Column:
    """Unit id for scoring: no UNIT/APT prefix, punctuation or leading zeros."""
    up = F.trim(F.upper(col(unit_number)))
    bare = F.regexp_replace(up, r"^(UNIT|APT|APARTMENT)\s*[#:.]?\s*", "")
    bare = F.regexp_replace(bare, r"[#\s.,_/\\-]+", "")
    return F.regexp_replace(bare, r"(?<![0-9])0+(?=[0-9])", "")


def norm_unit_plain(unit_number) -> Column:
    """Unit id for sheet and chunk comparison: upper case without punctuation."""
    return F.regexp_replace(F.upper(col(unit_number)), r"[#\s.,_/\\-]+", "")


def norm_tenant(name) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), r"[^a-z0-9]+", "")


def norm_name(name) -> Column:
    spaced = F.regexp_replace(F.lower(col(name)), r"[^a-z0-9 ]+", " ")
    tidy = F.trim(F.regexp_replace(spaced, r"\s+", " "))
    return let(tidy, lambda t: F.when((t != "") & ~t.isin(*V.PLACEHOLDER_NAMES), t))


def _similar(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, True).otherwise(
        (F.lit(1.0) - F.levenshtein(a, b) / longest) >= V.NAME_SIMILARITY)


def tokens(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.split(name, " ")))


def names_match(expected, actual) -> Column:
    def match(g: Column, a: Column) -> Column:
        return (
            F.when(g.isNull() & a.isNull(), True)
            .when(g.isNull() | a.isNull(), False)
            .when(g == a, True)
            .when(tokens(g) == tokens(a), True)
            .when(_similar(g, a), True)
            .otherwise(_similar(F.array_join(tokens(g), " "), F.array_join(tokens(a), " "))))

    return let(norm_name(expected), lambda g: let(norm_name(actual), lambda a: match(g, a)))


def number_close(expected: Column, actual: Column) -> Column:
    """Both missing, or within a dollar or half a percent of the expected."""
    limit = F.greatest(F.lit(1), F.abs(expected) * F.expr("0.005"))
    return (F.when(expected.isNull() & actual.isNull(), True)
            .when(expected.isNull() | actual.isNull(), False)
            .otherwise(F.abs(expected - actual) <= limit))


def numbers_match(expected, actual, acceptable=None) -> Column:
    e, a = col(expected), col(actual)
    hit = number_close(e, a)
    if acceptable is not None:
        hit = hit | F.coalesce(F.exists(col(acceptable), lambda c: number_close(c, a)), F.lit(False))
    zeroish = F.coalesce(e == 0, F.lit(True)) & F.coalesce(a == 0, F.lit(True))
    return hit | zeroish


def status_match(expected, actual) -> Column:
    e, a = col(expected), col(actual)
    return e.eqNullSafe(a) | (e.isin("applicant", "vacant") & a.isin("applicant", "vacant"))


def _number_text(text: Column) -> Column:
    return text.try_cast("double").cast("string")


def bed_bath(text) -> Column:
    """Beds/baths of a unit type text, or NULL."""
    t = F.regexp_replace(F.lower(col(text)), r"\s+", "")
    beds = F.regexp_extract(t, V.BED_BATH, 1)
    baths = F.regexp_extract(t, V.BED_BATH, 2)
    return F.when(t.rlike(V.BED_BATH), F.concat_ws(
        "/",
        F.when(beds == "studio", "0.0").otherwise(_number_text(beds)),
        F.when(baths.rlike(r"^-+$"), "?").otherwise(_number_text(baths))))


def types_match(expected, actual) -> Column:
    norm = lambda c: F.regexp_replace(
        F.lower(F.coalesce(col(c), F.lit(""))), r"[^a-z0-9]+", "")
    return let(norm(expected), lambda g: let(norm(actual), lambda a: (
        F.when((g == "") & (a == ""), True)
        .when((g == "") | (a == ""), False)
        .when(g.contains(a) | a.contains(g), True)
        .otherwise(F.coalesce(bed_bath(expected) == bed_bath(actual), F.lit(False))))))


def dates_match(expected, actual) -> Column:
    return col(expected).eqNullSafe(col(actual))


def category_match(expected, actual) -> Column:
    norm = lambda c: F.trim(F.lower(col(c)))
    return norm(expected).eqNullSafe(norm(actual))


def norm_rate_pct(rate) -> Column:
    """A rate of at most one is a fraction of a percent-formatted cell."""
    r = col(rate)
    return F.when((r > 0) & (r <= 1), r * 100).otherwise(r)


def unsentinel(value) -> Column:
    """Negative numbers stand for "absent"."""
    return F.when(col(value) >= 0, col(value))


def col_letter(index) -> Column:
    """0 is A, 26 is AA."""
    i = col(index).cast("int")
    letter = lambda n: F.char(n + 65)
    return F.when(i < 26, letter(i)).otherwise(
        F.concat(letter((i / 26).cast("int") - 1), letter(i % 26)))


def unit_digits(unit_number) -> Column:
    return F.nullif(F.regexp_replace(col(unit_number), r"[^0-9]", ""),
                    F.lit("")).try_cast("decimal(38,0)")


def unit_prefix(unit_number) -> Column:
    return F.when(col(unit_number).rlike(V.UNIT_NUMBER_SHAPE),
                  F.regexp_extract(col(unit_number), V.UNIT_NUMBER_SHAPE, 1))


def unit_serial(unit_number) -> Column:
    return F.regexp_extract(col(unit_number), V.UNIT_NUMBER_SHAPE, 2).try_cast("decimal(38,0)")


def format_money(amount) -> Column:
    """Dollars; four decimals below a cent, a dash for NULL."""
    a = col(amount).cast("double")
    return (F.when(a.isNull(), "—")
            .when((a > 0) & (a < 0.01), F.format_string("$%.4f", a))
            .otherwise(F.format_string("$%.2f", a)))


def vendor_tag(text) -> Column:
    """Which property management product printed a document."""
    t = F.lower(col(text))
    tag = None
    for name, words in V.VENDOR_MARKERS:
        hit = t.rlike("|".join(words))
        tag = F.when(hit, name) if tag is None else tag.when(hit, name)
    return tag.otherwise("unknown")


def contains_any(text: Column, patterns: Column) -> Column:
    """True when any non-empty pattern of the array occurs in the text."""
    return F.coalesce(
        F.exists(patterns, lambda p: (p != "") & F.contains(text, F.lower(p))), F.lit(False))
