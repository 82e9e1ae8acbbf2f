"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Spans come from one regular expression per kind: the pieces between matches and
the matches themselves alternate, so running lengths give code point positions.
Besides the base kinds, long mixed tokens are candidates. Every candidate value is
hashed and counted over the corpus by distinct repositories and owners: values that
many owners hold are copied examples, values of few owners look live. A candidate
token whose value looks live is added as a span of kind ``live``; base spans stay.

Defined results: a null text counts as empty and gives no spans; a null owner or
repository counts as one value of its own. A value repeated in a text counts once
for its repository, and exact copies of a text under one owner count as one repository,
however many hold them. Repeated rows give repeated rows. Other columns are ignored, an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitwise.llm.common import prepare
from unitwise.session import stage

# The patterns of the three base kinds, in the order their spans are listed.
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
          r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"

MAX_OWNERS = 2
MAX_REPOSITORIES = 25

#: Runs of one class are met at their start only, so that a long run is not tried from every place in it.
_KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", "(?<![0-9a-f])" + HEX),
          ("live", "(?<![A-Za-z0-9+/_=-])" + TOKEN))
_SPAN = "array<struct<start:int,end:int,rank:int,kind:string,value:string>>"


def _walked(kind: str, rank: int) -> Column:
    """Runs of about the square root of the matches ``m_``, with the pieces between them ``g_``; null without a match.

    Each run has its length and its spans, counted from its own start: growing one array by every match of
    a text would take time in the square of the matches.
    """
    m, g = F.col(f"m_{kind}"), F.col(f"g_{kind}")
    size = F.ceil(F.sqrt(F.size(m))).cast("int")

    def run(nth):
        steps = F.zip_with(F.slice(g, nth * size + 1, size), F.slice(m, nth * size + 1, size),
                           lambda gap, x: F.struct(F.length(gap).alias("gap"), x.alias("x")))
        return F.aggregate(
            F.filter(steps, lambda s: s["x"].isNotNull()),
            F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + F.length(s["x"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + F.length(s["x"])).alias("end"),
                    F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                    (F.regexp_extract(s["x"], ASSIGN, 2) if kind == "assign" else s["x"]).alias("value")))).alias("out")))

    return F.when(m.isNotNull(), F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / size).cast("int")), run))


def _placed(kind: str) -> Column:
    """Spans of a kind from its runs ``w_``: every run moved by the length of those before it."""
    runs = F.col(f"w_{kind}")
    before = F.aggregate(
        runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, w: F.struct((acc["at"] + w["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
    moved = F.zip_with(runs, before["out"], lambda w, at: F.transform(w["out"], lambda s: F.struct(
        (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["rank"].alias("rank"),
        s["kind"].alias("kind"), s["value"].alias("value"))))
    return F.when(runs.isNotNull(), F.flatten(moved)).otherwise(F.array().cast(_SPAN))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row: base spans and candidate tokens, each token with letters of both cases and digits."""
    text = F.col("text")
    found = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)).alias("digest"), "text",
        *(F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(f"m_{kind}")
          for kind, pattern in _KINDS))
    split = found.select(
        "row_id", "doc_id", "owner", "repository", "digest", *(f"m_{kind}" for kind, _ in _KINDS),
        *(F.when(F.col(f"m_{kind}").isNotNull(), F.split(text, pattern, -1)).alias(f"g_{kind}")
          for kind, pattern in _KINDS))
    walked = split.select("row_id", "doc_id", "owner", "repository", "digest",
                          *(_walked(kind, rank).alias(f"w_{kind}") for rank, (kind, _) in enumerate(_KINDS)))
    placed = walked.select("row_id", "doc_id", "owner", "repository", "digest",
                           *(_placed(kind).alias(kind) for kind, _ in _KINDS))
    return placed.select(
        "row_id", "doc_id", "owner", "repository", "digest",
        F.concat(F.filter("assign", lambda s: F.length(s["value"]) >= ASSIGN_VALUE), "access", "hex").alias("base"),
        F.filter("live", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]")
                 & s["value"].rlike("[A-Z]")).alias("tokens"))


def _each(rows: DataFrame, *more: str) -> DataFrame:
    """(row_id, ..., span, value_hash) for every base span and token of rows that have any."""
    return rows.select("row_id", *more, F.explode(F.concat("base", "tokens")).alias("span")).withColumn(
        "value_hash", F.unhex(F.sha2(F.col("span.value"), 256)))


def ownership(rows: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repositories): reduced per value, owner and repository first.

    Equal texts of an owner count as one, in the first of the repositories that hold them.
    """
    return (
        _each(rows, "owner", "repository", "digest").groupBy("value_hash", "owner", "digest").agg(
            F.min("repository").alias("repository")).select("value_hash", "owner", "repository").distinct()
        .groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
        .groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories")))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id",
         max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per row of ``docs``.

    doc_id, n_assign, n_access, n_hex, base_sha256, spans (base and added), n_live (added
    tokens), n_owned and n_copied (base spans whose value few or many owners hold). A
    value looks live when at most ``max_owners`` owners and ``max_repositories``
    repositories hold it.
    """
    prepare(docs.sparkSession)
    rows = stage(candidates(docs, owner, repository))
    seen = ownership(rows)
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    judged = _each(rows).join(seen, "value_hash").groupBy("row_id").agg(
        F.collect_list(F.when(live & (F.col("span.kind") == "live"), F.col("span"))).alias("added"),
        F.count_if(live & (F.col("span.kind") != "live")).alias("n_owned"),
        F.count_if(~live & (F.col("span.kind") != "live")).alias("n_copied"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    added = F.coalesce(F.col("added"), F.slice(F.col("base"), 1, 0))
    return rows.join(judged, "row_id", "left").select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", added)).alias("spans"), F.size(added).cast("long").alias("n_live"),
        F.coalesce("n_owned", F.lit(0)).alias("n_owned"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))
