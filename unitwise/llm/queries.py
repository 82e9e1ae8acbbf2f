"""Queries of the operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unitwise.llm import (
    chat,
    cost_packing,
    divergence,
    exact_dedup,
    language,
    lexical,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    quality,
    quality_rules,
    secret_scan,
)

QUERIES = {}
ORACLE = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return keep


@query("op1_ngram_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(_table(spark, sf_dir, "documents"))


@query("op4_chat_formatting", """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn,
         min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
b AS (
  SELECT pair_id, turn, any_value(said) FILTER (side = 0) AS chosen, any_value(said) FILTER (side = 1) AS rejected
  FROM t GROUP BY ALL),
m AS (SELECT *, min(turn) FILTER (chosen IS DISTINCT FROM rejected) OVER (PARTITION BY pair_id) AS apart FROM b),
r AS (
  SELECT pair_id, 'prompt' AS segment, turn, chosen AS said FROM m WHERE apart IS NULL OR turn < apart
  UNION ALL SELECT pair_id, 'chosen', turn, chosen FROM m WHERE turn >= apart AND chosen IS NOT NULL
  UNION ALL SELECT pair_id, 'rejected', turn, rejected FROM m WHERE turn >= apart AND rejected IS NOT NULL)
SELECT pair_id, segment, turn, said.role AS role,
       '<|' || said.role || '|>' || chr(10) || said.text || chr(10) AS rendered,
       segment <> 'prompt' AND said.role = 'assistant' AS loss
FROM r""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return chat.preference_rows(turns, chat.neighbours(turns))


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing(_table(spark, sf_dir, "documents"), mixing.domains_of(_table(spark, sf_dir, "labels")))


@query("op6_line_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


# Fixed values, written out apart from the operator: kind, pattern, group of the value, least length of the value.
_SECRET_KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
               r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24), ("live", r"[A-Za-z0-9+/_=-]{20,}", 0, 20))


def _secret_sql() -> str:
    """Positions from the pieces between matches; equal texts of an owner count as one, in their first document."""
    kinds = "\nUNION ALL\n".join(f"""
  SELECT doc_id, source, digest, {rank} AS rank, '{kind}' AS kind,
         unnest(list_transform(range(1, len(m) + 1), lambda i: {{
           's': list_sum(list_transform(g[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
           'n': length(m[i]), 'v': v[i]}})) AS p
  FROM (SELECT doc_id, source, digest, regexp_extract_all(t, pat, 0) AS m, regexp_extract_all(t, pat, {group}) AS v,
               string_split_regex(t, pat) AS g
        FROM (SELECT doc_id, source, sha256(coalesce(text, '')) AS digest, coalesce(text, '') AS t, '{pattern.replace("'", "''")}' AS pat FROM documents))
  WHERE len(m) > 0""" for rank, (kind, pattern, group, _) in enumerate(_SECRET_KINDS))
    least = " OR ".join(f"(kind = '{k}' AND length(p.v) >= {n})" for k, _, _, n in _SECRET_KINDS[:3])
    return f"""
WITH found AS ({kinds}),
spans AS (
  SELECT doc_id, coalesce(source, '') AS source, digest, rank, kind, CAST(p.s AS BIGINT) AS s,
         CAST(p.s + p.n AS BIGINT) AS e, p.v AS v
  FROM found
  WHERE {least} OR (kind = 'live' AND regexp_matches(p.v, '[0-9]') AND regexp_matches(p.v, '[a-z]')
                    AND regexp_matches(p.v, '[A-Z]'))),
held AS (SELECT v, source, digest, min(coalesce(CAST(doc_id AS VARCHAR), '')) AS repository FROM spans GROUP BY ALL),
seen AS (SELECT v, count(DISTINCT source) <= 2 AND count(*) <= 25 AS live
         FROM (SELECT DISTINCT v, source, repository FROM held) GROUP BY v),
judged AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'live') AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'live' OR live) AS spans,
         count(*) FILTER (kind = 'live' AND live) AS n_live,
         count(*) FILTER (kind <> 'live' AND live) AS n_owned,
         count(*) FILTER (kind <> 'live' AND NOT live) AS n_copied
  FROM spans JOIN seen USING (v) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied
FROM documents LEFT JOIN judged USING (doc_id)"""


@query("op7_secret_scan", _secret_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"))


@query("op10_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS kept,
       h AS text_sha256
FROM d""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


@query("op11_cost_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.cost_balanced_packing(_table(spark, sf_dir, "documents"))


@query("op12_source_divergence", r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
held AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS n FROM held GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(sums.n, 0)::HUGEINT + coalesce(langs.v, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sums USING (lang, source) LEFT JOIN langs USING (lang)),
p AS (
  SELECT lang, source, term, coalesce(held.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(held.n, 0) + 1) // total AS p
  FROM g JOIN kept USING (lang) LEFT JOIN held USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (kept.n + 1) // (langs.n + langs.v) AS q FROM kept JOIN langs USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b USING (lang) LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  WHERE a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


@query("op13_lexical_search", r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
c AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS total FROM d),
b AS (
  SELECT item_id, unnest(regexp_extract_all(translate(
           coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
t AS (
  SELECT k, doc_id, n, term, count(*) AS tf
  FROM (SELECT k, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, docs),
scored AS (
  SELECT item_id, k, doc_id, CAST(sum(
           times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM t JOIN w USING (term) JOIN asked USING (term), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
