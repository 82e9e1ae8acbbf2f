"""Language identification by interpolated Kneser-Ney character models.

One model per language over characters folded to lower case, learned from a bounded
sample of labelled rows (``DOCS_PER_LANGUAGE`` rows of each language, whole texts).
Spark counts the n-grams of the sample and derives continuation counts, discounts,
back-off weights and probabilities by grouping and joining; every gram of every language
stays. Languages are taken in groups of at most ``CELLS`` table cells (one language at
least). A group's models share one sorted array of gram hashes per order with a column of
log probabilities and of back-off weights for each language, so a text is scored for the
whole group in one look-up per character. Texts pass group after group and carry their
best language along; which languages share a group changes no result.

A text gets the language of lowest cross-entropy per character. ``rejected`` marks texts
whose best cross-entropy lies above the calibrated limit of that language: the
``REJECT_QUANTILE`` of sample rows kept out of the counts, plus an allowance for short
texts. The score is the posterior of the winner, softened for short texts.

Memory: a task holds one group's arrays and the texts of ``_BYTES_AT_ONCE`` at a time; the
driver one group's. After every ``GROUPS_AT_ONCE`` groups the texts are staged, so that no
executor holds more groups than that.

Defined results: a null text or one without a letter is ``und`` with score 0 and
rejected; so is every text when no language can be learned. Rows with a null language
are never learned from; equal rows are learned from once. Ties go to the language that
sorts first. Repeated rows give repeated rows. Other columns are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitwise.llm.common import fold, mix, prepare, slices
from unitwise.session import stage

ORDER = 4
DOCS_PER_LANGUAGE = 600
REJECT_QUANTILE = 0.999
#: The sample keeps the least hash of each of these buckets of a language, then the least hashes of all.
BUCKETS = 8192
#: Grams of the highest order times languages of a group, 4 bytes each.
CELLS = 16_000_000
GROUPS_AT_ONCE = 8
_BYTES_AT_ONCE = 1 << 20


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each behind ``ORDER - 1`` zeros, and where each text ends."""
    pad = "\0" * (ORDER - 1)
    joined = "".join(pad + " ".join(t.lower().split()) + " " for t in texts)
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = [len(pad) + len(" ".join(t.lower().split())) + 1 for t in texts]
    return flat, np.cumsum(sizes)


def gram_hashes(flat: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters ending at every place from ``ORDER - 1`` on; never 0."""
    n = len(flat) - ORDER + 1
    out = np.full(n, order, np.uint64)
    for back in range(order - 1, -1, -1):
        at = ORDER - 1 - back
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + flat[at:at + n] + np.uint64(1))
    return out | np.uint64(1)


def context_hashes(flat: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order - 1`` characters before every place from ``ORDER - 1`` on."""
    n = len(flat) - ORDER + 1
    out = np.full(n, order - 1, np.uint64)
    for back in range(order - 1, 0, -1):
        at = ORDER - 1 - back
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + flat[at:at + n] + np.uint64(1))
    return out | np.uint64(1)


def real_places(flat: np.ndarray) -> np.ndarray:
    """Which places from ``ORDER - 1`` on are characters of a text, not padding."""
    return flat[ORDER - 1:] != 0


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Highest-order grams of the sample as text, counted per language and batch."""
    for pdf in batches:
        for lang, rows in pdf.groupby("lang"):
            flat, _ = codes(rows["text"].tolist())
            if len(flat) < ORDER:
                continue
            places = np.flatnonzero(real_places(flat))
            grams = np.stack([flat[places + k] for k in range(ORDER)], axis=1).astype(np.uint32)
            kinds, counts = np.unique(grams, axis=0, return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": [x.tobytes() for x in kinds], "n": counts})


@dataclass
class Models:
    """Sorted hash arrays per order (1 to ``ORDER``) with a column per language."""

    languages: list[str]
    hashes: list[np.ndarray]
    logs: list[np.ndarray]
    context_hashes: list[np.ndarray]
    backoffs: list[np.ndarray]
    unseen: np.ndarray
    limits: np.ndarray | None = None

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per character, texts x languages, and characters per text."""
        flat, ends = codes(texts)
        n = len(flat) - ORDER + 1
        real = real_places(flat)
        total = np.zeros((n, len(self.languages)), np.float32)
        open_ = np.flatnonzero(real)
        for order in range(ORDER, 0, -1):
            wanted = gram_hashes(flat, order)[open_]
            at = np.minimum(np.searchsorted(self.hashes[order - 1], wanted), len(self.hashes[order - 1]) - 1)
            hit = self.hashes[order - 1][at] == wanted
            total[open_[hit]] += self.logs[order - 1][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
            if order > 1:
                before = context_hashes(flat, order)[open_]
                at = np.minimum(np.searchsorted(self.context_hashes[order - 1], before),
                                len(self.context_hashes[order - 1]) - 1)
                known = self.context_hashes[order - 1][at] == before
                total[open_[known]] += self.backoffs[order - 1][at[known]]
        total[open_] += self.unseen
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.add.reduceat(total, np.minimum(starts, n - 1), axis=0) if n else np.zeros((0, len(self.languages)))
        chars = ends - starts - (ORDER - 1)
        return -sums / chars[:, None], chars


def _weights(counted: DataFrame) -> DataFrame:
    """(lang, size, gram, w) of all orders: counts of the highest, distinct left neighbours below."""
    every = current = counted.select("lang", F.lit(ORDER).alias("size"), "gram", F.col("n").cast("double").alias("w"))
    for order in range(ORDER - 1, 0, -1):
        current = current.groupBy("lang", F.expr("substring(gram, 5)").alias("gram")).agg(
            F.count(F.lit(1)).cast("double").alias("w")).select("lang", F.lit(order).alias("size"), "gram", "w")
        every = every.unionByName(current)
    return every


def kneser_ney(counted: DataFrame) -> DataFrame:
    """All models from (lang, gram, n) rows, as (lang, size, gram, p, context, backoff).

    ``p`` is the interpolated probability of the gram's last character after the others;
    ``backoff`` the weight its context gives the next lower order. Each order of a language
    has one absolute discount, from its counts of counts.
    """
    every = stage(_weights(counted).withColumn("context", F.expr("substring(gram, 1, 4 * (size - 1))")))
    discount = every.groupBy("lang", "size").agg(
        F.count_if(F.col("w") == 1).alias("once"), F.count_if(F.col("w") == 2).alias("twice")).select(
        "lang", "size", F.when((F.col("once") > 0) & (F.col("twice") > 0), F.col("once") / (
            F.col("once") + 2 * F.col("twice"))).otherwise(0.5).alias("discount"))
    after = every.groupBy("lang", "size", "context").agg(F.sum("w").alias("mass"), F.count(F.lit(1)).alias("kinds"))
    after = after.join(discount, ["lang", "size"]).withColumn(
        "backoff", F.col("discount") * F.col("kinds") / F.col("mass"))
    own = stage(every.join(after, ["lang", "size", "context"]).select(
        "lang", "size", "gram", "context", "backoff",
        (F.greatest(F.col("w") - F.col("discount"), F.lit(0.0)) / F.col("mass")).alias("own")))
    letters = every.filter("size = 1").agg(F.count_distinct("gram")).first()[0]
    found = lower = own.filter("size = 1").withColumn("p", F.col("own") + F.col("backoff") / (letters + 1)).drop("own")
    for order in range(2, ORDER + 1):
        below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
        lower = own.filter(F.col("size") == order).withColumn("suffix", F.expr("substring(gram, 5)")).join(
            below, ["lang", "suffix"]).withColumn("p", F.col("own") + F.col("backoff") * F.col("q")).drop(
            "own", "suffix", "q")
        found = found.unionByName(lower)
    return found.withColumn("letters", F.lit(letters + 1))


def _hash_keys(keys: list[bytes], size: int) -> np.ndarray:
    out = np.full(len(keys), size, np.uint64)
    flat = np.frombuffer(b"".join(keys), np.uint32).reshape(len(keys), size).astype(np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + flat[:, k] + np.uint64(1))
    return out | np.uint64(1)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Grams, the grams one shorter that end them and their contexts, as hashes."""
    for pdf in batches:
        for size, rows in pdf.groupby("size"):
            grams = [bytes(x) for x in rows["gram"]]
            hashed = {"gram": _hash_keys(grams, size), "suffix": _hash_keys([x[4:] for x in grams], size - 1),
                      "context": _hash_keys([x[:-4] for x in grams], size - 1)}
            yield pd.DataFrame({"lang": rows["lang"], "size": size, "log_p": np.log(rows["p"]),
                                "log_b": np.log(rows["backoff"]), **{k: v.view(np.int64) for k, v in hashed.items()}})


def build_models(languages: list[str], rows: pa.Table, letters: int) -> Models:
    """Models of a group from its hashed rows; what a language lacks backs off to its lower order."""
    code = {x: k for k, x in enumerate(languages)}
    column = lambda name: rows.column(name).to_numpy()
    unsigned = lambda name: column(name).astype(np.int64).view(np.uint64)
    names = rows.column("lang").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    own = np.array([code[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    size, log_p, log_b = column("size"), column("log_p"), column("log_b")
    gram, suffix, context = (unsigned(x) for x in ("gram", "suffix", "context"))
    hashes, logs, before, backoffs = [], [], [], []
    below = unseen = None
    for order in range(1, ORDER + 1):
        at = np.flatnonzero(size == order)
        keys, first, where = np.unique(gram[at], return_index=True, return_inverse=True)
        contexts, place = np.unique(context[at], return_inverse=True)
        weight = np.zeros((len(contexts), len(languages)))
        weight[place, own[at]] = log_b[at]
        if order == 1:
            unseen = weight[0] - np.log(letters)
            table = np.tile(unseen, (len(keys), 1))
        else:
            table = weight[place[first]] + below[np.searchsorted(hashes[-1], suffix[at][first])]
        table[where, own[at]] = log_p[at]
        below = table
        for kept, value in ((hashes, keys), (logs, table.astype(np.float32)), (before, contexts),
                            (backoffs, weight.astype(np.float32))):
            kept.append(value)
    return Models(languages, hashes, logs, before, backoffs, unseen.astype(np.float32))


def sample_rows(rows: DataFrame) -> DataFrame:
    """At most ``DOCS_PER_LANGUAGE`` rows (lang, place, text) of each language, by hash; the texts move last."""
    usable = rows.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        "lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    least = usable.groupBy("lang", F.pmod("h", F.lit(BUCKETS)).alias("bucket")).agg(F.min("h").alias("h"))
    chosen = stage(least.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(
        F.col("place") <= DOCS_PER_LANGUAGE).select("lang", "h", "place"))
    return usable.join(chosen, ["lang", "h"]).groupBy("lang", "h", "place").agg(F.min("text").alias("text")).drop("h")


def language_groups(sizes: dict[str, int], cells: int) -> list[list[str]]:
    """Languages in order, cut so that a group's grams times its languages stay within ``cells``."""
    groups: list[list[str]] = []
    grams = 0
    for lang in sorted(sizes):
        grams += sizes[lang]
        if not groups or grams * (len(groups[-1]) + 1) > cells:
            groups.append([])
            grams = sizes[lang]
        groups[-1].append(lang)
    return groups


def learn(rows: DataFrame, cells: int | None = None) -> list[Broadcast[Models]]:
    """Models and rejection limits from labelled rows (doc_id, text, lang), by groups of languages."""
    spark = rows.sparkSession
    sample = stage(sample_rows(rows)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "place")
    # Every fifth row is kept out of the counts and sets the limits, unless a language has too few.
    counting = sample.filter((F.col("place") % 5 != 0) | (F.col("place") < 5))
    counted = counting.mapInPandas(_count_grams, "lang string, gram binary, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    model = stage(kneser_ney(counted))
    hashed = stage(model.mapInPandas(
        _hashed, "lang string, size int, gram long, suffix long, context long, log_p double, log_b double"))
    sizes = {r["lang"]: r["count"] for r in hashed.filter(F.col("size") == ORDER).groupBy("lang").count().collect()}
    groups = []
    for languages in language_groups(sizes, cells or CELLS):
        letters = model.select("letters").first()[0]
        models = build_models(languages, hashed.filter(F.col("lang").isin(languages)).toArrow(), letters)
        models.limits = _limits(sample.filter("place % 5 = 0").filter(F.col("lang").isin(languages)), models)
        groups.append(spark.sparkContext.broadcast(models))
    return groups


def _limits(held: DataFrame, models: Models) -> np.ndarray:
    """The highest cross-entropy a language accepts, from its rows outside the counts."""
    shared = held.sparkSession.sparkContext.broadcast(models)

    def entropies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for pdf in batches:
            if len(pdf):
                values, chars = own.entropy(pdf["text"].tolist())
                place = [own.languages.index(x) for x in pdf["lang"]]
                yield pd.DataFrame({"lang": pdf["lang"], "entropy": values[np.arange(len(pdf)), place],
                                    "chars": chars})

    found = held.mapInPandas(entropies, "lang string, entropy double, chars long").toPandas()
    shared.destroy()
    limits = np.full(len(models.languages), np.inf)
    for j, lang in enumerate(models.languages):
        own = found[found["lang"] == lang]
        if len(own) >= 10:
            limits[j] = np.quantile(own["entropy"] - _allowance(own["chars"].to_numpy()), REJECT_QUANTILE)
    return limits


def _allowance(chars: np.ndarray) -> np.ndarray:
    """How far the cross-entropy of a short text strays by chance."""
    return 3.0 / np.sqrt(np.maximum(chars, 1))


_STATE = "doc_id long, text string, held_out boolean, best string, low double, mass double, beyond boolean"


def _scorer(shared: Broadcast[Models]):
    """Carry each text's best language so far past one more group of languages."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        letter = regex.compile(r"\p{L}")
        own = shared.value
        for batch in slices(batches, "text", _BYTES_AT_ONCE):
            texts = batch.column("text").to_pylist()
            best, low, mass, beyond = (batch.column(x).to_pylist() for x in ("best", "low", "mass", "beyond"))
            usable = [i for i, t in enumerate(texts) if t and letter.search(t)]
            if usable:
                values, chars = own.entropy([texts[i] for i in usable])
                winner = values.argmin(axis=1)
                least = values[np.arange(len(winner)), winner]
                spread = np.minimum(chars, 50)
                parts = np.exp(-np.minimum((values - least[:, None]) * spread[:, None], 700)).sum(axis=1)
                over = least - _allowance(chars) > own.limits[winner]
                for k, i in enumerate(usable):
                    new, weight = float(least[k]), float(parts[k])
                    if best[i] is None:
                        best[i], low[i], mass[i], beyond[i] = own.languages[winner[k]], new, weight, bool(over[k])
                        continue
                    fall = float(np.exp(-min(abs(new - low[i]) * spread[k], 700)))
                    if new < low[i]:
                        mass[i] = mass[i] * fall + weight
                        best[i], low[i], beyond[i] = own.languages[winner[k]], new, bool(over[k])
                    else:
                        mass[i] += weight * fall
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), batch.column("held_out"), pa.array(best, pa.string()),
                 pa.array(low, pa.float64()), pa.array(mass, pa.float64()), pa.array(beyond, pa.bool_())],
                names=["doc_id", "text", "held_out", "best", "low", "mass", "beyond"])
    return score


def identify(docs: DataFrame, groups: list[Broadcast[Models]]) -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score, rejected, cross_entropy) per row of ``docs`` (doc_id, text, held_out)."""
    prepare(docs.sparkSession)
    rows = docs.selectExpr(
        "CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text", "held_out", "CAST(NULL AS STRING) AS best",
        "CAST(NULL AS DOUBLE) AS low", "CAST(NULL AS DOUBLE) AS mass", "CAST(NULL AS BOOLEAN) AS beyond")
    for k, shared in enumerate(groups):
        if k and k % GROUPS_AT_ONCE == 0:
            rows = stage(rows)
        rows = rows.mapInArrow(_scorer(shared), _STATE)
    return rows.selectExpr(
        "doc_id", "held_out", "coalesce(best, 'und') AS lang_pred", "coalesce(1 / mass, 0D) AS score",
        "coalesce(beyond, true) AS rejected", "low AS cross_entropy")


def language_id(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from the rows whose fold is not 0 and predict every row."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang", (fold("doc_id", folds) == 0).alias("held_out"))
    return identify(rows, learn(rows.filter("NOT held_out")))
