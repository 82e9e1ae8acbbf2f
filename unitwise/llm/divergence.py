"""How far the sources of a language differ in their terms, by chunk factorization.

Texts are split at white space only, and chunks are counted per document. Each globally distinct chunk is
broken into terms once, its terms are joined back to its counts, and counts and distinct documents are
summed per term. Terms are runs of letters and of characters above ASCII, A-Z lower-cased; a language keeps
those in at least three of its documents. Every (lang, source) group is then compared with every other one
of its language, and with the whole language.

The three steps share one table form, :data:`TALLY`: a key (chunk or term) of a language with its counts by
group, and its documents as the least and the greatest number and whether there is a third. That is exact
for the three documents asked for and stays one row however many documents there are. Tasks add up what
they read before it is exchanged: once by chunk, once by term.

All groups of a language meet in blocks of terms (:data:`CELLS` probabilities each). In a block, terms a
source does not have enter by their distinct probabilities, so the work follows the terms that occur.

Defined results: null text, lang and source count as empty. Each row is a document, so a repeated row counts
again. A group without terms has N = 0. Ties go by the UTF-8 bytes of the item. Other columns are ignored,
an empty table gives an empty result. Probabilities are exact at any count (decimals, or whole numbers of
any size in Python); a value is exact while it is below 2^63, which holds up to 10^9 kept terms a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitwise.llm.common import prepare, slices
from unitwise.session import stage

#: A key is kept with so many documents; a tally knows two of them and whether there are more.
MIN_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
CELLS = 1 << 21
_HELD = 1 << 20

TALLY = "lang string, key string, first long, last long, more boolean, groups array<long>, counts array<long>"
RESULT = "lang string, source string, part string, item string, value long, rank int"
_TERMS = bytes(k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or k > 127 else 32 for k in range(256))


class _Numbers(dict):
    """Numbers of keys, given when a key is first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of all members of the ranges (start, count), in order."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and the starts of their runs in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= np.diff(key[order]) != 0
    return order, np.flatnonzero(new)


class Tally:
    """Counts and documents of keys, added up in arrays; equal keys are merged now and then."""

    def __init__(self):
        self.langs, self.keys = _Numbers(), _Numbers()
        self.rows = [np.zeros(0, np.int64)] * 4   # key, first, last, more
        self.cells = [np.zeros(0, np.int64)] * 3  # key, group, count
        self.due: list[tuple[list[np.ndarray], list[np.ndarray]]] = []
        self.waiting = 0

    def add(self, lang: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray, more: np.ndarray,
            row: np.ndarray, group: np.ndarray, count: np.ndarray) -> None:
        """Rows of numbered languages and keys; ``row`` names the row a count belongs to."""
        own = (lang << 40) | key
        self.due.append(([own, first, last, more], [own[row], group, count]))
        self.waiting += len(row)
        if self.waiting >= _HELD:
            self.merge()

    def merge(self) -> None:
        key, first, last, more = map(np.concatenate, zip(self.rows, *(x[0] for x in self.due), strict=True))
        order, starts = _runs(key)
        if len(order):
            key, first, last, more = (x[order] for x in (key, first, last, more))
            low, high = np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts)
            sizes = np.diff(np.append(starts, len(key)))
            a, b = np.repeat(low, sizes), np.repeat(high, sizes)
            third = (more > 0) | ((first != a) & (first != b)) | ((last != a) & (last != b))
            self.rows = [key[starts], low, high, np.maximum.reduceat(third.astype(np.int64), starts)]
        key, group, count = map(np.concatenate, zip(self.cells, *(x[1] for x in self.due), strict=True))
        order, starts = _runs(key, group)
        if len(order):
            self.cells = [key[order][starts], group[order][starts], np.add.reduceat(count[order], starts)]
        self.due, self.waiting = [], 0

    def full(self) -> bool:
        return len(self.cells[0]) + self.waiting >= 2 * _HELD or len(self.keys) >= _HELD

    def flush(self, least: int | None = None) -> Iterator[pa.RecordBatch]:
        """All rows as ``TALLY``; with ``least`` only kept ones. Starts anew."""
        self.merge()
        key, first, last, more = self.rows
        sizes = np.bincount(np.searchsorted(key, self.cells[0]), minlength=len(key))
        langs, keys = pa.array(list(self.langs), pa.string()), pa.array(list(self.keys), pa.binary()).cast(pa.string())
        ends = np.append(0, np.cumsum(sizes))
        chosen = np.flatnonzero(more) if least else np.arange(len(key))
        for at in range(0, len(chosen), 20_000):
            own = chosen[at:at + 20_000]
            inside = _gather(ends[own], sizes[own])
            offsets = pa.array(np.append(0, np.cumsum(sizes[own])), pa.int32())
            known = more[own] == 0
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(key[own] >> 40)), keys.take(pa.array(key[own] & (1 << 40) - 1)),
                 pa.array(first[own] * known), pa.array(last[own] * known), pa.array(~known),
                 *(pa.ListArray.from_arrays(offsets, pa.array(self.cells[k][inside])) for k in (1, 2))],
                names=[x.split()[0] for x in TALLY.split(", ")])
        self.__init__()


def count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents (number, lang, group, text) added up per language and group: ``TALLY``."""
    tally = Tally()
    for batch in slices(batches, "text", 4 << 20):
        words = [t.encode("utf-8", "replace").split() for t in batch.column("text").to_pylist()]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter(map(tally.keys.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        held, count = np.unique(np.repeat(np.arange(len(words)), sizes) << 40 | ids, return_counts=True)
        row, key = held >> 40, held & (1 << 40) - 1
        lang = np.fromiter(map(tally.langs.__getitem__, batch.column("lang").to_pylist()), np.int64, len(words))
        number = batch.column("number").to_numpy()[row]
        tally.add(lang[row], key, number, number, np.zeros(len(row), np.int64), np.arange(len(row)),
                  batch.column("group").to_numpy()[row], count)
        if tally.full():
            yield from tally.flush()
    yield from tally.flush()


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first, last, more, sizes, groups and counts of a batch of ``TALLY``."""
    offsets = batch.column("groups").offsets.to_numpy()
    return (batch.column("first").to_numpy(), batch.column("last").to_numpy(),
            batch.column("more").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets),
            batch.column("groups").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())


def chunks_to_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk become rows of terms; a chunk is broken up once, at its first row."""
    tally = Tally()
    chunk, terms = None, Counter()
    for batch in batches:
        first, last, more, sizes, groups, counts = _columns(batch)
        coded = batch.column("key").dictionary_encode()
        each = []  # terms of the chunks of this batch; the first may go on from the batch before
        for own in coded.dictionary.to_pylist():
            if own != chunk:
                chunk, terms = own, Counter(own.encode().translate(_TERMS).split())
            each.append(terms)
        found = np.fromiter(map(len, each), np.int64, len(each))
        names = np.fromiter(map(tally.keys.__getitem__, chain.from_iterable(each)), np.int64, int(found.sum()))
        times = np.fromiter(chain.from_iterable(x.values() for x in each), np.int64, len(names))
        which = coded.indices.to_numpy()
        per_row = found[which]
        row = np.repeat(np.arange(batch.num_rows), per_row)
        at = _gather((np.cumsum(found) - found)[which], per_row)
        lang = np.fromiter(map(tally.langs.__getitem__, batch.column("lang").to_pylist()), np.int64, batch.num_rows)
        inside = _gather((np.cumsum(sizes) - sizes)[row], sizes[row])
        of = np.repeat(np.arange(len(row)), sizes[row])
        tally.add(lang[row], names[at], first[row], last[row], more[row], of, groups[inside], counts[inside] * times[at][of])
        if tally.full():
            yield from tally.flush()
    yield from tally.flush()


def merge_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, term) become one row for each term in three documents or more."""
    tally = Tally()
    for batch in batches:
        langs, keys = batch.column("lang").to_pylist(), batch.column("key").to_pylist()
        first, last, more, sizes, groups, counts = _columns(batch)
        ends = np.append(0, np.cumsum(sizes))
        # Only the last key may go on in the next batch.
        done = next((k + 1 for k in range(len(keys) - 1, -1, -1) if (langs[k], keys[k]) != (langs[-1], keys[-1])), 0)
        for a, b in ((0, done), (done, len(keys))):
            lang = np.fromiter(map(tally.langs.__getitem__, langs[a:b]), np.int64, b - a)
            key = np.fromiter((tally.keys[k.encode()] for k in keys[a:b]), np.int64, b - a)
            tally.add(lang, key, first[a:b], last[a:b], more[a:b], np.repeat(np.arange(b - a), sizes[a:b]),
                      groups[ends[a]:ends[b]], counts[ends[a]:ends[b]])
            if 0 < b == done:
                yield from tally.flush(MIN_DOCUMENTS)
    yield from tally.flush(MIN_DOCUMENTS)


def kept_terms(docs: DataFrame) -> DataFrame:
    """``TALLY`` of the terms each language keeps; ``docs``: lang, group, text, none of them null."""
    numbered = docs.select(F.monotonically_increasing_id().alias("number"), "lang", "group", "text")
    chunks = numbered.mapInArrow(count_chunks, TALLY)
    terms = chunks.repartition("key").sortWithinPartitions("key").mapInArrow(chunks_to_terms, TALLY)
    return terms.repartition("lang", "key").sortWithinPartitions("lang", "key").mapInArrow(merge_terms, TALLY)


def group_numbers(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, source, group) of every group, and the seed of its hash, chosen so that all differ."""
    named = stage(docs.select("lang", "source").distinct())
    seed = 0
    while True:
        groups = named.withColumn("group", F.xxhash64(F.lit(seed), "lang", "source"))
        total, different = groups.agg(F.count("*"), F.count_distinct("group")).first()
        if total == different:
            return groups, seed
        seed += 1


def _chance(count: str, total: str) -> F.Column:
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(20, 0))) div {total}")


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _compare(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over a block of terms for every ordered pair of a language's sources."""
    number, total = groups.column("group").to_numpy(), groups.column("total").to_numpy()
    none = np.array([1 + SCALE // t if t else 1 for t in total.tolist()], np.int64)
    p = np.tile(none, (terms.num_rows, 1))
    if terms.num_rows:
        held = terms.column("groups").combine_chunks()
        row = np.repeat(np.arange(terms.num_rows), np.diff(held.offsets.to_numpy()))
        order = np.argsort(number)
        place = order[np.searchsorted(number, held.flatten().to_numpy(), sorter=order)]
        count = terms.column("counts").combine_chunks().flatten().to_numpy()
        if count.max() >= 1 << 33:
            p[row, place] = [1 + SCALE * (int(c) + 1) // int(t) for c, t in zip(count, total[place], strict=True)]
        else:
            p[row, place] = 1 + SCALE * (count + 1) // total[place]
    values, times, owner = [], [], []
    for b in range(len(none)):
        own, n = np.unique(p[:, b], return_counts=True)
        values.append(own)
        times.append(n)
        owner.append(np.full(len(own), b))
    values, times, owner = map(np.concatenate, (values, times, owner))
    out = np.zeros((len(none), len(none)), np.int64)
    if len(p):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        for a in range(len(none)):
            mine = p[p[:, a] != none[a]]
            out[a] = (np.add.reduceat(_distance(none[a], values) * times, starts)
                      + (_distance(mine[:, [a]], mine) - _distance(none[a], mine)).sum(axis=0))
    a, b = np.nonzero(~np.eye(len(none), dtype=bool))
    return pa.table({"lang": groups.column("lang").take(pa.array(np.zeros(len(a), np.int64))),
                     "source": groups.column("source").take(pa.array(a)), "item": groups.column("source").take(pa.array(b)),
                     "value": pa.array(out[a, b])})


def source_divergence(docs: DataFrame) -> DataFrame:
    """``RESULT``: distances between sources (part pair), and terms a source has more often than its language (term)."""
    prepare(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    named, seed = group_numbers(docs)
    kept = stage(kept_terms(docs.withColumn("group", F.xxhash64(F.lit(seed), "lang", "source"))).select(
        "lang", "key", "groups", "counts", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")))
    cells = kept.select("lang", "key", "n", F.explode(F.arrays_zip("groups", "counts")).alias("x")).select(
        "lang", "key", "n", F.col("x.groups").alias("group"), F.col("x.counts").alias("count"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    sums = cells.groupBy("group").agg(F.sum("count").alias("own_n"))
    zero = F.lit(0).cast("long")
    groups = stage(named.join(sums, "group", "left").join(langs, "lang", "left").select(
        "lang", "source", "group", F.coalesce("v", zero).alias("v"),
        (F.coalesce("own_n", zero) + F.coalesce("v", zero)).alias("total"),
        (F.coalesce("lang_n", zero) + F.coalesce("v", zero)).alias("lang_total")))

    by_term = cells.join(groups.drop("lang"), "group").select(
        "lang", "source", F.col("key").alias("item"), _chance("count", "total").alias("p"), _chance("n", "lang_total").alias("q")).filter(
        "p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))

    # As many blocks a language as hold its terms times its sources.
    blocks = groups.groupBy("lang").agg(
        F.greatest(F.lit(1), F.ceil(F.max("v") * F.count("*") / F.lit(CELLS))).cast("long").alias("blocks"))
    dealt = kept.join(blocks, "lang").select(
        "lang", F.pmod(F.xxhash64("key"), "blocks").alias("block"), "groups", "counts")
    sides = groups.join(blocks, "lang").select(
        "lang", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), "source", "group", "total")
    pairs = dealt.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInArrow(
        _compare, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = by_term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)
