"""Ranked lexical search by per-term geometric blocking.

Every document is scored for every item by a saturated term-frequency sum in whole numbers. Documents are
read once into vectors over the terms the items ask for. Tasks build an index over shards of bounded size:
each term has a posting list, the list is clustered into blocks of similar documents (nearest of evenly
spaced seeds, by inner product of randomly projected vectors), and a block keeps the coordinatewise maximum
of its documents' vectors, over the terms that occur in an item together with the list's term. Blocks of a
list are formed when an item first opens the list.

An item opens its lists by descending greatest contribution, until the lists left cannot lift a document
they alone hold to the tenth score found so far. Of an opened list it takes blocks by descending bound, the
item's product with the block's maxima, and skips a block only if that bound is below the tenth score.
Bounds are sums of whole numbers that no document of the block can exceed, so nothing is lost. Every shard
returns its exact best; the best of all shards are the result. A term found in every document is split over
the shards like any other, and no posting list is ever gathered.

Items are taken in blocks of bounded text (:data:`ITEM_BYTES`), each a pass over the documents, so that what
a task holds of the items does not grow with their table.

Defined results: null text has no terms. Each row is a document of its own; equal scores go by ascending
``doc_id`` (null first), and equal (score, doc_id) get different ranks. Of rows that repeat an ``item_id``
the least text counts; a null ``item_id`` is an item. An item without terms, or without a document of a
score above 0, has no rows. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitwise.llm.common import prepare, slices
from unitwise.session import stage

TOP = 10
ITEM_BYTES = 4 << 20
#: Postings of a shard, and documents of a block on average.
SHARD = 1 << 20
BLOCK = 32
_PROJECTED = 16
_NONE = np.iinfo(np.int64).min  # a null doc_id, which comes first

RESULT = "item_id long, rank int, doc_id long, score long"
_VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"
_FOUND = "item int, doc_id long, score long"
_TERMS = bytes(k + 32 if 65 <= k <= 90 else k if 48 <= k <= 57 or 97 <= k <= 122 or k > 127 else 32 for k in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TERMS).split() if text else []


class Items:
    """Items as term numbers with their repeats."""

    def __init__(self, texts: list[str | None]):
        self.numbers: dict[bytes, int] = {}
        self.terms, self.times = [], []
        for text in texts:
            own = [self.numbers.setdefault(t, len(self.numbers)) for t in terms_of(text)]
            found, times = np.unique(np.array(own, np.int64), return_counts=True)
            self.terms.append(found)
            self.times.append(times)

    @cached_property
    def asking(self) -> list[list[int]]:
        """Items that hold a term."""
        out = [[] for _ in self.numbers]
        for item, own in enumerate(self.terms):
            for t in own.tolist():
                out[t].append(item)
        return out

    @cached_property
    def beside(self) -> np.ndarray:
        return np.zeros(len(self.numbers), bool)


def vectors(docs: DataFrame, items: Items) -> DataFrame:
    """Per row its number of terms, and the items' terms in it with their counts."""
    numbers = items.numbers

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            n, terms, counts, offsets = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                own = terms_of(text)
                n.append(len(own))
                found, times = np.unique(np.array([numbers[t] for t in own if t in numbers], np.int32), return_counts=True)
                terms.append(found)
                counts.append(times)
                offsets.append(offsets[-1] + len(found))
            ends = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()),
                 *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int32())) for x in (terms, counts))],
                names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, _VECTORS)


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Shard:
    """Index over some documents: ``impact`` of the term ``term`` in consecutive runs of ``sizes``."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray, items: Items,
                 weights: np.ndarray, block: int = BLOCK):
        self.ids, self.sizes, self.term, self.impact = ids, sizes, term, impact
        self.items, self.weights, self.block = items, weights, block
        self.starts = np.cumsum(sizes) - sizes
        order = np.argsort(term, kind="stable")
        self.posting = np.repeat(np.arange(len(ids)), sizes)[order]
        self.lists = np.append(0, np.cumsum(np.bincount(term, minlength=len(weights))))
        self.most = np.zeros(len(weights), np.int64)
        np.maximum.at(self.most, term, impact)
        self.blocks: dict[int, tuple[np.ndarray, ...]] = {}
        self.scored = self.opened = self.skipped = 0

    @cached_property
    def projected(self) -> np.ndarray:
        """Unit vectors of a few random signs a term, weighted as in the score."""
        signs = np.random.default_rng(0).choice(np.array([-1, 1], np.float32), (len(self.weights), _PROJECTED))
        strength = (self.impact * self.weights[self.term]).astype(np.float32)
        out = np.empty((len(self.ids), _PROJECTED), np.float32)
        for k in range(_PROJECTED):
            out[:, k] = np.add.reduceat(signs[self.term, k] * strength, self.starts)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def open(self, term: int) -> tuple[np.ndarray, ...]:
        """(documents in block order, starts of blocks, terms and maxima of the summaries, starts of those)."""
        if term not in self.blocks:
            docs = self.posting[self.lists[term]:self.lists[term + 1]]
            count = -(-len(docs) // self.block)
            label = np.zeros(len(docs), np.int64)
            if count > 1:
                seeds = self.projected[docs[np.linspace(0, len(docs) - 1, count).astype(np.int64)]]
                label = np.concatenate([(self.projected[docs[at:at + 4096]] @ seeds.T).argmax(axis=1)
                                        for at in range(0, len(docs), 4096)])
                order = np.argsort(label, kind="stable")
                docs, label = docs[order], label[order]
                label = np.cumsum(np.diff(label, prepend=label[0]) != 0)
            beside = self.items.beside
            for item in self.items.asking[term]:
                beside[self.items.terms[item]] = True
            at = _gather(self.starts[docs], self.sizes[docs])
            own = np.repeat(label, self.sizes[docs])
            used = beside[self.term[at]]
            beside[:] = False
            at, own = at[used], own[used]
            key = own * len(self.weights) + self.term[at]
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.diff(key, prepend=-1))
            greatest = np.maximum.reduceat(self.impact[at][order], new)
            which, coordinate = np.divmod(key[new], len(self.weights))
            self.blocks[term] = (docs, np.append(np.flatnonzero(np.diff(label, prepend=-1)), len(docs)), coordinate,
                                 greatest, np.flatnonzero(np.diff(which, prepend=-1)))
        return self.blocks[term]

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        sizes = self.sizes[docs]
        at = _gather(self.starts[docs], sizes)
        return np.add.reduceat(asked[self.term[at]] * self.impact[at], np.cumsum(sizes) - sizes)

    def search(self, item: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc_id, score) of the best documents of an item."""
        terms = self.items.terms[item]
        asked = np.zeros(len(self.weights), np.int64)
        asked[terms] = self.items.times[item] * self.weights[terms]
        gain = asked[terms] * self.most[terms]
        order = np.argsort(-gain, kind="stable")
        left = np.cumsum(gain[order][::-1])[::-1]
        seen = np.zeros(len(self.ids), bool)
        ids, found, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        for k, bound in zip(order, left, strict=True):
            if bound < least or not gain[k]:
                break
            docs, starts, coordinate, greatest, summary = self.open(int(terms[k]))
            bounds = np.add.reduceat(asked[coordinate] * greatest, summary)
            due = np.argsort(-bounds, kind="stable")
            self.opened += len(due)
            take = 1
            while len(due):
                due = due[:np.searchsorted(-bounds[due], -least, side="right")]
                now, due = due[:take], due[take:]
                own = docs[_gather(starts[now], starts[now + 1] - starts[now])]
                own = own[~seen[own]]
                if len(own):
                    seen[own] = True
                    self.scored += len(own)
                    score = self.scores(own, asked)
                    some = score >= least
                    ids, found = np.append(ids, self.ids[own][some]), np.append(found, score[some])
                    best = np.lexsort((ids, -found))[:top]
                    ids, found = ids[best], found[best]
                    if len(found) == top:
                        least = max(1, int(found[-1]))
                take *= 4
        return ids, found


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """(ids, lengths, sizes, terms, counts) of consecutive documents with about ``most`` postings."""
    held: list[list[np.ndarray]] = []
    total = 0
    for batch in batches:
        offsets = batch.column("terms").offsets.to_numpy()
        held.append([batch.column("doc_id").fill_null(_NONE).to_numpy(), batch.column("n").to_numpy(), np.diff(offsets),
                     *(batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))])
        total += len(held[-1][3])
        if total >= most:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, total = [], 0
    if total:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n * docs // total))


def _block(docs: DataFrame, texts: list[str | None], top: int, shard: int, block: int) -> DataFrame | None:
    items = Items(texts)
    if not items.numbers:
        return None
    context = docs.sparkSession.sparkContext
    read = stage(vectors(docs, items))
    count, total = read.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    weights = np.zeros(len(items.numbers), np.int64)
    # One row a term of the items at most.
    for term, df in read.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))
    sent = context.broadcast((items, weights))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        for ids, n, sizes, term, tf in shards(batches, shard):
            index = Shard(ids, sizes, term, impacts(tf, np.repeat(n, sizes), count, total), items, weights, block)
            found = [index.search(k, top) for k in range(len(items.terms))]
            ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]), pa.int32()),
                 pa.array(ids, pa.int64(), mask=ids == _NONE), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return read.filter("size(terms) > 0").mapInArrow(find, _FOUND)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The ``top`` documents of every item: ``RESULT``. ``docs``: doc_id, text; ``items``: item_id, text."""
    spark = prepare(docs.sparkSession)
    asked = items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    parts = max(1, -(-size // ITEM_BYTES))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    out = spark.createDataFrame([], RESULT)
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id").collect()
        found = _block(docs, [r.text for r in rows], top, shard, block)
        if found is not None:
            names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], "item int, item_id long")
            best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
