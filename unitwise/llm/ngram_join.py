"""N-gram Jaccard join: Voronoi regions around pivots in the metric space of shingle sets.

Jaccard distance is a metric, so a text within 0.25 of another lies, seen from any pivot,
within 0.25 of the other's distance. The join goes in these steps, all exact:

1. Equal sets become one class. All work below is on classes.
2. Shingles are ordered by frequency: rare ones by hash, then a bounded table of the most
   frequent ones. Of each set the first n - ceil(0.70 n) + 1 are compared. Two sets that link
   share at least one in twenty of the larger set's shingles among these first ones: the
   intersection, 3/7 of the sum of the sizes at least, has no more than ceil(0.70 n) - 1
   elements behind the first ones of the set whose first ones end earlier. Classes and pairs
   that share fewer are left out.
3. Every shared shingle names as pivot the class, among those that share it, whose shingles are
   most frequent (the centre of a group of copies). A class belongs to the regions of all
   pivots its shingles name, so two sets that link meet in at least one region. Where at most
   four classes share a shingle, one class of every pair is the pivot of the other.
4. Distances to the pivots are computed. Those within 0.25 are links.
5. What is linked to a pivot is connected already. In every region, classes outside the
   pivot's component join against the region's other components: only partners inside the
   triangle-inequality window of a home class are copied in. A region of more than
   ``REGION`` classes is divided by pivots of its own: each home class goes to its nearest
   pivot's cell, every class within reach of a cell by the triangle inequality is copied
   there, and cells join recursively. What is still too large after ``LEVELS`` divisions is
   joined in pairs of blocks.
6. Links found there and those of step 4 make the components.
7. Links lie inside components. To count them every component is a region whose classes are all
   home: a large one is divided into the cells of its nearest pivots, windows copy in all partners
   of a cell's classes, and cells join recursively. Each class is home in one cell and counts there,
   so every link counts once at both ends and only counts leave a task.

Shingles are 48-bit hashes and sets 64-bit hashes of them. The frequency table and the filter
of bodies have fixed sizes and only steer the work; no result depends on them.

Defined results: words are lower-cased in A-Z and split at ASCII white space. A null or wordless
text has an empty set, no links and is its own component. Repeated rows are copies; ``n_links`` of a row
counts all other rows it links with, copies included. A null ``doc_id`` never
names a component of other rows. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitwise.llm.common import lower_words, mix, partitions_for, prepare, slices
from unitwise.llm.regions import (COUNTED, LEVELS, LOW48, PACKED, REGION, ROWS_PER_TASK, Packer, Picker,
                                  count_links, from_bytes, link_shared, shared_keys, to_bytes)
from unitwise.session import release, stage, stage_by, staged_since, staged_tables

SIZE = 5
PERCENT = 75
FIRST_PERCENT = 70
FREQUENT = 1 << 16


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the runs of five words; a shorter text is one run."""
    found = lower_words(text)
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, n)
    width = min(SIZE, n)
    run = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        run = mix(run * np.uint64(0x9E3779B97F4A7C15) + each[k:n - width + 1 + k])
    return np.unique(run & LOW48)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, cls, body) of every row; cls is null for an empty set."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            found = [shingles(x.as_py()) for x in batch.column("text")]
            bodies = [to_bytes(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()),
                 pa.array([xxhash.xxh64_intdigest(b) - (1 << 63) if b else None for b in bodies], pa.int64()),
                 pa.array(bodies, pa.binary())], names=["doc_id", "n_shingles", "cls", "body"])
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(
        sets, "doc_id long, n_shingles long, cls long, body binary")


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of the corpus, sorted, and their counts: a bounded table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            kinds, counts = np.unique(np.concatenate(held), return_counts=True)
            top = np.flatnonzero(counts >= 3)
            top = top[np.argsort(-counts[top], kind="stable")[:FREQUENT]]
            return pa.RecordBatch.from_arrays([pa.array(kinds[top].astype(np.int64)), pa.array(counts[top])],
                                              names=["s", "n"])
        for batch in batches:
            for body in batch.column("body"):
                held.append(from_bytes(body.as_py()))
                size += len(held[-1])
                if size > 1_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    top = sets.select("body").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy(
        F.desc("n"), "s").limit(FREQUENT).toPandas().sort_values("s")
    return top["s"].to_numpy().astype(np.uint64), top["n"].to_numpy().astype(np.float64)


def least_shared(n: int) -> int:
    """How many of its first shingles a set of ``n`` shares with any set it links with."""
    return max(1, -(-(PERCENT - FIRST_PERCENT) * n // 100))


def prefix(values: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(rare, frequent) first shingles of a set, and a mark of 16 bits.

    The mark holds ``least_shared`` (ten bits, at most 1023) and how frequent the set's
    shingles are on average (six bits).
    """
    n = len(values)
    size = n - (FIRST_PERCENT * n + 99) // 100 + 1
    mark = min(least_shared(n), 1023) << 6
    if not len(hot):
        return values[:size], values[:0], mark
    at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
    hit = hot[at] == values
    rare = values[~hit][:size]
    often = counts[at[hit]]
    mark |= min(int(4 * np.log2(often).sum() / n), 63)
    return rare, values[hit][np.argsort(often, kind="stable")[:size - len(rare)]], mark


def first_shingles(sets: DataFrame, parts: int, table: Broadcast) -> DataFrame:
    """``PACKED`` rows of the first shingles of every set; the frequent ones (``table``) are dealt by class."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for batch in batches:
            for cls, body in zip(batch.column("cls").to_pylist(), batch.column("body"), strict=True):
                rare, frequent, mark = prefix(from_bytes(body.as_py()), *table.value)
                packer.add(rare | np.uint64(mark << 48), cls)
                packer.add(frequent | np.uint64(mark << 48), cls, spread=True)
                if packer.full:
                    yield packer.flush()
        if packer.size:
            yield packer.flush()

    return sets.filter("cls IS NOT NULL").select("cls", "body").mapInArrow(pack, PACKED)


def _bodies(sets: DataFrame, shared: Broadcast) -> DataFrame:
    """(cls, n, body) of the classes in the bit table."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picker = Picker(shared.value)
        for batch in batches:
            rows = picker(batch.column("cls").to_numpy()) if batch.num_rows else []
            if rows:
                yield batch.take(pa.array(rows))

    return sets.filter("cls IS NOT NULL").select("cls", F.col("n_shingles").alias("n"), "body").mapInArrow(
        pick, "cls long, n long, body binary").dropDuplicates(["cls"])


def link_classes(sets: DataFrame, region: int = REGION, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(node, component) of every class of ``sets`` (staged) that links with another class, and (cls, n, body)."""
    rows = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    hot, counts = frequent_shingles(sets)
    parts = partitions_for(sets.sparkSession, rows * (100 - FIRST_PERCENT) // 100, ROWS_PER_TASK)
    table = sets.sparkSession.sparkContext.broadcast((hot, counts))
    shared = stage(shared_keys(first_shingles(sets, parts, table), parts))
    table.destroy()
    return link_shared(shared, lambda bits: _bodies(sets, bits), PERCENT, region, levels)


def _classes(sets: DataFrame, comps: DataFrame) -> DataFrame:
    """(cls, first, size, component, least): least ``doc_id`` and rows of every class, and its component if it has links."""
    classes = sets.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count("*").alias("size"))
    known = stage(classes.join(comps, classes["cls"] == comps["node"], "left").select("cls", "first", "size", "component"))
    least = known.filter("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least"))
    return known.join(least, "component", "left")


def _named(sets: DataFrame, classes: DataFrame, *more: Column) -> DataFrame:
    found = classes.withColumn("found", F.coalesce("least", "first")).drop("first", "least", "component")
    return sets.select("doc_id", "n_shingles", "cls").join(found, "cls", "left").select(
        "doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"), *more)


def ngram_components(docs: DataFrame, region: int = REGION, levels: int = LEVELS) -> DataFrame:
    """Every row of ``docs``: doc_id, n_shingles, component_id (least doc_id its links reach)."""
    prepare(docs.sparkSession)
    sets = stage(shingle_sets(docs))
    return _named(sets, _classes(sets, link_classes(sets, region, levels)[0]))


def ngram_join(docs: DataFrame, region: int = REGION, levels: int = LEVELS, counted: int = COUNTED) -> DataFrame:
    """Every row of ``docs``: doc_id, n_shingles, component_id (least doc_id its links reach), n_links (rows it links with).

    Regions of more than ``region`` classes, and of more than ``counted`` where links are counted, are divided.
    """
    prepare(docs.sparkSession)
    sets = stage(shingle_sets(docs))
    mark = staged_tables()
    comps, bodies = link_classes(sets, region, levels)
    classes = stage(_classes(sets, comps))
    groups = classes.filter("component IS NOT NULL").select("cls", "component", "size")
    sized = stage_by(bodies.join(groups.select("cls", "size"), "cls"), "cls")
    release(docs.sparkSession, staged_since(mark)[:-2])
    links = count_links(groups.select("cls", "component"), sized, PERCENT, counted, levels)
    rows = F.coalesce(F.col("size") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).alias("n_links")
    return _named(sets, classes.join(links, "cls", "left"), rows)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the row with the least doc_id, once."""
    prepare(docs.sparkSession)
    numbered = stage(docs.withColumn("_row", F.monotonically_increasing_id()))
    # The row number stands for the id, so rows that repeat an id are told apart.
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_row").alias("c"))
    found = ngram_components(numbered.select(F.col("_row").alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group")).join(
        numbered.select("_row", "doc_id"), "_row")
    keep = groups.groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.c").alias("_row"))
    return numbered.join(keep, "_row", "left_semi").drop("_row")
