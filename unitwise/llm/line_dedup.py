"""Fuzzy line deduplication: MinHash bands, exact Jaccard verification, distributed union-find.

Every line with a word stands for the set of its runs of ``CHARS`` characters (a shorter line is
one run). Equal lines form one class. ``BANDS`` bands of ``ROWS`` minima over independent
permutations bring together classes whose similarity is ``PERCENT`` or more with a probability of
0.996 at the limit and more above it. Every pair brought together is verified exactly, or left out
only where the triangle inequality or their component decides it. Components keep their first line.

Lines and runs are known by hashes of 64 and 48 bits.

Defined results: lines are split at \\n and compared as they are; lines without a word are neither
dropped nor compared. A null text has no lines to drop. The first line is the one of the least
doc_id (null last), then row, then place, so of repeated rows one keeps its lines. Other columns are
ignored or, by ``strip_lines``, kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitwise.llm.common import mix, partitions_for, prepare, slices
from unitwise.llm.regions import (LEVELS, LOW48, PACKED, ROWS_PER_TASK, Packer, Picker, link_shared, shared_keys,
                                  to_bytes)
from unitwise.session import release, stage, staged_since, staged_tables

CHARS = 7
PERCENT = 80
BANDS = 14
ROWS = 5
#: Lines have few runs, so a block may hold more of them than of whole texts.
REGION = 8192
_BLANK = " \t\n\x0b\x0c\r"
_AT_ONCE = 1 << 17


def line_class(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


def run_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character runs of all lines, in order, and how many each line has."""
    sizes = np.array([len(x) for x in lines])
    flat = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    flat = np.append(flat + np.uint64(1), np.zeros(CHARS, np.uint64))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    short = np.flatnonzero(sizes < CHARS)
    out = _chained([flat[k:k + ends[-1]] for k in range(CHARS)])
    keep = np.ones(len(out), bool)
    for k in range(1, CHARS):
        keep[(ends - k)[sizes > k]] = False
    # A line of fewer characters is one run of them all: its last places count as empty.
    out[starts[short]] = _chained([np.where(sizes[short] > k, flat[starts[short] + k], np.uint64(0)) for k in range(CHARS)])
    keep[starts[short]] = True
    return mix(out[keep]), np.maximum(sizes - CHARS + 1, 1)


def _chained(steps: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(steps[0]), np.uint64)
    high = np.empty_like(out)
    for step in steps:
        out ^= step
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= np.right_shift(out, np.uint64(29), out=high)
    return out


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(80)
    n = BANDS * ROWS
    return (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
            rng.integers(0, 2**32, n, dtype=np.uint32))


def band_keys(lines: list[str]) -> np.ndarray:
    """48-bit keys, lines x ``BANDS``."""
    hashes, counts = run_hashes(lines)
    half = (hashes >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(counts) - counts
    factors, masks = _permutations()
    least, held = np.empty((BANDS * ROWS, len(lines)), np.uint32), np.empty_like(half)
    for k in range(BANDS * ROWS):
        np.bitwise_xor(half, masks[k], out=held)
        np.multiply(held, factors[k], out=held)
        np.minimum.reduceat(held, starts, out=least[k])
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + least[k::ROWS])
    return out.T & LOW48


def _lines(text: str | None) -> list[tuple[int, str]]:
    return [(k, x) for k, x in enumerate(text.split("\n")) if x.strip(_BLANK)] if text else []


def _chunks(lines: list[str]) -> Iterator[list[str]]:
    """Lists of lines with about ``_AT_ONCE`` characters together, which stay in the cache."""
    held, size = [], 0
    for line in lines:
        held.append(line)
        size += len(line)
        if size > _AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _banded(docs: DataFrame, parts: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(parts), set()
        for batch in slices(batches, "text", 4 << 20):
            if len(seen) > 2_000_000:
                seen.clear()  # only saves work: classes met again give the same rows
            fresh = {}
            for text in batch.column("text"):
                for _, line in _lines(text.as_py()):
                    cls = line_class(line)
                    if cls not in seen:
                        seen.add(cls)
                        fresh[cls] = line
            classes = list(fresh)
            at = 0
            for chunk in _chunks(list(fresh.values())):
                for keys in band_keys(chunk):
                    packer.add(keys | np.uint64(1 << 54), classes[at])
                    at += 1
            if packer.full:
                yield packer.flush()
        if packer.size:
            yield packer.flush()

    return docs.select("text").mapInArrow(pack, PACKED)


def occurrences(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, line, cls, n_lines): every line with a word, and one row of line -1 per text."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            found = [[(-1, None), *_lines(t)] for t in texts]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
            counts = [None if t is None else t.count("\n") + 1 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id").take(rows), batch.column("doc_id").take(rows),
                 pa.array([k for x in found for k, _ in x], pa.int32()),
                 pa.array([None if t is None else line_class(t) for x in found for _, t in x], pa.int64()),
                 pa.array([(n or 0) if k < 0 else None for n, x in zip(counts, found, strict=True) for k, _ in x],
                          pa.int64())], names=["row_id", "doc_id", "line", "cls", "n_lines"])

    return docs.selectExpr("row_id", "CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(
        find, "row_id long, doc_id long, line int, cls long, n_lines long")


def _bodies(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(cls, n, body) of the classes in the bit table; lines are exchanged as text, a sixth of their runs."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picker = Picker(shared.value)
        for batch in slices(batches, "text", 4 << 20):
            lines = [t for x in batch.column("text") for _, t in _lines(x.as_py())]
            cls = np.array([line_class(t) for t in lines], np.int64)
            rows = picker(cls) if lines else []
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls[rows]), pa.array([lines[i] for i in rows], pa.string())], names=["cls", "line"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "line", 4 << 20):
            sizes, bodies = [], []
            for chunk in _chunks(batch.column("line").to_pylist()):
                hashes, counts = run_hashes(chunk)
                owner, hashes = np.repeat(np.arange(len(counts)), counts), hashes & LOW48
                hashes = np.concatenate([np.sort(x) for x in np.split(hashes, np.cumsum(counts)[:-1])])
                fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
                sizes.append(np.bincount(owner[fresh]))
                bodies.append(to_bytes(hashes[fresh]))
            n = np.concatenate(sizes)
            ends = np.append(0, np.cumsum(n * 6)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), pa.array(n), pa.Array.from_buffers(
                    pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(bodies))])],
                names=["cls", "n", "body"])

    return docs.select("text").mapInArrow(pick, "cls long, line string").dropDuplicates(["cls"]).mapInArrow(
        cut, "cls long, n long, body binary")


def dropped_lines(docs: DataFrame, found: DataFrame, region: int = REGION, levels: int = LEVELS) -> DataFrame:
    """(row_id, line) of the lines that go; ``docs`` has row_id, doc_id and text, ``found`` its occurrences."""
    found = found.filter("cls IS NOT NULL")
    mark = staged_tables()
    parts = partitions_for(docs.sparkSession, BANDS * found.count(), ROWS_PER_TASK)
    shared = stage(shared_keys(_banded(docs, parts), parts))
    comps = stage(link_shared(shared, lambda bits: _bodies(docs, bits), PERCENT, region, levels)[0])
    release(docs.sparkSession, staged_since(mark)[:-1])
    grouped = stage(found.join(comps, found["cls"] == comps["node"], "left").select(
        "row_id", "doc_id", "line", F.coalesce("component", "cls").alias("group")))
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row_id").alias("c"),
                     F.col("line").alias("d"))
    first = grouped.groupBy("group").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return grouped.join(first, "group").filter(
        "row_id <> first.c OR line <> first.d").select("row_id", "line")


def line_dedup(docs: DataFrame, region: int = REGION, levels: int = LEVELS) -> DataFrame:
    """Every row of ``docs``: doc_id, n_lines (split at \\n), n_dropped and dropped (their places from 0)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    found = stage(occurrences(rows))
    gone = dropped_lines(rows, found, region, levels).groupBy("row_id").agg(
        F.sort_array(F.collect_list("line")).alias("dropped"))
    return found.filter("line < 0").join(gone, "row_id", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def strip_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the lines that go taken out of ``text``."""
    prepare(docs.sparkSession)
    numbered = stage(docs.withColumn("_row", F.monotonically_increasing_id()))
    rows = numbered.select(F.col("_row").alias("row_id"), "doc_id", "text")
    gone = dropped_lines(rows, stage(occurrences(rows))).groupBy(
        F.col("row_id").alias("_row")).agg(F.collect_set("line").alias("_gone"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, k: ~F.array_contains("_gone", k))
    return numbered.join(gone, "_row", "left").withColumn(
        "text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("_row", "_gone")
