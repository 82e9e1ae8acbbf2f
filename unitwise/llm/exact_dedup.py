"""Exact deduplication over a cuckoo-filter index of live digests.

Every shard of the digest space holds a cuckoo filter and, bucketed like it, the
stored keys. A miss of the filter proves a digest new. A hit is verified against
the keys of its bucket. When an insertion finds no free slot the filter doubles
and is filled anew from the stored keys. Copies met in one Arrow batch are
merged before the exchange, so a text that makes up a third of all rows reaches
its shard as one row per batch.

Defined results: a null text counts as empty; empty texts equal each other and
texts of white space alone. Repeated rows are copies like any other: of equal
rows exactly one is kept. A null ``doc_id`` loses ties against any number and is
returned as null. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitwise.llm.common import partitions_for, prepare
from unitwise.session import stage

ROWS_PER_SHARD = 400_000
_NO_ID = 2**63 - 1


class CuckooIndex:
    """Cuckoo filter of 16-bit fingerprints over stored 32-byte keys with a payload each."""

    SLOTS = 4
    KICKS = 120

    def __init__(self, buckets: int = 256):
        self.resizes = 0
        self.size = 0
        self._reset(buckets)

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = [0] * (buckets * self.SLOTS)
        self.content: dict[int, list[list]] = {}

    def _home(self, key: bytes) -> tuple[int, int]:
        return (int.from_bytes(key[:2], "big") or 1), int.from_bytes(key[2:10], "big") & self.mask

    def _other(self, print_: int, bucket: int) -> int:
        return bucket ^ (print_ * 0x5BD1E995 & self.mask)

    def _slot(self, bucket: int, print_: int) -> int:
        start = bucket * self.SLOTS
        for k in range(start, start + self.SLOTS):
            if self.table[k] == print_:
                return k
        return -1

    def may_contain(self, key: bytes) -> bool:
        print_, home = self._home(key)
        return self._slot(home, print_) >= 0 or self._slot(self._other(print_, home), print_) >= 0

    def get(self, key: bytes):
        """The payload of a live key or None; the stored keys are read on a filter hit only."""
        if self.may_contain(key):
            for stored, payload in self.content.get(self._home(key)[1], ()):
                if stored == key:
                    return payload
        return None

    def insert(self, key: bytes, payload) -> None:
        """Add a key that is not live."""
        print_, home = self._home(key)
        self.content.setdefault(home, []).append([key, payload])
        self.size += 1
        if not self._add(print_, home):
            self._grow()

    def _add(self, print_: int, bucket: int) -> bool:
        for place in (bucket, self._other(print_, bucket)):
            free = self._slot(place, 0)
            if free >= 0:
                self.table[free] = print_
                return True
        for kick in range(self.KICKS):
            victim = bucket * self.SLOTS + (kick * 7 + print_) % self.SLOTS
            print_, self.table[victim] = self.table[victim], print_
            bucket = self._other(print_, bucket)
            free = self._slot(bucket, 0)
            if free >= 0:
                self.table[free] = print_
                return True
        return False

    def _grow(self) -> None:
        stored = list(self.items())
        buckets = (self.mask + 1) * 2
        while True:
            self.resizes += 1
            self._reset(buckets)
            for key, payload in stored:
                print_, home = self._home(key)
                self.content.setdefault(home, []).append([key, payload])
                if not self._add(print_, home):
                    break
            else:
                return
            buckets *= 2

    def delete(self, key: bytes) -> bool:
        """Remove a live key and one copy of its fingerprint; False if it is not live."""
        if self.get(key) is None:
            return False
        print_, home = self._home(key)
        kept = [x for x in self.content[home] if x[0] != key]
        if kept:
            self.content[home] = kept
        else:
            del self.content[home]
        slot = self._slot(home, print_)
        self.table[slot if slot >= 0 else self._slot(self._other(print_, home), print_)] = 0
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.content.values():
            for key, payload in bucket:
                yield key, payload


def digests(docs: DataFrame, row_id: Column | None = None) -> DataFrame:
    """(doc_id, row_id, n_chars, digest): SHA-256 of every text without its white space."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.monotonically_increasing_id() if row_id is None else row_id).alias("row_id"),
        F.length(text).cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", ""), 256)).alias("digest"))


_PART = "digest binary, copies long, n_chars long, doc_id long, row_id long"


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per digest and batch: its copies and its best row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.frombuffer(b"".join(x.as_py() for x in batch.column("digest")), ">u8").reshape(n, 4)
        chars = batch.column("n_chars").to_numpy()
        ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
        rows = batch.column("row_id").to_numpy()
        order = np.lexsort((rows, ids, -chars, keys[:, 3], keys[:, 2], keys[:, 1], keys[:, 0]))
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        best = order[first]
        yield pa.RecordBatch.from_arrays([
            batch.column("digest").take(pa.array(best)), pa.array(np.diff(first, append=n)),
            pa.array(chars[best]), pa.array(ids[best]), pa.array(rows[best])],
            names=["digest", "copies", "n_chars", "doc_id", "row_id"])


def _index_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass the rows of a shard through its index; return the live keys with their best row."""
    index = CuckooIndex()
    for batch in batches:
        for key, copies, chars, doc, row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            found = index.get(key)
            if found is None:
                index.insert(key, [copies, (-chars, doc, row)])
            else:
                found[0] += copies
                found[1] = min(found[1], (-chars, doc, row))
    out = [(key, p[0], -p[1][0], p[1][1], p[1][2]) for key, p in index.items()]
    for k in range(0, len(out), 20_000):
        columns = list(zip(*out[k:k + 20_000], strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])],
            names=["digest", "copies", "n_chars", "doc_id", "row_id"])


def live_groups(prints: DataFrame, shards: int) -> DataFrame:
    """(digest, copies, n_chars, doc_id, row_id) per distinct text, from ``digests`` rows."""
    partial = prints.select("digest", "n_chars", "doc_id", "row_id").mapInArrow(_merge_batches, _PART)
    return partial.repartition(shards, "digest").mapInArrow(_index_shard, _PART)


def _groups(prints: DataFrame) -> DataFrame:
    return live_groups(prints, partitions_for(prints.sparkSession, prints.count(), ROWS_PER_SHARD))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with the row that stays in its place.

    Returns doc_id, keep_id, group_size, kept and text_sha256. Of equal texts the row
    with most code points stays, then the smallest doc_id, then the first row read.
    """
    prepare(docs.sparkSession)
    prints = stage(digests(docs))
    groups = _groups(prints).select(
        "digest", F.col("copies").alias("group_size"), F.col("row_id").alias("keep_row"),
        F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("keep_id"))
    return prints.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are numbered in a staged copy, so that each decision meets exactly one row.
    """
    prepare(docs.sparkSession)
    numbered = stage(docs.withColumn("_row", F.monotonically_increasing_id()))
    prints = stage(digests(numbered, F.col("_row")))
    keep = _groups(prints).select(F.col("row_id").alias("_row"))
    return numbered.join(keep, "_row", "left_semi").drop("_row")


def update_index(index: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """Apply insertions and deletions of live digests to a stored index.

    ``changes`` has (digest, delta): +1 for a copy that arrives, -1 for one that goes.
    ``index`` and the result have (shard, digest, live); a key leaves the index, and its
    fingerprint the filter, when no copy is live. Deleting more copies than live ends at none.
    """
    spark = changes.sparkSession
    prepare(spark)
    deltas = changes.groupBy("digest").agg(F.sum("delta").alias("delta")).filter("delta <> 0")
    deltas = deltas.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    if index is None:
        index = spark.createDataFrame([], "shard int, digest binary, live long")

    def apply(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        held = CuckooIndex()
        for digest, live in zip(old["digest"], old["live"], strict=True):
            held.insert(bytes(digest), [live])
        for digest, delta in zip(new["digest"], new["delta"], strict=True):
            digest = bytes(digest)
            found = held.get(digest)
            if found is None:
                if delta > 0:
                    held.insert(digest, [delta])
            elif found[0] + delta <= 0:
                held.delete(digest)
            else:
                found[0] += delta
        rows = [(key[0], digest, payload[0]) for digest, payload in held.items()]
        return pd.DataFrame(rows, columns=["shard", "digest", "live"])

    return index.groupBy("shard").cogroup(deltas.groupBy("shard")).applyInPandas(
        apply, "shard int, digest binary, live long")
