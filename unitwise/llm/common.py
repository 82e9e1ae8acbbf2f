"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitwise.session import configure, ship_package

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def prepare(spark: SparkSession) -> SparkSession:
    """Settings and code the operators need on the executors."""
    ship_package(configure(spark))
    return spark


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions so that none holds more than about ``per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(n))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; null and unpaired surrogates are harmless."""
    return text.encode("utf-8", "replace").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The same words with A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def texts_of(column: pa.Array | pa.ChunkedArray) -> Iterator[str | None]:
    for value in column:
        yield value.as_py()


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], np.int64)
        part = np.cumsum(sizes) // most
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those whose key hashes lowest; the same rows at any partitioning."""
    return rows.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(most)
