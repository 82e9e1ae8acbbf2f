"""Ordered scans (running count, sum, maximum) that no hot key can overload.

A plain window ``sum(x) OVER (PARTITION BY doc ORDER BY pos)`` sorts a whole
document in one task. Here the positions are cut into buckets of ``2**bits``
consecutive values: the window runs inside a bucket, bucket totals are built
with partial aggregation, and the totals are scanned the same way one level up.
With one row per position a window never holds more than ``2**bits`` rows,
whatever the document's share of the data, and all tasks of a level run in
parallel. Results depend on the data alone, not on how it is partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitwise.session import stage

BITS = 16


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: dict[str, Column],
    how: str = "sum",
    levels: int = 2,
    bits: int = BITS,
    order: Sequence[Column] | None = None,
    bucket: str | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Add inclusive running aggregates of ``values`` within ``keys`` along ``pos``.

    ``pos`` is an integer column; ``levels`` buckets of ``bits`` bits cover
    positions up to ``2**(bits * levels)``, and beyond that the topmost window
    grows but the result stays exact. ``order`` breaks ties inside a bucket
    when several rows share an integer position. ``bucket`` names a column that
    already holds ``pos >> bits``; rows dealt by it are not exchanged again. ``totals``
    has the aggregates of every bucket by ``keys`` and ``bucket`` where they are known, so
    the rows are not read for them.
    """
    combine = {"sum": F.sum, "max": F.max}[how]
    keys = list(keys)
    work = df.withColumns({f"_in_{n}": v for n, v in values.items()})
    out = _scan(work, keys, pos, list(values), combine, how, levels, bits, order, bucket, totals)
    return out.drop(*[f"_in_{n}" for n in values])


def _scan(df, keys, pos, names, combine, how, levels, bits, order, given=None, known=None):
    ordering = list(order) if order else [F.col(pos)]
    if levels <= 1:
        w = Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({n: combine(f"_in_{n}").over(w) for n in names})

    bucket = given or f"_b{levels}"
    work = df if given else df.withColumn(bucket, F.shiftright(F.col(pos).cast("long"), bits))
    if known is not None:
        totals = known.select(*keys, bucket, *[F.col(n).alias(f"_in_{n}") for n in names])
    else:
        totals = work.groupBy(*keys, bucket).agg(
            *[combine(f"_in_{n}").alias(f"_in_{n}") for n in names])
    scanned = _scan(totals, keys, bucket, names, combine, how, levels - 1, bits, None)
    # What all earlier buckets contribute: the inclusive value less the bucket
    # itself for sums; for maxima the preceding bucket's inclusive value.
    if how == "sum":
        before = scanned.select(*keys, bucket, *[
            (F.col(n) - F.coalesce(f"_in_{n}", F.lit(0))).alias(f"_before_{n}") for n in names])
    else:
        before = _previous(scanned, keys, bucket, names, levels - 1, bits)
    w = Window.partitionBy(*keys, bucket).orderBy(*ordering).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = work.withColumns({f"_w_{n}": combine(f"_in_{n}").over(w) for n in names})
    joined = inside.join(before, [*keys, bucket], "left")
    merge = (
        (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        if how == "sum" else F.greatest)
    return joined.withColumns(
        {n: merge(F.col(f"_w_{n}"), F.col(f"_before_{n}")) for n in names}
    ).drop(*[] if given else [bucket], *[f"_w_{n}" for n in names], *[f"_before_{n}" for n in names])


def _previous(scanned, keys, bucket, names, levels, bits):
    """Exclusive running maximum per bucket, from the inclusive one."""
    if levels <= 1:
        w = Window.partitionBy(*keys).orderBy(bucket)
        return scanned.select(*keys, bucket, *[
            F.lag(n).over(w).alias(f"_before_{n}") for n in names])
    # The top of a position is the maximum over smaller buckets; scan the
    # inclusive values shifted by one existing bucket inside each outer bucket,
    # with the outer bucket's own predecessor filling the first slot.
    outer = "_outer"
    work = scanned.withColumn(outer, F.shiftright(F.col(bucket), bits))
    last = work.groupBy(*keys, outer).agg(*[F.max(n).alias(n) for n in names])
    first_slot = _previous(
        last.withColumnRenamed(outer, "_ob"), keys, "_ob", names, levels - 1, bits
    ).withColumnRenamed("_ob", outer).select(
        *keys, outer, *[F.col(f"_before_{n}").alias(f"_edge_{n}") for n in names])
    w = Window.partitionBy(*keys, outer).orderBy(bucket)
    shifted = work.withColumns({f"_lag_{n}": F.lag(n).over(w) for n in names})
    return shifted.join(first_slot, [*keys, outer], "left").select(
        *keys, bucket, *[
            F.greatest(f"_lag_{n}", f"_edge_{n}").alias(f"_before_{n}") for n in names])


def numbered(df: DataFrame, keys: Sequence[str], pos: str, out: str,
             levels: int = 2, order: Sequence[Column] | None = None) -> DataFrame:
    """1-based rank along ``pos`` inside ``keys`` (positions must be unique)."""
    return running(df, keys, pos, {out: F.lit(1).cast("long")}, "sum", levels, order=order)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column],
                     scale: int = 100, levels: int = 3, bits: int = BITS) -> DataFrame:
    """Exact values at given 0-based ranks of ``value`` inside ``keys``.

    ``ranks`` maps an output name to the wanted rank as an expression over ``_n``, the number of values of
    the key. Equal values are counted first, in the only read of ``df``; the counts are staged. They are then
    summed by value range, the range that
    holds a rank is found, and only its part of the counts is summed by finer ranges, ``levels`` times:
    one aggregation a level, whose windows see the ranges inside one range, ``2**bits`` at most below the
    topmost level.
    """
    keys = list(keys)
    counts = stage(df.filter(F.col(value).isNotNull()).groupBy(
        *keys, F.floor(F.col(value) * scale).cast("long").alias("_pos"), F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")))
    wanted = counts.groupBy(*keys).agg(F.sum("_c").alias("_n")).select(*keys, "_n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("_name"), rank.cast("long").alias("_r")) for name, rank in ranks.items()])).alias("_w")
    ).select(*keys, "_n", "_w.*")
    found = None
    for level in range(levels - 1, -1, -1):
        at = F.struct("_pos", "_v") if level == 0 else F.shiftright("_pos", bits * level)
        ranges = counts.withColumn("_at", at)
        if found is None:
            sums = ranges.groupBy(*keys, "_at").agg(F.sum("_c").alias("_c")).join(wanted, keys)
        else:
            outer = F.shiftright("_pos", bits * (level + 1))
            sums = ranges.withColumn("_outer", outer).join(found, [*keys, "_outer"]).groupBy(
                *keys, "_n", "_name", "_r", "_at").agg(F.sum("_c").alias("_c"))
        order = Window.partitionBy(*keys, "_name").orderBy("_at").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        found = sums.withColumn("_upto", F.sum("_c").over(order)).filter(
            (F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_c"))).select(
            *keys, "_n", "_name", (F.col("_r") - F.col("_upto") + F.col("_c")).alias("_r"), F.col("_at").alias("_outer"))
    return found.groupBy(*keys).agg(F.max("_n").alias("n"), *[
        F.max(F.when(F.col("_name") == name, F.col("_outer")["_v"])).alias(name) for name in ranks])
