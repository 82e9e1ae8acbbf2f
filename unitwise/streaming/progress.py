"""The progress feed of running jobs, as streams and as batch twins.

Events have job_id, event_at, event_id, stage, detail and kind; a NULL kind is
a mere detail update.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from unitwise.functions import fixed_values as V
from unitwise.session import ship_package, stage


def latest_progress(events: DataFrame) -> DataFrame:
    """Current stage and last known detail per job, for batches and streams.

    Built from mergeable aggregates, so a job with most of the events is
    reduced on every task before anything moves; as a stream use update mode.
    """
    order = F.struct("event_at", "event_id")
    return events.groupBy("job_id").agg(
        F.max_by("stage", order).alias("stage"),
        F.max_by("detail", F.when(F.col("detail").isNotNull(), order)).alias("detail"),
        F.max("event_at").alias("updated_at"), F.count("kind").alias("n_events"))


def cap_events(events: DataFrame, most: int = V.MAX_TIMELINE_EVENTS) -> DataFrame:
    """The first timeline events of each job (the limit is the feature).

    The row-number filter is pushed before the exchange by the group limit, so
    no task sees more than ``most`` rows of a job per input partition.
    """
    w = Window.partitionBy("job_id").orderBy("event_at", "event_id")
    return events.filter(F.col("kind").isNotNull()).withColumn(
        "event_no", F.row_number().over(w).cast("bigint")).filter(F.col("event_no") <= most)


def stale_jobs(events: DataFrame, as_of, finished: tuple[str, ...] = ()) -> DataFrame:
    """Jobs without a heartbeat for ten minutes at ``as_of``."""
    last = events.groupBy("job_id").agg(
        F.max("event_at").alias("last_at"),
        F.max_by("stage", F.struct("event_at", "event_id")).alias("stage"))
    limit = as_of - F.expr(f"INTERVAL {V.STALE_MINUTES} MINUTES")
    stale = last.filter(F.col("last_at") < limit)
    return stale.filter(~F.col("stage").isin(*finished)) if finished else stale


def stale_sessions(events: DataFrame, watermark: str = "1 minute",
                   finished: tuple[str, ...] = ("complete", "failed")) -> DataFrame:
    """Streaming form: an unfinished job is stale when it is silent for ten minutes.

    A session closes at the gap; it is stale unless its last stage is a finished one. A job
    that goes on after a gap and stalls again is reported again with its later session. Rows
    later than the watermark are dropped, and closed sessions leave the state.
    """
    return (
        events.withWatermark("event_at", watermark)
        .groupBy("job_id", F.session_window("event_at", f"{V.STALE_MINUTES} minutes"))
        .agg(F.count(F.lit(1)).alias("n_updates"),
             F.max_by("stage", F.struct("event_at", "event_id")).alias("stage"))
        .filter(~F.coalesce(F.col("stage").isin(*finished), F.lit(False)))
        .select("job_id", F.col("session_window.start").alias("first_at"),
                F.col("session_window.end").alias("stale_at"), "n_updates", "stage"))


def _written(times: list[int], forced: list[bool], last: int | None) -> tuple[list[bool], int]:
    out = []
    for t, must in zip(times, forced):
        keep = must or last is None or t - last >= V.THROTTLE_MS
        out.append(keep)
        if keep:
            last = t
    return out, last


def _forced(events: DataFrame) -> DataFrame:
    """Events with ms, their second ``b`` and whether they are written whatever was written before.

    Certain are the first event of a job, a stage change, a timeline event and the end of a pause of a
    second. An event's predecessor is in its second or in the one before, else there was a pause.
    """
    e = events.withColumn("ms", F.unix_millis("event_at")).withColumn("b", F.floor(F.col("ms") / V.THROTTLE_MS))
    inside = Window.partitionBy("job_id", "b").orderBy("ms", "event_id")
    e = e.withColumns({"prev_ms": F.lag("ms").over(inside), "prev_stage": F.lag("stage").over(inside)})
    before = e.groupBy("job_id", "b").agg(F.max(F.struct("ms", "event_id", "stage")).alias("tail")).select(
        "job_id", (F.col("b") + 1).alias("b"), F.col("tail.ms").alias("t_ms"), F.col("tail.stage").alias("t_stage"))
    e = e.join(before, ["job_id", "b"], "left").withColumns({
        "prev_stage": F.when(F.col("prev_ms").isNull(), F.col("t_stage")).otherwise(F.col("prev_stage")),
        "prev_ms": F.coalesce("prev_ms", "t_ms")})
    return e.withColumn("forced", F.col("prev_ms").isNull() | (F.col("ms") - F.col("prev_ms") >= V.THROTTLE_MS)
                        | ~F.col("stage").eqNullSafe(F.col("prev_stage")) | F.col("kind").isNotNull())


#: Seconds of a group, and groups of a group, in the scan over seconds: 2 to this power.
_SCAN_BITS = 8
_SCAN_LEVELS = 3


def _then(state: Column, x: Column) -> Column:
    """State after a second or group ``x``: fixed by a certain write, else looked up."""
    return F.coalesce(x["fixed"], F.get(x["step"], state))


def _composed(parts: Column) -> Column:
    """(fixed, step) of consecutive seconds or groups taken together; both are bounded by one second's events."""
    kind = "struct<fixed:int,step:array<int>>"
    ask = F.transform(F.coalesce(F.get(parts, F.lit(0))["step"], F.array().cast("array<int>")), lambda _, i: i)
    start = F.struct(F.lit(None).cast("int").alias("fixed"), ask.alias("step")).cast(kind)
    return F.aggregate(parts, start, lambda acc, x: F.when(x["fixed"].isNotNull(), F.struct(
        x["fixed"].alias("fixed"), F.lit(None).cast("array<int>").alias("step"))).when(
        acc["fixed"].isNotNull(), F.struct(F.get(x["step"], acc["fixed"]).alias("fixed"),
                                           F.lit(None).cast("array<int>").alias("step"))).otherwise(
        F.struct(F.lit(None).cast("int").alias("fixed"),
                 F.transform(acc["step"], lambda i: F.get(x["step"], i)).alias("step"))).cast(kind))


def _entered(parts: DataFrame, levels: int) -> DataFrame:
    """(job_id, at, entry): the state each part is entered with.

    ``parts``: job_id, at, fixed, step. Parts are composed in groups of consecutive places, the groups are
    entered in the same way one level up, and each group is then gone through once.
    """
    order = F.array_sort(F.collect_list(F.struct("at", "fixed", "step")))
    groups = parts.groupBy("job_id", (F.shiftright("at", _SCAN_BITS) if levels else F.lit(0).cast("long")).alias("g")).agg(
        order.alias("parts"))
    if levels:
        outer = groups.withColumn("all", _composed(F.col("parts"))).select(
            "job_id", F.col("g").alias("at"), "all.fixed", "all.step")
        groups = groups.join(_entered(outer, levels - 1).withColumnRenamed("at", "g"), ["job_id", "g"], "left")
    else:
        groups = groups.withColumn("entry", F.lit(None).cast("int"))
    entries = F.aggregate("parts", F.array("entry"), lambda acc, x: F.concat(
        acc, F.array(_then(F.element_at(acc, -1), x))))
    return groups.select("job_id", F.posexplode(F.arrays_zip(
        F.transform("parts", lambda x: x["at"]).alias("at"), entries.alias("entry")))).filter(
        "col.at IS NOT NULL").select("job_id", F.col("col.at").alias("at"), F.col("col.entry").alias("entry"))


def throttle(events: DataFrame) -> DataFrame:
    """Updates that are written: detail-only ones in the same stage wait a second.

    Certain writes are known from an event and its predecessor. Of the other events a second holds at most
    one write, before its first certain one: the first event at least a second after the last write. So the
    state between seconds is which of a second's times the last write had, or that it had none, and a second
    is a step from that state to the next: the number of its times before the same point one second later.
    A second with a certain write has a fixed outcome. Steps are composed associatively, so seconds, groups
    of seconds and groups of groups are taken in parallel whatever a job's share of the events; a group's
    step is never longer than the times of one second, a thousand.
    """
    e = stage(_forced(events).select("job_id", "event_id", "ms", "b", "forced"))
    times = e.filter("b IS NOT NULL").groupBy("job_id", "b", "ms").agg(
        F.min("event_id").alias("event_id"), F.max("forced").alias("certain"),
        F.min(F.when(F.col("forced"), F.col("event_id"))).alias("first_certain"))
    seconds = times.groupBy("job_id", "b").agg(
        F.array_sort(F.collect_list(F.struct("ms", "event_id"))).alias("times"),
        F.max(F.when(F.col("certain"), F.col("ms"))).alias("last_ms"),
        F.min(F.when(F.col("certain"), F.struct("ms", F.col("first_certain").alias("event_id")))).alias("until"))
    ahead = seconds.select("job_id", (F.col("b") + 1).alias("b"), F.transform(
        "times", lambda t: t["ms"] + V.THROTTLE_MS).alias("due"))
    own = F.transform("times", lambda t: t["ms"])
    # Due points and times in one order: a point's place less the points before it counts the times before it.
    merged = F.array_sort(F.concat(
        F.transform("due", lambda t: F.struct(t.alias("t"), F.lit(0).alias("own"))),
        F.transform(own, lambda t: F.struct(t.alias("t"), F.lit(1).alias("own")))))
    points = F.filter(F.transform(merged, lambda x, i: F.struct(x["own"].alias("own"), i.alias("i"))),
                      lambda x: x["own"] == 0)
    # The last state is "no write in the second before", after which the first time is due.
    step = F.concat(F.transform(points, lambda x, k: x["i"] - k), F.array(F.lit(0)))
    steps = stage(seconds.join(ahead, ["job_id", "b"], "left").withColumn("step", F.when(
        F.col("due").isNotNull(), step)).withColumn(
        "fixed", F.when(F.col("last_ms").isNotNull(), F.array_position(own, F.col("last_ms")).cast("int") - 1)).select(
        "job_id", F.col("b").alias("at"), "fixed", "step", "times", "until"))
    entered = _entered(steps.select("job_id", "at", "fixed", "step"), _SCAN_LEVELS)
    chosen = steps.join(entered, ["job_id", "at"]).select(
        "job_id", "until", F.get("times", F.get("step", F.col("entry"))).alias("write"))
    waited = chosen.filter(F.col("write").isNotNull() & (F.col("until").isNull() | (F.col("write") < F.col("until"))))
    return e.filter("forced").select("job_id", "event_id").unionByName(
        waited.select("job_id", F.col("write.event_id").alias("event_id")))


_FORGET_MS = 24 * 3600 * 1000


def _keyed_writes(key, batches, state: GroupState):
    if state.hasTimedOut:
        state.remove()
        return
    last_write, stage, n_events = state.get if state.exists else (None, None, 0)
    rows = pd.concat(list(batches)).sort_values(["event_at", "event_id"])
    out = []
    for r in rows.itertuples():
        t = int(r.event_at.timestamp() * 1000)
        is_event = isinstance(r.kind, str)
        if is_event and n_events < V.MAX_TIMELINE_EVENTS:
            n_events += 1
        must = is_event or r.stage != stage
        (keep,), last_write = _written([t], [must], last_write)
        if keep:
            stage = r.stage
            out.append((key[0], int(r.event_id), r.stage, n_events))
    state.update((last_write, stage, n_events))
    state.setTimeoutDuration(_FORGET_MS)
    yield pd.DataFrame(out, columns=["job_id", "event_id", "stage", "n_events"])


def throttled_stream(events: DataFrame) -> DataFrame:
    """Streaming form of :func:`throttle` with the capped event count.

    The state of a job goes after a day without updates.
    """
    ship_package(events.sparkSession)
    return events.groupBy("job_id").applyInPandasWithState(
        _keyed_writes, "job_id long, event_id long, stage string, n_events long",
        "last_write long, stage string, n_events long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def incremental_ingest(files: DataFrame, content: str = "content", remember: str = "30 days",
                       ingested: str = "ingested_at") -> DataFrame:
    """Stream of files: only content not seen before passes, whatever date the file bears.

    Digests are remembered for ``remember`` behind the latest ingest, which bounds the state. The time is
    that of the micro-batch (``ingested``), so no file is ever late. Content older than that is kept apart
    by the stored manifest, see :func:`ingest_into`. Spark's file source itself skips files dated more than
    ``maxFileAge`` (a week) before the newest; set that option of the reader as far as dates may go back.
    """
    return (
        files.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
        .withColumn(ingested, F.current_timestamp())
        .withWatermark(ingested, remember).dropDuplicatesWithinWatermark(["sha256"]))


def ingest_into(manifest: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: ``write`` gets the rows whose digest no earlier batch stored in ``manifest``.

    ``manifest`` is a Parquet folder with the digests of every batch in a folder of its own. A batch
    that is run again overwrites its own part and passes the same rows, so ``write`` has to be
    idempotent by batch id.
    """
    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        stored = spark.createDataFrame([], "sha256 string, batch_id long")
        where = spark._jvm.org.apache.hadoop.fs.Path(manifest)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            stored = spark.read.schema("sha256 string, batch_id long").parquet(manifest)
        known = stored.filter(F.col("batch_id").isNull() | (F.col("batch_id") != batch_id)).select("sha256")
        fresh = rows.join(known, "sha256", "left_anti").persist()
        try:
            write(fresh, batch_id)
            fresh.select("sha256").write.mode("overwrite").parquet(f"{manifest.rstrip('/')}/batch_id={batch_id}")
        finally:
            fresh.unpersist()
    return batch
