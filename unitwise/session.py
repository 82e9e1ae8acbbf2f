"""Session settings the operators count on, staged tables, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One document may hold a third of all rows: let the runtime split it, also
    # where the split costs one more exchange further up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Spark's own value; queries over sheets set a lower one (see ``sources.tables``).
    "spark.sql.codegen.hugeMethodLimit": "65535",
    # Spark's own value; walks over sheets turn it on (see ``over_sorted_rows``).
    "spark.sql.execution.replaceHashWithSortAgg": "false",
}
_SHIPPED: set[str] = set()
_STAGED: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings; leaves partition counts to the cluster."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def over_sorted_rows(spark: SparkSession) -> None:
    """Aggregate rows that come dealt and sorted by their keys in one pass over the runs of equal keys."""
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")


def shared_folder(spark: SparkSession) -> str:
    """The folder driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="unitwise-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir() or own


def stage_path(spark: SparkSession, folder: str | None = None) -> str:
    """A new path below ``folder`` (the shared one by default), deleted when the application ends."""
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/stage-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged_tables() -> int:
    """A mark in the list of staged tables, for :func:`release`."""
    return len(_STAGED)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables nothing will read any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(where, True)
        files.cancelDeleteOnExit(where)
        if path in _STAGED:
            _STAGED.remove(path)


def release_unread(df: DataFrame, mark: int) -> None:
    """Delete the tables staged after a mark that ``df`` does not read."""
    read = {part for name in df.inputFiles() for part in name.split("/")}
    release(df.sparkSession, [path for path in staged_since(mark) if path.rsplit("/", 1)[1] not in read])


def staged_since(mark: int) -> list[str]:
    """Paths of the tables staged after a mark."""
    return _STAGED[mark:]


def stage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a table that several branches read once, as Parquet, and read it back.

    Later reads prune columns and survive lost executors; the files go when the application ends.
    """
    spark = df.sparkSession
    path = stage_path(spark, folder)
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, key: str) -> DataFrame:
    """As :func:`stage`, in buckets of a key: joins on the key exchange the other side only.

    The table leaves the catalog at once; the frame and what is built on it read its files.
    """
    spark = df.sparkSession
    path = stage_path(spark)
    _STAGED.append(path)
    name = f"unitwise_{path.rsplit('-', 1)[1]}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(
        name, format="parquet", path=path, compression="zstd")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for functions that run there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="unitwise-"), "unitwise.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
