"""Where jobs put tables: a folder every executor can reach."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Tables laid out by key are named in a database of their own, apart from what a user names.
_DATABASE = "turnaround_stored"
#: Whether Spark drops a query's shuffles at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: `spark.checkpoint.dir`, which the cluster names, else
    the warehouse, which driver and executors share as well."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once as Parquet and read back: later passes scan columns instead of replaying the
    lineage, and losing an executor costs no work. The shuffles of the write go with it: nothing else
    reads them, and Spark else keeps them until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    stored = spark.read.schema(df.schema).parquet(path)
    _paths[stored] = path
    return stored


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` returned, once nothing reads them any more; other frames stay."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            delete(table.sparkSession.sparkContext, path)


def delete(context: SparkContext, path: str) -> None:
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def drop_stored(spark: SparkSession) -> None:
    """Deletes what this application stored under the shared folder; for the end of a job."""
    delete(spark.sparkContext, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Full reload of a Parquet table (drop, create, append in one step)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, see `current`."""
    return spark.read.parquet(current(spark, path))


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Replaces the folder `path` by one that `write` fills beside it, only once it is whole.

    If `write` fails or the driver dies, `path` stays as it was. The swap is two renames: the old folder
    moves aside, where it stays until the next swap for readers that have begun, and the new one takes
    its place; between the two `current` points to the old one. (Object stores copy on rename.)
    """
    files, folder = _files(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    mark = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    staged = f"{path}.staged-{mark}"
    try:
        write(staged)
    except BaseException:
        files.delete(folder(staged), True)
        raise
    before = _aside(spark, path)
    if files.exists(folder(path)) and not files.rename(folder(path), folder(f"{path}.old-{mark}")):
        raise OSError(f"cannot move {path} aside")
    if not files.rename(folder(staged), folder(path)):
        raise OSError(f"cannot move {staged} to {path}")
    for old in before:
        files.delete(folder(old), True)
    return path


def publish_table(df: DataFrame, path: str) -> DataFrame:
    """Full reload of a Parquet table that a failure leaves as it was; the new table."""
    return df.sparkSession.read.parquet(publish(df.sparkSession, path, df.write.parquet))


def write_by_key(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Stores a table in `buckets` files by hash of `key`; tables stored alike join on it without a
    shuffle. Replaces what `path` holds, so give each version a path of its own."""
    df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {_DATABASE}")
    laid = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    laid.option("path", path).saveAsTable(_table_name(path))
    return df.sparkSession.table(_table_name(path))


def scan_by_key(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table that `write_by_key` stored, for a session that did not write it: the layout is stated again."""
    columns = spark.read.parquet(path).schema.toDDL()
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_DATABASE}")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_table_name(path)} ({columns}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(_table_name(path))


def _table_name(path: str) -> str:
    return f"{_DATABASE}.stored_{hashlib.md5(path.encode()).hexdigest()}"


def current(spark: SparkSession, path: str) -> str:
    """The folder to read for `path`: itself, or what a swap that was cut short has moved aside."""
    if _files(spark, path).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return path
    return max(_aside(spark, path), default=path)


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _aside(spark: SparkSession, path: str) -> list[str]:
    found = _files(spark, path).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-*"))
    return [s.getPath().toString() for s in found or []]


def write_jdbc(df: DataFrame, url: str, table: str, batch_rows: int = 5000, **options: str) -> None:
    """Reload a database table in place: truncate, then insert in batches from every partition."""
    (
        df.write.format("jdbc")
        .options(url=url, dbtable=table, truncate="true", batchsize=str(batch_rows), **options)
        .mode("overwrite")
        .save()
    )


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """Scan a database table in `partitions` parallel key ranges (rows outside the bounds are kept)."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper),
            numPartitions=str(partitions), **options,
        )
        .load()
    )


def run_sql(spark: SparkSession, text: str, views: dict[str, DataFrame]) -> DataFrame:
    """A query text over the named DataFrames, passed as arguments so no view is left behind."""
    return spark.sql(text, **views)


def list_columns(df: DataFrame) -> DataFrame:
    """Column names of a table with their position, counted from 1."""
    rows = [(i, name) for i, name in enumerate(df.columns, start=1)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string").orderBy("position")
