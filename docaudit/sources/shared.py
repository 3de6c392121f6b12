"""Tables in the folder that driver and executors share, which cut lineage and can be split and pruned."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, one of our own, if all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-docaudit-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Folders made inside passing().
_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes with all that is in it when the driver ends, or when passing() does."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = hadoop_path(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    if _MADE.get() is not None:
        _MADE.get().append(path)
    return path


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at its end: what is made of them has to be written inside as well."""
    token = _MADE.set([])
    try:
        yield
    finally:
        for path in _MADE.get():
            files, at = hadoop_path(spark, path)
            files.delete(at, True)
        _MADE.reset(token)


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, written to a folder of its own and read again; by names a column that partitions it, so that readers of some values skip the rest."""
    path = f"{own_folder(df.sparkSession, name)}/rows"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_by_document(df: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """df as a table of the warehouse (or at path), bucketed and sorted by doc_id: tables stored with as many buckets are joined and grouped by it without a shuffle."""
    out = df.write.bucketBy(buckets, "doc_id").sortBy("doc_id").mode("overwrite")
    (out.option("path", path) if path else out).saveAsTable(table)
    return df.sparkSession.table(table)
