"""What the training-data operators share: tables in the shared folder, words, clashing names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.sources.shared import hadoop_path, own_folder

#: Words are runs of anything but space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Seed of the second half of 128-bit keys.
SALT = "docaudit-2"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Batches that go to Python hold at most so many rows and bytes, so that a worker's memory does not depend on how long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


class Workspace:
    """Tables written to the shared folder, to cut lineage. Those no longer needed go at once, the last ones when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, own_folder(spark, name)
        # Shuffle files go when the query that wrote them ends; else they stay until the driver collects its garbage.
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            files, path = hadoop_path(self.spark, self.path(name))
            files.delete(path, True)

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """df, written, after which the other tables of the workspace go."""
        out = self.keep(df, name)
        files, root = hadoop_path(self.spark, self.root)
        for status in files.listStatus(root):
            if status.getPath().getName() != name:
                files.delete(status.getPath(), True)
        return out


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def key128(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: at billions of keys one alone would collide."""
    return F.xxhash64(text), F.xxhash64(F.lit(SALT), text)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keeping(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator's output columns would clash with."""
    return df.drop(*[c for c in df.columns if c in names])


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that df does not have, for columns that an operator needs on the way."""
    used = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in used:
            stem += "_"
        out.append(stem)
    return out


def unique_ids(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df as (id_col, text_col) with each non-null id once: where ids repeat, the row with the greatest text."""
    rows = df.select(id_col, text_col).filter(F.col(id_col).isNotNull())
    if rows.groupBy(id_col).count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy(id_col).agg(F.max(text_col).alias(text_col))
