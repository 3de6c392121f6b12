"""The same audits on streams, and sinks that a repeated batch does not change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docaudit.config import DEFAULT, Settings
from docaudit.functions.text import ocr_gate
from docaudit.operators.classify import classify
from docaudit.plans.audit import audit_documents
from docaudit.sources.catalog import TYPES
from docaudit.sources.shared import passing

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def read_stream(spark: SparkSession, path: str, schema: str = DOCUMENTS, files: int | None = None) -> DataFrame:
    """Rows from Parquet files as they arrive under path, which may also be a single file; files bounds those of a batch."""
    reader = spark.readStream.schema(schema)
    # Written as a pattern, a path is not taken for the folder of a partitioned table.
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def _dealt(stream: DataFrame) -> DataFrame:
    """The rows of a stream, dealt out by id: a file of one row group, however large, would come as one task."""
    return stream.repartition(stream.sparkSession.sparkContext.defaultParallelism, "doc_id") if stream.isStreaming else stream


def audit_stream(stream: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Gate and classification of each row (doc_id, requested_type, text, ocr_confidence); no state, so batch and stream agree."""
    out = classify(ocr_gate(_dealt(stream), settings), settings)
    return out.select("doc_id", "requested_type", "gate_passed", F.when(F.col("gate_passed"), F.col("document_type")).alias("document_type"), F.when(F.col("gate_passed"), F.col("classification_confidence")).alias("classification_confidence"))


def funnel_stream(log: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, stage, status, n) of each window of a log (ts, stage, status); entries later than delay are left out."""
    out = log.withWatermark("ts", delay).groupBy(F.window("ts", width), "stage", "status").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "stage", "status", "n")


def _into(path: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Writes what make gives for a batch to a folder of its own; a batch that comes again replaces it, so that no row is lost or counted twice."""

    def each(batch: DataFrame, k: int) -> None:
        with passing(batch.sparkSession):
            make(batch).write.mode("overwrite").parquet(f"{path}/batch={k}")

    return each


def audit_sink(stream: DataFrame, path: str, checkpoint: str, settings: Settings = DEFAULT, types: tuple[str, ...] = tuple(t[0] for t in TYPES)) -> DataStreamWriter:
    """A writer of the whole audit of each batch of a stream (doc_id, requested_type, text, ocr_confidence): extraction, validation and risk too.

    It starts where its checkpoint ends. read_sink() gives the rows; sources.corpus.summarize_results() counts them.
    """
    each = _into(path, lambda batch: audit_documents(batch, settings, types=types))
    return _dealt(stream).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def funnel_sink(log: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes", width: str = "5 minutes") -> DataStreamWriter:
    """A writer of the funnel of a log (doc_id, ts, stage, status) so far: each batch adds the windows that changed.

    A document that is logged twice in a stage within the delay counts once, with its first entry. Entries of windows that
    ended before the watermark (the latest entry of earlier batches less delay) count no more; all others do, so the last
    windows are there as far as they have come. read_funnel() gives the latest count of each window.
    """
    once = log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["doc_id", "stage"])
    counts = once.groupBy(F.window("ts", width), "stage", "status").agg(F.count("*").alias("n"))
    rows = counts.select(F.col("window.start").alias("start"), "stage", "status", "n")
    return rows.writeStream.outputMode("update").foreachBatch(_into(path, lambda batch: batch)).option("checkpointLocation", checkpoint)


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """All rows that batches have written, with the number of their batch."""
    return spark.read.parquet(path)


def read_funnel(spark: SparkSession, path: str) -> DataFrame:
    """(start, stage, status, n): the latest count of each window."""
    return read_sink(spark, path).groupBy("start", "stage", "status").agg(F.max_by("n", "batch").alias("n"))
