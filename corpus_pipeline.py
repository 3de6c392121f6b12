"""From raw documents to tokens: five stages, each over all that its predecessor kept and written before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import op2_quality_classifier, op3_byte_bpe, op5_line_dedup, op6_decontaminate, op9_ngram_jaccard
from docaudit.llm.common import Workspace, read

#: A part of the driver's contract; not expressible in SQL, as the first stage learns a model.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels outside the held-out fold, does not reject."""
    labels = read(spark, sf_dir, "labels").filter(~op2_quality_classifier.held_out())
    weights = op2_quality_classifier.train(docs, labels)
    return op2_quality_classifier.score(docs, weights).filter("predicted = 1").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are kept elsewhere; n_chars follows the text."""
    out = op5_line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all documents without an id.

    Documents are near copies if their texts are as line dedup left them, or were in the documents table: it leaves other
    parts of copies that share lines with others. What the join over the texts before has linked, that over the texts as
    they are now does not compare again. That with most text left is kept, as of a shared line only one document still
    has it; of equals that with the smallest id.
    """
    ws = Workspace(spark, "groups")
    first = read(spark, sf_dir, "documents").select("doc_id", "text").join(docs.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    before = op9_ngram_jaccard.jaccard_components(first).filter("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    near = op9_ngram_jaccard.jaccard_components(docs.select("doc_id", "text"), known=before)
    groups = near.select(F.col("doc_id").alias("id"), F.col("component_id").alias("comp"))
    sized = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("size"))
    sized = sized.join(groups, sized["doc_id"] == groups["id"], "left").withColumn("grp", F.coalesce("comp", "doc_id"))
    best = sized.groupBy("grp").agg(F.max(F.struct(F.col("size"), -F.col("doc_id"))).alias("b")).select((-F.col("b.col2")).alias("doc_id"))
    kept = docs.join(ws.only(best, "kept").hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return op6_decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each whole text, and digests of them and of what they decode to."""
    at, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = op3_byte_bpe.decode(op3_byte_bpe.encode(docs.select("doc_id", "text"), at, pattern), at, pattern)
    return op3_byte_bpe.digests(out, at, pattern).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_documents),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table; every stage is a table in the shared folder."""
    ws, docs = Workspace(spark, "pipeline"), read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs
