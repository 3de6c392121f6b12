"""Hard negatives: for each anchor its best rows of the same label, and for each of those the best rows of other labels in a band below it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.llm.common import Workspace, read, small_batches
from docaudit.llm.lemp import LEAST, MOST, Chunk, buckets

#: Components beyond this make inner products that a long cannot hold; such input is refused.
LARGEST = 1 << 27
BLOCK = "part int, block int, b_ids binary, b_labels binary, b_vectors binary"
CHUNK = "chunk int, q_ids binary, q_labels binary, q_vectors binary, query binary, tag binary, tag_score binary, low binary, high binary"
FOUND = "vec_id long, tag long, tag_score long, score long, id long"


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 3
    #: A negative's score lies from low to high per cent of its positive's.
    low: int = 50
    high: int = 95
    scale: int = 256
    anchor_step: int = 50
    #: Rows of a block and anchors of a chunk: what a task holds at a time. They do not change results.
    block_rows: int = 4096
    chunk_anchors: int = 1024
    #: Chunks that a task takes through its blocks.
    group_chunks: int = 64


def usable(df: DataFrame, label, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, each id once, v being floor(scale * x) padded with zeros to the longest vector."""
    sound = F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("int").alias("label"), F.when(sound, v).alias("v")).dropna()
    rows = rows if rows.groupBy("vec_id").count().filter("count > 1").isEmpty() else rows.groupBy("vec_id").agg(F.max(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v")
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(dims) - F.size("v"))))


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    if np.abs(out.astype(np.int64)).max(initial=0) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST}: inner products would not fit a long")
    return out.reshape(rows, -1)


def _pack(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block = 0

        def packed(rows: pa.Table, block: int) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            cells = [rows["part"][0].as_py(), block, rows["vec_id"].to_numpy().astype(np.int64).tobytes(), rows["label"].to_numpy().astype(np.int32).tobytes(), _matrix(rows["v"].combine_chunks(), len(rows)).tobytes()]
            return pa.record_batch([pa.array([c], t) for c, t in zip(cells, (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= most:
                rows = pa.Table.from_batches(held)
                yield packed(rows.slice(0, most), block)
                held, block = rows.slice(most).to_batches(), block + 1
        if sum(map(len, held)):
            yield packed(pa.Table.from_batches(held), block)

    return run


def length_blocks(ws: Workspace, rows: DataFrame, s: Settings) -> DataFrame:
    """Rows in blocks of packed vectors, dealt by length: part 0 has the longest. The id splits lengths that many rows share."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    ranged = rows.withColumn("norm", norm).repartitionByRange(F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions(F.col("norm").desc(), "vec_id")
    blocks = ranged.select(F.spark_partition_id().alias("part"), "vec_id", "label", "v").mapInArrow(_pack(s.block_rows), BLOCK)
    return ws.keep(blocks, "blocks")


def _pack_chunk(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["vec_id", "tag"])
    queries = rows.drop_duplicates("vec_id")
    at = np.searchsorted(queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy())
    long = {c: rows[c].to_numpy(np.int64).tobytes() for c in ("tag", "tag_score", "low", "high")}
    packed = {"q_ids": queries["vec_id"].to_numpy(np.int64).tobytes(), "q_labels": queries["label"].to_numpy(np.int32).tobytes(), "q_vectors": np.stack(queries["v"].to_list()).astype(np.int32).tobytes(), "query": at.astype(np.int32).tobytes()}
    return pd.DataFrame({"chunk": [int(rows["chunk"].iloc[0])], **{k: [x] for k, x in (packed | long).items()}})


def _search(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, Chunk] = {}
        last, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["part"], row["block"]) != last:
                    ids = np.frombuffer(row["b_ids"], np.int64)
                    last, held = (row["part"], row["block"]), buckets(ids, np.frombuffer(row["b_labels"], np.int32), np.frombuffer(row["b_vectors"], np.int32).reshape(len(ids), -1).astype(np.int64))
                if row["chunk"] not in chunks:
                    ids = np.frombuffer(row["q_ids"], np.int64)
                    vectors = np.frombuffer(row["q_vectors"], np.int32).reshape(len(ids), -1).astype(np.int64)
                    wants = [np.frombuffer(row[c], np.int64) for c in ("tag", "tag_score", "low", "high")]
                    chunks[row["chunk"]] = Chunk(ids, np.frombuffer(row["q_labels"], np.int32), vectors, np.frombuffer(row["query"], np.int32), *wants, k, same)
                for bucket in held:
                    chunks[row["chunk"]].search(bucket)
        for chunk in chunks.values():
            found = np.array(chunk.found(), np.int64).reshape(-1, 5)
            yield pa.record_batch([pa.array(found[:, j]) for j in range(5)], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def search(ws: Workspace, blocks: DataFrame, wants: DataFrame, k: int, same: bool, s: Settings, name: str) -> DataFrame:
    """(vec_id, tag, tag_score, score, id, rank) of the k best rows for each want (vec_id, label, v, tag, tag_score, low, high).

    Every block meets every chunk of wants: tasks are the cells of parts x groups of chunks, and blocks and chunks travel to
    them packed. Within a cell the best so far raise the threshold from block to block; a cell gives at most k rows a want.
    """
    n = wants.select("vec_id").distinct().count()
    chunks = max(1, math.ceil(n / s.chunk_anchors))
    packed = wants.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).groupBy("chunk").applyInPandas(_pack_chunk, CHUNK)
    packed = ws.keep(packed, name)
    parts = blocks.agg(F.max("part")).first()[0] or 0
    left = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit((chunks - 1) // s.group_chunks))))
    right = packed.withColumn("grp", F.floor(F.col("chunk") / s.group_chunks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts))))
    found = left.join(right.hint("shuffle_hash"), ["part", "grp"]).drop("grp").mapInArrow(_search(k, same), FOUND)
    order = Window.partitionBy("vec_id", "tag").orderBy(F.col("score").desc(), "id")
    return ws.keep(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), f"{name}-found")


def _raised(wants: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """wants whose lower limit is the k-th best of found, where so many were found."""
    floors = found.filter(F.col("rank") == k).select("vec_id", "tag", F.col("score").alias("_floor"))
    return wants.join(floors, ["vec_id", "tag"], "left").withColumn("low", F.greatest("low", F.coalesce("_floor", "low"))).drop("_floor")


def mine(rows: DataFrame, anchors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, v); anchors are some of these rows.

    Positives, then negatives, are searched first among the longest rows, whose k-th best is the first threshold for all.
    """
    small_batches(rows.sparkSession)
    ws = Workspace(rows.sparkSession, "op12")
    rows = ws.keep(rows, "rows")
    blocks = length_blocks(ws, rows, s)
    anchors = anchors.select("vec_id").join(rows, "vec_id")

    def best(wants: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        first = search(ws, blocks.filter("part = 0"), wants, k, same, s, f"{name}-first")
        found = search(ws, blocks, _raised(wants, first, k), k, same, s, name)
        ws.drop(f"{name}-first", f"{name}-first-found", name)
        return found

    wants = anchors.select("vec_id", "label", "v", F.lit(0).cast("long").alias("tag"), F.lit(0).cast("long").alias("tag_score"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    positives = best(wants, s.positives, True, "positives")
    of = positives.select("vec_id", F.col("id").alias("tag"), F.col("score").alias("tag_score"))
    # Whole numbers from low to high per cent of the positive's score.
    band = F.expr(f"-((-{s.low} * tag_score - pmod(-{s.low} * tag_score, 100)) div 100)"), F.expr(f"({s.high} * tag_score - pmod({s.high} * tag_score, 100)) div 100")
    negatives = best(anchors.join(of, "vec_id").select("vec_id", "label", "v", "tag", "tag_score", band[0].alias("low"), band[1].alias("high")), s.negatives, False, "negatives")
    ws.drop("blocks", "rows", "positives-found")
    return negatives.select(
        F.col("vec_id").alias("anchor_id"), F.col("tag").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("tag_score").alias("positive_score"), F.col("score").alias("negative_score")
    )


def hard_negatives(df: DataFrame, label=None, settings: Settings = Settings()) -> DataFrame:
    """mine() over an embeddings table (vec_id, embedding, label), whose anchors are the ids divisible by anchor_step.

    Rows with a null label or vector, a null or non-finite component, or no id take no part. Where ids repeat, the row with
    the greatest (label, vector) stands for the id. Shorter vectors count as padded with zeros. Ties go to the smaller id.
    Anchors without a positive, and positives without a row in their band, have no rows. An empty table gives an empty one.
    Components beyond 2**27 raise an error.
    """
    rows = usable(df, F.col("label") if label is None else label, scale=settings.scale)
    return mine(rows, rows.filter(F.col("vec_id") % settings.anchor_step == 0), settings)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), moved)


SQL = """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, id, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
