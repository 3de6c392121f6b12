"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap. Chunks are pre-tokenised in parallel, each from its own start, which may lie
inside a pre-token; they resynchronise, and two neighbours are stitched at the first position in their overlap where both
start a pre-token. Only positions between a letter and a space or newline count there: no pre-token of the pattern spans
them, whatever stands before or after, so that the pieces between stitches encode as in the whole text. Where an overlap
has no such position the chunks stay together as one piece. The pieces are encoded, and ids joined by position.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.llm.common import Workspace, fresh, keeping, read, small_batches

#: Code points of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 32_768, 1_024
CUT = regex.compile(r"(?<=\p{L})(?=[ \n])")


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, one for each process."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _encoder(ranks_path: str, pattern: str):
    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(ranks_path, pattern).encode_ordinary
        for batch in texts:
            yield batch.map(lambda t: np.array(encode(t), np.int32))

    return ids


def _pretokens(pattern: str):
    """Starts of pre-tokens at which texts can be cut, counted from the chunk's start."""
    split, cut = regex.compile(pattern), CUT

    @F.pandas_udf("array<int>")
    def starts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: np.array(sorted({m.start() for m in split.finditer(t)} & {m.start() for m in cut.finditer(t)}), np.int32))

    return starts


def _pieces(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(_row, at, piece): the texts of `long` (_row, _text), cut at stitches; pieces in the order of `at`."""
    ks = F.sequence(F.lit(0), F.floor((F.char_length("_text") - 1) / chunk).cast("int"))
    chunks = long.select("_row", "_text", F.explode(ks).alias("k")).select("_row", "k", F.substring("_text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("c"))
    starts = chunks.repartition("_row", "k").withColumn("starts", _pretokens(pattern)("c"))
    w = Window.partitionBy("_row").orderBy("k")
    tail = F.transform(F.filter("starts", lambda s: s >= chunk), lambda s: s - chunk)
    head = F.filter("starts", lambda s: s < overlap)
    # A stitch is counted from the start of the next chunk; a document is the largest group here, and its chunks are a row each.
    stitched = starts.select("_row", "k", "c", tail.alias("tail"), head.alias("head"))
    stitched = stitched.withColumn("stitch", F.array_min(F.array_intersect("tail", F.lead("head").over(w))))
    stitched = stitched.withColumn("from", F.lag("stitch").over(w)).withColumn("run", F.sum(F.when(F.col("from").isNotNull(), 1).otherwise(0)).over(w))
    parts = F.array_sort(F.collect_list(F.struct("k", F.substring("c", 1, chunk).alias("body"), "from", "stitch", F.substring("c", F.lit(chunk + 1), F.lit(overlap)).alias("rest"))))
    runs = stitched.groupBy("_row", "run").agg(parts.alias("p"))
    last = F.element_at("p", -1)
    whole = F.concat(F.array_join(F.transform("p", lambda x: x["body"]), ""), F.when(last["stitch"].isNotNull(), F.substring(last["rest"], F.lit(1), last["stitch"])).otherwise(F.lit("")))
    return runs.select("_row", F.col("run").alias("at"), F.substring(whole, F.coalesce(F.col("p")[0]["from"], F.lit(0)) + 1, F.char_length(whole)).alias("piece"))


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """df with ids (array<int>), which replaces a column of that name: the tokens of each whole text, no special tokens.

    Null and empty texts have no ids. Every row comes out, repeated ones too. The rank file lies at ranks_path on every
    machine. Only texts of more than `chunk` code points are moved, as chunks; they are written to the shared folder first.
    Other columns come out as they are, whatever their names.
    """
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = keeping(df, "ids")
    row, r = fresh(rows, "_row", "_r")
    ids = _encoder(ranks_path, pattern)
    short = rows.filter(F.char_length(text) <= chunk).withColumn("ids", ids(text))
    # Written with their numbers: both sides of the join below read the same ones, whatever executors are lost.
    far = Workspace(df.sparkSession, "long").keep(rows.filter(F.char_length(text) > chunk).withColumn(row, F.monotonically_increasing_id()), "texts")
    pieces = _pieces(far.select(F.col(row).alias("_row"), F.col(text_col).alias("_text")), pattern, chunk, overlap).select(F.col("_row").alias(r), "at", ids("piece").alias("piece_ids"))
    joined = pieces.groupBy(r).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece_ids"))), lambda x: x["piece_ids"])).alias("ids"))
    return short.unionByName(far.join(joined, F.col(row) == F.col(r)).drop(row, r))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """df with decoded (binary), which replaces a column of that name: the bytes of all ids, one after another; null ids give no bytes."""

    @F.pandas_udf("binary")
    def raw(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = encoding(ranks_path, pattern).decode_bytes
        for batch in ids:
            yield batch.map(lambda x: b"" if x is None else decode(x.tolist()))

    return keeping(df, "decoded").withColumn("decoded", raw(F.col(ids_col)))


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 from ids and decoded."""
    return df.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join("ids", " "), 256), "decoded_sha256": F.sha2("decoded", 256)})


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    at, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(decode(encode(docs, at, pattern), at, pattern), at, pattern).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
