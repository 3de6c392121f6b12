"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates, sparse scores."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import keeping, read

#: Words and runs of other signs, each a token.
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Longest n-gram that is looked at for a repeated word.
REACH = 6


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    #: Bound of the sample that is learned from; the share of labelled rows that meets it is taken by hash.
    max_rows: int = 20_000
    #: The sample is learned in parts of about so many rows, each by one task, and their weights are averaged.
    part_rows: int = 2_500
    epochs: int = 5
    alpha: float = 8.0
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.05


class _Tokens(dict):
    """Hash of each token, remembered for up to so many."""

    MOST = 300_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[token] = h = zlib.crc32(token.encode("utf-8", "replace")) * 0x9E3779B1 & 0xFFFFFFFF
        return h


def features(text: str | None, known: _Tokens, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of one text: hashed unigrams, bigrams and repeats, roots of counts scaled by the text; bucket 0 is the intercept."""
    tokens = TOKEN.findall(text or "")
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    two = (h[:-1] * np.uint64(0x85EBCA6B) + h[1:] * np.uint64(0xC2B2AE35) + np.uint64(1)) & np.uint64(0xFFFFFFFF)
    # An n-gram that ends in the word it starts with is the same feature whatever the word is.
    again = [np.full(np.count_nonzero(h[k:] == h[:-k]), 0x9E3779B1 * k & 0xFFFFFFFF, np.uint64) for k in range(1, REACH + 1)]
    every = np.concatenate([h, (two * np.uint64(0x27D4EB2F)) & np.uint64(0xFFFFFFFF), *again])
    at, counts = np.unique((every >> np.uint64(32 - bits)).astype(np.int64), return_counts=True)
    value = np.sqrt(counts)
    norm = np.sqrt(counts.sum()) or 1.0
    return np.concatenate([[0], at[at > 0]]), np.concatenate([[1.0], value[at > 0] / norm])


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _learn(s: Settings):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known = _Tokens()
        rows = rows.sort_values("_o")
        examples = [(*features(t, known, s.bits), y) for t, y in zip(rows["text"], rows["y"], strict=True)]
        z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)

        def weights(at: np.ndarray) -> np.ndarray:
            return np.where(np.abs(z[at]) <= s.l1, 0.0, -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

        for _ in range(s.epochs):
            for at, x, y in examples:
                w = weights(at)
                g = (_sigmoid(float(w @ x)) - y) * x
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
                z[at] += g - sigma * w
                n[at] += g * g
        w = weights(np.arange(1 << s.bits))
        at = np.flatnonzero(w)
        return pd.DataFrame({"bucket": at, "w": w[at]})

    return run


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings()) -> np.ndarray:
    """The weights, 2**bits of them, learned from the labelled rows of df; the caller leaves held-out rows out of labels.

    At most about max_rows rows are learned from: the share is set from the number of labels, and rows are taken by the
    hash of their id. Null labels count for nothing. Without labels all weights are 0. Only the weights reach the driver.
    """
    s = settings
    labels = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).filter("y IS NOT NULL AND _id IS NOT NULL").dropDuplicates(["_id"])
    n = labels.count()
    share = min(1.0, s.max_rows / max(n, 1))
    taken = labels.withColumn("_o", F.xxhash64("_id")).filter(F.pmod("_o", F.lit(1_000_000)) < int(share * 1_000_000))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(taken.hint("shuffle_hash"), "_id")
    parts = max(1, round(min(n, s.max_rows) / s.part_rows))
    rows = rows.withColumn("part", F.pmod(F.shiftright("_o", 20), F.lit(parts)))
    learned = rows.groupBy("part").applyInPandas(_learn(s), "bucket long, w double")
    mean = learned.groupBy("bucket").agg((F.sum("w") / parts).alias("w")).toPandas()
    weights = np.zeros(1 << s.bits, np.float32)
    weights[mean["bucket"].to_numpy(np.int64)] = mean["w"].to_numpy()
    return weights


def score(df: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= threshold), which replace columns of these names.

    Each text is scored whole, as a sparse dot product. Null and empty texts get the score of the intercept alone.
    """
    bits = int(len(weights)).bit_length() - 1
    shared = df.sparkSession.sparkContext.broadcast(weights)  # 2**bits floats, whatever the input

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, w = _Tokens(), shared.value
        for batch in texts:
            out = np.empty(len(batch))
            for i, text in enumerate(batch):
                at, x = features(text, known, bits)
                out[i] = _sigmoid(float(w[at] @ x))
            yield pd.Series(out)

    return keeping(df, "score", "predicted").withColumn("score", scored(F.col(text_col))).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, read(spark, sf_dir, "labels").filter(~held_out()))
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", "predicted")
