"""Language identification: known words by per-language log frequency, unseen words by progressively shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.llm.common import fresh, keeping, read

#: A letter and the letters and combining marks that follow it; learned and scored are the same words.
WORDS = r"\p{L}[\p{L}\p{M}]*"
#: What a language does not have counts as this part of one occurrence.
UNSEEN = 0.5


@dataclass(frozen=True)
class Settings:
    #: Bound of the sample that is learned from; the share of labelled rows that meets it is taken by hash.
    max_rows: int = 20_000
    #: Bounds of the model: so many words, and n-grams of each length, shared out evenly among the languages; each has its most
    #: frequent. None for all there are.
    max_words: int | None = 60_000
    max_grams: int | None = 20_000
    #: Bound of the table of log frequencies, in which a word has a number for each language; None for no bound.
    max_bytes: int | None = 256 << 20
    #: A word is known from so many occurrences on.
    min_count: int = 3
    longest: int = 4


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray  # a row for each word or n-gram: log frequency in each language
    longest: int
    #: Words and n-grams seen often enough that the bounds left out; None where nobody asked.
    cut: int | None = None


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def _shares(s: Settings, n_langs: int) -> tuple[int | None, int | None]:
    """Words, and n-grams of each length, that a language has."""
    if s.max_words is None or s.max_grams is None or s.max_bytes is None:
        return tuple(None if most is None else max(1, most // n_langs) for most in (s.max_words, s.max_grams))
    part = min(1.0, s.max_bytes / (8 * n_langs * max(1, s.max_words + s.longest * s.max_grams)))
    return max(1, int(s.max_words * part) // n_langs), max(1, int(s.max_grams * part) // n_langs)


def _counts(rows: DataFrame, key: str, most: int | None, least: int) -> DataFrame:
    """(lang, key, n) of the keys that are among the `most` most frequent of some language, ties in key order, of rows (lang, key, n).

    The best of each part of a language come first, so that the vocabulary of a hot one does not meet in one task.
    """
    each = rows.groupBy("lang", key).agg(F.sum("n").alias("n"))
    often = each.groupBy(key).agg(F.sum("n").alias("total")).filter(F.col("total") >= least).select(key)
    if most is None:
        return each.join(often, key).select("lang", F.col(key).alias("key"), "n")
    best = each.join(often, key).withColumn("part", F.pmod(F.hash(key), F.lit(64)))
    for by in (("lang", "part"), ("lang",)):
        best = best.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), key))).filter(F.col("r") <= most)
    return each.join(best.select(key).distinct(), key).select("lang", F.col(key).alias("key"), "n")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings(), count_cut: bool = False) -> Model:
    """The model of the rows of df that have a language and a text; the caller leaves held-out rows out.

    At most about max_rows rows are learned from, taken by the hash of their id. What reaches the driver is bounded by the
    words and n-grams of each language, whatever the input; a rare language has as many of them as a frequent one. count_cut
    has how many the bounds leave out counted in Model.cut, at the cost of counting all words and n-grams once more.
    """
    s = settings
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    share = min(1.0, s.max_rows / max(rows.count(), 1))
    rows = rows.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # N-grams are taken from the distinct words, each with its count.
    counted = rows.select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    n_langs = max(1, rows.select("lang").distinct().count())
    n_words, n_grams = _shares(s, n_langs)
    parts = [_counts(counted, "word", n_words, s.min_count).withColumn("size", F.lit(0))]
    seen = counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= s.min_count).agg(F.count("*").alias("c"))
    for size in range(1, s.longest + 1):
        padded = F.concat(F.lit("_"), "word", F.lit("_"))
        grams = counted.withColumn("p", padded).filter(F.char_length("p") >= size)
        grams = grams.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("p") - size + 1), lambda i: F.substring("p", i, F.lit(size)))).alias("gram"))
        parts.append(_counts(grams, "gram", n_grams, 1).withColumn("size", F.lit(size)))
        seen = seen.unionByName(grams.agg(F.countDistinct("gram").alias("c")))
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    got = got.toPandas()
    langs = sorted(got["lang"].unique().tolist())
    if not langs:
        return Model([], {}, {}, np.zeros((0, 0)), s.longest)
    known: tuple[dict, dict] = ({}, {})
    logs = []
    for size, part in got.groupby("size"):
        table = part.pivot_table(index="key", columns="lang", values="n", aggfunc="sum", fill_value=0).reindex(columns=langs, fill_value=0)
        totals = np.maximum(table.to_numpy(float).sum(axis=0), 1.0)
        for key in table.index:
            known[size > 0][key] = len(known[0]) + len(known[1])
        logs.append(np.log(np.maximum(table.to_numpy(float), UNSEEN) / totals))
    cut = (seen.agg(F.sum("c")).first()[0] or 0) - len(known[0]) - len(known[1]) if count_cut else None
    return Model(langs, known[0], known[1], np.concatenate(logs), s.longest, cut)


class _Known(dict):
    """Log frequencies of each word, remembered for up to so many words that the model lacks: a table of at most BYTES."""

    MOST, BYTES = 400_000, 64 << 20

    def __init__(self, model: Model):
        most = max(1_000, min(self.MOST, self.BYTES // (8 * max(1, len(model.langs)))))
        self.m, self.rows = model, np.concatenate([model.logs, np.zeros((most, len(model.langs)))])
        self.start()

    def start(self) -> None:
        self.clear()
        self.update(self.m.words)
        self.end = len(self.m.logs)

    def __missing__(self, word: str) -> int:
        if self.end >= len(self.rows):
            raise OverflowError
        self.rows[self.end] = self.backoff(f"_{word}_")
        self[word] = at = self.end
        self.end += 1
        return at

    def backoff(self, padded: str) -> np.ndarray:
        """The mean over positions of the longest known n-gram that starts there."""
        total, n, grams = np.zeros(len(self.m.langs)), 0, self.m.grams
        for i in range(len(padded)):
            for size in range(min(self.m.longest, len(padded) - i), 0, -1):
                at = grams.get(padded[i : i + size])
                if at is not None:
                    total += self.m.logs[at]
                    n += 1
                    break
        return total / max(n, 1)


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score, which replace columns of these names.

    lang_pred is the language with the greatest sum of log frequencies over all words of the whole text, the first in
    string order where several are equal, and score its share among the languages by the mean over the words. Null texts
    and texts without a letter, and every text where the model has no language, are "und" with score 0. Rows that repeat
    come out each; other columns come out as they are, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by Settings

    @F.pandas_udf("lang_pred string, score double")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        known = _Known(m)
        for batch in texts:
            langs, scores = [], []
            for text in batch:
                words = text.split(" ") if text else []
                if not words or not m.langs:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = np.zeros(len(m.langs))
                for k in range(0, len(words), 1_000):
                    part = words[k : k + 1_000]
                    try:
                        at = np.fromiter(map(known.__getitem__, part), np.int64, len(part))
                    except OverflowError:
                        known.start()
                        at = np.fromiter(map(known.__getitem__, part), np.int64, len(part))
                    total += known.rows.take(at, axis=0).sum(axis=0)
                best = int(np.argmax(total))
                mean = total / len(words)
                langs.append(m.langs[best])
                scores.append(float(1.0 / np.exp(mean - mean[best]).sum()))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    out = keeping(df, "lang_pred", "score")
    (got,) = fresh(out, "_found")
    # The words come from the JVM, cut and lower-cased as those that were learned.
    out = out.withColumn(got, found(F.array_join(words(F.col(text_col)), " ")))
    return out.withColumns({"lang_pred": F.col(got)["lang_pred"], "score": F.col(got)["score"]}).drop(got)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
