"""Quality rules: text statistics, and cross-document line frequency by host that finds documents made of boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import WORD, Workspace, key128, let, read, words
from docaudit.llm.op5_line_dedup import line_key

SYMBOL = r"[#*$%&|<>]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _repeat_words(text: Column) -> Column:
    """Words that lie in a three-word window that the text holds twice or more."""

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - 2)
        return F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - v, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    count = lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(let(windows(w), repeated), covered))
    return let(words(text), count)


def base_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[Column, ...] = ()) -> DataFrame:
    """id_col with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each row, and the columns of also; a narrow step."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_word = F.filter(_lines(F.col(text_col)), lambda x: x.rlike(WORD))
    out = df.select(
        F.col(id_col),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(text_col)).cast("long").alias("n_repeat_words"),
        *also,
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def boilerplate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, min_percent: int = 0) -> tuple[DataFrame, DataFrame]:
    """(lines, limits passed): (_id, _t, host, pos, h1, h2) of each line with a word, and (host, h1, h2) of boilerplate lines.

    A line of a host is boilerplate when at least min_docs of its documents hold it. min_percent asks beside that for a share
    of the host's documents, so that a group of copies has another verdict on a larger host; it is 0 unless a caller wants that.
    _t tells apart the texts of an id that repeats.
    """
    host = F.coalesce(F.col(host_col), F.lit("")).alias("host")
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_t"), host, F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    a, b = key128(F.col("key"))
    rows = rows.filter(F.col("line").rlike(WORD)).withColumn("key", line_key(F.col("line"))).select("_id", "_t", "host", "pos", a.alias("h1"), b.alias("h2"))
    # Distinct documents are counted in two steps, each combined before its shuffle: no host or line meets in one task.
    held = rows.groupBy("host", "h1", "h2").agg(F.countDistinct("_id").alias("n")).filter(F.col("n") >= min_docs)
    sizes = df.select(F.col(id_col).alias("_id"), host).groupBy("host").agg(F.countDistinct("_id").alias("host_docs"))
    return rows, held.join(sizes, "host").filter(100 * F.col("n") >= min_percent * F.col("host_docs")).select("host", "h1", "h2")


def apply_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, min_percent: int = 0, max_lost_percent: int = 50) -> DataFrame:
    """base_rules() with text_col without its boilerplate lines, n_lost_words, n_lost_lines (what that takes), depleted and kept.

    A document is depleted when boilerplate lines hold more than max_lost_percent of its words; it is kept when neither
    base_failed nor depleted. base_rules() and max_lost_percent are about the text as it came; the lines that stay are
    joined in their order. Null and empty texts have no words, stay as they are and fail. A null host is the host "".
    Distinct ids are counted, so repeated rows of an id do not make a line frequent; each row comes out, with what it
    loses itself. Rows without an id lose nothing. Other columns are not read and do not come out.

    Boilerplate lines and the positions that each text loses are written tables: joins with them can be split where a
    line or a host is hot, and their shuffles are gone before the texts move, once, to the positions they lose.
    """
    ws = Workspace(df.sparkSession, "rules")
    rows, bad = boilerplate(df, id_col, text_col, host_col, min_docs, min_percent)
    lost = ws.keep(rows.join(ws.keep(bad, "bad"), ["host", "h1", "h2"]).groupBy("_id", "_t").agg(F.collect_set("pos").alias("_lost")), "lost")
    base = base_rules(df, id_col, text_col, (F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_key")))
    out = base.join(lost.hint("shuffle_hash"), (base[id_col] == lost["_id"]) & (F.col("_key") == F.col("_t")), "left").drop("_id", "_t", "_key")

    every = _lines(F.col("_text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("_lost"))
    clean = let(every, lambda lines: F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n"))
    out = out.withColumn("_clean", F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(clean))
    gone = lambda n: F.when(F.col("_lost").isNotNull(), n).otherwise(0).cast("long")
    out = out.withColumn("n_lost_words", gone(F.col("n_words") - F.regexp_count("_clean", F.lit(WORD))))
    out = out.withColumn("n_lost_lines", gone(F.size("_lost"))).withColumn(text_col, F.col("_clean")).drop("_lost", "_text", "_clean")
    out = out.withColumn("depleted", 100 * F.col("n_lost_words") > max_lost_percent * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), min_percent=5).drop("text")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)
), grams AS (
  SELECT doc_id, s, array_to_string(w[s:s + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) > 2)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS r FROM (
    SELECT doc_id, unnest([s, s + 1, s + 2]) AS p FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
  ) GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE n > 0 GROUP BY doc_id
), sizes AS (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host
), bad AS (
  SELECT l.host, l.k FROM lines l JOIN sizes USING (host) WHERE l.n > 0 GROUP BY l.host, l.k, docs
  HAVING count(DISTINCT doc_id) >= 20 AND 100 * count(DISTINCT doc_id) >= 5 * docs
), lost AS (
  SELECT doc_id, sum(n)::BIGINT AS n_lost_words, count(*) AS n_lost_lines FROM lines JOIN bad ON lines.host = bad.host AND lines.k = bad.k WHERE n > 0 GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words,
    coalesce(n_lost_words, 0) AS n_lost_words, coalesce(n_lost_lines, 0) AS n_lost_lines
  FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_lost_words > 50 * n_words AS depleted,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * n_lost_words > 50 * n_words) AS kept
FROM base
"""
