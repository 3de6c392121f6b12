"""Line dedup: explode normalised lines, hash them, count distinct documents per hash, drop lines over the threshold, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import Workspace, fresh, keeping, key128, let, lower_ascii, read

BLANK = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z in lower case."""
    return lower_ascii(F.regexp_replace(line, BLANK, ""))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _places(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row (_id, _t, pos, h1, h2) for each line with a long key; _t tells apart the texts of an id that repeats."""
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_t"), F.posexplode(F.transform(_lines(text_col), line_key)).alias("pos", "key"))
    a, b = key128(F.col("key"))
    return rows.filter((F.char_length("key") >= min_chars) & F.col("_id").isNotNull()).select("_id", "_t", "pos", a.alias("h1"), b.alias("h2"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """df with text_col replaced by the lines that stay, and n_lines, n_dropped.

    A key of at least min_chars code points that at least min_docs distinct ids hold loses its lines everywhere but in
    the largest id that holds it (within that document all its lines stay). Null and empty texts are one empty line and
    come out empty. Rows that repeat an id count as one document for the threshold and each come out. A null id never
    holds a key. Input columns named n_lines or n_dropped are replaced; all others come out, whatever their names.

    The counts combine before the shuffle, so a line of every document costs one row a task; they are written, so that
    the join that brings them back is one of plain tables, which adaptive execution splits where one key is hot. Lines
    are told by their positions from there on, and texts move once, at the end.
    """
    ws = Workspace(df.sparkSession, "lines")
    rows = _places(df, id_col, text_col, min_chars)
    common = rows.groupBy("h1", "h2").agg(F.countDistinct("_id").alias("n"), F.max("_id").alias("owner")).filter(F.col("n") >= min_docs).drop("n")
    lost = rows.join(ws.keep(common, "common"), ["h1", "h2"]).filter("_id <> owner").groupBy("_id", "_t").agg(F.collect_set("pos").alias("lost"))

    df = keeping(df, "n_lines", "n_dropped")
    key, t, gone, left = fresh(df, "_id", "_t", "_lost", "_left")
    lost = ws.keep(lost, "lost").toDF(key, t, gone)
    out = df.join(lost.hint("shuffle_hash"), (F.col(id_col) == F.col(key)) & (F.xxhash64(text_col) == F.col(t)), "left").drop(key, t)
    lines = _lines(text_col)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    whole = let(lines, lambda every: F.transform(kept, lambda k: F.get(every, k)))
    out = out.withColumn(left, F.when(F.col(gone).isNull(), lines).otherwise(whole)).withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.col("n_lines") - F.size(left))
    return out.withColumn(text_col, F.array_join(left, "\n")).drop(left, gone)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), common AS (
  SELECT k, max(doc_id) AS owner FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.owner IS NOT NULL AND c.owner <> l.doc_id AS lost FROM lines l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
