"""Benchmark decontamination: a prefix-filtered set join of item windows against documents.

A window is a run of `width` consecutive item words (the whole item where it has fewer). Its tokens are its shingles of
GRAM words, ordered by rarity over the documents. For containment of the whole window its rarest shingle is the necessary
prefix: a document that holds the window holds that shingle, at the window's start plus the shingle's offset. Documents
are tokenised in one scan, which leaves only the places of shingles that some window has, each with the words around it;
rarity is counted there, the places are joined with the prefixes alone, windows that would start before the text or end
after it are left out (length and positional bounds), and what is left is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import Workspace, lower_ascii, read

#: Runs of anything but ASCII signs, spaces and controls. Written as what it holds: the same class negated is ten times slower.
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
#: Words of a shingle; a shorter window is one shingle.
GRAM = 4
#: Shingles (8 bytes each) that are broadcast; where windows have more, places are shuffled by their shingle instead.
BLOCK = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """(item_id, window): distinct windows of each item."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    rows = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter("item_id IS NOT NULL AND size(w) > 0")
    return rows.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(width)).alias("window")).distinct()


def _shingles(w: Column, size: Column) -> Column:
    """Hashes of the shingles of `size` words, in order; none where w is shorter."""
    at = F.sequence(F.lit(1), F.size(w) - size + 1)
    return F.when(F.size(w) >= size, F.transform(at, lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<long>"))


def _places(docs: DataFrame, sizes: list[int], *also: str) -> DataFrame:
    """(_id, pos, token) and the columns of also: every shingle of the documents; pos counts from 1."""
    w = F.col("_w")
    each = docs.select("_id", *also, F.posexplode(F.concat(*[_shingles(w, F.lit(k)) for k in sizes])).alias("pos", "token"), F.size(w).alias("_n"))
    pos, before = F.lit(None).cast("int"), F.lit(0)
    for k in sizes:
        pos = F.when(F.col("pos") >= before, F.col("pos") - before + 1).otherwise(pos)
        before = before + F.greatest(F.lit(0), F.col("_n") - k + 1)
    return each.withColumn("pos", pos).drop("_n")


def _matches(docs: DataFrame, tokens: DataFrame, sizes: list[int], width: int, few: bool) -> DataFrame:
    """(_id, pos, token, lead, around): each place of a shingle that a window has; around holds the words from lead before it to width - 1 after it."""
    if few:
        found = _places(docs, sizes, "_w").join(F.broadcast(tokens), "token")
    else:
        # Places alone are shuffled; texts move only where they have one that counts.
        found = _places(docs, sizes).join(tokens.hint("shuffle_hash"), "token").groupBy("_id").agg(F.collect_set(F.struct("pos", "token")).alias("x"))
        found = found.withColumnRenamed("_id", "_key").join(docs, F.col("_key").eqNullSafe(docs["_id"])).select("_id", "_w", F.explode("x").alias("x")).select("_id", "_w", "x.pos", "x.token")
        found = found.filter(F.col("pos") <= F.size("_w"))
    lead = F.least(F.col("pos"), F.lit(width)) - 1
    return found.select("_id", "pos", "token", lead.alias("lead"), F.slice("_w", F.col("pos") - lead, lead + width).alias("around"))


def _hits(ws: Workspace, df: DataFrame, items: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(_id, start, len, window) of each occurrence of a window, start counted from 1; and the windows of the items."""
    windows = ws.keep(item_windows(items, width=width), "windows")
    parts = windows.select("window").distinct()
    parts = ws.keep(parts.select("window", F.posexplode(_shingles(F.col("window"), F.least(F.size("window"), F.lit(GRAM)))).alias("off", "token")), "parts")
    tokens = parts.select("token").distinct()
    sizes = sorted(r[0] for r in parts.select(F.least(F.size("window"), F.lit(GRAM))).distinct().collect())  # GRAM at most
    docs = df.select(F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_w"))
    matches = ws.keep(_matches(docs, tokens, sizes or [GRAM], width, tokens.count() <= BLOCK), "matches")

    # Counts are combined before they are shuffled, and written, so that the joins can be split where a shingle is hot.
    counts = ws.keep(matches.groupBy("token").agg(F.count("*").alias("n")), "counts")
    rarest = parts.join(counts, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("first"))
    prefixes = ws.keep(rarest.filter("first.n > 0").select(F.col("first.token").alias("token"), F.col("first.off").alias("off"), "window", F.size("window").alias("len")), "prefixes")
    start = F.col("lead") - F.col("off") + 1
    fits = (start >= 1) & (start + F.col("len") - 1 <= F.size("around"))
    same = F.when(fits, F.slice("around", F.greatest(start, F.lit(1)), F.col("len")) == F.col("window")).otherwise(False)
    hits = matches.join(prefixes, "token").filter(same).select("_id", (F.col("pos") - F.col("off")).alias("start"), "len", "window").distinct()
    return ws.keep(hits, "hits"), windows


def find_contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """One row a document: id_col, n_words, n_hit, n_items, item_ids (array of strings in string order), contaminated.

    Null and empty texts have no words and are never hit. Items without words and items with a null id are left out.
    Rows that repeat an id are one document whose words are the sum and whose hits are the union; rows without an id are
    one document too. Without items nothing is hit. Other columns, whatever their names, are not read.
    """
    ws = Workspace(df.sparkSession, "leaks")
    hits, windows = _hits(ws, df, items, id_col, text_col, width)
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))
    spans = hits.groupBy("_id").agg(F.collect_set(F.struct("start", "len")).alias("spans")).select("_id", F.size(covered).cast("long").alias("n_hit"))
    held = hits.select("_id", "window").distinct().join(windows, "window").groupBy("_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    by_doc = ws.keep(spans.join(held.withColumnRenamed("_id", "_key"), F.col("_id").eqNullSafe(F.col("_key")), "left").drop("_key"), "documents")
    sizes = df.groupBy(F.col(id_col).alias("_id")).agg(F.sum(F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD))).cast("long").alias("n_words"))
    return sizes.join(by_doc, sizes["_id"].eqNullSafe(by_doc["_id"]), "left").select(
        sizes["_id"].alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """df, with all its columns, without the rows of contaminated documents; rows with a null id stay."""
    hits, _ = _hits(Workspace(df.sparkSession, "leaks"), df, items, id_col, text_col, width)
    bad = hits.select(F.col("_id").alias(id_col)).distinct()
    return df.join(bad, id_col, "left_anti").select(*df.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win), grams AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN lens WHERE len(w) >= n)
), hit AS (SELECT doc_id, s, grams.n, item_id FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
