"""Removal of byte strings that start earlier too, by sampled suffixes whose order decides that of the windows around them.

The bytes of all texts have one suffix each; to sort them all would move sixteen times the text. As in induced sorting,
only a sample is moved: the smallest hash of 32 bytes in each window of 100 bytes. All windows that share a sampled suffix
form one segment, and whatever equals one of them has the same sampled suffix at the same offset.

1. Sampled suffixes that occur once are left out; their windows occur once as well.
2. Equal segments are compared by hash: each but the first is covered whole.
3. First segments with a sampled suffix that other first segments have too may share some of their windows. Their bytes
   are fetched; windows fall into four quarters by their offset, each with a core of bytes that all its windows hold, and
   windows of cores that occur once are left out. The others are compared one by one.
4. Covered bytes are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.llm.common import SALT, Workspace, read, unique_ids
from docaudit.llm.windows import segments

WINDOW, LEVEL = 100, 5
SAMPLE = 1 << LEVEL
#: Offsets of a sampled suffix in its window run from 0 to SPAN.
SPAN = WINDOW - SAMPLE
QUARTERS = 4


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, parts = [], []
        for i, text in enumerate(batch.column(1)):
            data = np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), np.uint8)
            if len(data) >= WINDOW:
                parts.append(got := segments(data, WINDOW, LEVEL))
                rows.append(np.full(len(got[0]), i, np.int32))
        if parts:
            start, length, anchor, mh, sh = (np.concatenate(x) for x in zip(*parts, strict=True))
            place = start << 20 | length << 10 | anchor
            ids = batch.column(0).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(place), pa.array(mh.view(np.int64)), pa.array(sh.view(np.int64))], ["id", "place", "mh", "sh"])


_FETCHED = T.ArrayType(T.StructType([T.StructField("place", T.LongType()), T.StructField("mh", T.LongType()), T.StructField("bytes", T.BinaryType())]))
_KEPT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


@F.pandas_udf(_FETCHED)
def _fetch(texts: pd.Series, wanted: pd.Series) -> pd.Series:
    out = []
    for text, places in zip(texts, wanted, strict=True):
        data = text.encode("utf-8", "replace")
        out.append([{"place": x["place"], "mh": x["mh"], "bytes": data[(s := x["place"] >> 20) : s + (x["place"] >> 10 & 1023)]} for x in places])
    return pd.Series(out)


@F.pandas_udf(_KEPT)
def _remove(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, covers in zip(texts, spans, strict=True):
        data = (text or "").encode("utf-8", "replace")
        removed = n = 0
        kept, at = [], 0
        for x in [] if covers is None else covers:  # sorted by start
            start, end = x["s"], x["e"]
            if start > at or not n:
                kept.append(data[at:start])
                n, removed, at = n + 1, removed + end - start, end
            elif end > at:
                removed, at = removed + end - at, end
        kept.append(data[at:])
        rows.append((len(data), removed, n, b"".join(kept)))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])


def _windows(first: DataFrame) -> DataFrame:
    """(id, pos, w1, w2): windows of first segments whose quarter's core occurs in two of these segments or more."""
    anchor, length = F.col("place").bitwiseAND(1023), F.shiftright("place", 10).bitwiseAND(1023)
    rows = first.select("id", "mh", "bytes", F.shiftright("place", 20).alias("start"), anchor.cast("int").alias("anchor"), length.cast("int").alias("length"))
    # A window at offset d before the sampled suffix holds d bytes to its left and SPAN - d to the right of it.
    lows = F.array(*[F.lit(q * (SPAN + 1) // QUARTERS) for q in range(QUARTERS)])
    highs = F.array(*[F.lit((q + 1) * (SPAN + 1) // QUARTERS - 1) for q in range(QUARTERS)])
    quarter = rows.select("*", F.explode(F.arrays_zip(lows.alias("lo"), highs.alias("hi"))).alias("q")).select("id", "mh", "bytes", "start", "anchor", "length", F.col("q.lo").alias("lo"), F.col("q.hi").alias("hi"))
    # Windows of the segment start at 0 .. length - WINDOW; those of the quarter at anchor - hi .. anchor - lo.
    quarter = quarter.withColumn("a", F.greatest(F.lit(0), F.col("anchor") - F.col("hi"))).withColumn("b", F.least(F.col("length") - WINDOW, F.col("anchor") - F.col("lo"))).filter("a <= b")
    core = F.substring("bytes", F.col("anchor") - F.col("lo") + 1, F.lit(SAMPLE + SPAN) - F.col("hi") + F.col("lo"))
    quarter = quarter.withColumn("core", F.xxhash64("lo", "mh", core))
    twice = quarter.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    each = quarter.join(twice, "core").select("id", "start", "bytes", F.explode(F.sequence("a", "b")).alias("i"))
    window = F.substring("bytes", F.col("i") + 1, F.lit(WINDOW))
    return each.select("id", (F.col("start") + F.col("i")).alias("pos"), F.xxhash64(window).alias("w1"), F.xxhash64(F.lit(SALT), window).alias("w2"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct non-null id: id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary).

    A byte goes when a string of WINDOW bytes that covers it starts earlier too: in a smaller id, or in the same text at
    an earlier start; strings are judged on the input, overlap, and never cross texts. Null and empty texts, and those
    shorter than WINDOW bytes, lose nothing. Of rows that repeat an id, that with the greatest text counts.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "repeats")
    docs = unique_ids(df, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    every = docs.mapInArrow(_segments, f"id {kind}, place long, mh long, sh long")
    # Aggregates are written before they are joined: a join of plain tables is split where one suffix is hot.
    common = ws.keep(every.groupBy("mh").agg(F.count("*").alias("n")).filter("n > 1").select("mh"), "common")
    repeated = ws.keep(every.join(common, "mh"), "repeated")
    ws.drop("common")

    firsts = repeated.groupBy("mh", "sh").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n"))
    firsts = ws.keep(firsts.select("mh", "sh", F.col("first.id").alias("id"), F.col("first.place").alias("place"), "n"), "firsts")
    many = firsts.filter("n > 1").select("mh", "sh", F.col("id").alias("first_id"), F.col("place").alias("first_place"))
    later = repeated.join(many, ["mh", "sh"]).filter("id <> first_id OR place <> first_place")
    start = F.shiftright("place", 20)
    whole = later.select("id", start.alias("s"), (start + F.shiftright("place", 10).bitwiseAND(1023)).alias("e"))

    mixed = ws.keep(firsts.groupBy("mh").agg(F.count("*").alias("n")).filter("n > 1").select("mh"), "mixed")
    wanted = firsts.join(mixed, "mh").groupBy("id").agg(F.collect_list(F.struct("place", "mh")).alias("wanted"))
    fetched = docs.join(wanted.hint("shuffle_hash"), "id").select("id", F.explode(_fetch("text", "wanted")).alias("x")).select("id", "x.*")
    windows = ws.keep(_windows(ws.keep(fetched, "fetched")), "windows")
    ws.drop("fetched", "mixed")
    earliest = windows.groupBy("w1", "w2").agg(F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    earliest = ws.keep(earliest, "earliest")
    again = windows.join(earliest, ["w1", "w2"]).filter("id <> first.id OR pos <> first.pos").select("id", F.col("pos").alias("s"), (F.col("pos") + WINDOW).alias("e"))

    covers = whole.unionByName(again).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    covers = ws.keep(covers, "covers")
    ws.drop("repeated", "firsts", "windows", "earliest")
    out = docs.join(covers.hint("shuffle_hash"), "id", "left").select(F.col("id").alias(id_col), _remove("text", "spans").alias("x"))
    return out.select(id_col, "x.*")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """The same on a few texts in plain Python, for tests."""
    seen: set[bytes] = set()
    out = {}
    for key, text in sorted(rows):
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for i in range(len(data) - window + 1):
            if (w := data[i : i + window]) in seen:
                covered[i : i + window] = True
            seen.add(w)
        spans = int(np.count_nonzero(covered & ~np.r_[False, covered[:-1]])) if len(data) else 0
        out[key] = (len(data), int(covered.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~covered])).hexdigest())
    return out
