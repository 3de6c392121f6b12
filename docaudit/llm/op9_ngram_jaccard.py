"""N-gram Jaccard join by vertical partitioning, and the classes of linked documents.

Two documents link when 4 * |A and B| >= 3 * |A or B| over their sets of distinct five-word shingles.

1. Documents with equal sets are one node, named by their smallest id; copies are never expanded into pairs.
2. Filter. In hash order a document's region is its first n/4 + 1 + n/8 tokens. A partner lacks at most n/4 of them, so
   linked documents share at least 1 + n'/8 region tokens (n' the smaller size). Documents with fewer region tokens that
   any other document holds have no partner and leave here; only regions are shuffled, not whole sets.
3. Over what is left, tokens are ordered by rarity, and the rarest n/4 + 1 of a document are its prefix: linked documents
   share a prefix token.
4. Candidates are not all pairs of a token: in rounds each document meets a few leaders of its tokens, others in each
   round, and documents that are linked become one component. Rounds go on while pairs of different components get
   fewer and are more than the prefix tokens. Of those that then pass the length, positional and bitmap bounds the most
   alike of each two components goes first; where it does not link them, all their others are verified.
5. A pair is verified by fragments: the hash order is cut into FRAGMENTS, the overlap of each fragment is counted by
   itself, and the counts are summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import Workspace, read, unique_ids
from docaudit.llm.components import components
from docaudit.llm.shingles import WordHash, shingle_set

#: Leaders of a token in a round, and of those so many at most are tried by a document.
LEADERS = 4
#: A power of two; fragments are the leading bits of a token.
FRAGMENTS = 4
#: Bits of a document's bitmap, a power of two.
BITS = 1024


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)))


def _regions(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            n, c1, c2, regions = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), known, size)
                n.append(len(s))
                both = xxhash.xxh3_128_digest(s.tobytes())
                c1.append(int.from_bytes(both[:8], "little", signed=True))
                c2.append(int.from_bytes(both[8:], "little", signed=True))
                regions.append(s[: len(s) // 4 + 1 + len(s) // 8])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), _lists(regions)], ["id", "n", "c1", "c2", "region"])

    return run


def _fragments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        cuts = np.array([k * (2**64 // FRAGMENTS) for k in range(1, FRAGMENTS)], np.uint64)
        for batch in batches:
            rows, n, f, parts, maps = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                s = shingle_set(text.as_py(), known, size)
                bits = (np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
                for k, part in enumerate(np.split(s, np.searchsorted(s, cuts))):
                    rows.append(i)
                    n.append(len(s))
                    f.append(k)
                    parts.append(part)
                    maps.append(np.packbits(bits).view(np.uint64) if k == 0 else np.empty(0, np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(n, pa.int32()), pa.array(f, pa.int32()), _lists(parts), _lists(maps)], ["id", "n", "f", "part", "bits"])

    return run


def _linkable(na: Column, nb: Column) -> Column:
    return (4 * F.least(na, nb) >= 3 * F.greatest(na, nb)) & (na > 0)


def _differ() -> Column:
    """In how many bits the bitmaps xa and xb differ.

    A bit is the parity of the shingles that fall on it, so shared ones cancel out: each bit in which two bitmaps differ
    stands for a shingle that one document lacks. Linked ones lack at most a seventh of both their sizes together, and
    pairs that differ in more bits do not link.
    """
    return reduce(add, [F.bit_count(F.get("xa", F.lit(k)).bitwiseXOR(F.get("xb", F.lit(k)))) for k in range(BITS // 64)])


def _alike(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that pass the bitmap bound."""
    maps = parts.filter("f = 0")
    left = maps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = maps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    return pairs.join(left, "a").join(right, "b").filter(7 * _differ() <= F.col("na") + F.col("nb")).select("a", "b")


def _verify(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that link: partial overlaps by fragment, summed per pair."""
    left = parts.select(F.col("id").alias("a"), F.col("n").alias("na"), "f", F.col("part").alias("pa"))
    right = parts.select(F.col("id").alias("b"), F.col("n").alias("nb"), "f", F.col("part").alias("pb"))
    each = pairs.join(left, "a").join(right, ["b", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("o"))
    return each.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o")).filter("7 * o >= 3 * (na + nb)").select("a", "b")


def _mixed(rows: DataFrame) -> DataFrame:
    """The tokens that two components hold."""
    return rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")


def _contested(rows: DataFrame) -> DataFrame:
    """The rows of tokens that two components hold; a token that one holds alone stays so."""
    return rows.join(_mixed(rows), "token")


def _with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.drop("comp").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _led(rows: DataFrame, k: int) -> DataFrame:
    """Pairs of each document with the LEADERS leaders that most of its tokens have; rows are those of contested tokens.

    Each round draws others: of each token, the document that a hash puts first in each of LEADERS parts.
    """
    drawn = rows.withColumn("draw", F.xxhash64("id", F.lit(k))).withColumn("part", F.pmod("draw", F.lit(LEADERS)))
    lead = drawn.groupBy("token", "part").agg(F.min(F.struct("draw", "id", "n", "comp")).alias("lead")).select("token", "lead")
    met = rows.join(lead, "token").filter((F.col("comp") != F.col("lead.comp")) & _linkable(F.col("n"), F.col("lead.n")))
    votes = met.groupBy("id", F.col("lead.id").alias("leader")).agg(F.count("*").alias("votes"))
    top = votes.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("votes", "leader")), False), 1, LEADERS).alias("top"))
    top = top.select("id", F.explode("top").alias("t")).select("id", F.col("t.leader").alias("leader"))
    return top.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def _left(rows: DataFrame) -> int:
    """At most so many pairs of rows of one token lie in different components, counted at each token."""
    return rows.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg((F.sum("m") ** 2 - F.sum(F.col("m") ** 2)).alias("p")).agg(F.sum("p") / 2).first()[0] or 0


def _crossing(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, ca, cb, differ): all pairs of different components that share a prefix token and pass the length, positional and bitmap bounds; rows are those of contested tokens."""
    rows = rows.join(parts.filter("f = 0").select("id", "bits"), "id")
    x = rows.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("ia"), F.col("comp").alias("ca"), F.col("bits").alias("xa"))
    y = rows.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("ib"), F.col("comp").alias("cb"), F.col("bits").alias("xb"))
    na, nb = F.col("na"), F.col("nb")
    most = F.least(na - F.col("ia"), nb - F.col("ib")) + 1
    near = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _linkable(na, nb) & (7 * most >= 3 * (na + nb))
    near = near & (7 * _differ() <= na + nb)
    # Again, for the few that are left, in a form whose code is short: with both in one stage it is too long to be compiled.
    differ = F.aggregate(F.zip_with("xa", "xb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), add)
    met = x.join(y, (x["token"] == y["token"]) & near)
    return met.select("a", "b", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), differ.alias("differ")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that labels (id, comp) leave in different components."""
    left, right = (labels.select(F.col("id").alias(x), F.col("comp").alias(f"c_{x}")) for x in "ab")
    rows = pairs.select("a", "b").join(left, "a", "left").join(right, "b", "left")
    return rows.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, known: DataFrame | None = None) -> DataFrame:
    """One row for each distinct non-null id: id_col, n_shingles, component_id (smallest id reachable by links).

    A text of fewer than `size` words is one shingle; null, empty and blank texts have none and link with nothing. Of rows
    that repeat an id, that with the greatest text counts. An empty table gives an empty result. Links known (a, b) hold
    beside those of the texts, also for ids without words or a row; what they already tie together is not compared.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "jaccard")
    docs = unique_ids(df, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    base = ws.keep(docs.mapInArrow(_regions(size), f"id {kind}, n int, c1 long, c2 long, region array<long>"), "base")
    reps = base.filter("n > 0").groupBy("c1", "c2").agg(F.min("id").alias("rep"))
    labels: DataFrame | None = None
    if known is None:
        tokens = base.select("id", "n", F.explode("region").alias("token"))
        shared = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token")
    else:
        reps = ws.keep(reps, "reps")
        equal = base.filter("n > 0").select("id", "c1", "c2").join(reps, ["c1", "c2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
        labels = components(ws, known.select("a", "b").unionByName(equal), "labels-known")
        # Linked documents of different components share region tokens that two components hold.
        tokens = _with_component(base.select("id", "n", "region"), labels).select("id", "n", "comp", F.explode("region").alias("token"))
        shared, tokens = _mixed(tokens), tokens.drop("comp")
    held = tokens.join(shared.hint("shuffle_hash"), "token").groupBy("id", "n").agg(F.count("*").alias("k"))
    least = 1 + F.floor(F.ceil(0.75 * F.col("n")) / 8)
    alive = ws.keep(held.filter(F.col("k") >= least).join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id"), "alive")

    parts = ws.keep(docs.join(alive.hint("shuffle_hash"), "id", "left_semi").mapInArrow(_fragments(size), f"id {kind}, n int, f int, part array<long>, bits array<long>"), "parts")
    tokens = parts.select("id", "n", F.explode("part").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = tokens.join(shared.hint("shuffle_hash"), "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    ordered = ordered.withColumn("alone", F.col("n") - F.size("s")).withColumn("take", F.floor(F.col("n") / 4).cast("int") + 1 - F.col("alone")).filter("take > 0")
    prefixes = ordered.select("id", "n", "alone", F.posexplode(F.slice("s", F.lit(1), F.col("take"))).alias("k", "x"))
    prefixes = ws.keep(prefixes.select("id", "n", F.col("x.token").alias("token"), (F.col("alone") + F.col("k") + 1).alias("pos")), "prefixes")

    # Rows of tokens that are still contested, with their components: written, as each round reads them several times.
    start = prefixes.withColumn("comp", F.col("id"))
    rows = ws.keep(_contested(start if labels is None else _with_component(start, labels)), "rows-0")
    before, size_of, done = None, prefixes.count(), 0
    ws.drop("prefixes", "alive")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The components of the classes so far, each row of which is a link to its least document, and the links among pairs."""
        links = ws.keep(_verify(pairs, parts), f"links-{name}")
        if labels is not None:
            links = links.unionByName(labels.select(F.col("id").alias("a"), F.col("comp").alias("b")))
        return components(ws, links, f"labels-{name}")

    # Rounds of leaders go on while they help and more pairs than prefix tokens would be left.
    while (left := _left(rows)) > size_of and (before is None or left <= 0.9 * before):
        labels, done = linked(_alike(_led(rows, done), parts), str(done)), done + 1
        rows, before = ws.keep(_contested(_with_component(rows, labels)), f"rows-{done}"), left
        ws.drop(f"rows-{done - 1}")
    pairs = ws.keep(_crossing(rows, parts), "pairs")
    first = pairs.groupBy("ca", "cb").agg(F.min(F.struct("differ", "a", "b")).alias("x")).select("x.a", "x.b")
    first = ws.keep(first, "first")
    labels = linked(first, "first")
    labels = linked(_apart(pairs.join(first, ["a", "b"], "left_anti"), labels), "rest")

    named = reps.join(labels, reps["rep"] == labels["id"], "left").select("c1", "c2", F.coalesce("comp", "rep").alias("component_id"))
    # Written, so that the join can be split where one text has very many copies.
    out = base.select("id", "n", "c1", "c2").join(ws.keep(named, "named"), ["c1", "c2"], "left")
    if known is not None:
        out = out.join(labels, "id", "left").withColumn("component_id", F.coalesce("component_id", "comp"))
    out = out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return ws.only(out, "classes")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
