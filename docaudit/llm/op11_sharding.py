"""Sharding by a weighted hash tree: regions hold racks, racks hold shards, and each level is a weighted hash draw."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.llm.common import Workspace, fresh, keeping, read

#: Hexadecimal digits of MD5 that make a draw, and how many draws there are.
DIGITS, DRAWS = 13, 16**13


@dataclass(frozen=True)
class Tree:
    """Shards as (region, rack, shard, weight); racks and regions weigh what their shards weigh together.

    The tree is all that placement depends on beside the key. It is a fixed description of the store, not data.
    """

    leaves: tuple[tuple[int, int, int, float], ...]

    @staticmethod
    def build(shards: int, rack_size: int = 4, region_racks: int = 2) -> Tree:
        """Shards 0 to shards - 1 of weight 1, dealt to racks and regions in order."""
        return Tree(tuple((s // (rack_size * region_racks), s // rack_size, s, 1.0) for s in range(shards)))

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard, in a rack and region of its own, so that no other subtree's weight changes: rows move only into the new shard."""
        region, rack, shard = (max((leaf[k] for leaf in self.leaves), default=-1) + 1 for k in range(3))
        return Tree((*self.leaves, (region, rack, shard, weight)))

    def reweigh(self, weights: dict[int, float]) -> Tree:
        """Other weights for some shards; rows move only where a subtree's weight changes. A weight of 0 empties a shard."""
        return Tree(tuple((g, k, s, weights.get(s, w)) for g, k, s, w in self.leaves))

    def children(self) -> tuple[list, dict[int, list], dict[int, list]]:
        """(regions, racks by region, shards by rack), each node as (number, path, weight); nodes without weight are left out."""
        weight: dict[tuple, float] = defaultdict(float)
        for region, rack, shard, w in self.leaves:
            for path in ((region,), (region, rack), (region, rack, shard)):
                weight[path] += w
        nodes = [(p, (p[-1], "/".join(map(str, p)), w)) for p, w in sorted(weight.items()) if w > 0]
        below: tuple[dict, dict] = defaultdict(list), defaultdict(list)
        for path, node in nodes:
            if len(path) > 1:
                below[len(path) - 2][path[-2]].append(node)
        return [node for path, node in nodes if len(path) == 1], dict(below[0]), dict(below[1])


def _nodes(nodes: list) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(path).alias("path"), F.lit(float(w)).alias("w")) for k, path, w in nodes])


def _by_parent(children: dict[int, list], parent: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, nodes in children.items() for x in (F.lit(k), _nodes(nodes))]), parent)


def _winner(key: Column, nodes: Column) -> Column:
    """The node whose exponential arrival, at the rate of its weight and drawn from key and path, comes first; of equals the smallest number."""

    def arrival(node: Column) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), node["path"])), 1, DIGITS), 16, 10).cast("double")
        return F.struct((-F.ln((drawn + 0.5) / DRAWS) / node["w"]).alias("at"), node["k"].alias("k"))

    return F.array_min(F.transform(nodes, arrival))["k"]


def place(df: DataFrame, tree: Tree, key: Column, names: tuple[str, str, str] = ("region", "rack", "shard")) -> DataFrame:
    """df with the region, rack and shard of each row, which replace columns of these names.

    key is a string and never null; it alone and the tree decide. A node's draw depends on the key and the node's path only, so a
    changed weight moves rows into or out of that node, and what stays below unchanged nodes stays where it is. A tree
    without weight places no row: the columns are null. Narrow; the cost grows with the children on one path, not with all shards.
    """
    regions, racks, shards = tree.children()
    at, top = fresh(df, "_key", "_top")
    out = keeping(df.withColumn(at, key), *names)
    if not regions:
        return out.drop(at).withColumns(dict.fromkeys(names, F.lit(None).cast("int")))
    out = out.withColumn(top, _winner(F.col(at), _nodes(regions)))
    out = out.withColumn(names[0], F.col(top)).withColumn(names[1], _winner(F.col(at), _by_parent(racks, F.col(top))))
    return out.withColumn(names[2], _winner(F.col(at), _by_parent(shards, F.col(names[1])))).drop(at, top)


def number(ws: Workspace, df: DataFrame, group: str, order: Sequence[str], name: str = "slot") -> DataFrame:
    """df with the place of each row in its group, from 0 without gaps, in the order of the columns `order` (nulls first).

    Rows are dealt out by ranges of (group, order, a number of the row), so neither a group nor a value with a third of all
    rows meets in a task. A row's place within its range plus the rows of earlier ranges is its slot; only the count of each
    group and range (at most shuffle partitions + groups rows) is broadcast. Rows equal in `order` are numbered in any order.
    """
    own, place_, part, shift = fresh(df, "_own", "_place", "_part", "_shift")
    rows = ws.keep(keeping(df, name).withColumn(own, F.monotonically_increasing_id()), "rows")
    by = [group, *order, own]
    ranged = rows.repartitionByRange(*[F.col(c) for c in by]).sortWithinPartitions(*by).drop(own)
    ranged = ws.keep(ranged.withColumn(place_, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place_, 33)), "ranged")
    ws.drop("rows")
    counts = ranged.groupBy(group, part).agg(F.count("*").alias("_n"), F.min(place_).alias("_first"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col(group).alias("_g"), F.col(part).alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias(shift))
    met = ranged[group].eqNullSafe(shifts["_g"]) & (ranged[part] == shifts["_p"])
    return ranged.join(F.broadcast(shifts), met).withColumn(name, F.col(place_) + F.col(shift)).drop(place_, part, shift, "_g", "_p")


def shard_documents(df: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, region, rack, shard, slot, grown_shard) of each row, by the law `key`: id and tree decide.

    size is the UTF-8 bytes of the text plus 8; a null text has none and the checksum 0. grown_shard is the shard in the tree
    with one more. Rows without an id are placed by their text's checksum. Repeated rows share a shard and have a slot each;
    slots follow (id, checksum, size). An empty table gives an empty one.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_crc32").cast("string")))
    out = place(place(rows, tree, key), tree.grow(), key, ("_region", "_rack", "grown_shard")).drop("_region", "_rack")
    ws = Workspace(df.sparkSession, "op11")
    return number(ws, out, "shard", ["doc_id", "text_crc32", "size"]).withColumnRenamed("doc_id", id_col)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), Tree.build(24)).select(
        "doc_id", "size", "text_crc32", "law", "region", "rack", "shard", "slot", "grown_shard"
    )


def _race(key: str, path: str, weight: str) -> str:
    return f"-ln((('0x' || substr(md5({key} || '|' || {path}), 1, {DIGITS}))::BIGINT + 0.5) / {DRAWS}) / {weight}"


#: The law written out: the checksum by its table over the bytes, then the first arrival at each level, of 24 and of 25 shards.
SQL = f"""
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), raw AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents
), d AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(len(b) + 8 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM raw, tab
), k AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'text ' || text_crc32) AS key FROM d
), leaf AS (
  SELECT 24 AS shards, s // 8 AS region, s // 4 AS rack, s AS shard FROM (SELECT unnest(range(24)) AS s)
  UNION ALL SELECT 25, s // 8, s // 4, s FROM (SELECT unnest(range(24)) AS s) UNION ALL SELECT 25, 3, 6, 24
), regions AS (
  SELECT shards, region, count(*) AS w FROM leaf GROUP BY ALL
), racks AS (
  SELECT shards, region, rack, count(*) AS w FROM leaf GROUP BY ALL
), one AS (
  SELECT r, key, shards, arg_min(region, struct_pack(a := {_race("key", "region", "w")}, b := region)) AS region FROM k, regions GROUP BY ALL
), two AS (
  SELECT r, key, o.shards, o.region, arg_min(rack, struct_pack(a := {_race("key", "o.region || '/' || rack", "w")}, b := rack)) AS rack
  FROM one o JOIN racks ON o.shards = racks.shards AND o.region = racks.region GROUP BY ALL
), three AS (
  SELECT r, t.shards, t.region, t.rack, arg_min(shard, struct_pack(a := {_race("key", "t.region || '/' || t.rack || '/' || shard", "1.0")}, b := shard)) AS shard
  FROM two t JOIN leaf ON t.shards = leaf.shards AND t.rack = leaf.rack GROUP BY ALL
)
SELECT k.doc_id, size, text_crc32, 'key' AS law, CAST(a.region AS INTEGER) AS region, CAST(a.rack AS INTEGER) AS rack, CAST(a.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY a.shard ORDER BY k.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(b.shard AS INTEGER) AS grown_shard
FROM k JOIN three a ON k.r = a.r AND a.shards = 24 JOIN three b ON k.r = b.r AND b.shards = 25
"""
