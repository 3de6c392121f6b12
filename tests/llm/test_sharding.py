import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from docaudit.llm import op11_sharding as sharding
from docaudit.llm.op11_sharding import Tree
from tests.llm.fixtures import documents, odd_texts


def _walk(tree, key):
    """The descent in plain Python."""
    leaves = [leaf for leaf in tree.leaves if leaf[3] > 0]
    for depth in range(1, 4):
        weights = defaultdict(float)
        for leaf in leaves:
            weights[leaf[:depth]] += leaf[3]
        drawn = {p: (int(hashlib.md5(f"{key}|{'/'.join(map(str, p))}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13 for p in weights}
        best = min(weights, key=lambda p: (-math.log(drawn[p]) / weights[p], p))
        leaves = [leaf for leaf in leaves if leaf[:depth] == best]
    return leaves[0][:3]


def _placed(spark, tree, n=4000):
    df = spark.range(n).select("id", F.lit("clash").alias("rack"))
    rows = sharding.place(df, tree, F.col("id").cast("string")).collect()
    return {r["id"]: (r["region"], r["rack"], r["shard"]) for r in rows}


def test_descent_and_growth(spark):
    tree = Tree.build(24).reweigh({3: 2.5, 9: 0.0})
    before = _placed(spark, tree)
    assert before == {k: _walk(tree, str(k)) for k in range(4000)}
    held = Counter(x[2] for x in before.values())
    assert held[9] == 0 and all(0.7 < held[s] / (4000 / 24.5) / (2.5 if s == 3 else 1) < 1.3 for s in range(24) if s != 9)
    grown = tree
    for _ in range(3):
        last, grown = grown, grown.grow()
        was, now = _placed(spark, last), _placed(spark, grown)
        moved = {k for k in now if now[k] != was[k]}
        assert moved and all(now[k][2] == len(grown.leaves) - 1 for k in moved)


def test_other_weights_move_rows_only_where_a_subtree_changed(spark):
    tree = Tree.build(24)
    was = _placed(spark, tree)
    for weight in (3.0, 0.2, 0.0):
        now = _placed(spark, tree.reweigh({5: weight}))
        for k in now:
            if was[k] != now[k]:
                # What changes region enters (or leaves) that of shard 5; within it, what changes rack that of shard 5; and so on.
                depth = next(d for d in range(3) if was[k][d] != now[k][d])
                assert (now[k] if weight > 1 else was[k])[depth] == (0, 1, 5)[depth]
        assert any(now[k] != was[k] for k in now)


def test_every_row_has_a_slot(spark):
    texts = odd_texts()
    df = documents(spark, texts).unionByName(documents(spark, texts[:4])).unionByName(documents(spark, [None, "x", "x"]).withColumn("doc_id", F.lit(None).cast("long")))
    hot = df.unionByName(spark.range(300).select(F.lit(3).cast("long").alias("doc_id"), F.lit("hot").alias("text"), *[F.lit(None).alias(c) for c in ("lang", "source", "n_chars", "score", "n_words")]))
    rows = sharding.shard_documents(hot.withColumn("slot", F.lit("clash")).withColumn("shard", F.lit("clash")), Tree.build(24)).collect()
    assert len(rows) == hot.count()
    slots, by_id = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
        by_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    for got in slots.values():
        got.sort()
        assert [x[0] for x in got] == list(range(len(got))) and [x[1:] for x in got] == sorted(x[1:] for x in got)
    assert all(len(x) == 1 for k, x in by_id.items() if k is not None)
    first = {r["doc_id"]: r for r in rows if r["doc_id"] is not None and r["doc_id"] > 10}
    for k, text in enumerate(texts):
        if k > 10:
            assert (first[k]["size"], first[k]["text_crc32"]) == (len((text or "").encode()) + 8, zlib.crc32((text or "").encode()))
    assert sharding.shard_documents(hot.limit(0), Tree.build(24)).collect() == []
    assert sharding.place(hot, Tree(()), F.lit("a")).filter("shard IS NOT NULL").isEmpty()
