import random

from docaudit.llm import op6_decontaminate as bench
from docaudit.llm import op9_ngram_jaccard as near
from docaudit.llm.common import Workspace
from docaudit.llm.components import components
from tests.llm.fixtures import documents, odd_texts, table


def _lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _set(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", _lower(text or ""))
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def _classes(texts):
    sets = [_set(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def _check(spark, texts):
    got = table(near.jaccard_components(documents(spark, texts)))
    assert {k: tuple(r)[1:] for k, r in got.items()} == _classes(texts)


def test_components_of_odd_texts(spark):
    _check(spark, odd_texts())


def test_chains_and_borderline_pairs(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        words = [f"t{rng.randrange(900)}" for _ in range(rng.randrange(5, 160))]
        for _ in range(rng.randrange(1, 8)):
            texts.append(" ".join(words))
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    shared = " ".join(f"s{k}" for k in range(50))
    texts += [f"{shared} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 25))) for _ in range(25)]
    _check(spark, texts)


def test_jaccard_of_empty_and_repeated(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", None])
    assert near.jaccard_components(docs.filter("false")).count() == 0
    assert near.jaccard_components(docs.unionByName(docs)).count() == 3


def test_classes_with_known_links(spark):
    words = [f"w{k}" for k in range(60)]
    texts = {1: "another text", 2: " ".join(words), 3: " ".join(words[:-1]), 4: " ".join(words), 5: None, 6: "", 8: " ".join(reversed(words)), 9: "x y z"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    known = spark.createDataFrame([(4, 1), (6, 5), (9, 7), (7, 0), (8, 8)], "a long, b long")
    classes = lambda **given: {r.doc_id: (r.n_shingles, r.component_id) for r in near.jaccard_components(df, **given).collect()}
    alone, tied = classes(), classes(known=known)
    assert {k: c for k, (_, c) in alone.items()} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 6, 8: 8, 9: 9}
    assert {k: c for k, (_, c) in tied.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 8: 8, 9: 0}
    assert {k: n for k, (n, _) in alone.items()} == {k: n for k, (n, _) in tied.items()}
    assert classes(known=known.filter("false")) == alone


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(5, 5), (None, 3)], "a long, b long")
    got = components(Workspace(spark, "test"), links, "c").collect()
    assert {(r.id, r.comp) for r in got} == {(k, 0) for k in range(1, 61)}


def _contamination(texts, items, width=10):
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t or ""))
    out = {}
    for k, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for item, text in items:
            x = split(text)
            n = min(width, len(x))
            windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
            at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows] if windows else []
            if at:
                found.add(str(item))
                hit |= {j for i in at for j in range(i, i + n)}
        out[k] = (len(w), len(hit), len(found), sorted(found), bool(hit))
    return out


def test_contamination_matches_plain_python(spark):
    rng = random.Random(3)
    item = " ".join(f"b{rng.randrange(40)}" for _ in range(25))
    items = [(1, item), (2, "short one"), (10, "b1"), (3, None), (4, " . "), (5, item.upper()), (None, "b2")]
    texts = [*odd_texts(), f"x {item} y", item[:60], "Short, ONE!", "b1 " * 30, " ".join(item.split()[3:14]) + " tail", "short", "prefix b1"]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = table(bench.find_contamination(documents(spark, texts), df))
    assert {k: tuple(r)[1:] for k, r in got.items()} == _contamination(texts, [i for i in items if i[0] is not None])
    assert bench.find_contamination(documents(spark).filter("false"), df).count() == 0
    assert not any(r.contaminated for r in bench.find_contamination(documents(spark), df.filter("false")).collect())


def test_windows_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(k, " ".join(f"b{k}x{i}" for i in range(14))) for k in range(8)], "item_id long, text string")
    texts = [" ".join(f"b{k}x{i}" for i in range(2, 13)) for k in range(8)]
    whole = sorted(map(tuple, bench.find_contamination(documents(spark, texts), df).collect()))
    monkeypatch.setattr(bench, "BLOCK", 7)
    assert sorted(map(tuple, bench.find_contamination(documents(spark, texts), df).collect())) == whole
    assert all(r[2] == 11 for r in whole)


def test_contamination_and_classes_with_clashing_names(spark):
    names = {c: bench.F.lit(c) for c in ("_id", "_w", "_bad", "_key", "pos", "token", "id", "n", "c1", "component_id", "item_id", "window")}
    df = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").withColumns({"start": bench.F.lit(1), "len": bench.F.lit("x")})
    docs = documents(spark, ["x One two three, four five six seven", "one two three", None]).withColumns(names)
    assert [r.contaminated for r in sorted(bench.find_contamination(docs, df).collect(), key=lambda r: r.doc_id)] == [True, False, False]
    kept = bench.drop_contaminated(docs, df)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert sorted(map(tuple, near.jaccard_components(docs).collect())) == [(0, 4, 0), (1, 1, 1), (2, 0, 2)]


def test_rows_without_an_id_and_rows_that_repeat_one(spark):
    df = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "one two three four five"), (None, "y"), (3, "a one two three four five"), (3, "one two three four five one")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in bench.find_contamination(docs, df).collect())
    assert got == [("3", 12, 6, 1), ("None", 6, 5, 1)]
    assert [r.doc_id for r in bench.drop_contaminated(docs, df).collect()] == [None, None]
