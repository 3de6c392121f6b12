import math
from collections import Counter

import numpy as np

from docaudit.llm import lemp
from docaudit.llm import op12_hard_negatives as mining
from docaudit.llm.op12_hard_negatives import Settings

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, v string"


def _brute(rows, s):
    kept = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = max(kept.get(i, (-1, [])), (label, [math.floor(s.scale * float(x)) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(kept[a][1], kept[b][1], strict=False))
    out = Counter()
    for a in (i for i in kept if i % s.anchor_step == 0):
        scores = {b: dot(a, b) for b in kept if b != a}
        order = sorted(scores, key=lambda b: (-scores[b], b))
        for p in [b for b in order if kept[b][0] == kept[a][0]][: s.positives]:
            band = [b for b in order if kept[b][0] != kept[a][0] and s.low * scores[p] <= 100 * scores[b] <= s.high * scores[p]]
            out.update((a, p, k + 1, b, scores[p], scores[b]) for k, b in enumerate(band[: s.negatives]))
    return out


def _compare(spark, rows, s):
    df = spark.createDataFrame([(i, v, label, "clash", "clash") for i, v, label in rows], SCHEMA)
    got = Counter(tuple(r) for r in mining.hard_negatives(df.repartition(3), settings=s).collect())
    assert got == _brute(rows, s)
    return got


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    means = rng.normal(size=(4, 6))
    rows = [(k, [float(x) for x in np.float32(means[k % 4] * rng.choice([0.5, 1, 3]) + rng.normal(size=6) * 0.4)], int(rng.integers(0, 4))) for k in range(500)]
    hot = [(1000 + k, rows[9][1], k % 2) for k in range(120)]
    odd = [
        (2000, None, 1), (2001, [1.0] * 6, None), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2003, [float("nan")] * 6, 1), (2004, [float("inf")] + [0.0] * 5, 1), (None, [1.0] * 6, 1),
        (2005, [], 1), (2006, [2.0, 2.0], 2), (2050, [0.0] * 6, 1), (7, rows[7][1], rows[7][2]), (8, [9.0] * 6, 3), (-50, [-1.0] * 6, 2),
    ]
    small = Settings(anchor_step=10, block_rows=70, chunk_anchors=9, group_chunks=2)
    assert _compare(spark, rows + hot + odd, small)
    assert _compare(spark, rows + hot, Settings(anchor_step=10, low=90, high=99, positives=2))
    assert not _compare(spark, odd[:6], small)
    assert not _compare(spark, [(0, [1.0, 1.0], 1)], small)
    assert _compare(spark, [(k, [5000.0 * (k % 3), -300.0 + k], k % 2) for k in range(40)], small)


def test_lists_leave_out_rows_that_cannot_reach_the_threshold():
    rng = np.random.default_rng(4)
    means = rng.normal(size=(60, 8)) * 100
    vectors = np.floor(means[np.arange(6000) % 60] + rng.normal(size=(6000, 8)) * 8).astype(np.int64)
    ids, labels = np.arange(6000), np.arange(6000) % 60
    at = np.arange(0, 6000, 200)
    low = np.array([int((vectors[a] @ vectors[a]) * 0.97) for a in at])
    chunk = lemp.Chunk(ids[at], labels[at], vectors[at], np.arange(len(at)), ids[at], low, low, np.full(len(at), lemp.MOST), 3, True)
    for bucket in lemp.buckets(ids, labels, vectors):
        chunk.search(bucket)
    found = {}
    for q, _, _, score, row in chunk.found():
        found.setdefault(q, []).append((-score, row))
    for a, least in zip(at, low, strict=True):
        products = vectors @ vectors[a]
        want = sorted((-int(products[b]), int(b)) for b in ids if b != a and labels[b] == labels[a] and products[b] >= least)[:3]
        assert found.get(int(a), []) == want
    assert chunk.verified < 0.2 * chunk.pairs


def test_components_that_no_long_can_hold_are_refused(spark):
    df = spark.createDataFrame([(k, [float(1 << 22)] * 4, k) for k in range(3)], "vec_id long, embedding array<float>, label int")
    try:
        mining.hard_negatives(df).collect()
    except Exception as error:
        assert "beyond" in str(error)
    else:
        raise AssertionError("accepted")
