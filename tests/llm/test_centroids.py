import hashlib
import math
from collections import Counter, defaultdict

import numpy as np

from docaudit.llm import op13_centroids as centroids
from docaudit.llm.common import Workspace
from docaudit.llm.op13_centroids import Settings

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v string"
SMALL = Settings(clusters=6, rounds=4, dims=4)


def _brute(rows, s):
    kept = [(i, [math.floor(s.scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == s.dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{s.seed}{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[: s.clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), k) for k, m in enumerate(c))

    for _ in range(s.rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        c = [[sum(x) // len(members[k]) for x in zip(*members[k], strict=True)] if k in members else m for k, m in enumerate(c)]
    got = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, k in got:
        inertia[k] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), sha[k]) for i, d, k in got)


def _compare(spark, rows, s):
    df = spark.createDataFrame([(i, v, 1, "clash", "clash") for i, v in rows], SCHEMA)
    assert Counter(tuple(r) for r in centroids.cluster_vectors(df.repartition(5), settings=s).collect()) == _brute(rows, s)


def test_moved_centroids_come_no_nearer_than_the_bound():
    rng = np.random.default_rng(3)
    tight = 0
    for _ in range(300):
        centre, old = rng.normal(size=(2, 5)) * rng.choice([0.1, 1, 10])
        new = old + rng.normal(size=5) * rng.choice([0.01, 1, 5])
        radius = float(rng.choice([0.0, 0.1, 1, 5]))
        way = rng.normal(size=(2000, 5))
        x = centre + way / np.linalg.norm(way, axis=1)[:, None] * radius * rng.random((2000, 1)) ** 0.1
        bound, full = centroids.nearing(centre, radius, old, new), np.linalg.norm(new - old)
        assert (np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)).max() <= bound + 1e-9
        assert 0 <= bound <= full
        tight += bound < 0.9 * full
    assert tight > 100


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in np.float32(rng.normal(size=4) + (k % 5))]) for k in range(400)]
    rows += [(7, rows[7][1]), (7, [0.5, 0.5, 0.5, 0.5]), (None, [1.0, 1.0, 1.0, 1.0])] + [(1000 + k, rows[3][1]) for k in range(200)]
    odd = [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0] * 5), (2004, [1.0, None, 1.0, 1.0]), (2005, [float("nan")] * 4), (2006, [float("inf"), 0.0, 0.0, 0.0]), (2007, [-0.0] * 4)]
    _compare(spark, rows + odd, SMALL)
    _compare(spark, odd, SMALL)
    _compare(spark, odd[:4], SMALL)
    _compare(spark, [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(30)], SMALL)
    _compare(spark, [(k, [float(k % 3) * 5000, 300.0, -200.0, float(k)]) for k in range(60)], SMALL)
    _compare(spark, rows[:50], Settings(clusters=1, rounds=2, dims=4))


def test_bounds_spare_scans(spark):
    rng = np.random.default_rng(11)
    means = rng.normal(size=(12, 16)) * 8
    data = [(k, [int(x) for x in (means[k % 12] + rng.normal(size=16)) * 100]) for k in range(3000)]
    s = Settings(clusters=12, rounds=6, dims=16)
    rows, _, figures = centroids.cluster(Workspace(spark, "spare"), spark.createDataFrame(data, "vec_id long, v array<int>"), s)
    assert rows.count() == 3000 and all(f["rows"] == 3000 for f in figures)
    assert figures[0]["scanned"] == 3000 and figures[-1]["scanned"] < 600


def test_components_that_no_long_can_hold_are_refused(spark):
    df = spark.createDataFrame([(1, [float(1 << 22)] * 4)], "vec_id long, embedding array<float>")
    try:
        centroids.cluster_vectors(df, settings=SMALL).collect()
    except Exception as error:
        assert "beyond" in str(error)
    else:
        raise AssertionError("accepted")
