"""Centroid clustering of integer vectors: bounds on distances, loosened by how far moved centroids can have come near a cluster's sphere."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import Workspace, read

#: Components beyond this make squared distances that a long cannot hold; such input is refused.
LARGEST = 1 << 27
#: Products of components below this are summed exactly by floating-point matrix products.
SMALL = 1 << 20
STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, distance long, n long, sums array<long>, radius double, inertia decimal(38,0), scanned long"


@dataclass(frozen=True)
class Settings:
    clusters: int = 40
    rounds: int = 5
    dims: int = 64
    #: Components become floor(scale * x).
    scale: int = 256
    #: Start centroids are the vectors with the smallest hash of this and their id.
    seed: str = "2:"


@dataclass(frozen=True)
class Move:
    """What a round knows of the centroids: where they are, and by cluster what its bounds lose to the last move."""

    centroids: np.ndarray
    #: How far the cluster's own centroid moved; None before the first round.
    drift: np.ndarray | None = None
    #: By how much any other centroid can have come nearer to a vector of the cluster.
    loosening: np.ndarray | None = None

    def half_gaps(self) -> np.ndarray:
        """Half the distance of each centroid to the nearest other: vectors nearer than that belong to it."""
        c = self.centroids.astype(np.float64)
        gaps = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
        np.fill_diagonal(gaps, np.inf)
        return gaps.min(1, initial=np.inf) / 2


def nearing(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """A bound on |x - old| - |x - new| over all x of a sphere: how much nearer a centroid can have come to any of its vectors.

    All of it happens in the plane of centre, old and new. With m between old and new, D their distance and t the angle of x - m
    to the way from old to new, the difference is 2 (x - m)(new - old) / (|x - old| + |x - new|). The denominator is at
    least 2 |x - m|, which gives D cos t, and at least D, which gives twice the way along the axis; the sphere bounds both.
    """
    way = new - old
    moved = float(np.sqrt(way @ way))
    if moved == 0:
        return 0.0
    to = centre - (old + new) / 2
    far, along = float(np.sqrt(to @ to)), float(to @ way) / moved
    cosine = 1.0
    if far > radius:
        angle = np.arccos(np.clip(along / far, -1, 1)) - np.arcsin(min(1.0, radius / far))
        cosine = float(np.cos(max(0.0, angle)))
    return max(0.0, min(moved, moved * cosine, 2 * (along + radius)))


def moved(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
    """Bounds of the next round, from the centroids before and after and the radius of each cluster's sphere around the old one."""
    a, b = old.astype(np.float64), new.astype(np.float64)
    k = len(a)
    loosening = np.array([max([nearing(a[i], radius[i], a[j], b[j]) for j in range(k) if j != i], default=0.0) for i in range(k)])
    return Move(new, np.sqrt(((a - b) ** 2).sum(1)), loosening)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of each row of v to each row of c."""
    top = max(np.abs(v).max(initial=0), np.abs(c).max(initial=0))
    if top < SMALL:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(1) for row in c], 1)


def _vectors(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _assign(move: Move, s: Settings, last: bool):
    """A round over batches of vectors with their bounds: rows with new clusters and bounds, then a row of sums for each cluster met."""
    half, c = move.half_gaps(), move.centroids
    k, schema = len(c), None

    def nearest(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Settles each vector in place; returns how many had to be compared with all centroids."""
        if move.drift is not None:
            upper += move.drift[cluster]
            lower -= move.loosening[cluster]
            safe = np.maximum(lower, half[cluster])
            # Bounds are rounded, and equal distances go to the smaller number: what is as near as that is scanned.
            slack = lambda at: 1e-6 * (1 + np.abs(upper[at]))
            at = np.flatnonzero(upper >= safe - slack(slice(None)))
            upper[at] = np.sqrt(((v[at] - c[cluster[at]]) ** 2).sum(1))
            at = at[upper[at] >= safe[at] - slack(at)]
        else:
            at = np.arange(len(v))
        for part in np.array_split(at, len(at) // 4096 + 1):
            d = squared(v[part], c)
            cluster[part] = best = d.argmin(1)
            upper[part] = np.sqrt(d[np.arange(len(part)), best])
            d[np.arange(len(part)), best] = np.iinfo(np.int64).max
            lower[part] = np.sqrt(d.min(1)) if k > 1 else np.inf
        return len(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, radius, inertia, scanned = np.zeros(k, np.int64), np.zeros((k, s.dims), np.int64), np.zeros(k), [0] * k, np.zeros(k, np.int64)
        for batch in batches:
            v = _vectors(batch.column("v"), s.dims)
            if np.abs(v).max(initial=0) > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST}: squared distances would not fit a long")
            size = len(v)
            cluster, upper, lower = (batch.column(x).to_numpy(zero_copy_only=False).copy() for x in ("cluster", "upper", "lower"))
            scanned[0] += nearest(v, cluster, upper, lower)
            own = ((v - c[cluster]) ** 2).sum(1) if last else np.zeros(size, np.int64)
            for j in np.unique(cluster):
                at = cluster == j
                n[j] += np.count_nonzero(at)
                sums[j] += v[at].sum(0)
                radius[j] = max(radius[j], upper[at].max())
                inertia[j] += int(own[at].sum())
            rows = {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "cluster": cluster, "upper": upper, "lower": lower, "distance": own}
            yield _batch(rows, size)
        met = np.flatnonzero((n > 0) | (scanned > 0))
        totals = {"cluster": met.astype(np.int32), "n": n[met], "sums": list(sums[met]), "radius": radius[met], "inertia": [inertia[j] for j in met], "scanned": scanned[met]}
        yield _batch(totals, len(met))

    def _batch(columns: dict, size: int) -> pa.RecordBatch:
        nonlocal schema
        if schema is None:
            kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "decimal(38,0)": pa.decimal128(38, 0)}
            schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ", 1) for x in STATE.split(", "))])
        return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, f.type) if x is not None else pa.nulls(size, f.type) for f in schema for x in [columns.get(f.name)]], schema=schema)

    return run


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, s: Settings) -> DataFrame:
    """(vec_id, v) of the rows whose vector has s.dims components, none null, NaN or infinite, as floor(scale * x)."""
    sound: Column = F.col(vec_col).isNotNull() & (F.size(vec_col) == s.dims)
    sound &= F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(s.scale)) * x.cast("double")).cast("int"))
    return df.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def cluster(ws: Workspace, vectors: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, np.ndarray, list[dict]]:
    """(rows with cluster and distance, the centroids, figures of each round) of (vec_id, v).

    The start centroids, and in each round the sum, count and radius of each cluster, are all that the driver sees:
    clusters x dims numbers. A round is one narrow pass over the table that the last one wrote.
    """
    start = vectors.orderBy(F.sha2(F.concat(F.lit(s.seed), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(s.clusters).collect()
    if not start:
        return vectors.limit(0).selectExpr("vec_id", "v", "0 AS cluster", "0L AS distance"), np.zeros((0, s.dims), np.int64), []
    move = Move(np.array([r["v"] for r in start], np.int64))
    state = vectors.selectExpr("vec_id", "v", "0 AS cluster", "double('inf') AS upper", "0D AS lower")
    figures = []
    for k in range(s.rounds + 1):
        last = k == s.rounds
        state = ws.keep(state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(_assign(move, s, last), STATE), f"round-{k}")
        if k:
            ws.drop(f"round-{k - 1}")
        sums = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(s.dims)]
        totals = state.filter("n IS NOT NULL").groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("inertia").alias("inertia"), F.sum("scanned").alias("scanned"), *sums).collect()
        state = state.filter("n IS NULL")
        figures.append({"rows": sum(r["n"] for r in totals), "scanned": sum(r["scanned"] for r in totals), "inertia": {r["cluster"]: int(r["inertia"]) for r in totals if r["n"]}})
        if not last:
            new, radius = move.centroids.copy(), np.zeros(len(move.centroids))
            for r in totals:
                if r["n"]:
                    new[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(s.dims)]
                    radius[r["cluster"]] = r["radius"]
            move = moved(move.centroids, new, radius * (1 + 1e-9) + 1e-9)
    return state, move.centroids, figures


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each row with a whole vector.

    Rows with a null, short, long or non-finite vector are left out. Repeated rows count as often as they occur, and may each
    be a start centroid; rows without an id are clustered too, and start centroids only where others do not suffice. With fewer
    vectors than clusters each is a centroid. An empty table gives an empty one. Components beyond 2**27 raise an error.
    """
    spark, ws = df.sparkSession, Workspace(df.sparkSession, "op13")
    rows, centroids, figures = cluster(ws, whole_vectors(df, id_col, vec_col, settings), settings)
    inertia = figures[-1]["inertia"] if figures else {}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = spark.createDataFrame([(k, inertia.get(k, 0), sum(inertia.values()), sha) for k, sha in enumerate(shas)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.select(F.col("vec_id").alias(id_col), "cluster", "distance")
    return out.join(F.broadcast(table), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read(spark, sf_dir, "embeddings"))


def _rounds_sql(rounds: int) -> str:
    """Each round written out: every vector against every centroid, then floors of means; centroids without vectors stay."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""
, a{k} AS MATERIALIZED (
  SELECT r, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d
  FROM (SELECT r, c, list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m) AS d FROM kept, m{k}) GROUP BY r
)""")
        if k < rounds:
            out.append(f"""
, m{k + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(n.m, m.m) AS m FROM m{k} m LEFT JOIN (
    SELECT c, list(floor(s / n) ORDER BY i) AS m FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n
      FROM (SELECT a.c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k} a JOIN kept ON a.r = kept.r) GROUP BY c, i) GROUP BY c
  ) n ON m.c = n.c
)""")
    return "".join(out)


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v AS m FROM kept QUALIFY c < 40
){_rounds_sql(5)}
SELECT vec_id, CAST(a5.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a5.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(m5.m, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a5 JOIN kept ON a5.r = kept.r JOIN m5 ON a5.c = m5.c
"""
