"""Queries over planted images; their SQL applies the rules to a row for each pixel, without lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.operators import raster as ra
from docaudit.plans.registry import query
from docaudit.sources import corpus as co

_V = "(x * 13 + y * 7 + image_id * 29 + (x * y) % 17) % 256"
_PIXELS = f"SELECT image_id, x, y, {_V} AS v FROM (SELECT s_suppkey AS image_id, unnest(range(64)) AS x, y FROM (SELECT s_suppkey, unnest(range(48)) AS y FROM supplier))"


def _grid(spark, sf_dir, width, height):
    """(image_id, y, x) for each supplier; sides are expressions over image_id."""
    rows = co.read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"))
    rows = rows.select("*", F.explode(F.expr(f"sequence(0, CAST({height} AS INT) - 1)")).alias("y"))
    return rows.select("*", F.explode(F.expr(f"sequence(0, CAST({width} AS INT) - 1)")).alias("x"))


def pixels(spark, sf_dir):
    """(image_id, y, x, v, r, g, b): an image of 64 by 48 pixels for each supplier."""
    v = F.expr(_V)
    return _grid(spark, sf_dir, "64", "48").withColumns({"v": v, "r": v, "g": (v + 40) % 256, "b": (v * 3) % 256})


_STENCIL = "SELECT *, max(x) OVER i + 1 AS w, max(y) OVER i + 1 AS h, lag(v) OVER r AS l, lead(v) OVER r AS rr, lag(v) OVER c AS u, lead(v) OVER c AS d FROM ({pixels}) WINDOW i AS (PARTITION BY image_id), r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)"


@query(
    "p1_p2_p3_p5_raster",
    f"""WITH s AS ({_STENCIL.format(pixels=_PIXELS)}), i AS (SELECT * FROM s WHERE l IS NOT NULL AND rr IS NOT NULL AND u IS NOT NULL AND d IS NOT NULL),
  e AS (SELECT image_id, abs(v - lag(v) OVER (PARTITION BY image_id ORDER BY y, x)) > 30 AS e FROM ({_PIXELS}))
  SELECT image_id, round(b, 4) AS brightness, round(c, 4) AS contrast, round(blur, 2) AS blur, round(noise, 6) AS noise, dpi, round(edge, 6) AS edge_density
  FROM (SELECT image_id, avg(v) AS b, stddev_pop(v) / 128 AS c, CAST(floor(greatest(max(x) + 1, max(y) + 1) / 8.5 + 0.5) AS INT) AS dpi FROM s GROUP BY image_id)
  JOIN (SELECT image_id, var_pop(l + rr + u + d - 4 * v) AS blur, avg(CASE WHEN x % 2 = 1 AND y % 2 = 1 THEN abs(v - (v + l + rr + u + d) / 5) END) / 255 AS noise FROM i GROUP BY image_id) USING (image_id)
  JOIN (SELECT image_id, sum(CAST(coalesce(e, false) AS INT)) / count(*) AS edge FROM e GROUP BY image_id) USING (image_id)""",
)
def raster(spark, sf_dir):
    r = lambda c, k: F.round(c, k).alias(c)
    return ra.raster_metrics(ra.image_lines(pixels(spark, sf_dir))).select("image_id", r("brightness", 4), r("contrast", 4), r("blur", 2), r("noise", 6), "dpi", r("edge_density", 6))


#: Of every third image the first and last lines alone have edges on one side, which a slope over inner lines does not see; of another third lines lean.
_LEAN = "CASE image_id % 3 WHEN 0 THEN CASE WHEN y IN (0, 47) THEN CASE WHEN x > 50 THEN 255 * (x % 2) ELSE 0 END ELSE CASE WHEN x BETWEEN 20 AND 23 THEN 200 ELSE 0 END END WHEN 1 THEN CASE WHEN x - y // (2 + image_id % 5) BETWEEN 20 AND 25 THEN 180 ELSE 10 END ELSE (x * 13 + y * 7 + image_id * 29 + (x * y) % 17) % 256 END"


@query(
    "p4_skew",
    f"""WITH s AS ({_STENCIL.format(pixels=_PIXELS.replace(_V, _LEAN))}),
  g AS (SELECT image_id, y, sum(x * g) / sum(g) AS cx FROM (SELECT image_id, y, x, abs(rr - l) AS g FROM s WHERE x BETWEEN 1 AND w - 2 AND y BETWEEN 1 AND h - 2) WHERE g > 40 GROUP BY 1, 2),
  a AS (SELECT image_id, count(*) AS n, degrees(atan((count(*) * sum(y * cx) - sum(y) * sum(cx)) / (count(*) * sum(y * y) - sum(y) * sum(y)))) AS a FROM g GROUP BY 1)
  SELECT s_suppkey AS image_id, round(CASE WHEN n IS NULL OR n < 10 OR abs(a) > 20 THEN 0 ELSE a END, 4) + 0 AS skew_angle FROM supplier LEFT JOIN a ON image_id = s_suppkey""",
)
def skew(spark, sf_dir):
    leaning = _grid(spark, sf_dir, "64", "48").withColumn("v", F.expr(_LEAN.replace("//", "div")).cast("int"))
    return ra.raster_metrics(ra.image_lines(leaning)).select("image_id", (F.round("skew_angle", 4) + 0).alias("skew_angle"))


@query(
    "p6_p7_regions",
    f"""WITH c AS (SELECT image_id, x - 9 AS cx, y - 7 AS cy, v AS r, (v + 40) % 256 AS g, v * 3 % 256 AS b FROM ({_PIXELS}) WHERE x - 9 BETWEEN 0 AND 43 AND y - 7 BETWEEN 0 AND 32), m AS (SELECT *, (r + g + b) / 3 AS mean, greatest(r, g, b) - least(r, g, b) AS spread, cx % 4 = 0 AND cy % 4 = 0 AS p FROM c),
  t AS (SELECT image_id, avg(mean) AS br, avg(CASE WHEN p THEN CAST(mean < 40 AS INT) END) AS dark, avg(CASE WHEN p THEN CAST(spread > 35 AND mean > 35 AND mean < 230 AS INT) END) AS photo FROM m GROUP BY image_id)
  SELECT image_id, round(br, 4) AS center_brightness, round(dark, 6) AS dark_block_ratio, round(photo, 6) AS photo_region_ratio, NOT (br < 85 AND photo < 0.02) AND dark > 0.03 AND dark < 0.25 AS "hasQrLikeRegion", NOT (br < 85 AND photo < 0.02) AND photo > 0.03 AS "hasPhotoLikeRegion" FROM t""",
)
def regions(spark, sf_dir):
    out = ra.raster_regions(pixels(spark, sf_dir)).withColumns({"color_variance": F.lit(50.0), "width": F.lit(64), "height": F.lit(48)})
    r = lambda c, k: F.round(c, k).alias(c)
    return ra.visual_flags(out).select("image_id", r("center_brightness", 4), r("dark_block_ratio", 6), r("photo_region_ratio", 6), "hasQrLikeRegion", "hasPhotoLikeRegion")


#: Content of many levels in a box on a dark ground: all of the image, a middle part, too little, none, and all of its width but not of its height.
_BOX = "CASE WHEN x * 100 >= w * x0 AND x * 100 < w * x1 AND y * 100 >= h * y0 AND y * 100 < h * y1 THEN 60 + (x * (31 + image_id % 7) + y * (17 + image_id % 11) + image_id) % 170 + CASE WHEN image_id % 2 = 0 THEN y % 3 ELSE x % 3 END * 10 ELSE 20 END"
_BOXED = """SELECT *, CASE WHEN image_id % 4 < 2 THEN 64 ELSE 48 END AS w, CASE WHEN image_id % 4 < 2 THEN 48 ELSE 64 END AS h,
  CASE image_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 10 + image_id % 9 WHEN 2 THEN 40 WHEN 3 THEN 0 ELSE 0 END AS x0, CASE image_id % 5 WHEN 0 THEN 100 WHEN 1 THEN 80 WHEN 2 THEN 60 WHEN 3 THEN 0 ELSE 100 END AS x1,
  CASE image_id % 5 WHEN 1 THEN 5 + image_id % 13 WHEN 4 THEN 30 ELSE 0 END AS y0, CASE image_id % 5 WHEN 1 THEN 90 WHEN 4 THEN 85 ELSE 100 END AS y1 FROM (SELECT s_suppkey AS image_id FROM supplier)"""


@query(
    "p8_p9_boxes",
    f"""WITH p AS (SELECT image_id, x, y, w, h, {_BOX} AS v FROM (SELECT *, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM ({_BOXED})))),
  s AS (SELECT *, lag(v) OVER (PARTITION BY image_id, y ORDER BY x) AS l, lag(v) OVER (PARTITION BY image_id, x ORDER BY y) AS u FROM p),
  o AS (SELECT *, v > 35 AND v < 250 AND abs(v - l) + abs(v - u) >= 12 AS c FROM s WHERE x % 2 = 1 AND y % 2 = 1 AND x < w - 1 AND y < h - 1),
  -- The image turned: its lines are the columns from the right, its columns the lines.
  t AS (SELECT *, lag(v) OVER (PARTITION BY image_id, ty ORDER BY tx) AS l, lag(v) OVER (PARTITION BY image_id, tx ORDER BY ty) AS u FROM (SELECT image_id, v, w, h, y AS tx, w - 1 - x AS ty FROM p)),
  a AS (SELECT image_id, count(*) FILTER (WHERE abs(v - l) > 28) - count(*) FILTER (WHERE abs(v - u) > 28) AS as_is FROM o GROUP BY 1),
  b AS (SELECT image_id, count(*) FILTER (WHERE abs(v - l) > 28) - count(*) FILTER (WHERE abs(v - u) > 28) AS turned FROM t WHERE tx % 2 = 1 AND ty % 2 = 1 AND tx < h - 1 AND ty < w - 1 GROUP BY 1),
  m AS (SELECT image_id, w, h, w * 10 AS fw, h * 10 AS fh, min(x) FILTER (WHERE c) AS x0, max(x) FILTER (WHERE c) AS x1, min(y) FILTER (WHERE c) AS y0, max(y) FILTER (WHERE c) AS y1 FROM o GROUP BY ALL),
  k AS (SELECT *, (x1 - x0) / w AS sx, (y1 - y0) / h AS sy, greatest(0, floor((x0 / w - 0.03::DOUBLE) * fw)) AS lf, greatest(0, floor((y0 / h - 0.03::DOUBLE) * fh)) AS tp FROM m),
  z AS (SELECT *, least(fw - lf, ceil((sx + 2 * 0.03::DOUBLE) * fw)) AS cw, least(fh - tp, ceil((sy + 2 * 0.03::DOUBLE) * fh)) AS ch FROM k),
  r AS (SELECT *, coalesce(fw >= 100 AND fh >= 100 AND NOT (sx > 0.92 AND sy > 0.92) AND sx >= 0.25 AND sy >= 0.25 AND cw >= 80 AND ch >= 80, false) AS ok FROM z)
  SELECT image_id, CAST(CASE WHEN ok THEN lf ELSE 0 END AS INT) AS "left", CAST(CASE WHEN ok THEN tp ELSE 0 END AS INT) AS top, CAST(CASE WHEN ok THEN cw ELSE fw END AS INT) AS crop_width, CAST(CASE WHEN ok THEN ch ELSE fh END AS INT) AS crop_height,
    ok AS cropped, CASE WHEN w > h * 1.15 THEN CASE WHEN turned >= as_is THEN 270 ELSE 0 END ELSE CASE WHEN turned > as_is THEN 270 ELSE 0 END END AS angle, greatest(as_is, turned) AS uprightness
  FROM r JOIN a USING (image_id) JOIN b USING (image_id)""",
)
def boxes(spark, sf_dir):
    rows = co._sql(spark, _BOXED, supplier=co.read_table(spark, sf_dir, "supplier")).selectExpr("*", "explode(sequence(0, h - 1)) AS y").selectExpr("*", "explode(sequence(0, w - 1)) AS x")
    metrics = ra.raster_metrics(ra.image_lines(rows.selectExpr("image_id", "x", "y", f"CAST({_BOX} AS INT) AS v")))
    return ra.content_box(metrics, F.col("width") * 10, F.col("height") * 10).join(ra.best_angle(metrics), "image_id")
