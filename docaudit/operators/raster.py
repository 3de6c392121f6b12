"""Image statistics: pixel tables become lines of values, lines meet their neighbours, and one pass over them gives a row for each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions.patterns import half_up


# Differences that count as an edge in density, in a row's centre, and in uprightness; rows a slope needs, and the steepest.
DENSITY_STEP, CENTRE_STEP, UPRIGHT_STEP, LEAST_ROWS, STEEPEST = 30, 40, 28, 10, 20
# Levels and difference of content; shares of a side that are nearly all and too little; padding, least sides.
DARK, LIGHT, CONTENT_STEP, NEARLY_ALL, TOO_LITTLE, PADDING, LEAST_IMAGE, LEAST_CROP = 35, 250, 12, 0.92, 0.25, 0.03, 100, 80
# Fixed value: an image this much wider than high is tried sideways first.
SIDEWAYS = 1.15


def image_lines(pixels: DataFrame, value: str = "v") -> DataFrame:
    """(image_id, y, w, h, v, up, down) of pixels (image_id, y, x, value 0 to 255): a row for each line of an image, with its two neighbours.

    Pixels are dealt out once, by image; lines, their neighbours and all that is made of them by image stay where they are.
    Images are small (at most some hundred pixels wide), so one image in one task is no burden.
    """
    packed = F.sort_array(F.collect_list(F.col("x").cast("long") * 256 + F.col(value)))
    lines = pixels.repartition("image_id").groupBy("image_id", "y").agg(F.transform(packed, lambda p: (p % 256).cast("int")).alias("v"))
    order = Window.partitionBy("image_id").orderBy("y")
    return lines.select("image_id", "y", F.size("v").alias("w"), F.count("*").over(Window.partitionBy("image_id")).cast("int").alias("h"), "v", F.lag("v").over(order).alias("up"), F.lead("v").over(order).alias("down"))


def _cells(lines: DataFrame) -> DataFrame:
    """A row for each pixel with its four neighbours: u and d from the lines beside, l the one before it in reading order, across line ends."""
    before = F.concat(F.array(F.try_element_at("up", F.lit(-1))), F.slice("v", F.lit(1), F.col("w") - 1))
    after = F.concat(F.slice("v", F.lit(2), F.col("w") - 1), F.array(F.lit(None).cast("int")))
    xs = F.sequence(F.lit(0), F.col("w") - 1)
    beside = lambda c: F.coalesce(F.col(c), F.array().cast("array<int>"))  # noqa: E731  a zip with null would be null
    stencil = F.arrays_zip(xs.alias("x"), F.col("v"), before.alias("l"), after.alias("r"), beside("up").alias("u"), beside("down").alias("d"))
    return lines.select("image_id", "y", "w", "h", F.inline(stencil).alias("x", "v", "l", "r", "u", "d"))


def raster_metrics(lines: DataFrame, sample: bool = False) -> DataFrame:
    """(image_id, width, height, brightness, color_variance, contrast, blur, noise, skew_angle, dpi, edge_density, x0, x1, y0, y1, upright, upright_270) from image_lines().

    One pass: sums by line, then by image. blur: variance of the four-neighbour Laplacian over inner pixels. noise: mean
    distance of inner pixels at odd places from the mean of themselves and their neighbours, as a share of 255. skew_angle:
    slope of the inner rows' edge centres in degrees; 0 with few rows with edges, or beyond STEEPEST. edge_density: share of
    pixels that differ from the one before them in reading order. x0 to y1: the box of content at odd inner places, null without
    any. upright: steps to the left neighbour less steps to the upper one at odd inner places, as it stands and turned by 270.
    """
    v, l, r, u, d, x, y = (F.col(c) for c in "vlrudxy")
    inner = x.between(1, F.col("w") - 2) & y.between(1, F.col("h") - 2)
    odd = inner & (x % 2 == 1) & (y % 2 == 1)
    # Turned by 270 degrees the upper neighbour stands left, the right one above, and columns are counted from the right.
    odd_270 = inner & (y % 2 == 1) & ((F.col("w") - 1 - x) % 2 == 1)
    lap, five, step = l + r + u + d - 4 * v, F.abs(4 * v - l - r - u - d), F.abs(r - l)
    content = odd & (v > DARK) & (v < LIGHT) & (F.abs(v - l) + F.abs(v - u) >= CONTENT_STEP)
    total = lambda cond, value=F.lit(1): F.sum(F.when(cond, value).otherwise(0).cast("long"))
    sums = {
        "n": F.count("*"), "s": F.sum(v.cast("long")), "ss": F.sum((v * v).cast("long")),
        "ln": total(inner), "ls": total(inner, lap), "lss": total(inner, lap * lap), "on": total(odd), "os": total(odd, five),
        "e": total(F.abs(v - l) > DENSITY_STEP), "gs": total(inner & (step > CENTRE_STEP), step), "gx": total(inner & (step > CENTRE_STEP), step * x),
        "h0": total(odd & (F.abs(v - l) > UPRIGHT_STEP)), "v0": total(odd & (F.abs(v - u) > UPRIGHT_STEP)),
        "h270": total(odd_270 & (F.abs(v - u) > UPRIGHT_STEP)), "v270": total(odd_270 & (F.abs(v - r) > UPRIGHT_STEP)),
        "x0": F.min(F.when(content, x)), "x1": F.max(F.when(content, x)),
    }
    rows = _cells(lines).groupBy("image_id", "y", "w", "h").agg(*[c.alias(name) for name, c in sums.items()])
    added = [F.sum(name).alias(name) for name in sums if name not in ("x0", "x1", "gs", "gx")]
    edged = F.when(F.col("gs") > 0, F.col("gx") / F.col("gs"))
    boxed = F.when(F.col("x0").isNotNull(), F.col("y"))
    out = rows.groupBy("image_id").agg(
        *added, F.max("w").alias("width"), F.max("h").alias("height"), F.count(edged).alias("edged"), F.regr_slope(edged, F.when(edged.isNotNull(), F.col("y"))).alias("slope"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min(boxed).alias("y0"), F.max(boxed).alias("y1"),
    )
    c = F.col
    spread = c("ss") / c("n") - (c("s") / c("n")) ** 2
    spread = F.sqrt(F.greatest(spread * c("n") / (c("n") - 1), F.lit(0.0)) if sample else F.greatest(spread, F.lit(0.0)))
    angle = F.degrees(F.atan("slope"))
    return out.select(
        "image_id", "width", "height", (c("s") / c("n")).alias("brightness"), spread.alias("color_variance"), (spread / 128).alias("contrast"),
        F.when(c("ln") > 0, c("lss") / c("ln") - (c("ls") / c("ln")) ** 2).otherwise(0.0).alias("blur"), F.when(c("on") > 0, c("os") / 5 / c("on") / 255).otherwise(0.0).alias("noise"),
        F.when((c("edged") < LEAST_ROWS) | (F.abs(angle) > STEEPEST), 0.0).otherwise(F.coalesce(angle, F.lit(0.0))).alias("skew_angle"),
        half_up(F.greatest("width", "height") / 8.5).alias("dpi"), (c("e") / c("n")).alias("edge_density"), "x0", "x1", "y0", "y1", (c("h0") - c("v0")).alias("upright"), (c("h270") - c("v270")).alias("upright_270"),
    )


def raster_levels(pixels: DataFrame, channels: tuple[str, ...] = ("v",), sample: bool = False) -> DataFrame:
    """(image_id, brightness, contrast, color_variance) of images with several channels: mean of the channels' means, and of their deviations, whole and as a share of 128."""
    dev = F.stddev_samp if sample else F.stddev_pop
    mean = lambda f: sum((f(F.col(c)) for c in channels[1:]), f(F.col(channels[0]))) / len(channels)
    out = pixels.groupBy("image_id").agg(mean(F.avg).alias("brightness"), mean(dev).alias("color_variance"))
    return out.withColumn("contrast", F.col("color_variance") / 128)


def raster_regions(pixels: DataFrame) -> DataFrame:
    """(image_id, center_brightness, dark_block_ratio, photo_region_ratio) of pixels with r, g, b: the middle 70 percent, every fourth pixel of it for the ratios.

    Pixels are dealt out once, by image, three small numbers in one; sizes, combined before they are dealt, meet them there.
    They are never broadcast: the size of rows that are made by explode() is not known before they are counted.
    """
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    bits = lambda c, k: F.shiftleft(F.col(c).cast("long"), k)
    packed = bits("x", 44) + bits("y", 24) + F.shiftleft((F.col("r") + F.col("g") + F.col("b")).cast("long"), 8) + (F.greatest("r", "g", "b") - F.least("r", "g", "b"))
    inside = pixels.select("image_id", packed.alias("p")).join(size.hint("shuffle_hash"), "image_id")
    part = lambda k, n: F.shiftright("p", k).bitwiseAND(F.lit((1 << n) - 1))
    inside = inside.withColumns({"cx": part(44, 19) - F.floor(F.col("w") * 0.15), "cy": part(24, 20) - F.floor(F.col("h") * 0.15)})
    inside = inside.filter((F.col("cx") >= 0) & (F.col("cy") >= 0) & (F.col("cx") < F.greatest(F.lit(10), F.floor(F.col("w") * 0.7))) & (F.col("cy") < F.greatest(F.lit(10), F.floor(F.col("h") * 0.7))))
    mean, spread = part(8, 16) / 3, part(0, 8)
    picked = (F.col("cx") % 4 == 0) & (F.col("cy") % 4 == 0)
    return inside.groupBy("image_id").agg(F.avg(mean).alias("center_brightness"), F.avg(F.when(picked, (mean < 40).cast("int"))).alias("dark_block_ratio"), F.avg(F.when(picked, ((spread > 35) & (mean > 35) & (mean < 230)).cast("int"))).alias("photo_region_ratio"))


def visual_flags(metrics: DataFrame) -> DataFrame:
    """metrics (center_brightness, color_variance, dark_block_ratio, photo_region_ratio, width, height) with the flags that detectors use."""
    dark = (F.col("center_brightness") < 85) & (F.col("photo_region_ratio") < 0.02)
    return metrics.withColumns(
        {
            "isDarkUi": dark,
            "isNearWhiteBg": (F.col("center_brightness") > 230) & (F.col("color_variance") < 35),
            "hasQrLikeRegion": ~dark & (F.col("dark_block_ratio") > 0.03) & (F.col("dark_block_ratio") < 0.25),
            "hasPhotoLikeRegion": ~dark & (F.col("photo_region_ratio") > 0.03),
            "aspect_ratio": F.col("width") / F.col("height"),
        }
    )


def content_box(metrics: DataFrame, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """(image_id, left, top, crop_width, crop_height, cropped) of raster_metrics(): the box of content with padding, in pixels of the full image.

    width and height are the full image's, where the metrics are of a smaller copy. It stays whole when it is small, has no
    content, when content takes nearly all of both sides or too little of one, or when little would be left.
    """
    c = F.col
    full = (c("width") if width is None else width, c("height") if height is None else height)
    share = [(c(f"{a}1") - c(f"{a}0")) / c(side) for a, side in (("x", "width"), ("y", "height"))]
    start = [F.greatest(F.lit(0), F.floor((c(f"{a}0") / c(side) - PADDING) * n)) for a, side, n in (("x", "width", full[0]), ("y", "height", full[1]))]
    size = [F.least(n - at, F.ceil((part + 2 * PADDING) * n)) for n, at, part in zip(full, start, share, strict=True)]
    ok = (full[0] >= LEAST_IMAGE) & (full[1] >= LEAST_IMAGE) & ~((share[0] > NEARLY_ALL) & (share[1] > NEARLY_ALL)) & (share[0] >= TOO_LITTLE) & (share[1] >= TOO_LITTLE) & (size[0] >= LEAST_CROP) & (size[1] >= LEAST_CROP)
    ok = F.coalesce(ok, F.lit(False))
    pick = lambda x, whole: F.when(ok, x).otherwise(whole).cast("int")
    return metrics.select("image_id", pick(start[0], 0).alias("left"), pick(start[1], 0).alias("top"), pick(size[0], full[0]).alias("crop_width"), pick(size[1], full[1]).alias("crop_height"), ok.alias("cropped"))


def best_angle(metrics: DataFrame) -> DataFrame:
    """(image_id, angle, uprightness) of raster_metrics(): 0 or 270, whichever is more upright; of equals 270 for wide images, else 0."""
    wide, as_is, turned = F.col("width") > F.col("height") * SIDEWAYS, F.col("upright"), F.col("upright_270")
    turn = F.when(wide, turned >= as_is).otherwise(turned > as_is)
    return metrics.select("image_id", F.when(turn, 270).otherwise(0).alias("angle"), F.greatest(as_is, turned).alias("uprightness"))
