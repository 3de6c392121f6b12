"""Integrity detectors: a score, a pass mark and a weight each, over a document's cues, image statistics and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.patterns import has
from docaudit.sources.catalog import DETECTORS, detector_catalog

# What each detector says when it fails.
MESSAGES = {
    "layoutDetector": "Card layout mismatch",
    "logoDetector": "Government emblem missing",
    "checksumValidator": "Validation failed",
    "screenshotDetector": "Screenshot / UI capture detected",
    "blurDetector": "Image too blurry for reliable verification",
    "resolutionDetector": "Resolution too low",
    "fontDetector": "Highly inconsistent text rendering detected",
    "templateMatcher": "Document template does not match expected format",
    "cropDetector": "Document appears heavily cropped",
    "typedTextDetector": "Typed text / non-card document detected",
    "tamperingDetector": "Possible image tampering or compression artifacts detected",
    "ocrQualityDetector": "OCR quality too low for reliable extraction",
}
#: Columns that a features table may have; those it lacks count as absent, null or false.
NUMBERS = ("blur", "brightness", "contrast", "noise", "skew_angle", "dpi", "width", "height", "aspect_ratio", "edge_density", "color_variance", "ocr_confidence", "extraction_confidence", "word_count", "line_count", "n_words", "n_confident", "low_share", "conf_std", "n_heights", "height_cv")
FLAGS = (
    "isDarkUi", "hasExplicitFake", "hasJunkWords", "hasAadhaarLabel", "hasUidai", "hasGovernmentOfIndia", "hasPanLabel", "hasIncomeTax", "hasQrLikeRegion", "hasPhotoLikeRegion", "hasTimestampCue", "hasUiChrome",
    "hasScreenshotCues", "hasCamScanner", "hasNotepadCues", "isNearWhiteBg", "validation_passed", "has_number",
)


def _sum(*terms: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for when, points in terms:
        total = total + F.when(when, points).otherwise(0.0)
    return total


def _scores(df: DataFrame) -> dict[str, Column]:
    f = {x: F.coalesce(F.col(x), F.lit(False)) if x in df.columns else F.lit(False) for x in FLAGS}
    n = {x: F.col(x).cast("double") if x in df.columns else F.lit(None).cast("double") for x in NUMBERS}
    zero = {x: F.coalesce(n[x], F.lit(0.0)) for x in NUMBERS}
    ratio = F.coalesce(F.nullif(n["aspect_ratio"], F.lit(0.0)), F.lit(1.0))
    kind = F.col("requested_type") if "requested_type" in df.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in df.columns else F.lit("")
    photo, qr, dark = f["hasPhotoLikeRegion"], f["hasQrLikeRegion"], f["isDarkUi"]
    fake = dark | f["hasExplicitFake"] | f["hasJunkWords"]
    visual = photo | qr
    goi, label = f["hasGovernmentOfIndia"], f["hasAadhaarLabel"] | f["hasUidai"]
    by_type = lambda a, p: F.when(kind == "AADHAAR", a).when(kind == "PAN", p).otherwise(0.0)

    layout = by_type(
        _sum((label, 0.25), (goi, 0.15), (qr, 0.2), (photo, 0.2), ((ratio > 1.1) & (ratio < 2.2), 0.15), (zero["line_count"] >= 3, 0.05)),
        _sum((f["hasPanLabel"], 0.25), (f["hasIncomeTax"], 0.2), (goi, 0.1), (qr, 0.2), (photo, 0.15), ((ratio > 1.1) & (ratio < 2.4), 0.1), (zero["line_count"] >= 2, 0.05)),
    )
    logo = _sum((goi, 0.35), ((kind == "AADHAAR") & f["hasUidai"], 0.25), ((kind == "PAN") & f["hasIncomeTax"], 0.25), (qr, 0.2), (photo, 0.2), (zero["contrast"] > 0.12, 0.05), (zero["edge_density"] > 0.015, 0.1))
    template = by_type(
        _sum((label, 0.35), (goi, 0.2), (qr, 0.25), (photo, 0.2), (f["has_number"] & f["validation_passed"], 0.2)),
        _sum((f["hasIncomeTax"] | f["hasPanLabel"], 0.35), (goi, 0.15), (qr, 0.25), (photo, 0.2), (f["has_number"] & f["validation_passed"], 0.2)),
    )
    named = f["hasPanLabel"] | f["hasIncomeTax"] | label
    shot = _sum(
        (dark, 0.7), (f["hasTimestampCue"], 0.45), (f["hasUiChrome"], 0.4), (f["hasScreenshotCues"], 0.35), (f["hasCamScanner"] & dark, 0.05), ((ratio > 0.4) & (ratio < 0.7) & dark, 0.2), (ratio > 2.2, 0.1),
        ((n["brightness"] > 230) & (zero["edge_density"] < 0.01), 0.2), (dark & (goi | f["hasIncomeTax"] | f["hasUidai"] | f["hasPanLabel"]), 0.35),
    )
    typed = _sum(
        (f["hasExplicitFake"], 0.9), (f["hasJunkWords"], 0.55), (f["hasNotepadCues"], 0.5), (f["hasUiChrome"], 0.45), (f["hasTimestampCue"], 0.35), (dark, 0.55), (f["isNearWhiteBg"] & ~visual, 0.35), ((zero["ocr_confidence"] >= 85) & ~visual, 0.4),
        ((F.coalesce(n["brightness"], F.lit(128.0)) < 90) & ~photo, 0.35), (has(text, r"UNIQUE\s*IDENTIFICATION\s*AUTHORITY") & ~photo, 0.3), ((zero["word_count"] > 0) & (zero["line_count"] <= 8) & ~photo & (goi | f["hasIncomeTax"] | f["hasUidai"]), 0.25),
        ((n["contrast"] < 0.12) & (zero["edge_density"] < 0.015), 0.2), ((zero["color_variance"] < 30) & ~photo, 0.25), (~visual, 0.35),
    )
    tamper = _sum((n["noise"] > 0.22, 0.2), (n["contrast"] > 0.9, 0.1), (F.abs(zero["skew_angle"]) > 18, 0.1), ((zero["n_confident"] > 8) & (zero["low_share"] > 0.55), 0.15), (zero["edge_density"] > 0.12, 0.15))
    tamper = tamper * F.when(photo, 0.5).otherwise(1.0) * F.when(qr, 0.7).otherwise(1.0)
    short, long = F.least(zero["width"], zero["height"]), F.greatest(zero["width"], zero["height"])
    crop = 0.8 - _sum(((n["aspect_ratio"] != 0) & ((n["aspect_ratio"] < 0.5) | (n["aspect_ratio"] > 3.0)), 0.4), ((long > 0) & (short / F.nullif(long, F.lit(0.0)) < 0.3), 0.25))
    size = F.when(short >= 800, 0.4).when(short >= 500, 0.25).otherwise(0.1) + F.when(zero["dpi"] >= 150, 0.35).when(zero["dpi"] >= 100, 0.2).otherwise(0.05) + _sum(((zero["width"] >= 1000) & (zero["height"] >= 600), 0.25))
    band = F.when(n["conf_std"] < 20, 0.95).when(n["conf_std"] < 35, 0.8).when(n["conf_std"] < 50, 0.65).otherwise(0.45)
    font = F.when(zero["n_words"] == 0, 0.6).when(zero["n_confident"] < 5, 0.65).otherwise(band - _sum(((zero["n_heights"] > 5) & (zero["height_cv"] > 0.75), 0.2)))
    read = zero["ocr_confidence"] / 100 * F.when(zero["blur"] < 80, 0.75).otherwise(1.0) * F.when(zero["extraction_confidence"] < 40, 0.85).otherwise(1.0)
    read = F.when(zero["extraction_confidence"] >= 70, F.greatest(read, F.lit(0.55))).when(zero["extraction_confidence"] >= 50, F.greatest(read, F.lit(0.45))).otherwise(read)
    capped = F.when(f["validation_passed"] & named, F.least(template, F.lit(0.55))).otherwise(F.least(template, F.lit(0.35)))
    return {
        "layoutDetector": F.when(fake, 0.1).otherwise(F.when(visual, layout).otherwise(F.least(layout, F.lit(0.35)))),
        "logoDetector": F.when(fake, 0.05).otherwise(F.when((goi | f["hasIncomeTax"]) & ~visual, F.least(logo, F.lit(0.35))).otherwise(logo)),
        "checksumValidator": F.when(f["validation_passed"], 1.0).otherwise(0.0),
        "screenshotDetector": F.when(photo & ~dark, 0.9).otherwise(1 - F.least(shot, F.lit(1.0))),
        "blurDetector": F.when(zero["blur"] < 50, 0.2).when(zero["blur"] < 100, 0.5).when(zero["blur"] < 200, 0.75).otherwise(0.95),
        "resolutionDetector": size,
        "fontDetector": font,
        "templateMatcher": F.when(fake, 0.1).otherwise(F.when(visual, template).otherwise(capped)),
        "cropDetector": crop,
        "typedTextDetector": F.when(photo & (qr | (zero["edge_density"] > 0.02)), 0.9).otherwise(1 - F.least(typed, F.lit(1.0))),
        "tamperingDetector": 1 - tamper,
        "ocrQualityDetector": F.when(f["has_number"], F.greatest(read, F.lit(0.5))).otherwise(read),
    }


def word_stats(words: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_confident, low_share, conf_std, n_heights, height_cv) of words (doc_id, confidence, y0, y1); one row a document."""
    conf, height = F.when(F.col("confidence") > 0, F.col("confidence")), F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0"))
    out = words.groupBy("doc_id").agg(
        F.count("*").alias("n_words"), F.count(conf).alias("n_confident"), F.avg((conf < 30).cast("int")).alias("low_share"), F.stddev_pop(conf).alias("conf_std"), F.count(height).alias("n_heights"), (F.stddev_pop(height) / F.avg(height)).alias("height_cv")
    )
    return out


def all_detectors(features: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, name, pos, category, weight, score, passed, fraud_message): every detector on every row; scores have three places."""
    scores = _scores(features)
    rows = []
    for k, (name, category, weight, mark, _) in enumerate(DETECTORS):
        score = F.least(F.greatest(scores[name], F.lit(0.0)), F.lit(1.0))
        fixed = F.round(F.round(score, 9), 3)  # first to what the sum is in decimals
        passed = fixed >= mark
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(k).alias("pos"), F.lit(category).alias("category"), F.lit(weight).alias("weight"), fixed.alias("score"), passed.alias("passed"), F.when(~passed, MESSAGES[name]).alias("fraud_message")))
    return features.select(id_col, *(["requested_type"] if "requested_type" in features.columns else []), F.explode(F.array(*rows)).alias("d")).select(id_col, *(["requested_type"] if "requested_type" in features.columns else []), "d.*")


def run_detectors(features: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The detectors of each row's requested type, in the order of that type; the catalogue is a few dozen rows."""
    catalog = F.broadcast(detector_catalog(features.sparkSession).select("type", "name", F.col("pos").alias("type_pos")))
    every = all_detectors(features, id_col)
    return every.join(catalog, (every["requested_type"] == catalog["type"]) & (every["name"] == catalog["name"])).select(id_col, "requested_type", every["name"], F.col("type_pos").alias("pos"), "category", "weight", "score", "passed", "fraud_message")
