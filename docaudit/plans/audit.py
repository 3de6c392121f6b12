"""The gated audit: readable documents are classified, those that fit their type are extracted, validated and judged; one row comes out for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.config import DEFAULT, Settings
from docaudit.functions.names import word_map
from docaudit.functions.text import cues, n_lines, ocr_gate
from docaudit.operators.classify import TRIES, classify, judge_type, score_types, try_types
from docaudit.operators.detectors import run_detectors, word_stats
from docaudit.operators.extract import extract, long_fields, validate
from docaudit.operators.raster import visual_flags
from docaudit.operators.results import completed_results, stopped_results
from docaudit.operators.score import decide, risk_block, risk_score, route_indicators
from docaudit.sources.catalog import TYPES
from docaudit.sources.shared import keep

VERIFIED = [t[0] for t in TYPES if t[3] == "verification"]


def verified(df: DataFrame, type_: str, settings: Settings = DEFAULT) -> DataFrame:
    """df (extracted and validated documents of a verified type) with risk_score, indicators and the decision."""
    text = F.coalesce(F.col("text"), F.lit(""))
    number = "aadhaar" if type_ == "AADHAAR" else "pan"
    flags = cues(text)
    if "isDarkUi" in df.columns:
        flags["hasScreenshotCues"] = flags["hasScreenshotCues"] | F.coalesce(F.col("isDarkUi"), F.lit(False))
    features = df.withColumns(flags | {"has_number": F.col(number).isNotNull(), "validation_passed": F.col("validation.passed"), "line_count": n_lines(text)})
    det = run_detectors(features)
    risk = risk_score(det, settings)
    # Both are one small row a document, keyed alike, so that the joins reuse one partitioning.
    return risk_block(decide(df.join(risk, "doc_id").join(route_indicators(det, risk), "doc_id"), settings), settings)


def audit_documents(df: DataFrame, settings: Settings = DEFAULT, blur_col: str | None = None, types: tuple[str, ...] = tuple(t[0] for t in TYPES), bag: bool = False, images: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """One result row for each row of df (doc_id, requested_type, text, ocr_confidence): stopped at the reading, stopped at the type, or completed.

    doc_ids are distinct. Rows of a type that is not in `types` stop at the classification. bag adds the entities that
    every type has. What the types' branches share, the gated and classified rows without their scores, is written once to
    the shared folder by branch, and each branch reads and extracts its own rows only. Rows of verified types are written
    again with their fields, since detectors, risk and decision each read them.

    images: a row of statistics by doc_id (the metrics of raster.raster_metrics() and raster_regions(), width, height), which
    the gate, the classification and the detectors use. words: (doc_id, text, confidence, y0, y1) of what was read; how it was
    read counts for names and for the font detector. Tables stored by store_by_document() are joined without a shuffle.
    """
    rows, blur_col = _with_images_and_words(df, blur_col, images, words)
    return _results(classify(_gated(rows, settings, blur_col), settings), settings, types, bag)


def _with_images_and_words(df: DataFrame, blur_col: str | None, images: DataFrame | None, words: DataFrame | None) -> tuple[DataFrame, str | None]:
    """df with what is known of its images and words, and the column of the blur."""
    if images is not None:
        stats = visual_flags(images)
        df = df.join(stats.select("doc_id", *[c for c in stats.columns if c not in df.columns]), "doc_id", "left")
        blur_col = blur_col or "blur"
    if words is not None:
        df = df.join(word_stats(words), "doc_id", "left").join(word_map(words), "doc_id", "left")
    return df, blur_col


def _gated(df: DataFrame, settings: Settings, blur_col: str | None) -> DataFrame:
    return ocr_gate(df, settings, blur_col=blur_col).withColumn("text", F.coalesce("text", F.lit("")))


def _results(rows: DataFrame, settings: Settings, types: tuple[str, ...], bag: bool, also: tuple[str, ...] = ()) -> DataFrame:
    """Result rows of gated and classified ones, with further columns of theirs."""
    rows = rows.drop("type_scores", "signals", "best_type")
    fits = F.col("classified") & F.col("requested_type").isin(*types)
    known = keep(rows.withColumn("branch", F.when(~F.col("gate_passed"), "ocr").when(fits, F.col("requested_type")).otherwise("classification")), "classified", "branch")
    out = stopped_results(known.filter("branch = 'ocr'").drop("classification_confidence"), "ocr", "gate_reasons", also)
    out = out.unionByName(stopped_results(known.filter("branch = 'classification'"), "classification", "class_reasons", also))
    for t in types:
        done = validate(extract(known.filter(F.col("branch") == t), t, settings, bag), t, settings)
        if t in VERIFIED:
            done = verified(keep(done, f"extracted-{t}"), t, settings)
        out = out.unionByName(completed_results(long_fields(done, t), also))
    return out


def audit_unknown(
    df: DataFrame, settings: Settings = DEFAULT, tries: tuple[str, ...] = TRIES, blur_col: str | None = None, bag: bool = False, images: DataFrame | None = None, words: DataFrame | None = None
) -> DataFrame:
    """One result row, and tried, for each row of df (doc_id, text, ocr_confidence) whose type nobody named: audited as one type after the other.

    Gate and scores do not depend on the type that is tried, and they decide how an attempt ends: they are made once, the
    attempts are judged inside the row (try_types()), and each document is extracted as the type that is taken only.
    Further arguments are those of audit_documents().
    """
    rows, blur_col = _with_images_and_words(df, blur_col, images, words)
    rows = try_types(score_types(_gated(rows, settings, blur_col), settings), F.col("gate_passed"), tries, settings)
    return _results(judge_type(rows, settings), settings, tries, bag, ("tried",))
