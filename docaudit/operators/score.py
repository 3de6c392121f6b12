"""Grouped measures: page and document readings, category and risk scores, indicators, decisions, stage logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.config import DEFAULT, Settings
from docaudit.functions.patterns import REASONS, half_up, reason
from docaudit.sources.catalog import DETECTORS

HARD = [d[0] for d in DETECTORS if d[4]]
SOFT = [d[0] for d in DETECTORS if not d[4]]


def page_confidence(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, ocr_confidence): the rounded mean of the positive word confidences of a page, 0 where there are none."""
    out = words.groupBy("doc_id", "page").agg(half_up(F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0))).alias("ocr_confidence"))
    if pages is None:
        return out
    return pages.join(out, ["doc_id", "page"], "left").withColumn("ocr_confidence", F.coalesce("ocr_confidence", F.lit(0)))


def assemble_document(pages: DataFrame) -> DataFrame:
    """(doc_id, text, ocr_confidence, n_pages): page texts in page order with a blank line between them, and the rounded mean of their confidences."""
    parts = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"), half_up(F.avg("ocr_confidence")).alias("ocr_confidence"), F.count("*").alias("n_pages"))


def best_variant(variants: DataFrame, settings: Settings = DEFAULT, fast: bool = False) -> DataFrame:
    """The best reading of each page, of variants (doc_id, page, variant, text, ocr_confidence, read_score) tried in their order.

    The search ends at an excellent score, at a good one when the best so far is confident, or, when fast, at a confident
    reading of more than 40 characters; of equal scores the first is kept.
    """
    order = Window.partitionBy("doc_id", "page").orderBy("variant")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    good = settings.fast_read if fast else settings.good_read
    rows = variants.withColumn("_best", F.max(F.struct("read_score", (-F.col("variant")).alias("v"), "ocr_confidence", F.char_length(F.trim(F.coalesce("text", F.lit("")))).alias("n"))).over(upto))
    conf = F.col("_best.ocr_confidence")
    stop = (F.col("read_score") >= settings.excellent_read) | ((F.col("read_score") >= good) & (conf >= 55))
    if fast:
        stop = stop | ((conf >= 60) & (F.col("_best.n") > 40))
    rows = rows.withColumn("_stop", stop.cast("int")).withColumn("_over", F.coalesce(F.max("_stop").over(before), F.lit(0))).filter("_over = 0")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("read_score"), "variant"))).filter("_r = 1")
    return rows.drop("_best", "_stop", "_over", "_r")


def choose_orientation(probes: DataFrame, margin: float = 20.0, enough: float = 90.0) -> DataFrame:
    """(doc_id, angle, score) of probes (doc_id, try_pos, angle, score): the first is taken, later ones only when better by margin; a first one of `enough` ends the search."""
    rows = probes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("try_pos", "angle", "score"))).alias("p"))
    first = F.get("p", F.lit(0))
    start = F.struct(first["angle"].alias("angle"), first["score"].alias("score"))
    better = lambda a, x: F.when((first["score"] < enough) & (x["score"] >= a["score"] + margin), F.struct(x["angle"].alias("angle"), x["score"].alias("score"))).otherwise(a)
    return rows.withColumn("b", F.aggregate(F.slice("p", F.lit(2), F.size("p")), start, better)).select("doc_id", "b.angle", "b.score")


def category_scores(det: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, category, score): weighted means with two places; a detector without a category tells of tampering.

    Scores have three places, and are summed as whole thousandths: sums do not depend on the order of rows.
    """
    known = F.create_map(*[F.lit(x) for d in DETECTORS for x in d[:2]])
    out = det.withColumn("category", F.coalesce(known[F.col("name")], F.lit("tampering"))).groupBy(id_col, "category").agg(F.sum(F.round(F.col("score") * 1000).cast("long") * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    return out.select(id_col, "category", (F.floor(F.when(F.col("w") == 0, F.col("s") / 10).otherwise(F.col("s") / (10 * F.nullif("w", F.lit(0)))) + 0.5) / 100).alias("score"))


def risk_score(det: DataFrame, settings: Settings = DEFAULT, id_col: str = "doc_id") -> DataFrame:
    """(id_col, risk_score, risk_passed, category_scores): a category that is missing counts 0; failed detectors cap the score.

    One row a document from at most a dozen detectors, in two combining aggregates.
    """
    s = settings
    cats = category_scores(det, id_col).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("category", "score"))).alias("category_scores"))
    one = lambda name, what: F.max(F.when(F.col("name") == name, what))
    failed = lambda name: F.coalesce(one(name, ~F.col("passed")), F.lit(False))
    caps = det.groupBy(id_col).agg(
        (failed("typedTextDetector") | F.coalesce(one("typedTextDetector", F.col("score") < 0.5), F.lit(False))).alias("c35"),
        F.coalesce(one("screenshotDetector", ~F.col("passed") & (F.col("score") < 0.45)), F.lit(False)).alias("c40"),
        (failed("logoDetector") & failed("layoutDetector")).alias("c45"),
    )
    total = F.lit(0.0)
    for name, weight in s.categories.items():
        total = total + F.round(F.coalesce(F.col("category_scores")[name], F.lit(0.0)) * 100) * round(weight * 100) / 100
    out = cats.join(caps, id_col).withColumn("risk_score", half_up(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0))))
    for flag, most in (("c35", 35), ("c40", 40), ("c45", 45)):
        out = out.withColumn("risk_score", F.when(F.col(flag), F.least("risk_score", F.lit(most))).otherwise(F.col("risk_score")))
    return out.select(id_col, "risk_score", (F.col("risk_score") >= s.risk).alias("risk_passed"), "category_scores")


def route_indicators(det: DataFrame, risk: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, fraud_indicators, quality_warnings, risk_reasons, risk_checks): failed hard detectors tell of fraud, soft ones only where the risk failed and they score below 0.35."""
    rows = det.join(risk.select(id_col, "risk_passed"), id_col)
    hard, soft = F.col("name").isin(HARD), F.col("name").isin(SOFT)
    said = ~F.col("passed") & F.col("fraud_message").isNotNull()
    fraud = said & (hard | (soft & ~F.col("risk_passed") & (F.col("score") < 0.35)) | (~hard & ~soft & ~F.col("risk_passed")))
    rows = rows.withColumns({"fraud": fraud, "warn": said & ~fraud})
    code = F.concat(F.lit("DETECTOR_"), F.upper("name"), F.when(F.col("fraud"), "_FAIL").otherwise("_WARN"))
    one = F.struct(code.alias("code"), F.col("fraud_message").alias("message"), F.lit("risk").alias("stage"), F.lit(None).cast("int").alias("impact"))
    listed = lambda when, what: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", what.alias("x"))))), lambda v: v["x"])
    return rows.groupBy(id_col).agg(
        F.array_distinct(listed(F.col("fraud"), F.col("fraud_message"))).alias("fraud_indicators"),
        F.array_distinct(listed(F.col("warn"), F.col("fraud_message"))).alias("quality_warnings"),
        listed(said & (F.col("fraud") | soft), one).alias("risk_reasons"),
        F.map_from_entries(F.collect_list(F.struct("name", "passed"))).alias("risk_checks"),
    )


def decide(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """df (with validation and risk_score) with risk_assessment, its older mirror authenticity, and overall_passed."""
    block = lambda *extra: F.struct((F.col("risk_score") >= settings.risk).alias("passed"), F.col("risk_score").alias("score"), F.lit(settings.risk).alias("threshold"), *extra)
    return df.withColumns({"risk_assessment": block(F.col("risk_score").alias("overallScore")), "authenticity": block(), "overall_passed": F.col("validation.passed") & (F.col("risk_score") >= settings.risk)})


def risk_block(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """df (with risk_score, fraud_indicators) with risk_reasoning: how the score meets the threshold, then each indicator."""
    passed = F.col("risk_score") >= settings.risk
    first = F.coalesce(
        reason("RISK_BELOW_THRESHOLD", F.format_string(f"Integrity score %d meets threshold {settings.risk}", F.col("risk_score")), "risk", passed),
        reason("RISK_ABOVE_THRESHOLD", F.format_string(f"Integrity score %d below threshold {settings.risk}", F.col("risk_score")), "risk", ~passed),
    )
    rest = F.transform("fraud_indicators", lambda m: F.struct(F.lit("INTEGRITY_INDICATOR").alias("code"), m.alias("message"), F.lit("risk").alias("stage"), F.lit(None).cast("int").alias("impact")))
    return df.withColumn("risk_reasoning", F.when(F.col("risk_score").isNotNull(), F.concat(F.array(first), rest)).cast(REASONS))


STAGES = ("ocr", "classification", "extraction", "validation", "risk")


def stage_timings(log: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(doc_id, <stage>_ms..., total_ms) of a log (doc_id, stage, ts): from the first to the last entry of each stage, and of the document."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    per = [(F.max(F.when(F.col("stage") == s, ms("ts"))) - F.min(F.when(F.col("stage") == s, ms("ts")))).alias(f"{s}_ms") for s in stages]
    return log.groupBy("doc_id").agg(*per, (F.max(ms("ts")) - F.min(ms("ts"))).alias("total_ms"))


def stage_funnel(log: DataFrame) -> DataFrame:
    """(type, stage, status, n): entries of a log at each level; "*" stands for all."""
    out = log.rollup("type", "stage", "status").count()
    return out.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in ("type", "stage", "status")], F.col("count").alias("n"))


def group_summary(results: DataFrame, by: str) -> DataFrame:
    """(by, completed, stopped, error, total)."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    return results.groupBy(by).agg(n("completed").alias("completed"), n("stopped").alias("stopped"), n("error").alias("error"), F.count("*").alias("total"))
