"""Queries over scores, detectors, results, evaluation, raster statistics, sources and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from docaudit.operators import detectors as de
from docaudit.operators import evaluate as ev
from docaudit.operators import results as re_
from docaudit.operators import score as sc
from docaudit.plans import audit
from docaudit.plans.record_queries import _WORDS, _passports, ocr_words
from docaudit.plans.registry import query
from docaudit.plans.text_queries import _FIT, MIX
from docaudit.sources import catalog
from docaudit.sources import corpus as co
from docaudit.sources.shared import own_folder
from docaudit.streaming import streams


@query("a1_page_confidence", f"SELECT doc_id, page, CAST(floor(coalesce(avg(confidence) FILTER (WHERE confidence > 0), 0) + 0.5) AS INT) AS ocr_confidence FROM ({_WORDS}) GROUP BY doc_id, page")
def page_confidence(spark, sf_dir):
    return sc.page_confidence(ocr_words(spark, sf_dir))


@query(
    "a3_assembled_documents",
    "SELECT conv_id AS doc_id, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest, CAST(floor(avg(CAST((conv_id * 13 + turn * 29) % 100 AS INT)) + 0.5) AS INT) AS ocr_confidence, count(*) AS n_pages FROM conversations GROUP BY conv_id",
)
def assembled(spark, sf_dir):
    pages = co.read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text", ((F.col("conv_id") * 13 + F.col("turn") * 29) % 100).cast("int").alias("ocr_confidence"))
    return sc.assemble_document(pages).select("doc_id", F.md5("text").alias("digest"), "ocr_confidence", "n_pages")


@query(
    "a2_best_variants",
    """WITH v AS (SELECT doc_id, p AS variant, (doc_id * 17 + p * 71) % 230 AS s, CAST((doc_id * 7 + p * 31) % 100 AS INT) AS conf FROM documents CROSS JOIN (VALUES (1), (2), (3)) t(p)),
  b AS (SELECT *, arg_max(conf, s * 10 - variant) OVER (PARTITION BY doc_id ORDER BY variant ROWS UNBOUNDED PRECEDING) AS best_conf FROM v),
  st AS (SELECT *, min(CASE WHEN s >= 200 OR (s >= 140 AND best_conf >= 55) THEN variant END) OVER (PARTITION BY doc_id) AS stop FROM b)
  SELECT doc_id, arg_max(variant, s * 10 - variant) AS variant, max(s) AS read_score FROM st WHERE variant <= coalesce(stop, 3) GROUP BY doc_id""",
)
def variants(spark, sf_dir):
    rows = co.read_table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("variant"), "text")
    d, p = F.col("doc_id"), F.col("variant")
    rows = rows.withColumns({"read_score": (d * 17 + p * 71) % 230, "ocr_confidence": ((d * 7 + p * 31) % 100).cast("int")})
    return sc.best_variant(rows).select("doc_id", "variant", "read_score")


@query(
    "a4_orientations",
    """WITH p AS (SELECT doc_id, doc_id * 7 % 120 AS s0, doc_id * 11 % 150 AS s1, doc_id * 13 % 170 AS s2 FROM documents), q AS (SELECT *, s0 < 90 AND s1 >= s0 + 20 AS t1 FROM p), r AS (SELECT *, CASE WHEN t1 THEN s1 ELSE s0 END AS b FROM q)
  SELECT doc_id, CASE WHEN s0 < 90 AND s2 >= b + 20 THEN 90 WHEN t1 THEN 270 ELSE 0 END AS angle, CASE WHEN s0 < 90 AND s2 >= b + 20 THEN s2 ELSE b END AS score FROM r""",
)
def orientations(spark, sf_dir):
    d = F.col("doc_id")
    tries = F.array(*[F.struct(F.lit(k).alias("try_pos"), F.lit(a).alias("angle"), (d * f % m).alias("score")) for k, (a, f, m) in enumerate(((0, 7, 120), (270, 11, 150), (90, 13, 170)))])
    rows = co.read_table(spark, sf_dir, "documents").select("doc_id", F.explode(tries).alias("t")).select("doc_id", "t.*")
    return sc.choose_orientation(rows)


_META = """SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'AADHAAR' ELSE 'PAN' END AS requested_type, CAST(doc_id * 13 % 260 AS DOUBLE) AS blur, CAST(doc_id * 7 % 256 AS DOUBLE) AS brightness, (doc_id * 3 % 100) / 100.0 AS contrast, (doc_id * 11 % 40) / 100.0 AS noise, CAST(doc_id * 5 % 41 - 20 AS DOUBLE) AS skew_angle,
  CAST(doc_id * 17 % 250 AS DOUBLE) AS dpi, 300 + doc_id * 19 % 1500 AS width, 200 + doc_id * 23 % 1100 AS height, (doc_id * 29 % 200) / 1000.0 AS edge_density, CAST(doc_id * 31 % 90 AS DOUBLE) AS color_variance, doc_id % 3 = 0 AS "hasPhotoLikeRegion", doc_id % 4 = 0 AS "hasQrLikeRegion", doc_id % 11 = 0 AS "isDarkUi",
  doc_id % 5 = 0 AS "hasGovernmentOfIndia", doc_id % 7 = 0 AS "hasUidai", doc_id % 6 = 0 AS "hasIncomeTax", doc_id % 13 <> 0 AS validation_passed, CAST(30 + doc_id * 37 % 70 AS INT) AS ocr_confidence, CAST(doc_id * 41 % 101 AS INT) AS extraction_confidence, doc_id % 17 = 0 AS has_number, CAST(doc_id % 12 AS INT) AS line_count FROM documents"""


def image_meta(spark, sf_dir):
    """Image statistics by arithmetic on the documents' ids, in every band of the detectors."""
    return co._sql(spark, _META.replace('"', "`"), documents=co.read_table(spark, sf_dir, "documents")).withColumn("aspect_ratio", F.col("width") / F.col("height"))


_ONE = {
    "blurDetector": ("CASE WHEN blur < 50 THEN 0.2 WHEN blur < 100 THEN 0.5 WHEN blur < 200 THEN 0.75 ELSE 0.95 END", 0.5),
    "cropDetector": ("0.8 - CASE WHEN ratio < 0.5 OR ratio > 3 THEN 0.4 ELSE 0 END - CASE WHEN lo / hi < 0.3 THEN 0.25 ELSE 0 END", 0.5),
    "resolutionDetector": ("CASE WHEN lo >= 800 THEN 0.4 WHEN lo >= 500 THEN 0.25 ELSE 0.1 END + CASE WHEN dpi >= 150 THEN 0.35 WHEN dpi >= 100 THEN 0.2 ELSE 0.05 END + CASE WHEN width >= 1000 AND height >= 600 THEN 0.25 ELSE 0 END", 0.5),
    "checksumValidator": ("CASE WHEN validation_passed THEN 1.0 ELSE 0.0 END", 1.0),
    "tamperingDetector": (
        'CAST(1 AS DOUBLE) - (CASE WHEN noise > 0.22 THEN 0.2 ELSE 0 END + CASE WHEN contrast > 0.9 THEN 0.1 ELSE 0 END + CASE WHEN abs(skew_angle) > 18 THEN 0.1 ELSE 0 END + CASE WHEN edge_density > 0.12 THEN 0.15 ELSE 0 END) * CASE WHEN "hasPhotoLikeRegion" THEN 0.5 ELSE 1 END * CASE WHEN "hasQrLikeRegion" THEN 0.7 ELSE 1 END',
        0.5,
    ),
    "logoDetector": ('CASE WHEN "isDarkUi" THEN 0.05 ELSE least(1.0, CASE WHEN ("hasGovernmentOfIndia" OR "hasIncomeTax") AND NOT "hasPhotoLikeRegion" AND NOT "hasQrLikeRegion" THEN least(0.35, pts) ELSE pts END) END', 0.45),
    "screenshotDetector": ('CASE WHEN "hasPhotoLikeRegion" AND NOT "isDarkUi" THEN 0.9 ELSE 1 - least(1.0, shot) END', 0.55),
    "ocrQualityDetector": (
        "greatest(CASE WHEN extraction_confidence >= 70 THEN 0.55 WHEN extraction_confidence >= 50 THEN 0.45 ELSE 0 END, CASE WHEN has_number THEN 0.5 ELSE 0 END, CAST(ocr_confidence AS DOUBLE) / 100 * CASE WHEN blur < 80 THEN 0.75 ELSE 1 END * CASE WHEN extraction_confidence < 40 THEN 0.85 ELSE 1 END)",
        0.35,
    ),
}
_POINTS = """CASE WHEN "hasGovernmentOfIndia" THEN 0.35 ELSE 0 END + CASE WHEN requested_type = 'AADHAAR' AND "hasUidai" THEN 0.25 ELSE 0 END + CASE WHEN requested_type = 'PAN' AND "hasIncomeTax" THEN 0.25 ELSE 0 END + CASE WHEN "hasQrLikeRegion" THEN 0.2 ELSE 0 END + CASE WHEN "hasPhotoLikeRegion" THEN 0.2 ELSE 0 END + CASE WHEN contrast > 0.12 THEN 0.05 ELSE 0 END + CASE WHEN edge_density > 0.015 THEN 0.1 ELSE 0 END AS pts,
  CASE WHEN "isDarkUi" THEN 0.7 ELSE 0 END + CASE WHEN "isDarkUi" AND ratio > 0.4 AND ratio < 0.7 THEN 0.2 ELSE 0 END + CASE WHEN ratio > 2.2 THEN 0.1 ELSE 0 END + CASE WHEN brightness > 230 AND edge_density < 0.01 THEN 0.2 ELSE 0 END + CASE WHEN "isDarkUi" AND ("hasGovernmentOfIndia" OR "hasIncomeTax" OR "hasUidai") THEN 0.35 ELSE 0 END AS shot"""
_DETECTED = f"SELECT *, {_POINTS} FROM (SELECT *, least(width, height) AS lo, greatest(width, height) AS hi, width / height AS ratio FROM ({_META}))"


@query(
    "d1_d12_detectors",
    " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, round(CAST({s} AS DOUBLE), 3) AS score, round(CAST({s} AS DOUBLE), 3) >= {m} AS passed FROM ({_DETECTED})" for n, (s, m) in _ONE.items() if n != "ocrQualityDetector"),
)
def detected(spark, sf_dir):
    rows = de.all_detectors(image_meta(spark, sf_dir)).filter(F.col("name").isin([n for n in _ONE if n != "ocrQualityDetector"]))
    return rows.select("doc_id", "name", "score", "passed")


@query("d7_reading_quality", f"SELECT doc_id, score, score >= {_ONE['ocrQualityDetector'][1]} AS passed FROM (SELECT doc_id, CAST(round(CAST({_ONE['ocrQualityDetector'][0]} AS DECIMAL(18, 9)), 3) AS DOUBLE) AS score FROM ({_DETECTED}))")
def reading_quality(spark, sf_dir):
    return de.all_detectors(image_meta(spark, sf_dir)).filter("name = 'ocrQualityDetector'").select("doc_id", "score", "passed")


def _add(*terms: tuple[str, float]) -> str:
    return "(" + " + ".join(f"CASE WHEN {when} THEN {points} ELSE 0 END" for when, points in terms) + ")"


# What the three say of cards, in whole hundredths; image_meta has no text and names no label but these.
_QR, _PHOTO, _GOI, _TAX, _UID = '"hasQrLikeRegion"', '"hasPhotoLikeRegion"', '"hasGovernmentOfIndia"', '"hasIncomeTax"', '"hasUidai"'
_A = "requested_type = 'AADHAAR'"
_LAYOUT = f"CASE WHEN {_A} THEN {_add((_UID, 25), (_GOI, 15), (_QR, 20), (_PHOTO, 20), ('ratio > 1.1 AND ratio < 2.2', 15), ('line_count >= 3', 5))} ELSE {_add((_TAX, 20), (_GOI, 10), (_QR, 20), (_PHOTO, 15), ('ratio > 1.1 AND ratio < 2.4', 10), ('line_count >= 2', 5))} END"
_TEMPLATE = f"CASE WHEN {_A} THEN {_add((_UID, 35), (_GOI, 20), (_QR, 25), (_PHOTO, 20), ('has_number AND validation_passed', 20))} ELSE {_add((_TAX, 35), (_GOI, 15), (_QR, 25), (_PHOTO, 20), ('has_number AND validation_passed', 20))} END"
_TYPED = _add(('"isDarkUi"', 55), (f"ocr_confidence >= 85 AND NOT ({_PHOTO} OR {_QR})", 40), (f"brightness < 90 AND NOT {_PHOTO}", 35), ("contrast < 0.12 AND edge_density < 0.015", 20), (f"color_variance < 30 AND NOT {_PHOTO}", 25), (f"NOT ({_PHOTO} OR {_QR})", 35))
_CARD = {
    "layoutDetector": (f"CASE WHEN \"isDarkUi\" THEN 10 WHEN {_PHOTO} OR {_QR} THEN {_LAYOUT} ELSE least(35, {_LAYOUT}) END", 45),
    "templateMatcher": (f"CASE WHEN \"isDarkUi\" THEN 10 WHEN {_PHOTO} OR {_QR} THEN least(100, {_TEMPLATE}) WHEN validation_passed AND ({_TAX} OR {_UID}) THEN least(55, {_TEMPLATE}) ELSE least(35, {_TEMPLATE}) END", 40),
    "typedTextDetector": (f"CASE WHEN {_PHOTO} AND ({_QR} OR edge_density > 0.02) THEN 90 ELSE 100 - least(100, {_TYPED}) END", 50),
}


@query("d5_d11_d12_card_cues", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, CAST({sql} AS INT) AS hundredths, {sql} >= {mark} AS passed FROM ({_DETECTED})" for n, (sql, mark) in _CARD.items()))
def card_cues(spark, sf_dir):
    rows = de.all_detectors(image_meta(spark, sf_dir)).filter(F.col("name").isin(*_CARD))
    return rows.select("doc_id", "name", F.round(F.col("score") * 100).cast("int").alias("hundredths"), "passed")


@query(
    "d4_fonts",
    f"""SELECT doc_id, CAST(score AS DOUBLE) AS score, score >= 0.4 AS passed FROM (SELECT doc_id, CASE WHEN n_confident < 5 THEN 0.65 ELSE round(CASE WHEN s < 20 THEN 0.95 WHEN s < 35 THEN 0.8 WHEN s < 50 THEN 0.65 ELSE 0.45 END - CASE WHEN n > 5 AND cv > 0.75 THEN 0.2 ELSE 0 END, 3) END AS score
  FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE confidence > 0) AS n_confident, stddev_pop(confidence) FILTER (WHERE confidence > 0) AS s, stddev_pop(y1 - y0) / avg(y1 - y0) AS cv FROM ({_WORDS}) GROUP BY doc_id))""",
)
def fonts(spark, sf_dir):
    rows = de.all_detectors(de.word_stats(ocr_words(spark, sf_dir))).filter("name = 'fontDetector'")
    return rows.select("doc_id", "score", "passed")


@query(
    "d4_font_words",
    f"SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE confidence > 0) AS n_confident, round(stddev_pop(confidence) FILTER (WHERE confidence > 0), 6) AS conf_std, round(stddev_pop(y1 - y0) / avg(y1 - y0), 6) AS height_cv FROM ({_WORDS}) GROUP BY doc_id",
)
def font_words(spark, sf_dir):
    out = de.word_stats(ocr_words(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_confident", F.round("conf_std", 6).alias("conf_std"), F.round("height_cv", 6).alias("height_cv"))


# The detectors of cards, in their order.
_CARDS = ("checksumValidator", "layoutDetector", "logoDetector", "ocrQualityDetector", "screenshotDetector")


@query("d13_detectors_by_type", f"SELECT doc_id, requested_type, '{','.join(_CARDS)}' AS names FROM ({_META})")
def detectors_by_type(spark, sf_dir):
    rows = de.run_detectors(image_meta(spark, sf_dir)).groupBy("doc_id", "requested_type")
    return rows.agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


_DET = "SELECT doc_id, pos, name, score, weight, score >= 0.5 AS passed, CASE WHEN score < 0.5 THEN concat(name, ' failed') END AS fraud_message, category FROM (SELECT doc_id, v.pos, v.name, v.weight, v.category, (doc_id * 7 + v.pos * 13) % 100 / 100.0 AS score FROM documents CROSS JOIN (VALUES @rows) AS v(pos, name, weight, category))"
_DET = _DET.replace("@rows", ", ".join(f"({k}, '{d[0]}', {d[2]}, '{d[1]}')" for k, d in enumerate(catalog.DETECTORS)))


def det_table(spark, sf_dir):
    """Detector results by arithmetic on the documents' ids."""
    rows = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(d[0]).alias("name"), F.lit(d[2]).alias("weight")) for k, d in enumerate(catalog.DETECTORS)])
    out = co.read_table(spark, sf_dir, "documents").select("doc_id", F.explode(rows).alias("d")).select("doc_id", "d.*")
    score = ((F.col("doc_id") * 7 + F.col("pos") * 13) % 100) / 100
    return out.withColumns({"score": score, "passed": score >= 0.5, "fraud_message": F.when(score < 0.5, F.concat("name", F.lit(" failed")))})


_CATS = f"SELECT doc_id, category, CAST(floor(sum(CAST(round(score * 100) AS BIGINT) * weight) / sum(weight) + 0.5) AS BIGINT) AS h FROM ({_DET}) GROUP BY doc_id, category"


@query("a8_category_scores", f"SELECT doc_id, category, h / 100 AS score FROM ({_CATS})")
def categories(spark, sf_dir):
    return sc.category_scores(det_table(spark, sf_dir)).select("doc_id", "category", "score")


_RISK = f"""SELECT doc_id, least(CAST(floor(least(100, greatest(0, sum(h * CASE category WHEN 'ocrQuality' THEN 8 WHEN 'layoutMatch' THEN 25 WHEN 'logoDetection' THEN 20 WHEN 'validation' THEN 18 WHEN 'tampering' THEN 19 ELSE 10 END) / 100)) + 0.5) AS INT),
  any_value(CASE WHEN typed < 0.5 THEN 35 WHEN shot < 0.45 THEN 40 WHEN logo < 0.5 AND layout < 0.5 THEN 45 ELSE 100 END)) AS risk_score
  FROM ({_CATS}) JOIN (SELECT doc_id, max(score) FILTER (WHERE name = 'typedTextDetector') AS typed, max(score) FILTER (WHERE name = 'screenshotDetector') AS shot, max(score) FILTER (WHERE name = 'logoDetector') AS logo, max(score) FILTER (WHERE name = 'layoutDetector') AS layout FROM ({_DET}) GROUP BY doc_id) USING (doc_id) GROUP BY doc_id"""


@query("a9_a11_risk", f"SELECT doc_id, risk_score, risk_score >= 70 AS passed, risk_score >= 70 AND doc_id % 3 <> 0 AS overall_passed FROM ({_RISK})")
def risk(spark, sf_dir):
    out = sc.risk_score(det_table(spark, sf_dir)).withColumn("validation", F.struct((F.col("doc_id") % 3 != 0).alias("passed")))
    return sc.decide(out).select("doc_id", "risk_score", F.col("risk_assessment.passed").alias("passed"), "overall_passed")


_FRAUD = f"(name IN ({', '.join(repr(x) for x in sc.HARD)}) OR (risk_score < 70 AND score < 0.35))"


@query(
    "a10_r3_indicators",
    f"""SELECT doc_id, coalesce(string_agg(fraud_message, ',' ORDER BY pos) FILTER (WHERE NOT passed AND {_FRAUD}), '') AS fraud, coalesce(string_agg(fraud_message, ',' ORDER BY pos) FILTER (WHERE NOT passed AND NOT {_FRAUD}), '') AS warnings,
  coalesce(string_agg(concat('DETECTOR_', upper(name), CASE WHEN {_FRAUD} THEN '_FAIL' ELSE '_WARN' END), ',' ORDER BY pos) FILTER (WHERE NOT passed), '') AS codes,
  concat(CASE WHEN any_value(risk_score) >= 70 THEN 'RISK_BELOW_THRESHOLD' ELSE 'RISK_ABOVE_THRESHOLD' END, repeat(',INTEGRITY_INDICATOR', count(*) FILTER (WHERE NOT passed AND {_FRAUD}))) AS reasoning, bool_and(passed) AS clean FROM ({_DET}) JOIN ({_RISK}) USING (doc_id) GROUP BY doc_id""",
)
def indicators(spark, sf_dir):
    det = det_table(spark, sf_dir)
    risk = sc.risk_score(det)
    out = sc.risk_block(sc.route_indicators(det, risk).join(risk.select("doc_id", "risk_score"), "doc_id"))
    codes = lambda c: F.array_join(F.transform(c, lambda r: r["code"]), ",")
    clean = F.forall(F.map_values("risk_checks"), lambda v: v)
    return out.select("doc_id", F.array_join("fraud_indicators", ",").alias("fraud"), F.array_join("quality_warnings", ",").alias("warnings"), codes("risk_reasons").alias("codes"), codes("risk_reasoning").alias("reasoning"), clean.alias("clean"))


_STAGE = "CASE event_type WHEN 'click' THEN 'ocr' WHEN 'view' THEN 'classification' WHEN 'error' THEN 'extraction' WHEN 'purchase' THEN 'validation' ELSE 'risk' END"


def stage_log(spark, sf_dir):
    """(doc_id, type, stage, status, ts): the events table as the log of an audit."""
    stage = F.when(F.col("event_type") == "click", "ocr").when(F.col("event_type") == "view", "classification").when(F.col("event_type") == "error", "extraction").when(F.col("event_type") == "purchase", "validation").otherwise("risk")
    kind = F.element_at(F.array(*[F.lit(t[0]) for t in catalog.TYPES]), (F.col("user_id") % 7 + 1).cast("int"))
    return co.read_table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), kind.alias("type"), stage.alias("stage"), F.when(F.col("event_id") % 3 == 0, "stopped").otherwise("completed").alias("status"), "ts")


@query(
    "a12_stage_timings",
    "SELECT user_id AS doc_id, " + ", ".join(f"epoch_us(max(ts) FILTER (WHERE {_STAGE} = '{s}')) // 1000 - epoch_us(min(ts) FILTER (WHERE {_STAGE} = '{s}')) // 1000 AS {s}_ms" for s in sc.STAGES) + ", epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS total_ms FROM events GROUP BY user_id",
)
def timings(spark, sf_dir):
    return sc.stage_timings(stage_log(spark, sf_dir))


_LOG = "SELECT CASE user_id % 7 " + " ".join(f"WHEN {k} THEN '{t[0]}'" for k, t in enumerate(catalog.TYPES)) + f" END AS type, {_STAGE} AS stage, CASE WHEN event_id % 3 = 0 THEN 'stopped' ELSE 'completed' END AS status, ts FROM events"


@query("a13_stage_funnel", f"SELECT coalesce(type, '*') AS type, coalesce(stage, '*') AS stage, coalesce(status, '*') AS status, count(*) AS n FROM ({_LOG}) GROUP BY ROLLUP (type, stage, status)")
def funnel(spark, sf_dir):
    return sc.stage_funnel(stage_log(spark, sf_dir))


@query("a14_group_summary", f"SELECT type, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'stopped') AS stopped, 0::BIGINT AS error, count(*) AS total FROM ({_LOG}) GROUP BY type")
def summary(spark, sf_dir):
    return sc.group_summary(stage_log(spark, sf_dir), "type")


_EXTRACTED = ("CIN", "SECURITY_CLEARANCE", "AUTHORITY_LETTER")


@query(
    "r1_r2_r4_audit",
    f"""SELECT doc_id, CASE WHEN NOT readable OR {_FIT} = 'UNKNOWN' THEN 'stopped' ELSE 'completed' END AS status, CASE WHEN NOT readable THEN 'ocr' WHEN {_FIT} = 'UNKNOWN' THEN 'classification' ELSE 'completed' END AS stage, CASE WHEN readable THEN {_FIT} END AS document_type,
  CASE WHEN NOT readable OR {_FIT} = 'UNKNOWN' THEN false WHEN t = 5 THEN NULL WHEN t = 2 THEN k % 10 NOT IN (1, 2, 3) ELSE k % 10 NOT IN (1, 3) END AS overall_passed
  FROM (SELECT *, doc_id // 10 AS k, doc_id % 10 AS t, ocr_confidence >= 40 AND len(regexp_extract_all(text, '[A-Za-z0-9]')) >= 25 AS readable FROM ({MIX})) WHERE requested_type IN {_EXTRACTED}""",
)
def audited(spark, sf_dir):
    mix = co.planted_mix(spark, sf_dir).filter(F.col("requested_type").isin(*_EXTRACTED))
    return audit.audit_documents(mix, types=_EXTRACTED).select("doc_id", "status", "stage", "document_type", "overall_passed")


@query(
    "r1_r2_r4_audit_programme",
    f"""SELECT doc_id, CASE WHEN NOT readable THEN 'stopped' ELSE 'completed' END AS status, CASE WHEN NOT readable THEN 'ocr' ELSE 'completed' END AS stage, CASE WHEN readable THEN requested_type END AS document_type, readable AND doc_id // 10 % 10 <> 1 AS overall_passed
  FROM (SELECT *, ocr_confidence >= 40 AND len(regexp_extract_all(text, '[A-Za-z0-9]')) >= 25 AS readable FROM ({MIX})) WHERE requested_type = 'SECURITY_PROGRAMME'""",
)
def audited_programmes(spark, sf_dir):
    mix = co.planted_mix(spark, sf_dir).filter("requested_type = 'SECURITY_PROGRAMME'")
    return audit.audit_documents(mix, types=("SECURITY_PROGRAMME",)).select("doc_id", "status", "stage", "document_type", "overall_passed")


# Without an image a card's layout and emblem are capped at 0.35 and fail, which caps the score of a valid one at 45.
_SIGHT = "CAST(floor(CAST(round(conf * 0.75 * 0.85 * 10) AS BIGINT) / 10 + 0.5) AS BIGINT)"


@query(
    "r4_card_audit",
    f"""WITH r AS (SELECT doc_id, requested_type, doc_id // 10 % 10 AS d, doc_id % 10 AS t, ocr_confidence AS conf, ocr_confidence >= 40 AND len(regexp_extract_all(text, '[A-Za-z0-9]')) >= 25 AS readable FROM ({MIX})),
  v AS (SELECT *, readable AND d <> 5 AS done, CASE WHEN t = 0 THEN d NOT IN (1, 2, 3) ELSE d <> 3 END AS valid FROM r WHERE t IN (0, 1))
  SELECT doc_id, CASE WHEN done THEN 'completed' ELSE 'stopped' END AS status, CASE WHEN NOT readable THEN 'ocr' WHEN done THEN 'completed' ELSE 'classification' END AS stage, CASE WHEN done THEN requested_type WHEN readable THEN 'UNKNOWN' END AS document_type, CASE WHEN done THEN valid END AS validation_passed,
    CAST(CASE WHEN done AND valid THEN 45 WHEN done THEN floor(0.35 * 25 + 0.35 * 20 + 19 + {_SIGHT} * 0.08 + 0.5) END AS INT) AS risk_score, false AS overall_passed,
    CASE WHEN done THEN concat('RISK_ABOVE_THRESHOLD', repeat(',INTEGRITY_INDICATOR', CASE WHEN valid THEN 2 WHEN conf * 0.75 * 0.85 < 35 THEN 4 ELSE 3 END)) END AS reasoning FROM v""",
)
def audited_cards(spark, sf_dir):
    mix = co.planted_mix(spark, sf_dir).filter(F.col("requested_type").isin("AADHAAR", "PAN"))
    out = audit.audit_documents(mix, types=("AADHAAR", "PAN"))
    return out.select("doc_id", "status", "stage", "document_type", "validation_passed", "risk_score", "overall_passed", F.array_join(F.transform("risk_reasoning", lambda r: r["code"]), ",").alias("reasoning"))


@query(
    "r4_passport_audit",
    """SELECT k AS doc_id, 'completed' AS status, 'PASSPORT' AS document_type, CASE WHEN d = 3 THEN 55 ELSE 100 END AS classification_confidence, CASE d WHEN 3 THEN 14 WHEN 2 THEN 81 ELSE 91 END AS extraction_confidence,
  CASE d WHEN 1 THEN 'FORMAT_VALID,MRZ_COMPOSITE_CHECK_FAIL' WHEN 2 THEN 'DATE_ORDER_INVALID,FORMAT_VALID,LOGICAL_INCONSISTENCY'
    WHEN 3 THEN 'DATE_ORDER_INVALID,EXTRACTION_BELOW_THRESHOLD,LOGICAL_INCONSISTENCY,MISSING_MANDATORY_FIELDS,MRZ_MISSING,PASSPORT_NUMBER_FORMAT' ELSE 'FORMAT_VALID' END AS codes, d NOT IN (1, 2, 3) AS overall_passed,
  CASE WHEN d <> 3 THEN concat(chr(CAST(65 + k % 26 AS INT)), lpad(CAST(k AS VARCHAR), 7, '0')) END AS number, CASE WHEN d <> 3 THEN 'ROE' END AS surname, CASE WHEN d <> 3 THEN concat('SAM ', translate(CAST(k AS VARCHAR), '0123456789', 'ABCDEFGHIJ')) END AS given, CASE WHEN d <> 3 THEN concat(dd, '/05/1980') END AS birth,
  CASE WHEN d <> 3 THEN concat(dd, '/05/2031') ELSE '06/05/2021' END AS expiry, CASE WHEN d = 2 THEN '01/01/2035' ELSE '06/05/2021' END AS issue FROM (SELECT c_custkey AS k, c_custkey % 10 AS d, lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS dd FROM customer)""",
)
def audited_passports(spark, sf_dir):
    rows = _passports(spark, sf_dir).drop("number").withColumn("requested_type", F.lit("PASSPORT"))
    out = audit.audit_documents(rows, types=("PASSPORT",))
    said = F.filter(F.transform("reasons", lambda r: r["code"]), lambda c: ~c.isin("SIGNAL_MATCH", "HIGH_OCR_CONFIDENCE", "MANDATORY_FIELDS_COMPLETE", "OCR_SUPPORTS_EXTRACTION"))
    f = lambda field, name: F.col("fields")[field].alias(name)
    return out.select(
        "doc_id", "status", "document_type", "classification_confidence", "extraction_confidence", F.array_join(F.array_sort(said), ",").alias("codes"), "overall_passed",
        f("passportNumber", "number"), f("surname", "surname"), f("givenName", "given"), f("dateOfBirth", "birth"), f("dateOfExpiry", "expiry"), f("dateOfIssue", "issue"),
    )


@query(
    "e17_a7_letter_bag",
    f"""SELECT doc_id, CASE WHEN readable THEN 'completed' ELSE 'stopped' END AS status, CASE WHEN readable THEN concat('a', CAST(k AS VARCHAR), '@acme.example') END AS emails, CASE WHEN readable THEN concat(lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0'), '/05/2022') END AS dates,
  CASE WHEN readable THEN concat('ACME ', CAST(k AS VARCHAR), ' Limited') END AS company, CASE WHEN readable THEN concat('AUTHORITY LETTER;Company Name: ACME ', CAST(k AS VARCHAR), ' Limited;Ref No: AL/', lpad(CAST(k AS VARCHAR), 5, '0')) END AS headers, CASE WHEN readable THEN 'false' END AS signature
  FROM (SELECT k * 10 + 5 AS doc_id, k, conf >= 40 AS readable FROM (SELECT c_custkey AS k, CAST(30 + (c_custkey * 37) % 70 AS INT) AS conf FROM customer))""",
)
def letter_bag(spark, sf_dir):
    mix = co.planted_mix(spark, sf_dir).filter("requested_type = 'AUTHORITY_LETTER'")
    out = audit.audit_documents(mix, types=("AUTHORITY_LETTER",), bag=True)
    each = lambda name: F.array_join(F.col("lists")[name], ";")
    # Lists are taken out first: where the filtered map of the fields is named once, the planner makes those alone that are asked for.
    out = out.select("doc_id", "status", each("emailAddresses").alias("emails"), each("dates").alias("dates"), each("headers").alias("headers"), "fields")
    return out.select("doc_id", "status", "emails", "dates", F.col("fields")["companyName"].alias("company"), "headers", F.col("fields")["signaturePresence"].alias("signature"))


@query(
    "f9_f10_scrubbed_summary",
    f"SELECT doc_id, CASE WHEN ocr_confidence < 40 OR doc_id % 10 = 4 THEN 'stopped' ELSE 'completed' END AS status, false AS leaks, CASE WHEN ocr_confidence >= 40 AND doc_id % 10 NOT IN (3, 4) THEN cin END AS cin FROM ({co.PLANTED_CIN})",
)
def scrubbed(spark, sf_dir):
    rows = co.planted(spark, sf_dir, co.PLANTED_CIN).withColumn("requested_type", F.lit("CIN"))
    results = audit.audit_documents(rows, types=("CIN",))
    out = re_.summarize(results).withColumn("data", F.struct("doc_id"))
    clean = re_.scrub_pii(out.withColumn("key_fields", F.map_concat(F.coalesce("key_fields", F.create_map().cast("map<string,string>")), F.create_map(F.lit("pan"), F.lit("secret")))))
    leaks = F.lit("data" in clean.columns) | F.map_contains_key("key_fields", F.lit("pan"))
    return clean.select("doc_id", "status", leaks.alias("leaks"), F.col("key_fields")["cinNumber"].alias("cin"))


@query(
    "q1_q2_expected_fields",
    f"""WITH m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' ELSE 'jpg' END AS format, ocr_confidence >= 40 AND doc_id % 10 NOT IN (3, 4) AS ok FROM ({co.PLANTED_CIN}))
  SELECT coalesce(format, '*') AS format, count(*) FILTER (WHERE ok) AS passed, count(*) AS total FROM m GROUP BY ROLLUP (format)""",
)
def expected_fields(spark, sf_dir):
    rows = co.planted(spark, sf_dir, co.PLANTED_CIN).withColumn("requested_type", F.lit("CIN"))
    results = audit.audit_documents(rows, types=("CIN",))
    wanted = rows.select("doc_id", F.explode(F.array(F.struct(F.lit("cinNumber").alias("field"), F.lit("literal").alias("kind"), F.col("cin").alias("value")), F.struct(F.lit("companyName").alias("field"), F.lit("regex").alias("kind"), F.lit(r"^acme \d+ private").alias("value")), F.struct(F.lit("roc").alias("field"), F.lit("literal").alias("kind"), F.lit(None).cast("string").alias("value")))).alias("e")).select("doc_id", "e.*")
    ok = ev.documents_ok(ev.match_expected(results, wanted), results, rows.select("doc_id", F.lit("CIN").alias("type")))
    kind = F.element_at(F.array(F.lit("pdf"), F.lit("png"), F.lit("jpg")), (F.col("doc_id") % 3 + 1).cast("int"))
    return ev.pass_by_format(ok.withColumn("format", kind))


@query(
    "q3_expectations",
    """WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'FAKE' WHEN 1 THEN 'UNKNOWN' ELSE 'PAN' END AS expectation, doc_id % 4 = 0 AS passed, CASE WHEN doc_id % 5 = 0 THEN 'UNKNOWN' ELSE 'PAN' END AS document_type FROM documents WHERE doc_id % 11 <> 0)
  SELECT expectation, count(*) FILTER (WHERE CASE expectation WHEN 'FAKE' THEN NOT passed WHEN 'UNKNOWN' THEN document_type = 'UNKNOWN' OR NOT passed ELSE document_type = 'PAN' AND passed END) AS ok, count(*) AS total FROM r GROUP BY expectation""",
)
def expectations(spark, sf_dir):
    docs, d = co.read_table(spark, sf_dir, "documents"), F.col("doc_id")
    results = docs.select("doc_id", (d % 4 == 0).alias("overall_passed"), F.when(d % 5 == 0, "UNKNOWN").otherwise("PAN").alias("document_type"), F.when(d % 11 == 0, "error").otherwise("completed").alias("status"))
    return ev.expectation_match(results, docs.select("doc_id", F.when(d % 3 == 0, "FAKE").when(d % 3 == 1, "UNKNOWN").otherwise("PAN").alias("expectation")))


_FILE = "concat('/in/', CASE page_id % 6 WHEN 0 THEN 'My-PAN' WHEN 1 THEN 'passport_scan' WHEN 2 THEN 'security-programme' WHEN 3 THEN 'clearance' WHEN 4 THEN 'authority letter' ELSE 'holiday' END, CAST(page_id AS STRING), CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.exe' ELSE '.jpg' END)"


@query(
    "s1_q4_intake",
    f"""SELECT CASE page_id % 6 WHEN 0 THEN 'pan' WHEN 1 THEN 'passport' WHEN 2 THEN 'security-programme' WHEN 3 THEN 'security-clearance' WHEN 4 THEN 'authority-letter' END AS slug,
  CASE WHEN page_id % 4 = 2 THEN 'unsupported_extension' WHEN page_id % 9 = 0 THEN 'unsupported_mime' WHEN page_id * 100000 % 20000000 > 10485760 THEN 'file_too_large' END AS reject_reason, count(*) AS n FROM pages GROUP BY 1, 2""",
)
def intake(spark, sf_dir):
    rows = co._sql(spark, f"SELECT {_FILE} AS path, page_id * 100000 % 20000000 AS length, CASE WHEN page_id % 9 = 0 THEN 'text/html' ELSE 'image/png' END AS mime FROM pages", pages=co.read_table(spark, sf_dir, "pages"))
    return co.intake_manifest(rows).groupBy(ev.infer_slug(F.col("path")).alias("slug"), "reject_reason").agg(F.count("*").alias("n"))


def _drained(spark, stream, name):
    """All rows of a stream, by one run that ends with the input, as a table in the shared folder."""
    at = own_folder(spark, name)
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


@query("t1_streamed_audit", f"SELECT requested_type, count(*) AS n, count(*) FILTER (WHERE ocr_confidence >= 40 AND len(regexp_extract_all(trim(text), '[A-Za-z0-9]')) >= 25) AS n_read FROM ({co.CORPUS}) GROUP BY requested_type")
def streamed(spark, sf_dir):
    kinds = F.array(*[F.lit(t[0]) for t in catalog.TYPES])
    rows = streams.read_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text", F.element_at(kinds, (F.col("doc_id") % 7 + 1).cast("int")).alias("requested_type"), (30 + F.col("doc_id") * 37 % 70).cast("int").alias("ocr_confidence"))
    out = _drained(spark, streams.audit_stream(rows), "audit-stream")
    return out.groupBy("requested_type").agg(F.count("*").alias("n"), F.sum(F.col("gate_passed").cast("long")).alias("n_read"))


@query(
    "t2_streamed_funnel",
    """SELECT epoch_ms(start) AS start_ms, stage, status, count(*) AS n FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 'stopped' ELSE 'completed' END AS status FROM events)
  WHERE start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY start, stage, status""",
)
def streamed_funnel(spark, sf_dir):
    """Windows that end within the watermark's delay before the last event stay open, as more could come, and are not in the result."""
    events = streams.read_stream(spark, f"{sf_dir}/events.parquet", "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    log = events.select("ts", F.col("event_type").alias("stage"), F.when(F.col("event_id") % 3 == 0, "stopped").otherwise("completed").alias("status"))
    return _drained(spark, streams.funnel_stream(log), "funnel-stream").select(F.unix_millis("start").alias("start_ms"), "stage", "status", "n")

