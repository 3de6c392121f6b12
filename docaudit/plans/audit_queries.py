"""Audits with image statistics and word confidences, over planted cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.functions.checks import verhoeff_digit
from docaudit.functions.names import word_map
from docaudit.operators.extract import extract_fields
from docaudit.operators.results import stage_log
from docaudit.operators.score import stage_funnel
from docaudit.plans import audit
from docaudit.plans.registry import query
from docaudit.plans.text_queries import MIX
from docaudit.sources import corpus as co

#: Two names of equal points: without word confidences the first is taken.
CARD = "GOVERNMENT OF INDIA\nUnique Identification Authority of India\nRahul Sharma 1\nVivek Sharma 2\nMALE\n#\nAADHAAR"


def cards(spark, sf_dir):
    """(documents, images, words): of keys that leave 0 over 4 the image has a photo and a code, of 1 it is a dark screen, of 2 there is none, of 3 it is blurred.

    Of even keys the second name was read better, of odd ones the first; every seventh card has no words.
    """
    k = F.col("doc_id")
    base = co.read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    number = F.concat(F.lit("2"), F.lpad((k * 104729 % 10000000000).cast("string"), 10, "0"))
    documents = base.select("doc_id", F.lit("AADHAAR").alias("requested_type"), F.when(k % 4 == 3, 50).otherwise(90).alias("ocr_confidence"), F.replace(F.lit(CARD), F.lit("#"), F.concat(number, verhoeff_digit(number).cast("string"))).alias("text"))
    dark = k % 4 == 1
    images = base.filter("doc_id % 4 <> 2").select(
        "doc_id", F.when(k % 4 == 3, 30.0).otherwise(300.0).alias("blur"), F.lit(140.0).alias("brightness"), F.lit(0.4).alias("contrast"), F.lit(0.05).alias("noise"), F.lit(0.0).alias("skew_angle"), F.lit(200).alias("dpi"), F.lit(0.05).alias("edge_density"),
        F.lit(60.0).alias("color_variance"), F.when(dark, 60.0).otherwise(140.0).alias("center_brightness"), F.when(dark, 0.5).otherwise(0.1).alias("dark_block_ratio"), F.when(dark, 0.0).otherwise(0.1).alias("photo_region_ratio"), F.lit(1200).alias("width"), F.lit(760).alias("height"),
    )
    read = F.array(*[F.struct(F.lit(w).alias("text"), F.when(k % 2 == 0, even).otherwise(odd).cast("double").alias("confidence")) for w, even, odd in (("Rahul", 20, 90), ("Vivek", 90, 20), ("Sharma,", 60, 60), ("sharma", 0, 0))])
    words = base.filter("doc_id % 7 <> 0").select("doc_id", F.explode(read).alias("w")).select("doc_id", "w.text", "w.confidence", F.lit(100).alias("y0"), F.lit(112).alias("y1"))
    return documents, images, words


_NAME = "CASE WHEN k % 7 <> 0 AND k % 2 = 0 THEN 'VIVEK SHARMA' ELSE 'RAHUL SHARMA' END"


@query(
    "r4_image_audit",
    f"""SELECT k AS doc_id, CASE WHEN k % 4 = 3 THEN 'stopped' ELSE 'completed' END AS status, CASE WHEN k % 4 = 3 THEN 'Excessive blur combined with low OCR confidence' END AS stop_reason,
  CASE WHEN k % 4 <> 3 THEN {_NAME} END AS name, CAST(CASE k % 4 WHEN 0 THEN 87 WHEN 1 THEN 29 WHEN 2 THEN 45 END AS INTEGER) AS risk_score, k % 4 = 0 AS overall_passed,
  CASE k % 4 WHEN 0 THEN 'Integrity score 87 meets threshold 70' WHEN 1 THEN 'Integrity score 29 below threshold 70;Card layout mismatch;Government emblem missing;Screenshot / UI capture detected'
    WHEN 2 THEN 'Integrity score 45 below threshold 70;Card layout mismatch;Government emblem missing' END AS reasoning,
  CASE WHEN k % 4 = 3 THEN 'Image blur is high (Laplacian variance 30.0 < 40);Excessive blur combined with low OCR confidence' ELSE '' END AS warnings
FROM (SELECT c_custkey AS k FROM customer)""",
)
def image_audit(spark, sf_dir):
    documents, images, words = cards(spark, sf_dir)
    out = audit.audit_documents(documents, types=("AADHAAR",), images=images, words=words)
    return out.select(
        "doc_id", "status", "stop_reason", F.col("fields")["name"].alias("name"), "risk_score", "overall_passed",
        F.array_join(F.transform("risk_reasoning", lambda r: r["message"]), ";").alias("reasoning"), F.array_join("warnings", ";").alias("warnings"),
    )


@query(
    "a13_audit_funnel",
    """WITH r AS (SELECT 'AADHAAR' AS type, c_custkey % 4 = 3 AS stopped FROM customer), l AS (
    SELECT type, s.stage, CASE WHEN stopped THEN 'stopped' ELSE 'completed' END AS status FROM r, (VALUES ('ocr', 1), ('classification', 2), ('extraction', 3), ('validation', 4), ('risk', 5)) s(stage, pos) WHERE NOT stopped OR pos = 1)
  SELECT coalesce(type, '*') AS type, coalesce(stage, '*') AS stage, coalesce(status, '*') AS status, count(*) AS n FROM l GROUP BY ROLLUP (type, stage, status)""",
)
def audit_funnel(spark, sf_dir):
    """The funnel of the audit's own log: blurred cards stop at the reading, the others come to the risk."""
    documents, images, words = cards(spark, sf_dir)
    return stage_funnel(stage_log(audit.audit_documents(documents, types=("AADHAAR",), images=images, words=words)))


@query("n5_names_by_confidence", f"SELECT k AS doc_id, {_NAME} AS name FROM (SELECT c_custkey AS k FROM customer)")
def names_by_confidence(spark, sf_dir):
    documents, _, words = cards(spark, sf_dir)
    return extract_fields(documents.join(word_map(words), "doc_id", "left"), "AADHAAR").select("doc_id", "name")


# A card that names income tax and the government but no number is an account card of 45 points: two signals, and no type is better.
_PAN_LIKE = "CASE WHEN conf >= 70 THEN 50 WHEN conf < 45 THEN 37 ELSE 45 END"
_HIGH = "CASE WHEN p = 0 AND conf < 45 THEN 0 WHEN conf >= 70 THEN least(100, p + 5) WHEN conf < 45 THEN greatest(0, p - 8) ELSE p END"


@query(
    "c11_types_by_trying",
    f"""WITH m AS (
    SELECT doc_id, requested_type AS own, doc_id // 10 % 10 AS d, ocr_confidence AS conf, ocr_confidence >= 40 AND len(regexp_extract_all(text, '[A-Za-z0-9]')) >= 25 AS readable FROM ({MIX}) WHERE requested_type IN ('AADHAAR', 'PAN', 'CIN')
  ), p AS (
    SELECT *, CASE own WHEN 'AADHAAR' THEN CASE WHEN d = 3 THEN 90 ELSE 100 END WHEN 'PAN' THEN CASE WHEN d = 3 THEN 90 ELSE 100 END ELSE CASE d WHEN 4 THEN 0 WHEN 3 THEN 50 WHEN 1 THEN 90 ELSE 100 END END AS p,
      readable AND NOT (own IN ('AADHAAR', 'PAN') AND d = 5) AND NOT (own = 'CIN' AND d = 4) AS fits FROM m
  ), r AS (
    SELECT *, {_HIGH} AS score FROM p
  )
  SELECT doc_id, CASE WHEN fits THEN own WHEN readable AND own = 'AADHAAR' AND d = 5 THEN 'PAN' ELSE 'PASSPORT' END AS requested_type,
    CASE WHEN fits OR readable AND own = 'AADHAAR' AND d = 5 THEN 'completed' ELSE 'stopped' END AS status,
    CAST(CASE WHEN fits THEN CASE own WHEN 'PAN' THEN 2 WHEN 'AADHAAR' THEN 3 ELSE 4 END WHEN readable AND own = 'AADHAAR' AND d = 5 AND conf >= 70 THEN 2 ELSE 4 END AS INTEGER) AS tried,
    CAST(CASE WHEN fits THEN score WHEN readable AND own = 'AADHAAR' AND d = 5 THEN {_PAN_LIKE} WHEN readable THEN CASE WHEN conf >= 70 THEN 5 ELSE 0 END END AS INTEGER) AS confidence FROM r""",
)
def types_by_trying(spark, sf_dir):
    mix = co.planted_mix(spark, sf_dir).filter(F.col("requested_type").isin("AADHAAR", "PAN", "CIN")).drop("requested_type")
    return audit.audit_unknown(mix).select("doc_id", "requested_type", "status", "tried", F.col("classification_confidence").alias("confidence"))
