"""Queries over what a document's context adds to its scores: reading, photo, QR, logos, aspect; and over types that give a number alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.operators import classify as cl
from docaudit.plans.registry import query
from docaudit.sources import corpus as co

#: Texts by key, the points of their rules, and (signal, detail) of each; a signal that no message names is its own detail.
CASES = (
    ("VALID FROM then", 10, ("validity", "Matched validity dates")),
    ("SECURITY CLEARANCE", 45, ("clearanceTitle", "clearanceTitle")),
    ("SECURITY CLEARANCE CERTIFICATE, CLEARANCE TYPE, ISSUING AUTHORITY", 100, ("clearanceTitle", "clearanceTitle", "clearanceKind", "clearanceKind", "clearanceMeta", "clearanceMeta", "issuer", "issuer")),
    ("xx", 0, ()),
)
_MESSAGES = {"validity": "Matched validity dates", "clearanceTitle": "Matched SECURITY CLEARANCE", "clearanceKind": "Matched clearance certificate/letter/level", "clearanceMeta": "Matched clearance type/number", "issuer": "Matched issuing authority"}


def _rows(spark, sf_dir):
    k = F.col("doc_id")
    rows = co.read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    return rows.withColumns(
        {
            "text": F.get(F.array(*[F.lit(text) for text, *_ in CASES]), (k % 4).cast("int")),
            "requested_type": F.lit("SECURITY_CLEARANCE"),
            "ocr_confidence": (30 + k * 37 % 70).cast("int"),
            "hasPhotoLikeRegion": k % 3 == 0,
            "hasQrLikeRegion": k % 5 == 0,
            "logo_matches": F.slice(F.array(F.lit("emblem"), F.lit("seal"), F.lit("crest")), F.lit(1), (k % 4).cast("int")),
            "aspect_ratio": F.when(k % 10 != 0, 1 + (k % 10) / 10),
            "points": F.when(k % 7 != 0, (k * 3 % 130).cast("int")),
        }
    )


#: (condition, points, code, message, signal, detail) of the context, in order.
_STEPS = (
    ("conf >= 70", 5, "HIGH_OCR_CONFIDENCE", "concat('OCR confidence ', conf, '% supports classification')", "highOcrConfidence", "concat('OCR ', conf, '%')"),
    ("conf < 45", -8, "LOW_OCR_CONFIDENCE", "concat('Low OCR confidence ', conf, '% reduces classification confidence')", "lowOcrConfidence", "concat('OCR ', conf, '%')"),
    ("k % 3 = 0", 3, "PHOTO_LAYOUT", "'Photo-like region detected (layout cue)'", "photoLayout", "'photo region'"),
    ("k % 5 = 0", 2, "QR_LAYOUT", "'QR-like region detected (layout cue)'", "qrLayout", "'QR region'"),
    ("k % 4 > 0", 8, "LOGO_DETECTED", "concat('Logo match: ', CASE WHEN k % 4 = 1 THEN 'emblem' ELSE 'emblem, seal' END)", "logoDetected", "CASE WHEN k % 4 = 1 THEN 'emblem' ELSE 'emblem, seal' END"),
    ("k % 10 BETWEEN 4 AND 8", 2, "CARD_ASPECT", "'Document aspect ratio consistent with ID card'", "cardAspect", "concat('ratio 1.', k % 10, '0')"),
)
_KEYS = "SELECT c_custkey AS k, CAST(30 + c_custkey * 37 % 70 AS INT) AS conf FROM customer"
_OWN = "CASE k % 4 " + " ".join(f"WHEN {i} THEN [{', '.join(repr(_MESSAGES[s]) for s in own[::2])}]::VARCHAR[]" for i, (_, _, own) in enumerate(CASES)) + " END"
_ADDED = "list_filter([" + ", ".join(f"CASE WHEN {when} THEN {text} END" for when, _, _, text, _, _ in _STEPS) + "], lambda x: x IS NOT NULL)"


def _folded(start: str) -> str:
    """The score after each step, as a chain of subqueries: each step is stated once."""
    inner = f"SELECT *, {start} AS s FROM ({_KEYS})"
    for when, points, *_ in _STEPS:
        step = f"greatest(0, s + {points})" if points < 0 else f"least(100, s + {points})"
        inner = f"SELECT * REPLACE (CASE WHEN {when} THEN {step} ELSE s END AS s) FROM ({inner})"
    return inner


_BASE = "CASE k % 4 " + " ".join(f"WHEN {i} THEN {points}" for i, (_, points, _) in enumerate(CASES)) + " END"
_POINTS = "CASE WHEN k % 7 <> 0 THEN k * 3 % 130 ELSE 0 END"


@query(
    "c7_context_scores",
    f"""SELECT k AS doc_id, 'SECURITY_CLEARANCE' AS type, CAST(least(100, s) AS INTEGER) AS score, array_to_string(list_concat({_OWN}, {_ADDED}), ';') AS messages FROM ({_folded(_BASE)})
  UNION ALL SELECT k, 'CUSTOM', CAST(least(100, s) AS INTEGER), array_to_string(list_concat(CASE WHEN {_POINTS} > 0 THEN [concat('Custom card identify score ', {_POINTS})] ELSE []::VARCHAR[] END, {_ADDED}), ';') FROM ({_folded(_POINTS)})""",
)
def context_scores(spark, sf_dir):
    scored = cl.score_types(_rows(spark, sf_dir), more={"CUSTOM": ("Custom card", F.col("points"))})
    out = scored.select("doc_id", F.explode_outer("type_scores").alias("s")).filter("s.type IN ('SECURITY_CLEARANCE', 'CUSTOM')")
    return out.select("doc_id", "s.type", "s.score", F.array_join(F.transform("s.reasons", lambda r: r["message"]), ";").alias("messages"))


_SIGNALS = (
    "list_concat(CASE k % 4 "
    + " ".join(f"WHEN {i} THEN [{', '.join(f'struct_pack(id := {s!r}, weight := 1.0::DOUBLE, detail := {d!r})' for s, d in zip(own[::2], own[1::2], strict=True))}]" for i, (_, _, own) in enumerate(CASES) if own)
    + " ELSE [] END, list_filter(["
    + ", ".join(f"CASE WHEN {when} THEN struct_pack(id := '{signal}', weight := {points}.0::DOUBLE, detail := {detail}) END" for when, points, _, _, signal, detail in _STEPS)
    + "], lambda x: x IS NOT NULL))"
)


@query(
    "c10_signal_details",
    f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, s.id AS id, s.weight AS weight, s.detail AS detail
  FROM (SELECT k AS doc_id, unnest(a) AS s, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT k, {_SIGNALS} AS a FROM ({_KEYS})))""",
)
def signal_details(spark, sf_dir):
    return cl.matched_signals(cl.classify(_rows(spark, sf_dir))).select("doc_id", "pos", "id", "weight", "detail")


# Texts of the third case fit, so that nothing is said of why not.
@query(
    "c10_keywords_and_reasons",
    f"""SELECT k AS doc_id, array_to_string(list_filter(list_concat({_OWN}, {_ADDED}), lambda m: regexp_matches(m, 'keyword|matched|regex|pattern|logo|layout|mrz|pan|aadhaar|cin', 'i')), ';') AS keywords,
  array_to_string(list_concat({_OWN}, {_ADDED})[1:5], ';') AS reasons FROM ({_KEYS}) WHERE k % 4 = 2""",
)
def keywords_and_reasons(spark, sf_dir):
    out = cl.classify(_rows(spark, sf_dir).filter("doc_id % 4 = 2"))
    tops = cl.top_reasons(out).filter("type = 'SECURITY_CLEARANCE'").select("doc_id", F.array_join(F.transform("reasons", lambda r: r["message"]), ";").alias("reasons"))
    return cl.matched_keywords(out).select("doc_id", F.array_join("keywords", ";").alias("keywords")).join(tops, "doc_id")
