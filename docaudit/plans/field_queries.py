"""Queries over whole card records, numbers written back, stopped rows, flags, scrubbed logs and lists, each with values that vary by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.functions import entities as en
from docaudit.operators import extract as ex
from docaudit.operators import raster as ra
from docaudit.operators import results as rs
from docaudit.plans import audit
from docaudit.plans.registry import query
from docaudit.plans.text_queries import MIX
from docaudit.sources import corpus as co

_KEYS = "SELECT c_custkey AS k, concat('AB', chr(CAST(65 + c_custkey % 26 AS INT)), 'PK', lpad(CAST(c_custkey * 37 % 10000 AS {s}), 4, '0'), 'Q') AS pan, lpad(CAST(c_custkey % 28 + 1 AS {s}), 2, '0') AS dd FROM customer"

#: Of every third card the lower half is missing, and of another third all but a line.
_PAN_TEXT = """CASE k % 3
  WHEN 0 THEN concat('INCOME TAX DEPARTMENT', chr(10), 'GOVT. OF INDIA', chr(10), pan, chr(10), 'Name', chr(10), 'ROHAN MEHTA', chr(10), 'Father''s Name', chr(10), 'VIJAY MEHTA', chr(10), 'Date of Birth', chr(10), dd, '/06/1980')
  WHEN 1 THEN concat('INCOME TAX DEPARTMENT', chr(10), 'GOVT. OF INDIA', chr(10), lower(pan), chr(10), 'Name: ROHAN MEHTA')
  ELSE 'INCOME TAX DEPARTMENT GOVT. OF INDIA' END"""


@query(
    "x2_card_records",
    f"""SELECT k AS doc_id, CASE WHEN k % 3 < 2 THEN 'ROHAN MEHTA' END AS name, CASE WHEN k % 3 = 0 THEN 'VIJAY MEHTA' END AS "fatherName", CASE WHEN k % 3 < 2 THEN pan END AS pan, CASE WHEN k % 3 = 0 THEN concat(dd, '/06/1980') END AS dob,
  CAST(CASE k % 3 WHEN 0 THEN 100 WHEN 1 THEN 80 ELSE 8 END AS INTEGER) AS confidence,
  CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'Father''s name not found;DOB missing' ELSE 'PAN number not found;Name not found;Father''s name not found;DOB missing;name not found;pan not found' END AS issues
  FROM ({_KEYS.format(s="VARCHAR")})""",
)
def card_records(spark, sf_dir):
    rows = co.planted(spark, sf_dir, f"SELECT k AS doc_id, {_PAN_TEXT} AS text, 80 AS ocr_confidence FROM ({_KEYS.format(s='STRING')})")
    out = ex.extract(rows, "PAN")
    return out.select("doc_id", "name", "fatherName", "pan", "dob", F.col("extraction_confidence").alias("confidence"), F.array_join("extraction_issues", ";").alias("issues"))


@query(
    "v18_numbers_written_back",
    f"""SELECT doc_id, CASE WHEN doc_id // 10 % 10 <> 3 THEN substr(regexp_extract(pan, '[A-Z]{{5}}[0-9]{{4}}[A-Z]'), 1, 10) END AS number, doc_id // 10 % 10 <> 3 AS passed FROM (SELECT doc_id * 10 + 1 AS doc_id, pan FROM ({co.PLANTED_PAN.replace("STRING", "VARCHAR")}))""",
)
def written_back(spark, sf_dir):
    """Account numbers as they are validated: of spaced ones and of those with a letter for a digit what was meant."""
    rows = co.planted_mix(spark, sf_dir).filter("requested_type = 'PAN'")
    return ex.validate(ex.extract(rows, "PAN"), "PAN").select("doc_id", F.col("pan").alias("number"), F.col("validation.passed").alias("passed"))


@query(
    "r1_stopped_rows",
    f"""WITH r AS (SELECT doc_id, ocr_confidence AS conf, len(regexp_extract_all(text, '[A-Za-z0-9]')) AS n FROM ({MIX}) WHERE requested_type = 'CIN'),
  s AS (SELECT doc_id, list_filter([CASE WHEN conf < 40 THEN concat('OCR confidence ', conf, '% below threshold 40%') END, CASE WHEN n < 25 THEN concat('OCR text too sparse (', n, ' alphanumeric chars; need ≥ 25)') END], lambda x: x IS NOT NULL) AS said FROM r)
  SELECT doc_id, 'ocr' AS stage, said[1] AS stop_reason, array_to_string(said, ';') AS reasons, array_to_string(said, ';') AS warnings, CAST(NULL AS VARCHAR) AS document_type, false AS overall_passed FROM s WHERE len(said) > 0""",
)
def stopped_rows(spark, sf_dir):
    out = audit.audit_documents(co.planted_mix(spark, sf_dir).filter("requested_type = 'CIN'"), types=("CIN",)).filter("stage = 'ocr'")
    return out.select("doc_id", "stage", "stop_reason", F.array_join(F.transform("reasons", lambda r: r["message"]), ";").alias("reasons"), F.array_join("warnings", ";").alias("warnings"), "document_type", "overall_passed")


_STATS = "SELECT c_custkey AS id, CAST(40 + c_custkey * 7 % 200 AS DOUBLE) AS center_brightness, CAST(c_custkey % 70 AS DOUBLE) AS color_variance, c_custkey % 40 / CAST(100 AS DOUBLE) AS dark_block_ratio, c_custkey % 9 / CAST(100 AS DOUBLE) AS photo_region_ratio, CAST(300 + c_custkey % 900 AS INT) AS width, 400 AS height FROM customer"


@query(
    "p7_flags",
    f"""SELECT id, dark AS "isDarkUi", center_brightness > 230 AND color_variance < 35 AS "isNearWhiteBg", NOT dark AND dark_block_ratio > 0.03 AND dark_block_ratio < 0.25 AS "hasQrLikeRegion", NOT dark AND photo_region_ratio > 0.03 AS "hasPhotoLikeRegion",
  round(width / CAST(height AS DOUBLE), 6) AS aspect_ratio FROM (SELECT *, center_brightness < 85 AND photo_region_ratio < 0.02 AS dark FROM ({_STATS}))""",
)
def flags(spark, sf_dir):
    out = ra.visual_flags(co.planted(spark, sf_dir, _STATS))
    return out.select("id", "isDarkUi", "isNearWhiteBg", "hasQrLikeRegion", "hasPhotoLikeRegion", F.round("aspect_ratio", 6).alias("aspect_ratio"))


@query(
    "f9_scrubbed_logs",
    """SELECT c_custkey AS doc_id, 'doc_id,fields,log' AS columns, concat('{"requestId":"r', c_custkey, '","ocrConfidence":', c_custkey % 100, '}') AS log, concat('{"roc":"R', c_custkey % 7, '"}') AS fields FROM customer""",
)
def scrubbed(spark, sf_dir):
    """Of a log sensitive columns go, and such fields of its structs and keys of its maps; a struct of nothing else goes whole."""
    k = F.col("c_custkey")
    rows = co.read_table(spark, sf_dir, "customer").select(
        k.alias("doc_id"), F.lit("secret").alias("text"), F.struct(F.lit("x").alias("name"), F.lit("y").alias("pan")).alias("person"),
        F.struct(F.concat(F.lit("r"), k.cast("string")).alias("requestId"), (k % 100).alias("ocrConfidence"), F.lit("all").alias("fullOcrText"), F.lit("d").alias("data")).alias("log"),
        F.create_map(F.lit("name"), F.lit("N"), F.lit("roc"), F.concat(F.lit("R"), (k % 7).cast("string")), F.lit("mrz"), F.lit("M")).alias("fields"),
    )
    out = rs.scrub_pii(rows)
    return out.select("doc_id", F.lit(",".join(sorted(out.columns))).alias("columns"), F.to_json("log").alias("log"), F.to_json("fields").alias("fields"))


_LISTED = "concat('SAFETY PLAN ', k % 50, chr(10), '- item ', k, chr(10), '  * second item', chr(10), '1) third ', k % 3, chr(10), 'b) fourth', chr(10), '2. ab', chr(10), '- item ', k, chr(10), 'plain text of some length', chr(10), 'Scope Of Work', chr(10), '3.1. Staff ', k % 4, chr(10), '05/06/2020', chr(10), 'last ', k)"


@query(
    "e14_e15_e16_lists",
    """SELECT k AS doc_id, concat('item ', k, ';second item;third ', k % 3, ';fourth') AS bullets, concat('SAFETY PLAN ', k % 50, ';1) third ', k % 3, ';2. ab;Scope Of Work;3.1. Staff ', k % 4) AS headings,
  concat('SAFETY PLAN ', k % 50, ';- item ', k, ';* second item') AS header, concat('3.1. Staff ', k % 4, ';05/06/2020;last ', k) AS footer FROM (SELECT c_custkey AS k FROM customer)""",
)
def lists(spark, sf_dir):
    rows = co.planted(spark, sf_dir, f"SELECT k AS doc_id, {_LISTED} AS text FROM (SELECT c_custkey AS k FROM customer)")
    return rows.select("doc_id", *[F.array_join(f(F.col("text")), ";").alias(n) for n, f in (("bullets", en.bullets), ("headings", en.headings), ("header", en.header), ("footer", en.footer))])
