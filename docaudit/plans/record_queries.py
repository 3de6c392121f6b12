"""Queries over labelled fields, identifiers, dates, zones and names, on planted documents whose truth is stated from the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.config import DEFAULT
from docaudit.functions import checks, labels, mrz, names
from docaudit.functions import entities as en
from docaudit.functions.text import ocr_gate
from docaudit.operators import extract as ex
from docaudit.operators import passports as pp
from docaudit.plans.registry import query
from docaudit.sources import corpus as co

_K = "SELECT c_custkey AS k, c_nationkey AS nation, CAST(30 + (c_custkey * 37) % 70 AS INT) AS conf FROM customer"


def _codes(v):
    return F.array_join(F.array_sort(F.transform(v["reasons"], lambda r: r["code"])), ",")


@query(
    "audit_cin_by_nation",
    f"""SELECT nation, count(*) AS n, count(*) FILTER (WHERE ok) AS n_read, count(*) FILTER (WHERE ok AND k % 10 NOT IN (1, 2, 3)) AS n_valid, count(*) FILTER (WHERE ok AND k % 10 = 1) AS n_length, count(*) FILTER (WHERE ok AND k % 10 = 1) AS n_format,
  count(*) FILTER (WHERE ok AND k % 10 IN (1, 2)) AS n_year, count(*) FILTER (WHERE ok AND k % 10 = 3) AS n_missing FROM (SELECT *, conf >= 40 AND k % 10 <> 4 AS ok FROM ({_K})) GROUP BY nation""",
)
def audit_cin_by_nation(spark, sf_dir):
    """Of each nation's certificates: how many can be read, hold a valid number, or fail for each reason."""
    t = F.col("text")
    rows = ocr_gate(co.planted(spark, sf_dir, co.PLANTED_CIN))
    number = F.coalesce(F.get(en.cins(t), F.lit(0)), labels.labeled_value(t, (r"\bCIN\b", r"Corporate\s*Identity\s*Number"), 30))
    rows = rows.withColumn("v", F.when(F.col("gate_passed"), checks.cin(number, DEFAULT.as_of)))
    has = lambda code: F.sum(F.exists(F.coalesce("v.reasons", F.array().cast("array<struct<code:string,message:string,stage:string,impact:int>>")), lambda r: r["code"] == code).cast("int"))
    return rows.groupBy("nation").agg(
        F.count("*").alias("n"), F.sum(F.col("gate_passed").cast("int")).alias("n_read"), F.sum(F.coalesce("v.passed", F.lit(False)).cast("int")).alias("n_valid"),
        has("CIN_LENGTH_INVALID").alias("n_length"), has("CIN_FORMAT_INVALID").alias("n_format"), has("CIN_YEAR_INVALID").alias("n_year"), has("CIN_MISSING").alias("n_missing"),
    )


def _fields(spark, sf_dir, sql, type_, *cols):
    return ex.extract_fields(co.planted(spark, sf_dir, sql), type_).select("doc_id", *cols)


@query(
    "x4_cin_fields",
    f"SELECT doc_id, CASE WHEN doc_id % 10 IN (3, 4) THEN NULL ELSE cin END AS \"cinNumber\", CASE WHEN doc_id % 10 <> 4 THEN concat('ACME ', CAST(doc_id AS VARCHAR), ' PRIVATE LIMITED') END AS \"companyName\", CASE WHEN doc_id % 10 <> 4 THEN concat(lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0'), '/', lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0'), '/', CAST(1990 + doc_id % 35 AS VARCHAR)) END AS \"incorporationDate\" FROM ({co.PLANTED_CIN})",
)
def cin_fields(spark, sf_dir):
    return _fields(spark, sf_dir, co.PLANTED_CIN, "CIN", "cinNumber", "companyName", "incorporationDate")


@query(
    "x5_clearance_fields",
    "SELECT k AS doc_id, concat('SC-', lpad(CAST(k AS VARCHAR), 6, '0')) AS \"clearanceNumber\", 'Airside' AS \"clearanceType\", CASE WHEN k % 10 <> 3 THEN concat('Person ', chr(CAST(65 + k % 26 AS INT)), 'lex') END AS \"employeeName\", ': ACME Airlines' AS organization, CASE WHEN k % 10 = 1 THEN '01/01/2030' ELSE '01/01/2020' END AS \"validFrom\", '31/12/2025' AS \"validUntil\", 'Bureau of Security' AS \"issuingAuthority\" FROM (" + _K + ")",
)
def clearance_fields(spark, sf_dir):
    return _fields(spark, sf_dir, co.PLANTED_CLEARANCE, "SECURITY_CLEARANCE", "clearanceNumber", "clearanceType", "employeeName", "organization", "validFrom", "validUntil", "issuingAuthority")


@query(
    "x6_programme_fields",
    "SELECT k AS doc_id, concat(': Plan ', CAST(k AS VARCHAR)) AS \"programmeTitle\", concat('ASP-', lpad(CAST(k AS VARCHAR), 5, '0')) AS \"documentNumber\", concat(CAST(1 + k % 9 AS VARCHAR), '.0') AS version, CASE WHEN k % 10 = 1 THEN '15/03/2029' ELSE '15/03/2021' END AS \"effectiveDate\", '15/03/2024' AS \"reviewDate\", 'Jane Roe' AS \"preparedBy\", 3 AS n_bullets FROM (" + _K + ")",
)
def programme_fields(spark, sf_dir):
    return _fields(spark, sf_dir, co.PLANTED_PROGRAMME, "SECURITY_PROGRAMME", "programmeTitle", "documentNumber", "version", "effectiveDate", "reviewDate", "preparedBy", F.size("bulletLists").alias("n_bullets"))


@query(
    "x7_letter_fields",
    "SELECT k AS doc_id, concat('ACME ', CAST(k AS VARCHAR), ' Limited') AS \"companyName\", concat('AL/', lpad(CAST(k AS VARCHAR), 5, '0')) AS \"letterReferenceNumber\", concat(lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0'), '/05/2022') AS \"letterDate\", CASE WHEN k % 10 <> 3 THEN concat('Sam ', chr(CAST(65 + k % 26 AS INT)), 'oe') END AS \"authorizedPerson\", 'Manager' AS designation, concat('a', CAST(k AS VARCHAR), '@acme.example') AS \"contactInformation\" FROM (" + _K + ")",
)
def letter_fields(spark, sf_dir):
    return _fields(spark, sf_dir, co.PLANTED_LETTER, "AUTHORITY_LETTER", "companyName", "letterReferenceNumber", "letterDate", "authorizedPerson", "designation", "contactInformation")


@query(
    "x1_aadhaar_fields",
    f"SELECT doc_id, CASE WHEN doc_id % 10 NOT IN (1, 2, 3) THEN number END AS aadhaar, '01/01/1980' AS dob, 'MALE' AS gender FROM ({co.DUCK_AADHAAR})",
)
def aadhaar_fields(spark, sf_dir):
    return ex.extract_fields(co.planted_aadhaar(spark, sf_dir), "AADHAAR").select("doc_id", "aadhaar", "dob", "gender")


@query("x2_v5_v6_pan", f"SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN pan END AS pan, CASE WHEN doc_id % 10 = 3 THEN 'PAN_MISSING' ELSE '' END AS codes FROM ({co.PLANTED_PAN})")
def pan_fields(spark, sf_dir):
    rows = co.planted(spark, sf_dir, co.PLANTED_PAN).withColumn("pan", F.get(checks.pan_candidates(F.col("text")), F.lit(0)))
    return rows.select("doc_id", "pan", _codes(checks.pan(F.col("pan"))).alias("codes"))


@query("v1_v2_verhoeff", f"SELECT doc_id, digit, TRUE AS ok, FALSE AS ok_changed FROM (SELECT *, {co.DUCK_DIGIT} AS digit FROM ({co.AADHAAR_BASE}))")
def verhoeff(spark, sf_dir):
    rows = co.planted(spark, sf_dir, co.AADHAAR_BASE).withColumn("digit", checks.verhoeff_digit(F.col("b")))
    ok = lambda d: checks.verhoeff_ok(F.concat("b", d.cast("string")))
    return rows.select("doc_id", "digit", ok(F.col("digit")).alias("ok"), ok((F.col("digit") + 1) % 10).alias("ok_changed"))


@query("v3_v4_aadhaar", f"SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN number END AS candidate, CASE doc_id % 10 WHEN 3 THEN 'AADHAAR_MISSING' WHEN 1 THEN 'CHECKSUM_MISMATCH' WHEN 2 THEN 'AADHAAR_INVALID' ELSE '' END AS codes FROM ({co.DUCK_AADHAAR})")
def aadhaar_codes(spark, sf_dir):
    rows = co.planted_aadhaar(spark, sf_dir).withColumn("candidate", F.get(checks.aadhaar_candidates(F.col("text")), F.lit(0)))
    return rows.select("doc_id", "candidate", _codes(checks.aadhaar(F.col("candidate"))).alias("codes"))


@query(
    "v3_candidates_in_documents",
    """WITH c AS (SELECT doc_id, unnest(list_distinct(list_concat(list_transform(regexp_extract_all(text, '\\b\\d{4}[\\s\\-.]?\\d{4}[\\s\\-.]?\\d{4}\\b'), lambda x: regexp_replace(x, '\\D', '', 'g')),
  list_filter(list_transform(regexp_extract_all(text, '\\d[\\d\\s\\-.]{10,20}\\d'), lambda x: regexp_replace(x, '\\D', '', 'g')), lambda x: length(x) = 12), regexp_extract_all(text, '\\d{12}')))) AS n FROM documents WHERE text IS NOT NULL)
  SELECT count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM c""",
)
def document_candidates(spark, sf_dir):
    docs = co.read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(checks.aadhaar_candidates(F.coalesce("text", F.lit("")))).alias("n")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("v7_cin_codes", f"SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN 'CIN_FORMAT_INVALID,CIN_LENGTH_INVALID,CIN_YEAR_INVALID' WHEN 2 THEN 'CIN_YEAR_INVALID' WHEN 3 THEN 'CIN_MISSING' ELSE '' END AS codes, doc_id % 10 NOT IN (1, 2, 3) AS passed FROM ({co.PLANTED_CIN})")
def cin_codes(spark, sf_dir):
    number = F.when(F.col("doc_id") % 10 != 3, F.lower("cin"))
    return co.planted(spark, sf_dir, co.PLANTED_CIN).withColumn("v", checks.cin(number, DEFAULT.as_of)).select("doc_id", _codes(F.col("v")).alias("codes"), F.col("v.passed").alias("passed"))


_DIGIT = "(list_sum(list_transform(range(1, length({f}) + 1), lambda i: (CASE WHEN substr({f}, CAST(i AS INT), 1) = '<' THEN 0 ELSE instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({f}, CAST(i AS INT), 1)) - 1 END) * [7, 3, 1][CAST((i - 1) % 3 + 1 AS INT)])) % 10)::INT"


@query("v8_mrz_digits", f"SELECT c_custkey AS id, {_DIGIT.format(f='f')} AS digit FROM (SELECT c_custkey, concat(chr(CAST(65 + c_custkey % 26 AS INT)), lpad(CAST(c_custkey * 37 % 10000000 AS VARCHAR), 7, '0'), '<') AS f FROM customer)")
def mrz_digits(spark, sf_dir):
    rows = co.planted(spark, sf_dir, "SELECT c_custkey AS id, concat(chr(CAST(65 + c_custkey % 26 AS INT)), lpad(CAST(c_custkey * 37 % 10000000 AS STRING), 7, '0'), '<') AS f FROM customer")
    return rows.select("id", checks.mrz_check_digit(F.col("f")).cast("int").alias("digit"))


def _passports(spark, sf_dir):
    """Zones with computed digits; of keys that end in 1 the last digit is wrong, of those that end in 3 there is no zone."""
    rows = co.planted(spark, sf_dir, "SELECT c_custkey AS k, concat(chr(CAST(65 + c_custkey % 26 AS INT)), lpad(CAST(c_custkey AS STRING), 7, '0')) AS number, lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') AS dd FROM customer")
    d = lambda c: checks.mrz_check_digit(c).cast("string")
    rows = rows.withColumns({"f1": F.concat("number", F.lit("<"))}).withColumns({"p1": F.concat("f1", d(F.col("f1"))), "p2": F.concat(F.lit("8005"), "dd")}).withColumns({"p2": F.concat("p2", d(F.col("p2"))), "p3": F.concat(F.lit("3105"), "dd")})
    rows = rows.withColumn("p3", F.concat("p3", d(F.col("p3")), F.lit("<" * 15)))
    last = (d(F.concat("p1", "p2", "p3")).cast("int") + F.when(F.col("k") % 10 == 1, 1).otherwise(0)) % 10
    rows = rows.withColumn("two", F.concat("p1", F.lit("IND"), "p2", F.lit("M"), "p3", last.cast("string")))
    one = F.rpad(F.concat(F.lit("P<INDROE<<SAM<"), F.translate(F.col("k").cast("string"), "0123456789", "ABCDEFGHIJ")), 44, "<")
    issue = F.when(F.col("k") % 10 == 2, "01/01/2035").otherwise("06/05/2021")
    zone = F.when(F.col("k") % 10 == 3, F.lit("")).otherwise(F.concat(one, F.lit("\n"), F.col("two")))
    text = F.concat(F.lit("PASSPORT\nREPUBLIC OF INDIA\nDate of Issuance: "), issue, F.lit("\n"), zone)
    return rows.select(F.col("k").alias("doc_id"), F.lit(80).alias("ocr_confidence"), text.alias("text"), "number")


@query(
    "x3_v9_v10_v11_v13_passports",
    """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 10 <> 3 THEN concat(chr(CAST(65 + c_custkey % 26 AS INT)), lpad(CAST(c_custkey AS VARCHAR), 7, '0')) END AS number, CASE WHEN c_custkey % 10 <> 3 THEN 'ROE' END AS surname, CASE WHEN c_custkey % 10 <> 3 THEN concat(lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0'), '/05/1980') END AS birth,
  CASE c_custkey % 10 WHEN 1 THEN 'MRZ_COMPOSITE_CHECK_FAIL' WHEN 2 THEN 'DATE_ORDER_INVALID' WHEN 3 THEN 'MRZ_MISSING,PASSPORT_NUMBER_FORMAT' ELSE '' END AS codes FROM customer""",
)
def passports(spark, sf_dir):
    rows = _passports(spark, sf_dir).withColumn("m", mrz.parse_mrz(mrz.mrz_lines(F.col("text")))).withColumn("issue", labels.labeled_date(F.col("text"), (r"Date\s*of\s*Issuance",)))
    v = mrz.validate_passport(F.col("m.number"), F.col("m.birth"), F.col("issue"), F.col("m.expiry"), F.col("m.lines"), DEFAULT.as_of)
    return rows.select("doc_id", F.col("m.number").alias("number"), F.col("m.surname").alias("surname"), F.col("m.birth").alias("birth"), _codes(v).alias("codes"))


@query(
    "v12_rebuilt_zones",
    """SELECT k AS doc_id, concat(rpad(concat('P<INDROE<<SAM<', given), 44, '<'), chr(10), rpad(concat(number, '<<IND8005', dd, 'M3105', dd), 44, '<')) AS zone, false AS passed
  FROM (SELECT c_custkey AS k, translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS given, concat(chr(CAST(65 + c_custkey % 26 AS INT)), lpad(CAST(c_custkey AS VARCHAR), 7, '0')) AS number, lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS dd FROM customer)""",
)
def rebuilt(spark, sf_dir):
    dd = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    given = F.concat(F.lit("Sam "), F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij"))
    zone = mrz.rebuild_mrz(F.lit("Roe"), given, F.col("number"), F.lit("IND"), F.concat(dd, F.lit("/05/1980")), F.lit("M"), F.concat(dd, F.lit("/05/2031")))
    return _passports(spark, sf_dir).select("doc_id", zone.alias("zone"), mrz.validate_mrz(zone)["passed"].alias("passed"))


_RAW = "CASE k % 5 WHEN 0 THEN {dmy} WHEN 1 THEN {iso} WHEN 2 THEN {mdy} WHEN 3 THEN '31/02/2020' ELSE 'soon' END"


@query(
    "v14_v15_v16_dates",
    """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 2 THEN CASE WHEN day(o_orderdate) > 12 THEN CAST(o_orderdate AS DATE) ELSE make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END ELSE CAST(o_orderdate AS DATE) END AS parsed,
  CASE WHEN o_orderkey % 5 IN (3, 4) THEN 'INVALID_DATE' WHEN year(o_orderdate) >= 1996 THEN 'DATE_ORDER_INVALID' ELSE '' END AS code, o_orderkey % 5 NOT IN (3, 4) AS plausible FROM orders""",
)
def parsed_dates(spark, sf_dir):
    k, f = F.col("o_orderkey") % 5, lambda p: F.date_format("o_orderdate", p)
    raw = F.when(k == 0, f("dd/MM/yyyy")).when(k == 1, f("yyyy-MM-dd")).when(k == 2, f("MM/dd/yyyy")).when(k == 3, "31/02/2020").otherwise("soon")
    rows = co.read_table(spark, sf_dir, "orders").withColumn("raw", raw)
    order = checks.date_order(F.col("raw"), F.lit("01/01/1996"), "order")
    return rows.select(F.col("o_orderkey").alias("id"), checks.parse_date(F.col("raw")).alias("parsed"), F.coalesce(order["code"], F.lit("")).alias("code"), checks.plausible_dob(F.col("raw"), DEFAULT.as_of).alias("plausible"))


@query(
    "v17_v19_v20_validation_audit",
    f"""WITH t AS (SELECT 'SECURITY_CLEARANCE' AS requested_type, CASE WHEN k % 10 = 3 THEN 'MISSING_MANDATORY' WHEN k % 10 = 1 THEN 'DATE_ORDER_INVALID' ELSE 'PASSED' END AS code FROM ({_K}) UNION ALL
  SELECT 'SECURITY_PROGRAMME', CASE WHEN k % 10 = 1 THEN 'DATE_ORDER_INVALID' ELSE 'PASSED' END FROM ({_K}) UNION ALL SELECT 'AUTHORITY_LETTER', 'PASSED' FROM ({_K})), u AS (SELECT * FROM t UNION ALL SELECT requested_type, 'ALL' FROM t)
  SELECT coalesce(requested_type, '*') AS requested_type, code, count(*) AS n FROM u GROUP BY GROUPING SETS ((code, requested_type), (code))""",
)
def validation_audit(spark, sf_dir):
    out = None
    for t, q in (("SECURITY_CLEARANCE", co.PLANTED_CLEARANCE), ("SECURITY_PROGRAMME", co.PLANTED_PROGRAMME), ("AUTHORITY_LETTER", co.PLANTED_LETTER)):
        rows = ex.validate(ex.extract_fields(co.planted(spark, sf_dir, q), t), t).select(F.lit(t).alias("requested_type"), "validation")
        out = rows if out is None else out.unionByName(rows)
    return ex.validation_audit(out)


@query(
    "a5_a6_a7_extraction_confidence",
    f"""SELECT k AS doc_id, CAST(floor(least(100, greatest(0, (CASE WHEN k % 10 = 3 THEN 0.5 ELSE 1.0 END) * 0.55 * 100 + 5.0 / 6 * 0.3 * 100 + conf / 100.0 * 0.15 * 100 - CASE WHEN conf < 50 THEN 10 ELSE 0 END - CASE WHEN k % 10 = 1 THEN 10 ELSE 0 END)) + 0.5) AS INT) AS confidence,
  CASE WHEN k % 10 = 3 THEN 'employeeName not found' ELSE '' END AS issues FROM ({_K})""",
)
def confidence(spark, sf_dir):
    out = ex.extract(co.planted(spark, sf_dir, co.PLANTED_CLEARANCE), "SECURITY_CLEARANCE")
    return out.select("doc_id", F.col("extraction_confidence").alias("confidence"), F.array_join("extraction_issues", ";").alias("issues"))


_NAMES = "SELECT c_custkey AS doc_id, concat('INCOME TAX DEPARTMENT', chr(10), 'Name: ', CASE c_custkey % 3 WHEN 0 THEN 'Subhash Singh' WHEN 1 THEN 'Meera Kapoor' ELSE 'Arjun Desai' END, chr(10), 'Father Name: Ramesh ', CASE c_custkey % 2 WHEN 0 THEN 'Verma' ELSE 'Kumar' END, chr(10), 'DOB: 01/02/1980') AS text FROM customer"


@query(
    "n1_n7_names",
    "SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'SUBHASH SINGH' WHEN 1 THEN 'MEERA KAPOOR' ELSE 'ARJUN DESAI' END AS person, CASE c_custkey % 2 WHEN 0 THEN 'RAMESH VERMA' ELSE 'RAMESH KUMAR' END AS father FROM customer",
)
def person_and_father(spark, sf_dir):
    father = names.father_name(F.col("text"))
    rows = co.planted(spark, sf_dir, _NAMES).withColumn("father", father)
    return rows.select("doc_id", names.best_name(F.col("text"), F.col("father")).alias("person"), "father")


@query(
    "n2_n5_name_scores",
    """SELECT c_custkey AS doc_id, v.value, v.source, v.score, v.rank FROM customer, LATERAL (SELECT concat('SUBHASH SING', chr(CAST(65 + c_custkey % 26 AS INT))) AS value, 'title-case' AS source, 2 * 12 + 13 + 35 + 2 * 12 + 15 AS score, 1 AS rank
  UNION ALL SELECT 'RAMESH VERMA', 'title-case', 2 * 12 + 12 + 35 + 2 * 12 + 15, 2) v""",
)
def name_scores(spark, sf_dir):
    """Both stand in title case, and so both are of that source; the one before the father's label leads by 50 points and its place."""
    rows = co.planted(spark, sf_dir, "SELECT c_custkey AS doc_id, concat('INCOME TAX DEPARTMENT', chr(10), 'Name: Subhash Sing', chr(CAST(97 + c_custkey % 26 AS INT)), chr(10), 'Father Name: Ramesh Verma', chr(10), 'DOB: 01/02/1980') AS text FROM customer")
    return names.name_candidates(rows).select("doc_id", "value", "source", "score", "rank")


@query(
    "e12_person_names",
    "SELECT c_custkey AS doc_id, concat('SUBHASH SING', chr(CAST(65 + c_custkey % 26 AS INT)), ';RAMESH VERMA') AS names FROM customer",
)
def person_names(spark, sf_dir):
    rows = co.planted(spark, sf_dir, "SELECT c_custkey AS doc_id, concat('Name: Subhash Sing', chr(CAST(97 + c_custkey % 26 AS INT)), chr(10), 'Father Name: Ramesh Verma', chr(10), 'subhash and Old Bus') AS text FROM customer")
    return rows.select("doc_id", F.array_join(names.person_names(F.col("text")), ";").alias("names"))


@query(
    "n3_n4_clean_names",
    "SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN concat('MR SUBHASH SING', chr(CAST(65 + c_custkey % 26 AS INT))) WHEN 1 THEN NULL WHEN 2 THEN concat('MEERA KAPO', chr(CAST(65 + c_custkey % 26 AS INT))) ELSE NULL END AS cleaned, c_custkey % 2 = 0 AS real FROM customer",
)
def cleaned(spark, sf_dir):
    k, letter = F.col("c_custkey") % 4, F.chr((97 + F.col("c_custkey") % 26).cast("int"))
    raw = F.when(k == 0, F.concat(F.lit("Mr. Govt Subhash  Sing"), letter, F.lit("!!"))).when(k == 1, F.concat(F.lit("INCOME TAX "), letter)).when(k == 2, F.concat(F.lit("meera kapo"), letter, F.lit(" "), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("Zzz Qqq"), F.lit(" 1")))
    rows = co.read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), names.clean_name(raw).alias("cleaned"))
    return rows.withColumn("real", names.is_real(F.col("cleaned")))


_WORDS = "SELECT doc_id, pos, word AS text, CAST((doc_id * 31 + pos * 17) % 101 AS DOUBLE) AS confidence, CAST(100 AS INT) AS y0, CAST(110 + (pos * 7) % 5 AS INT) AS y1, CAST(pos // 500 AS INT) AS page FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents)"


def ocr_words(spark, sf_dir):
    """(doc_id, page, pos, text, confidence, y0, y1): a row for each word of the documents, with confidences and heights by arithmetic."""
    docs = co.read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    return rows.select("doc_id", F.floor(F.col("pos") / 500).cast("int").alias("page"), "pos", "text", ((F.col("doc_id") * 31 + F.col("pos") * 17) % 101).cast("double").alias("confidence"), F.lit(100).alias("y0"), (110 + (F.col("pos") * 7) % 5).alias("y1"))


@query(
    "n6_word_confidence",
    f"SELECT doc_id, count(*) AS n, sum(c)::BIGINT AS total FROM (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS w, max(confidence) AS c FROM ({_WORDS}) GROUP BY 1, 2 HAVING w <> '') GROUP BY doc_id",
)
def word_confidence(spark, sf_dir):
    return names.word_confidence(ocr_words(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("confidence").cast("long").alias("total"))


@query(
    "x8_x11_x13_parts",
    """SELECT k AS doc_id, concat('MEERA ANAND KAPO', chr(CAST(65 + k % 26 AS INT))) AS fullest, strftime(e - INTERVAL 10 YEAR + CASE WHEN month(e) = 2 AND day(e) = 29 AND day(e - INTERVAL 10 YEAR) = 28 THEN INTERVAL 2 DAY ELSE INTERVAL 1 DAY END, '%d/%m/%Y') AS issue,
  CASE k % 3 WHEN 0 THEN 'FEMALE' WHEN 1 THEN 'MALE' ELSE 'TRANSGENDER' END AS gender, concat(lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0'), '/06/', CAST(1950 + k % 50 AS VARCHAR)) AS dob FROM (SELECT c_custkey AS k, DATE '2018-01-01' + CAST(c_custkey AS INT) AS e FROM customer)""",
)
def parts(spark, sf_dir):
    k = F.col("c_custkey")
    letter, day = F.chr((97 + k % 26).cast("int")), F.lpad((1 + k % 28).cast("string"), 2, "0")
    year = (1950 + k % 50).cast("string")
    text = F.concat(F.lit("Sex: "), F.when(k % 3 == 0, "female").when(k % 3 == 1, "Male").otherwise("TRANSGENDER"), F.when(k % 2 == 0, F.concat(F.lit(", Date of Birth: "), day, F.lit(".06."), year)).otherwise(F.concat(F.lit(", born "), day, F.lit("/06/"), year)))
    expiry = F.date_format(F.date_add(F.lit("2018-01-01").cast("date"), k.cast("int")), "dd/MM/yyyy")
    short, full = (F.concat(F.lit(x), letter) for x in ("Meera Kapo", "Meera Anand Kapo"))
    return co.read_table(spark, sf_dir, "customer").select(k.alias("doc_id"), names.fullest(short, full).alias("fullest"), labels.infer_issue(expiry).alias("issue"), labels.gender(text).alias("gender"), labels.dob(text).alias("dob"))


@query(
    "l2_l4_l5_labels",
    """SELECT k AS doc_id, concat('Ann ', x, 'ee;Bob Ray;Issued on the day;', '/02/2020 and 03/04/', y, ' 02/04/2035') AS directors, concat(dd, '/02/2020') AS near, concat('03/04/', y) AS issue, '02/04/2035' AS expiry
  FROM (SELECT c_custkey AS k, chr(CAST(65 + c_custkey % 26 AS INT)) AS x, CAST(2000 + c_custkey % 25 AS VARCHAR) AS y, lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') AS dd FROM customer)""",
)
def label_parts(spark, sf_dir):
    rows = co.planted(spark, sf_dir, "SELECT c_custkey AS doc_id, concat('Directors', chr(10), '1. Ann ', chr(CAST(65 + c_custkey % 26 AS INT)), 'ee', chr(10), '2) Bob Ray', chr(10), 'No', chr(10), 'Issued on the day', chr(10), lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0'), '/02/2020 and 03/04/', CAST(2000 + c_custkey % 25 AS STRING), ' 02/04/2035') AS text FROM customer")
    t = F.col("text")
    pair = labels.issue_expiry(t)
    return rows.select("doc_id", F.array_join(labels.labeled_list(t, ("Directors?",)), ";").alias("directors"), labels.date_near(t, ("Issued",)).alias("near"), pair["issue"].alias("issue"), pair["expiry"].alias("expiry"))


@query(
    "x9_x10_x12_x14_passport_parts",
    """SELECT c_custkey AS doc_id, number, true AS exact, 'P' AS type, 'IND' AS country, CASE c_custkey % 2 WHEN 0 THEN 'KOCHI, KERALA' ELSE 'PUNE' END AS place, '123456789012' AS personal FROM (SELECT c_custkey, concat('U1', lpad(CAST((c_custkey * 765432 + 123456) % 1000000 AS VARCHAR), 6, '2')) AS number FROM customer)""",
)
def passport_parts(spark, sf_dir):
    """Of odd keys the printed number is misread; the zone's number, which has its check digit, is trusted."""
    number = "concat('U1', lpad(CAST((c_custkey * 765432 + 123456) % 1000000 AS STRING), 6, '2'))"
    read = f"CASE WHEN c_custkey % 2 = 0 THEN {number} ELSE concat('UI', substr({number}, 3)) END"
    rows = co.planted(spark, sf_dir, f"SELECT c_custkey AS doc_id, {number} AS number, concat('Type / Type', chr(10), 'P  IND', chr(10), 'Place: ', CASE c_custkey % 2 WHEN 0 THEN 'Kochi, Kerala' ELSE 'Pune' END, chr(10), {read}, chr(10), {number}, '<1IND8001011M3001015123456789012') AS text FROM customer")
    t = F.col("text")
    best = pp.best_number(F.array(t))
    kind = pp.type_country(t)
    out = rows.select("doc_id", kind["type"].alias("type"), kind["country"].alias("country"), pp.gazetteer_place(t).alias("place"), pp.personal_number(t, F.col("number")).alias("personal"), best.alias("b"))
    return out.select("doc_id", F.col("b.number").alias("number"), F.col("b.exact").alias("exact"), "type", "country", "place", "personal")
