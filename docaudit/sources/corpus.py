"""Document corpora: text already read from scans, intake manifests, results, and a planted corpus whose truth is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.config import DEFAULT, Settings
from docaudit.functions.checks import VERHOEFF_D, VERHOEFF_INV, VERHOEFF_P

# What an upload may be.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".pdf")
MIME_TYPES = ("image/jpeg", "image/jpg", "image/png", "application/pdf")

#: The corpus view over the documents table, in SQL that Spark and DuckDB read alike.
CORPUS = """
SELECT doc_id, text, lang, source,
  CASE doc_id % 7 WHEN 0 THEN 'AADHAAR' WHEN 1 THEN 'PAN' WHEN 2 THEN 'PASSPORT' WHEN 3 THEN 'CIN' WHEN 4 THEN 'SECURITY_CLEARANCE' WHEN 5 THEN 'SECURITY_PROGRAMME' ELSE 'AUTHORITY_LETTER' END AS requested_type,
  CAST(30 + (doc_id * 37) % 70 AS INT) AS ocr_confidence, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(20 + (doc_id * 13) % 230 AS DOUBLE) END AS blur
FROM documents
"""

_NL = "chr(10)"


def _letters(k: str, n: int) -> str:
    return ", ".join(f"chr(CAST(65 + floor({k} / {26**i}) % 26 AS INT))" for i in range(n))


#: Incorporation certificates: identifier, defects by k % 10, text.
PLANTED_CIN = f"""
SELECT doc_id, nation, ocr_confidence, cin, CASE WHEN doc_id % 10 = 4 THEN 'xx' ELSE
  concat('CERTIFICATE OF INCORPORATION', {_NL}, 'Ministry of Corporate Affairs', {_NL},
    CASE WHEN doc_id % 10 = 3 THEN '' ELSE concat('CIN: ', cin, {_NL}) END,
    'Company Name: ACME ', CAST(doc_id AS STRING), ' PRIVATE LIMITED', {_NL},
    'Date of Incorporation: ', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), '/', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '/', CAST(1990 + doc_id % 35 AS STRING)) END AS text
FROM (SELECT c_custkey AS doc_id, c_nationkey AS nation, CAST(30 + (c_custkey * 37) % 70 AS INT) AS ocr_confidence,
  concat(CASE WHEN c_custkey % 3 = 0 THEN 'L' ELSE 'U' END, lpad(CAST((c_custkey * 7919) % 100000 AS STRING), 5, '0'),
    chr(CAST(65 + c_nationkey % 26 AS INT)), chr(CAST(65 + (c_nationkey * 7) % 26 AS INT)),
    CAST(CASE WHEN c_custkey % 10 = 2 THEN 1800 ELSE 1990 END + c_custkey % 35 AS STRING), 'PTC',
    lpad(CAST(c_custkey % 1000000 AS STRING), CASE WHEN c_custkey % 10 = 1 THEN 5 ELSE 6 END, '0')) AS cin FROM customer)
"""

#: Account cards: the printed number is spaced (k % 10 = 2), has a letter for a digit (1), or is left out (3); 5 also names another type.
PLANTED_PAN = f"""
SELECT doc_id, ocr_confidence, pan, concat('INCOME TAX DEPARTMENT', {_NL}, 'GOVT. OF INDIA', {_NL}, 'Permanent Account Number', {_NL},
    CASE doc_id % 10 WHEN 3 THEN '' WHEN 1 THEN concat(substr(pan, 1, 5), replace(substr(pan, 6, 4), '0', 'O'), substr(pan, 10, 1)) WHEN 2 THEN concat(substr(pan, 1, 5), ' ', substr(pan, 6, 4), ' ', substr(pan, 10, 1)) ELSE pan END, {_NL},
    CASE WHEN doc_id % 10 = 5 THEN concat('UIDAI', {_NL}) ELSE '' END, 'Father Name') AS text
FROM (SELECT c_custkey AS doc_id, CAST(30 + (c_custkey * 37) % 70 AS INT) AS ocr_confidence,
  concat({_letters("c_custkey", 5)}, lpad(CAST((c_custkey * 7919) % 10000 AS STRING), 4, '0'), chr(CAST(65 + c_nationkey % 26 AS INT))) AS pan FROM customer)
"""

#: Numbers whose check digit the caller adds: b is what it is computed from.
AADHAAR_BASE = "SELECT c_custkey AS doc_id, CAST(30 + (c_custkey * 37) % 70 AS INT) AS ocr_confidence, concat(CASE WHEN c_custkey % 10 = 2 THEN '1' ELSE '2' END, lpad(CAST((c_custkey * 104729) % 10000000000 AS STRING), 10, '0')) AS b FROM customer"

AADHAAR_TEXT = f"""
SELECT doc_id, ocr_confidence, number, concat('GOVERNMENT OF INDIA', {_NL}, 'Unique Identification Authority of India', {_NL}, 'DOB: 01/01/1980', {_NL}, 'MALE', {_NL},
    CASE WHEN doc_id % 10 = 3 THEN '' ELSE concat(substr(number, 1, 4), ' ', substr(number, 5, 4), ' ', substr(number, 9, 4)) END, {_NL},
    CASE WHEN doc_id % 10 = 5 THEN 'INCOME TAX' ELSE 'AADHAAR' END) AS text
FROM (SELECT doc_id, ocr_confidence, concat(b, CAST((digit + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END) % 10 AS STRING)) AS number FROM numbered)
"""

PLANTED_CLEARANCE = f"""
SELECT doc_id, ocr_confidence, person, concat('SECURITY CLEARANCE CERTIFICATE', {_NL}, 'Clearance Number: SC-', lpad(CAST(doc_id AS STRING), 6, '0'), {_NL}, 'Clearance Type: Airside', {_NL},
    CASE WHEN doc_id % 10 = 3 THEN '' ELSE concat('Employee Name: ', person, {_NL}) END, 'Organisation: ACME Airlines', {_NL},
    'Valid From: 01/01/', CAST(CASE WHEN doc_id % 10 = 1 THEN 2030 ELSE 2020 END AS STRING), {_NL}, 'Valid Until: 31/12/2025', {_NL}, 'Issuing Authority: Bureau of Security') AS text
FROM (SELECT c_custkey AS doc_id, CAST(30 + (c_custkey * 37) % 70 AS INT) AS ocr_confidence, concat('Person ', chr(CAST(65 + c_custkey % 26 AS INT)), 'lex') AS person FROM customer)
"""

PLANTED_PROGRAMME = f"""
SELECT doc_id, ocr_confidence, concat('AIRPORT SECURITY PROGRAMME', {_NL}, 'Programme Title: Plan ', CAST(doc_id AS STRING), {_NL}, 'Organisation: ACME Airport', {_NL}, 'Document Number: ASP-', lpad(CAST(doc_id AS STRING), 5, '0'), {_NL},
    'Version: ', CAST(1 + doc_id % 9 AS STRING), '.0', {_NL}, 'Effective Date: 15/03/', CAST(CASE WHEN doc_id % 10 = 1 THEN 2029 ELSE 2021 END AS STRING), {_NL}, 'Review Date: 15/03/2024', {_NL}, 'Prepared By: Jane Roe', {_NL},
    '1. Purpose', {_NL}, '- guards', {_NL}, '- gates', {_NL}, 'Post | Count', {_NL}, 'North | ', CAST(doc_id % 50 AS STRING), {_NL}, 'South | 3') AS text
FROM (SELECT c_custkey AS doc_id, CAST(30 + (c_custkey * 37) % 70 AS INT) AS ocr_confidence FROM customer)
"""

PLANTED_LETTER = f"""
SELECT doc_id, ocr_confidence, concat('AUTHORITY LETTER', {_NL}, 'Company Name: ACME ', CAST(doc_id AS STRING), ' Limited', {_NL}, 'Ref No: AL/', lpad(CAST(doc_id AS STRING), 5, '0'), {_NL}, 'Date: ', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), '/05/2022', {_NL},
    'TO WHOM IT MAY CONCERN', {_NL}, CASE WHEN doc_id % 10 = 3 THEN '' ELSE concat('Authorized Person: Sam ', chr(CAST(65 + doc_id % 26 AS INT)), 'oe', {_NL}) END,
    'Designation: Manager', {_NL}, 'We hereby authorize the above to act.', {_NL}, 'Email: a', CAST(doc_id AS STRING), '@acme.example') AS text
FROM (SELECT c_custkey AS doc_id, CAST(30 + (c_custkey * 37) % 70 AS INT) AS ocr_confidence FROM customer)
"""


def _flat(rows) -> str:
    return ", ".join(str(x) for row in rows for x in row)


#: The check digit in DuckDB, whose lists count from 1.
DUCK_DIGIT = f"""[{", ".join(map(str, VERHOEFF_INV))}][list_reduce(list_prepend(0, range(0, length(b))), lambda c, i:
  [{_flat(VERHOEFF_D)}][10 * c + [{_flat(VERHOEFF_P)}][CAST(10 * ((i + 1) % 8) + CAST(substr(reverse(b), CAST(i + 1 AS INT), 1) AS INT) AS INT) + 1] + 1]) + 1]"""
DUCK_AADHAAR = AADHAAR_TEXT.replace("FROM numbered", f"FROM (SELECT *, {DUCK_DIGIT} AS digit FROM ({AADHAAR_BASE}))")


#: Tables of texts, or of which texts are made, and the column that deals them out.
TEXTS = {"documents": "doc_id", "customer": "c_custkey"}


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. Texts that come in fewer pieces than there are cores, as a file of one row group cannot be split, are dealt out first.

    A table of many files has more pieces than that and is read without a shuffle.
    """
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    if table in TEXTS and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, TEXTS[table])
    return df


def _sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """query with its table names standing for DataFrames; nothing is registered in the session."""
    for name in tables:
        query = query.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(query, **tables)


def read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, lang, source, requested_type, ocr_confidence, blur) of the documents table."""
    return _sql(spark, CORPUS, documents=read_table(spark, sf_dir, "documents"))


def planted(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return _sql(spark, query, customer=read_table(spark, sf_dir, "customer"))


def planted_aadhaar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.functions.checks import verhoeff_digit

    return _sql(spark, AADHAAR_TEXT, numbered=planted(spark, sf_dir, AADHAAR_BASE).withColumn("digit", verhoeff_digit(F.col("b"))))


def planted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, requested_type, ocr_confidence, text) of six planted types; doc_id is the customer's key times ten and the type's place."""
    parts = [("AADHAAR", planted_aadhaar(spark, sf_dir))]
    parts += [(t, planted(spark, sf_dir, q)) for t, q in (("PAN", PLANTED_PAN), ("CIN", PLANTED_CIN), ("SECURITY_CLEARANCE", PLANTED_CLEARANCE), ("SECURITY_PROGRAMME", PLANTED_PROGRAMME), ("AUTHORITY_LETTER", PLANTED_LETTER))]
    out = None
    for k, (t, df) in enumerate(parts):
        df = df.select((F.col("doc_id") * 10 + k).alias("doc_id"), F.lit(t).alias("requested_type"), "ocr_confidence", "text")
        out = df if out is None else out.unionByName(df)
    return out


def intake_manifest(files: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(path, accepted, reject_reason) of files (path, length, mime): extension, matching mime type, size; contents are never read."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    reason = (
        F.when(~ext.isin(*EXTENSIONS), "unsupported_extension").when(~F.coalesce(F.lower("mime"), F.lit("")).isin(*MIME_TYPES), "unsupported_mime").when(F.coalesce("length", F.lit(0)) > settings.max_upload_bytes, "file_too_large")
    )
    return files.select("path", reason.isNull().alias("accepted"), reason.alias("reject_reason"))


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, mime) of the files under path; contents are not read."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    mime = F.create_map(*[F.lit(x) for x in ("jpg", "image/jpeg", "jpeg", "image/jpeg", "png", "image/png", "pdf", "application/pdf")])
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", mime[ext].alias("mime"))


def summarize_results(df: DataFrame) -> DataFrame:
    """(requested_type, status, count) of result rows."""
    return df.groupBy("requested_type", "status").count()


def write_results(df: DataFrame, path: str) -> None:
    """Full rows as Parquet by status, and counts by type and status as JSON."""
    df.write.mode("overwrite").partitionBy("status").parquet(f"{path}/rows")
    summarize_results(df).write.mode("overwrite").json(f"{path}/summary")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What write_results() wrote: rows, and counts."""
    return spark.read.parquet(f"{path}/rows"), spark.read.schema("requested_type string, status string, count long").json(f"{path}/summary")
