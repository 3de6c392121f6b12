"""How results compare with what was expected of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_expected(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, field, ok) of results (doc_id, fields) and expected (doc_id, field, kind, value): a pattern matches or a literal is contained, in any case.

    A null value is always met; a field that is missing is not.
    """
    actual = results.select("doc_id", F.explode_outer("fields").alias("field", "actual")).filter("field IS NOT NULL")
    rows = expected.join(actual, ["doc_id", "field"], "left")
    met = F.when(F.col("kind") == "regex", F.rlike("actual", F.concat(F.lit("(?i)"), F.col("value")))).otherwise(F.contains(F.lower("actual"), F.lower("value")))
    return rows.select("doc_id", "field", (F.col("value").isNull() | F.coalesce(met, F.lit(False))).alias("ok"))


def documents_ok(matches: DataFrame, results: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ok): every field met, and the type that was wanted (doc_id, type)."""
    fields = matches.groupBy("doc_id").agg(F.bool_and("ok").alias("fields_ok"))
    rows = wanted.join(fields, "doc_id", "left").join(results.select("doc_id", "document_type", "status"), "doc_id", "left")
    return rows.select("doc_id", (F.coalesce("fields_ok", F.lit(True)) & F.coalesce((F.col("document_type") == F.col("type")) & (F.col("status") != "error"), F.lit(False))).alias("ok"))


def pass_by_format(df: DataFrame, by: str = "format") -> DataFrame:
    """(by, passed, total) of each format, and of all as "*"."""
    out = df.rollup(by).agg(F.sum(F.col("ok").cast("long")).alias("passed"), F.count("*").alias("total"))
    return out.withColumn(by, F.coalesce(by, F.lit("*")))


def misses(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Expected documents that have no result."""
    return expected.join(results.select("doc_id"), "doc_id", "left_anti")


def expectation_match(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(expectation, ok, total): FAKE is met by what did not pass, UNKNOWN by an unknown type or what did not pass, a type by that type passed; errors do not count."""
    rows = expected.join(results, "doc_id").filter("status <> 'error'")
    passed = F.coalesce("overall_passed", F.lit(False))
    ok = F.when(F.col("expectation") == "FAKE", ~passed).when(F.col("expectation") == "UNKNOWN", (F.coalesce("document_type", F.lit("UNKNOWN")) == "UNKNOWN") | ~passed)
    ok = ok.otherwise(F.coalesce(F.col("document_type") == F.col("expectation"), F.lit(False)) & passed)
    return rows.groupBy("expectation").agg(F.sum(ok.cast("long")).alias("ok"), F.count("*").alias("total"))


# What a file's name tells of its type, in the order that is tried.
SLUGS = (("passport", "passport"), ("clearance", "security-clearance"), ("programme", "security-programme"), ("program", "security-programme"), ("authority", "authority-letter"), ("letter", "authority-letter"), ("aadhaar", "aadhaar"), ("aadhar", "aadhaar"), ("pan", "pan"), ("cin", "cin"))


def infer_slug(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    return F.coalesce(*[F.when(F.contains(name, F.lit(part)), slug) for part, slug in SLUGS])
