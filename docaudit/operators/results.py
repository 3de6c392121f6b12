"""Result rows: stopped and completed documents under one schema, and what leaves the system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.functions.patterns import REASONS

# Names of values that must not be logged.
SENSITIVE = ("fullOcrText", "text", "data", "name", "fatherName", "aadhaar", "pan", "passportNumber", "personalNumber", "address", "dob", "dateOfBirth", "mrz", "extractedData")
# Key fields of a summary.
KEY_FIELDS = ("name", "aadhaar", "pan", "passportNumber", "surname", "givenName", "cinNumber", "companyName", "employeeName", "clearanceNumber", "programmeTitle", "authorizedPerson")


DECISION = "struct<passed:boolean,score:int,threshold:int,overallScore:int>"
MIRROR = "struct<passed:boolean,score:int,threshold:int>"


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def stopped_results(df: DataFrame, stage: str, reasons: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows that a gate turned back: nothing later is known, the first reason is why, and warnings gather what was said. also: further columns of df."""
    said = F.transform(F.col(reasons), lambda r: r["message"])
    typed = F.lit(None).cast("string") if stage == "ocr" else F.lit("UNKNOWN")
    conf = F.col("classification_confidence") if "classification_confidence" in df.columns else _null("int")
    return df.select(
        "doc_id", "requested_type", F.lit("stopped").alias("status"), F.lit(stage).alias("stage"), F.coalesce(F.get(said, F.lit(0)), F.lit("Processing stopped")).alias("stop_reason"),
        F.col(reasons).cast(REASONS).alias("reasons"), typed.alias("document_type"), F.col("ocr_confidence").cast("int").alias("ocr_confidence"), conf.alias("classification_confidence"), F.lit(0).alias("extraction_confidence"),
        F.array_distinct(F.concat("gate_warnings", said)).alias("warnings"), _null("map<string,string>").alias("fields"), _null("map<string,array<string>>").alias("lists"), _null("boolean").alias("validation_passed"), _null("int").alias("risk_score"), _null(DECISION).alias("risk_assessment"), _null(MIRROR).alias("authenticity"), _null(REASONS).alias("risk_reasoning"), F.lit(False).alias("overall_passed"), *also,
    )


def completed_results(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows that came through: of types that are only extracted there is no risk, and validation decides (null where there is none).

    Verified types have the risk block: the decision, its older mirror and what was said; soft signs are warnings. also: further columns of df.
    """
    judged = "risk_score" in df.columns
    risk = F.col("risk_score") if judged else _null("int")
    block = [(F.col(c) if judged else _null(k)).cast(k).alias(c) for c, k in (("risk_assessment", DECISION), ("authenticity", MIRROR), ("risk_reasoning", REASONS))]
    warnings = F.array_distinct(F.concat("gate_warnings", "quality_warnings")) if judged else F.col("gate_warnings")
    overall = F.col("overall_passed") if "overall_passed" in df.columns else F.when(~F.col("validation_skipped"), F.col("validation.passed"))
    return df.select(
        "doc_id", "requested_type", F.lit("completed").alias("status"), F.lit("completed").alias("stage"), _null("string").alias("stop_reason"),
        F.concat("class_reasons", "extraction_reasons", "validation.reasons").cast(REASONS).alias("reasons"), F.col("document_type"), F.col("ocr_confidence").cast("int").alias("ocr_confidence"), F.col("classification_confidence"), F.col("extraction_confidence"),
        warnings.alias("warnings"), F.col("fields"), F.col("lists"), F.when(~F.col("validation_skipped"), F.col("validation.passed")).alias("validation_passed"), risk.alias("risk_score"), *block, overall.alias("overall_passed"), *also,
    )


def stage_log(results: DataFrame) -> DataFrame:
    """(doc_id, type, stage, status): an entry for each stage that a document came to; where it stopped, its last one says so.

    It is made from the rows of the audit, so that a funnel of it agrees with them; the risk is a stage of judged types only.
    """
    upto = lambda *stages: F.array(*[F.lit(s) for s in stages])
    came = F.when(F.col("stage") == "ocr", upto("ocr")).when(F.col("stage") == "classification", upto("ocr", "classification"))
    came = came.when(F.col("risk_score").isNull(), upto("ocr", "classification", "extraction", "validation")).otherwise(upto("ocr", "classification", "extraction", "validation", "risk"))
    rows = results.select("doc_id", F.col("requested_type").alias("type"), F.col("stage").alias("_last"), F.col("status").alias("_status"), F.explode(came).alias("stage"))
    return rows.select("doc_id", "type", "stage", F.when((F.col("_status") == "stopped") & (F.col("stage") == F.col("_last")), "stopped").otherwise("completed").alias("status"))


def summarize(results: DataFrame) -> DataFrame:
    """(doc_id, status, confidences, stop_reason, codes, key_fields): the first three reason codes, and key fields that are there, of 60 characters."""
    keys = F.map_filter(F.transform_values("fields", lambda k, v: F.substring(v, 1, 60)), lambda k, v: k.isin(*KEY_FIELDS) & v.isNotNull())
    return results.select("doc_id", "status", "ocr_confidence", "classification_confidence", "extraction_confidence", "stop_reason", F.slice(F.transform("reasons", lambda r: r["code"]), 1, 3).alias("codes"), keys.alias("key_fields"))


def scrub_pii(df: DataFrame, sensitive: tuple[str, ...] | list[str] = tuple(SENSITIVE)) -> DataFrame:
    """df without sensitive columns, nor such fields of its structs and keys of its maps of one level."""
    keep = []
    for f in df.schema.fields:
        if f.name in sensitive:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StructType):
            drop = [x.name for x in f.dataType.fields if x.name in sensitive]
            if len(drop) == len(f.dataType.fields):
                continue
            c = c.dropFields(*drop) if drop else c
        elif isinstance(f.dataType, T.MapType) and isinstance(f.dataType.keyType, T.StringType):
            c = F.map_filter(c, lambda k, v: ~k.isin(list(sensitive)))
        keep.append(c.alias(f.name))
    return df.select(*keep)
