"""Queries over stream sinks and result folders, each read back from what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.plans import audit, score_queries  # noqa: F401  its SQL is used here
from docaudit.plans.registry import SQL, query
from docaudit.sources import corpus as co
from docaudit.sources.shared import own_folder
from docaudit.streaming import streams

ROWS = "doc_id long, requested_type string, ocr_confidence int, text string"


@query("s5_t1_streamed_results", SQL["r1_r2_r4_audit_programme"])
def streamed_results(spark, sf_dir):
    """Programmes arrive in three files, a batch each, and are audited whole into a sink."""
    at = own_folder(spark, "programmes")
    co.planted_mix(spark, sf_dir).filter("requested_type = 'SECURITY_PROGRAMME'").repartition(3, "doc_id").write.parquet(f"{at}/in")
    stream = streams.read_stream(spark, f"{at}/in", ROWS, files=1)
    streams.audit_sink(stream, f"{at}/rows", f"{at}/state", types=("SECURITY_PROGRAMME",)).trigger(availableNow=True).start().awaitTermination()
    return streams.read_sink(spark, f"{at}/rows").select("doc_id", "status", "stage", "document_type", "overall_passed")


@query(
    "s5_results_read_back",
    f"SELECT requested_type, status, count(*) AS n_rows, count(*) AS n_said FROM (SELECT requested_type, CASE WHEN status = 'stopped' THEN 'stopped' ELSE 'completed' END AS status FROM (SELECT *, 'SECURITY_PROGRAMME' AS requested_type FROM ({SQL['r1_r2_r4_audit_programme']}))) GROUP BY ALL",
)
def results_read_back(spark, sf_dir):
    """Rows by status and the summary of a result folder, counted against each other."""
    at = own_folder(spark, "results")
    mix = co.planted_mix(spark, sf_dir).filter("requested_type = 'SECURITY_PROGRAMME'")
    co.write_results(audit.audit_documents(mix, types=("SECURITY_PROGRAMME",)), at)
    rows, summary = co.read_results(spark, at)
    counted = rows.groupBy("requested_type", "status").agg(F.count("*").alias("n_rows"))
    return counted.join(summary.withColumnRenamed("count", "n_said"), ["requested_type", "status"], "full")


@query(
    "t2_live_funnel",
    "SELECT epoch_ms(start) AS start_ms, stage, status, count(*) AS n FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 'stopped' ELSE 'completed' END AS status FROM events) GROUP BY start, stage, status",
)
def live_funnel(spark, sf_dir):
    """Every entry comes twice and counts once; the last windows are there as well."""
    at = own_folder(spark, "funnel")
    events = [streams.read_stream(spark, f"{sf_dir}/events.parquet", "event_id long, ts timestamp, user_id long, event_type string, value double, props string") for _ in range(2)]
    log = events[0].unionByName(events[1]).select(F.col("event_id").alias("doc_id"), "ts", F.col("event_type").alias("stage"), F.when(F.col("event_id") % 3 == 0, "stopped").otherwise("completed").alias("status"))
    streams.funnel_sink(log, f"{at}/rows", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return streams.read_funnel(spark, f"{at}/rows").select(F.unix_millis("start").alias("start_ms"), "stage", "status", "n")
