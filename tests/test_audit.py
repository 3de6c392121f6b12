"""The gated audit, evaluation, sinks and streams, and that registered queries are well formed."""

import subprocess
import sys

from pyspark.sql import functions as F

from docaudit.operators import evaluate as ev
from docaudit.operators import raster as ra
from docaudit.operators import score as sc
from docaudit.operators.classify import classify
from docaudit.plans.audit import audit_documents
from docaudit.sources import corpus as co

SF = "/root/testdata/sf0.001"


def test_every_row_has_one_result(spark, tmp_path):
    rows = co.planted(spark, SF, co.PLANTED_CIN).withColumn("requested_type", F.lit("CIN")).drop("cin")
    out = audit_documents(rows, types=("CIN",)).cache()
    assert out.count() == rows.count() == out.select("doc_id").distinct().count()
    assert {r.status for r in out.select("status").distinct().collect()} == {"stopped", "completed"}
    co.write_results(out, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/rows").count() == rows.count()


def test_programmes_are_audited(spark):
    from docaudit.plans.all_queries import QUERIES

    got = QUERIES["r1_r2_r4_audit_programme"](spark, SF).collect()
    done = [r for r in got if r.status == "completed"]
    assert 0 < len(done) < len(got) == spark.read.parquet(f"{SF}/customer.parquet").count()
    # Of keys that end in 1 the effective date lies in the future.
    assert all(r.overall_passed == (r.doc_id // 10 % 10 != 1) and r.document_type == "SECURITY_PROGRAMME" for r in done)


def test_wrong_and_unknown_types_stop(spark):
    rows = [(1, "PAN", "REPUBLIC OF X PASSPORT P<UTO surname", 90), (2, "NONE", "CERTIFICATE OF INCORPORATION", 90), (3, "CIN", None, None)]
    got = {r.doc_id: r for r in classify(spark.createDataFrame(rows, "doc_id int, requested_type string, text string, ocr_confidence int")).collect()}
    assert [got[k].document_type for k in (1, 2, 3)] == ["UNKNOWN"] * 3
    assert "WRONG_DOC_TYPE" in [r.code for r in got[1].class_reasons]


def test_expected_fields(spark):
    results = spark.createDataFrame([(1, {"a": "Acme Ltd"}), (2, {})], "doc_id int, fields map<string,string>")
    wanted = spark.createDataFrame([(1, "a", "literal", "acme"), (1, "b", "literal", None), (2, "a", "regex", "^x")], "doc_id int, field string, kind string, value string")
    assert sorted((r.doc_id, r.field, r.ok) for r in ev.match_expected(results, wanted).collect()) == [(1, "a", True), (1, "b", True), (2, "a", False)]
    assert ev.misses(wanted.select("doc_id").distinct(), results.filter("doc_id = 1")).count() == 1


def test_risk_caps(spark):
    rows = [(1, "typedTextDetector", 0, 0.2, 25, False, "typed"), (1, "layoutDetector", 1, 1.0, 25, True, None), (2, "layoutDetector", 1, 1.0, 25, True, None), (2, "unheardOf", 2, 0.1, 5, False, "odd")]
    det = spark.createDataFrame(rows, "doc_id int, name string, pos int, score double, weight int, passed boolean, fraud_message string")
    risk = sc.risk_score(det)
    got = {r.doc_id: r for r in risk.collect()}
    assert got[1].risk_score == 29 and got[2].risk_score == 27
    routed = {r.doc_id: r for r in sc.route_indicators(det, risk).collect()}
    assert routed[1].fraud_indicators == ["typed"] and routed[2].fraud_indicators == ["odd"]


def test_flat_images(spark):
    px = spark.range(0, 400).select(F.lit(1).alias("image_id"), F.floor(F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"), F.lit(100).alias("v"))
    m = ra.raster_metrics(ra.image_lines(px))
    got = m.first()
    assert (got.width, got.height, got.brightness, got.blur, got.noise, got.edge_density, got.skew_angle, got.upright, got.upright_270) == (20, 20, 100, 0, 0, 0, 0, 0, 0)
    assert not ra.content_box(m).first().cropped and ra.best_angle(m).first().angle == 0


def test_tiny_and_empty_images(spark):
    px = spark.createDataFrame([(1, 0, 0, 7), (2, 0, 0, 7), (2, 0, 1, 90)], "image_id int, y int, x int, v int")
    got = {r.image_id: r for r in ra.raster_metrics(ra.image_lines(px)).collect()}
    assert got[1].brightness == 7 and got[1].blur == 0 and got[2].edge_density == 0.5 and got[2].x0 is None
    assert ra.raster_metrics(ra.image_lines(px.limit(0))).collect() == []


def test_pixels_are_dealt_out_once(spark):
    px = spark.range(10).selectExpr("id AS image_id", "id AS y", "id AS x", "1 AS v")
    plan = ra.raster_metrics(ra.image_lines(px))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_stored_tables_meet_without_a_shuffle_of_texts(spark, tmp_path):
    from docaudit.functions.names import word_map
    from docaudit.operators.detectors import word_stats
    from docaudit.plans.audit_queries import cards
    from docaudit.sources.shared import store_by_document

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = [store_by_document(df, f"stored_{k}", 4, f"{tmp_path}/{k}") for k, df in enumerate(cards(spark, SF))]
        met = stored[0].join(stored[1], "doc_id", "left").join(word_stats(stored[2]), "doc_id", "left").join(word_map(stored[2]).hint("shuffle_hash"), "doc_id", "left")
        plan = met._jdf.queryExecution().executedPlan().toString()
        texts = [x for x in plan.split("Exchange") if "hashpartitioning" in x[:40]]
        assert met.count() == stored[0].count() and len(texts) <= 1, plan  # words are counted by (document, word), and may be dealt out by both
        got = {r.doc_id: r.status for r in audit_documents(stored[0], types=("AADHAAR",), images=stored[1], words=stored[2]).collect()}
        assert len(got) == stored[0].count() and set(got.values()) == {"completed", "stopped"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for k in range(3):
            spark.sql(f"DROP TABLE IF EXISTS stored_{k}")


def test_entry_imports_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 70"], capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
