"""Streams that are broken off and go on, repeated and late entries, and folders that pass."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docaudit.config import Settings
from docaudit.plans.audit import audit_documents
from docaudit.plans.stream_queries import ROWS
from docaudit.sources import corpus as co
from docaudit.sources.shared import own_folder, passing, shared_dir
from docaudit.streaming import streams

SF = "/root/testdata/sf0.001"


def test_an_audit_that_is_broken_off_goes_on_where_it_was(spark, tmp_path):
    mix = co.planted_mix(spark, SF).filter("requested_type = 'SECURITY_PROGRAMME' AND doc_id < 400")
    mix.repartition(3, "doc_id").write.parquet(f"{tmp_path}/in")
    whole = audit_documents(mix, types=("SECURITY_PROGRAMME",))
    stream = streams.read_stream(spark, f"{tmp_path}/in", ROWS, files=1)
    real, tries = streams.audit_documents, []

    def breaks(batch, *args, **kw):
        tries.append(batch.count())
        if len(tries) == 2:
            raise RuntimeError("a lost driver")
        return real(batch, *args, **kw)

    streams.audit_documents = breaks
    try:
        with pytest.raises(Exception, match="a lost driver"):
            streams.audit_sink(stream, f"{tmp_path}/rows", f"{tmp_path}/state", types=("SECURITY_PROGRAMME",)).trigger(availableNow=True).start().awaitTermination()
        # What a batch had written before it was lost is replaced when it comes again.
        os.makedirs(f"{tmp_path}/rows/batch=1", exist_ok=True)
        streams.read_sink(spark, f"{tmp_path}/rows").drop("batch").limit(3).write.mode("append").parquet(f"{tmp_path}/rows/batch=1")
        streams.audit_sink(stream, f"{tmp_path}/rows", f"{tmp_path}/state", types=("SECURITY_PROGRAMME",)).trigger(availableNow=True).start().awaitTermination()
    finally:
        streams.audit_documents = real
    assert len(tries) == 4
    got = streams.read_sink(spark, f"{tmp_path}/rows").drop("batch")
    key = lambda df: sorted(map(str, df.select(*sorted(whole.columns)).collect()))
    assert key(got) == key(whole)
    assert sorted(map(tuple, co.summarize_results(got).collect())) == sorted(map(tuple, co.summarize_results(whole).collect()))


def test_repeats_count_once_and_late_entries_not_at_all(spark, tmp_path):
    start = datetime(2024, 1, 1, 12)
    at = lambda minutes: start + timedelta(minutes=minutes)
    batches = (
        [(1, at(0), "ocr", "completed"), (1, at(1), "ocr", "completed"), (2, at(2), "ocr", "stopped"), (1, at(3), "risk", "completed")],
        [(3, at(60), "ocr", "completed"), (2, at(2), "ocr", "stopped")],
        [(4, at(1), "ocr", "completed"), (5, at(58), "ocr", "completed"), (3, at(61), "ocr", "completed")],
    )
    schema = "doc_id long, ts timestamp, stage string, status string"
    log = streams.read_stream(spark, f"{tmp_path}/in", schema, files=1)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.funnel_sink(log, f"{tmp_path}/rows", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(int((r.start - start).total_seconds() // 60), r.stage, r.status): r.n for r in streams.read_funnel(spark, f"{tmp_path}/rows").collect()}
    # The fourth document is over 10 minutes behind the latest entry; the fifth is not. The last window is there.
    assert got == {(0, "ocr", "completed"): 1, (0, "ocr", "stopped"): 1, (0, "risk", "completed"): 1, (60, "ocr", "completed"): 1, (55, "ocr", "completed"): 1}


def test_folders_made_inside_pass(spark):
    with passing(spark):
        inside = own_folder(spark, "inside")
        spark.range(3).write.parquet(f"{inside}/rows")
        assert os.path.exists(inside.removeprefix("file:"))
    outside = own_folder(spark, "outside")
    assert not os.path.exists(inside.removeprefix("file:")) and outside.startswith(shared_dir(spark))


def test_results_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "CIN", "completed"), (2, "CIN", "stopped"), (3, "PAN", "stopped")], "doc_id long, requested_type string, status string")
    co.write_results(df, str(tmp_path))
    rows, counts = co.read_results(spark, str(tmp_path))
    assert rows.filter(F.col("status") == "stopped").count() == 2
    assert sorted(map(tuple, counts.collect())) == [("CIN", "completed", 1), ("CIN", "stopped", 1), ("PAN", "stopped", 1)]


def test_files_are_taken_in_by_what_they_are(spark, tmp_path):
    for name, size in (("a.PDF", 10), ("b.png", 3), ("c.exe", 1), ("deep/d.jpeg", 2), ("noend", 1)):
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(b"x" * size)
    got = {r["path"].rsplit("/", 1)[-1]: (r["accepted"], r["reject_reason"]) for r in co.intake_manifest(co.scan_files(spark, str(tmp_path))).collect()}
    assert got == {"a.PDF": (True, None), "b.png": (True, None), "d.jpeg": (True, None), "c.exe": (False, "unsupported_extension"), "noend": (False, "unsupported_extension")}
    small = co.intake_manifest(co.scan_files(spark, str(tmp_path)), Settings(max_upload_bytes=5)).filter("reject_reason = 'file_too_large'")
    assert [r["path"].rsplit("/", 1)[-1] for r in small.collect()] == ["a.PDF"]
