"""The single-row semantics that the corpus jobs are made of."""

import re

import pytest
from pyspark.sql import functions as F

from docaudit.config import DEFAULT, Settings
from docaudit.functions import checks, labels, mrz, names
from docaudit.functions import entities as en
from docaudit.functions.patterns import java, unique_ci
from docaudit.functions.text import normalize_reasons, ocr_gate, presence_flags, text_signals
from docaudit.operators.results import scrub_pii


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(*[c(F.col("t")).alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_patterns_have_ascii_boundaries_and_strict_ends(spark):
    text = spark.createDataFrame([("éPAN x",), ("abc\n",), ("a b",)], "t string")
    got = text.select(F.col("t").rlike(java(r"\bPAN\b")), F.col("t").rlike(java("^abc$")), F.col("t").rlike(java(r"a\sb"))).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, False, False), (False, False, True)]


def test_gate_cases(spark):
    rows = [("A" * 50 + "1234567890", 10, 100.0), ("   ", 90, None), ("CORPORATE IDENTITY NUMBER U72900MH2018PTC312456", 80, 120.0), ("xx", 15, 10.0), (None, None, None)]
    got = ocr_gate(spark.createDataFrame(rows, "text string, ocr_confidence int, blur double"), blur_col="blur").collect()
    codes = [[r.code for r in x.gate_reasons] for x in got]
    assert codes == [["OCR_CONFIDENCE_LOW"], ["OCR_TEXT_EMPTY", "OCR_ALNUM_LOW"], [], ["OCR_CONFIDENCE_LOW", "OCR_ALNUM_LOW", "OCR_EXCESSIVE_BLUR"], ["OCR_TEXT_EMPTY", "OCR_CONFIDENCE_LOW", "OCR_ALNUM_LOW"]]
    strict = ocr_gate(spark.createDataFrame(rows[2:3], "text string, ocr_confidence int, blur double"), Settings(ocr_confidence=90)).first()
    assert not strict.gate_passed


@pytest.mark.parametrize("base", ["23456789012", "99999999999", "20000000000"])
def test_verhoeff_round_trip(spark, base):
    digit = one(spark, base, checks.verhoeff_digit)[0]
    assert one(spark, f"{base}{digit}", checks.verhoeff_ok)[0]
    assert not one(spark, f"{base}{(digit + 1) % 10}", checks.verhoeff_ok)[0]


def test_numbers(spark):
    assert one(spark, "ABCDE1234F", checks.pan)[0].passed
    assert [r.code for r in one(spark, "ABCDE1234", checks.pan)[0].reasons] == ["PAN_FORMAT_INVALID"]
    assert one(spark, "0KYPS8I36M", checks.normalize_pan)[0] == "OKYPS8136M"
    cin = lambda c: checks.cin(c, DEFAULT.as_of)
    assert one(spark, "U72900MH2018PTC312456", cin)[0].passed
    assert {r.code for r in one(spark, "INVALID", cin)[0].reasons} == {"CIN_LENGTH_INVALID", "CIN_FORMAT_INVALID", "CIN_LISTING_INVALID", "CIN_YEAR_INVALID"}
    assert one(spark, "5555 6666 77778888", checks.aadhaar_candidates)[0] == ["666677778888"]
    assert one(spark, "L898902C3", checks.mrz_check_digit)[0] == 6


def test_dates(spark):
    assert str(one(spark, "15/03/2018", checks.parse_date)[0]) == "2018-03-15"
    assert one(spark, "31/02/2020", checks.parse_date)[0] is None
    order = lambda a, b: one(spark, a, lambda c: checks.date_order(c, F.lit(b), "x"))[0]
    assert order("01/01/2020", "01/01/2021").passed and order("", "01/01/2021").skipped
    assert (order("01/01/2022", "01/01/2021").code, order("soon", "01/01/2021").code) == ("DATE_ORDER_INVALID", "INVALID_DATE")
    assert not one(spark, "01/01/2099", lambda c: checks.plausible_dob(c, DEFAULT.as_of))[0]
    assert one(spark, "on 5 March 1999, 2001-02-03 and 1.2.49, 31/02/2020, 45/01/2000", en.dates)[0] == ["05/03/1999", "03/02/2001", "01/02/2049", "31/02/2020"]


def test_zone(spark):
    zone = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
    m = one(spark, f"noise\n{zone}\nmore", lambda c: mrz.parse_mrz(mrz.mrz_lines(c)))[0]
    assert (m.surname, m.given, m.number, m.birth, m.expiry, m.personal) == ("ERIKSSON", "ANNA MARIA", "L898902C3", "12/08/1974", "15/04/2012", "ZE184226B")
    assert one(spark, m.lines, mrz.validate_mrz)[0].passed
    assert [r.code for r in one(spark, m.lines[:-1] + "1", mrz.validate_mrz)[0].reasons] == ["MRZ_COMPOSITE_CHECK_FAIL"]
    assert [r.code for r in one(spark, None, mrz.validate_mrz)[0].reasons] == ["MRZ_MISSING"]


def test_entities(spark):
    got = one(spark, "A@b.co, a@B.CO and +1 (644) 555-4442; REF: AB/123 and Clearance No: XK-99", en.emails, en.phones, en.references, en.document_numbers)
    assert list(got) == [["A@b.co"], ["+1 (644) 555-4442"], ["AB/123"], ["XK-99"]]
    df = spark.createDataFrame([([" b", "B", "", None, "a "],)], "a array<string>")
    assert df.select(unique_ci(F.col("a"))).first()[0] == ["b", "a"]
    assert one(spark, None, en.emails)[0] == []


def test_document_tables_reads_all_texts(spark):
    from docaudit.plans.text_queries import document_tables

    def held(text):
        run = 0
        for line in [x.strip() for x in (text or "").split("\n") if x.strip()]:
            cut = [[c for c in parts if c.strip()] for parts in (line.split("|"), re.split(r"\t+", line), re.split(r"\s{2,}", line))]
            run = run + 1 if any(len(c) >= 2 for c in cut) else 0
            if run == 2:
                return True
        return False

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert document_tables(spark, "/root/testdata/sf0.01").first().n_docs == sum(map(held, texts)) > 0


def test_tables_are_runs_of_columns(spark):
    df = spark.createDataFrame([(1, "x | y\n1 | 2\nplain\nlone | row\nplain\na  b\nc  d\ne  f"), (2, None), (3, "")], "doc_id int, text string")
    assert [(r.doc_id, r.table_no, r.row_count) for r in en.tables(df).orderBy("doc_id", "table_no").collect()] == [(1, 1, 2), (1, 2, 3)]


def test_labels(spark):
    assert one(spark, "Name of Company: Acme Ltd\nx", lambda c: labels.labeled_value(c, (r"Company\s*Name", r"Name\s*of\s*Company")))[0] == "Acme Ltd"
    assert one(spark, "Purpose: n/a\nTravel", lambda c: labels.labeled_value(c, ("Purpose",)))[0] == "Travel"
    assert one(spark, "Organisation: Acme", lambda c: labels.labeled_value(c, ("Organisation|Organization",)))[0] == ": Acme"
    assert one(spark, "Organisation: Acme", lambda c: labels.labeled_value(c, ("Organisation|Organization",), strict=True))[0] == "Acme"
    assert one(spark, "29/02/2020", labels.infer_issue)[0] == "02/03/2010"


def test_names(spark):
    assert one(spark, "Mr Govt Subhash  Singh", lambda c: names.clean_name(F.regexp_replace(c, "Mr", "")))[0] == "SUBHASH SINGH"
    assert one(spark, "INCOME TAX", names.clean_name)[0] is None
    assert one(spark, "MEERA KAPOOR", names.is_real)[0] and not one(spark, "XX YY", names.is_real)[0]


def test_flags_reasons_and_scrub(spark):
    df = spark.createDataFrame([("Signed, official seal at 10:30 PM", {"name": "x", "k": "y"}, ("z", "w"))], "text string, m map<string,string>, s struct<aadhaar:string,other:string>")
    flags = text_signals(presence_flags(df)).first()
    assert flags.signature and flags.stamp and flags.hasTimestampCue and flags.hasScreenshotCues and not flags.hasUidai
    assert [r.message for r in df.select(normalize_reasons(F.array(F.lit("a"), F.lit(None).cast("string")), "ocr")).first()[0]] == ["a"]
    clean = scrub_pii(df).first()
    assert "text" not in clean.asDict() and clean.m == {"k": "y"} and clean.s.asDict() == {"other": "w"}
