"""Queries over more, or larger, keys than the given tables have."""

import re

import pytest
from pyspark.sql import functions as F

from docaudit.functions.patterns import BOUNDARY, exploded, has, java, needs_of, words_of
from docaudit.operators import classify as cl
from docaudit.operators import raster as ra
from docaudit.plans.all_queries import QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _customers(spark, path, *keys):
    rows = [(k, f"Customer#{k:09}", k % 25, 1.0, "MACHINERY") for k in keys]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_pixels_are_never_broadcast(spark):
    """Rows that explode() makes look as few as what they are made of."""
    pixels = spark.range(2).selectExpr("id AS image_id", "explode(sequence(0, 19)) AS y").selectExpr("*", "explode(sequence(0, 29)) AS x").withColumns({"r": F.col("x") * 8, "g": F.col("y") * 12, "b": F.lit(255)})
    out = ra.raster_regions(pixels)
    assert "Broadcast" not in _plan(out)
    got = {r["image_id"]: r for r in out.collect()}
    inside = [(x * 8, y * 12, 255, x - 4, y - 3) for x in range(4, 25) for y in range(3, 17)]
    means = [(r + g + b) / 3 for r, g, b, _, _ in inside]
    photo = [max(r, g, b) - min(r, g, b) > 35 and 35 < (r + g + b) / 3 < 230 for r, g, b, x, y in inside if x % 4 == 0 and y % 4 == 0]
    for k in (0, 1):
        assert abs(got[k]["center_brightness"] - sum(means) / len(means)) < 1e-9
        assert got[k]["dark_block_ratio"] == 0.0
        assert abs(got[k]["photo_region_ratio"] - sum(photo) / len(photo)) < 1e-9


def test_addresses_of_keys_with_six_digits(spark, tmp_path):
    got = {r["doc_id"]: r["coded"] for r in QUERIES["e10_addresses"](spark, _customers(spark, tmp_path, 7, 123456)).collect()}
    assert got == {k: f"Registered Office: {k} High Street, Ward Five, Bengaluru 560{k % 1000:03}" for k in (7, 123456)}


#: Keys of which the account number's letters hold MRZ and whose card both types of cards refuse.
MRZ_CARDS = (451205, 451215, 451225)


def test_letters_of_an_account_number_are_no_label_of_a_zone(spark, tmp_path):
    got = {r["doc_id"]: r["best"] for r in QUERIES["c8_best_types"](spark, _customers(spark, tmp_path, 15, *MRZ_CARDS)).collect()}
    assert {got[10 * k + 1] for k in (15, *MRZ_CARDS)} == {"AADHAAR"}
    rows = spark.createDataFrame([(1, "MRZ below", 60), (2, "AMRZB 1234 C, see MRZ", 60), (3, "PAN bmrzc1234d", 60)], "doc_id long, text string, ocr_confidence int")
    scores = {r["doc_id"]: r["score"] for r in cl.type_scores_long(rows).filter("type = 'PASSPORT'").collect()}
    assert scores == {1: 15, 2: 15, 3: 0}


def test_types_are_tried_over_scores_that_are_made_once(spark, tmp_path, monkeypatch):
    from docaudit.plans import audit

    written, keep = [], audit.keep
    monkeypatch.setattr(audit, "keep", lambda df, name, by=None: written.append(name) or keep(df, name, by))
    keys = (15, 24, 33, *MRZ_CARDS)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["c11_types_by_trying"](spark, _customers(spark, tmp_path, *keys)).collect()}
    assert written.count("classified") == 1 and len(written) == 3
    assert len(got) == 3 * len(keys)
    for k in MRZ_CARDS:
        conf = 30 + k * 37 % 70
        assert got[10 * k + 1] == ("PASSPORT", "stopped", 4, None if conf < 40 else 5 if conf >= 70 else 0)


def test_types_tried_in_a_row_are_those_of_single_attempts(spark):
    texts = ["", None, "INCOME TAX DEPARTMENT\nGOVT. OF INDIA", "PERMANENT ACCOUNT NUMBER\nABCDE1234F", "UIDAI\nAADHAAR\n2345 6789 0124", "P<INDROE<<SAM<<<<<<\nPASSPORT A1234567", "CERTIFICATE OF INCORPORATION\nCIN: U12345AB1990PTC123456", "PASSPORT\nCERTIFICATE OF INCORPORATION\nMinistry of Corporate Affairs", "Surname Given Name CIN"]
    df = spark.createDataFrame([(k, t, conf) for k, t in enumerate(t for t in texts for _ in range(3)) for conf in [(20, 50, 80)[k % 3]]], "doc_id long, text string, ocr_confidence int").withColumn("readable", F.col("ocr_confidence") > 30)
    single = None
    for k, t in enumerate(cl.TRIES):
        one = cl.classify(df.withColumn("requested_type", F.lit(t)))
        one = one.select("doc_id", F.lit(k).alias("try_pos"), F.lit(t).alias("type"), F.when(F.col("readable") & F.col("classified"), "completed").otherwise("stopped").alias("status"), F.when(F.col("readable"), F.col("classification_confidence")).alias("confidence"))
        single = one if single is None else single.unionByName(one)
    want = {r["doc_id"]: (r["type"], r["tried"]) for r in cl.resolve_unknown_type(single).collect()}
    got = {r["doc_id"]: (r["requested_type"], r["tried"]) for r in cl.try_types(cl.score_types(df), F.col("readable")).collect()}
    assert got == want and len({t for t, _ in got.values()}) == 4


def test_lists_of_the_bag_that_nobody_asks_for_are_not_made(spark, tmp_path):
    out = QUERIES["e17_a7_letter_bag"](spark, _customers(spark, tmp_path, 10, 11))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "title-case" not in plan and "Registered" not in plan
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[105]["emails"] == "a10@acme.example" and got[105]["headers"].startswith("AUTHORITY LETTER;") and got[105]["signature"] == "false"


def test_trimmed_as_by_both_ends(spark):
    from docaudit.functions.patterns import squeeze, trim

    texts = ["", " ", "a", " a", "a ", " \t a  b\u00a0 \n", "\u3000\ufeff", "a\u2003\u2003", "a  b", "\u00e9 ", "\U0001f600 \n", "x" + " " * 2000 + "y" + " " * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", trim(F.col("t")).alias("a"), squeeze(F.col("t")).alias("b"))
    space = " \t\n\r\x0b\x0c\u00a0\u2003\u3000\ufeff"
    for r in df.collect():
        assert r["a"] == r["t"].strip(space)
        assert r["b"] == re.sub(f"[{space}]+", " ", r["t"]).strip(" ")


def test_leftovers_of_one_letter_and_repaired_numbers(spark):
    from docaudit.functions.checks import pan_candidates
    from docaudit.functions.names import FUSED, GARBAGE, is_garbage

    def plain(x):
        most = max(x.count(c) for c in x)
        return len(x) > 18 or x in GARBAGE or re.search(FUSED, x) is not None or (len(x) <= 3 and set(x) <= set("AEIOU")) or (len(x) >= 4 and not set(x) & set("AEIOU")) or (len(x) >= 3 and most / len(x) >= 0.75)

    tokens = ["A", "BA", "AAA", "ABA", "AABA", "ABAA", "BAAAA", "ABABA", "ABCA", "OOOOXOOX", "OXOOXOOO", "SAMUEL", "XYZW", "TAXES", "AAAAAAAAAAAAAAAAAAA"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", is_garbage(F.col("t"))).collect()}
    assert got == {t: plain(t) for t in tokens}
    texts = {"ABCDE1234F": ["ABCDE1234F"], "ABCDE 1234 F, ABCDE1234F": ["ABCDE1234F"], "abcdeS23OF": ["ABCDE5230F", "ABCDE8230F"], "AB0DE1234F ZZZZZ9999Z": ["ZZZZZ9999Z", "ABODE1234F"], "none": []}
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", pan_candidates(F.col("t"))).collect()}
    assert got == texts


def test_scores_are_made_once_where_they_are_exploded(spark):
    """A filter on an array's size would make all scores, and the texts below them, once more."""
    rows = spark.createDataFrame([(1, "INCOME TAX", 80), (2, None, 80)], "doc_id long, text string, ocr_confidence int").withColumn("text", F.concat("text", F.lit("")))
    plan = cl.type_scores_long(rows).filter("rank = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in "".join(x for x in plan.split("\n") if x.strip().startswith(("Filter", "+- Filter")))
    assert {r["doc_id"] for r in cl.type_scores_long(rows).filter("rank = 1").collect()} == {1, 2}
    listed = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "doc_id long, l array<string>")
    assert sorted(tuple(r) for r in exploded(listed, F.col("l")).collect()) == [(1, 0, "a"), (1, 1, "b")]


@pytest.mark.parametrize(
    "pattern, words",
    [(r"MEETING\s*NOTES|COPY", ["MEETING", "COPY"]), (r"\b(MALE|FEMALE)\b", ["MALE", "FEMALE"]), (r"\b\d{4}[\s\-]?\d{4}\b", None), (r"<{3,}|ab", ["<<<", "AB"]), (r"(?:(?:ab|c)de)?fgh", ["FGH"]), (r"colou?r", ["COLO"]), (r"(?:xyz)*ab?c", None), (r"\u00A0abc", None), ("stra\u00dfe", None)],
)
def test_words_that_a_pattern_needs(pattern, words):
    assert words_of(pattern) == words


def test_patterns_match_as_without_their_words(spark):
    from docaudit.functions.text import CUES, READ_BONUS
    from docaudit.sources.catalog import LABELS, RULES

    patterns = {(p, True) for p in CUES.values()} | {(p, fold) for p, _, fold in READ_BONUS} | {(r[1], r[4]) for rules in RULES.values() for r in rules} | {(p, True) for f in LABELS.values() for ps in f.values() for p in ps}
    texts = ["", None, "govt. of india \u092d\u093e\u0930\u0924 \u0938\u0930\u0915\u093e\u0930", "\u0130ncome tax, m\u0131nistry of corporate affairs", "Male, 12 May, then 2021 p<IND<<<<", "A1234567 U12345AB2020PTC123456 x", "on 12 May in 2021 at 9:15", "security  programme\nvalid until\nref no", "\u00e9PAN name_x NAME MALEx", "\u017fignature stra\u00dfe Signed sd/-"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = [F.coalesce(F.col("t").rlike(java(p, fold)), F.lit(False)).alias(f"p{k}") for k, (p, fold) in enumerate(sorted(patterns))]
    quick = [has(F.col("t"), p, fold).alias(f"p{k}") for k, (p, fold) in enumerate(sorted(patterns))]
    assert df.select(*plain).collect() == df.select(*quick).collect()


def test_read_scores_count_without_arrays_of_tokens(spark):
    """Counts of tokens of all lengths, at every kind of space, without a function called for each token."""
    from docaudit.functions import text as tx

    texts = ["", "a bb ccc dddd e", "éab éé ééé x1 ab,cd efgh-ij", "abcde1fghij   12 345 हिन्दी \U0001f600\U0001f600 z\U0001f600z", " \n\t ", "abcd　abc﻿abcdabcd"]
    rows = [(t, re.findall(r"[^\s   -     　﻿]+", t)) for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(*[x.alias(n) for n, x in tx._shape(F.col("text")).items()]).collect()
    for (t, tokens), r in zip(rows, got):
        assert (r.tokens, r.short, r.long) == (len(tokens), sum(len(x) <= 2 for x in tokens) / max(len(tokens), 1), sum(bool(re.search("[A-Za-z]{4,}", x)) for x in tokens)), t
        assert (r.alnum, r.letters) == (len(re.findall("[A-Za-z0-9]", t)), len(re.findall("[A-Za-z]", t)))
    both = tx.readability_score(tx.ocr_read_score(df.withColumn("ocr_confidence", F.lit(80))))
    assert "lambdafunction" not in both._jdf.queryExecution().optimizedPlan().toString()


def test_signals_share_one_upper_case_text(spark):
    from docaudit.functions import text as tx

    df = spark.createDataFrame([("Pan card, seen on 12 May 2021",), (None,)], "text string")
    out = tx.text_signals(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1
    assert [(r.hasPanLabel, r.hasTimestampCue, r.hasJunkWords) for r in out.collect()] == [(True, True, False), (False, False, False)]


@pytest.mark.parametrize(
    "pattern, needs",
    [
        (r"\bat\s+\d{1,2}:\d{2}", [[["AT"], [":"]]]), (r"\b(APPLE|HELLO\s*THIS)\b", [[["APPLE", "HELLO"]]]), (r"(?:ab|c)d", []), (r"(?!abc)de", [[["DE"]]]), (r"a(?:bc)?d|ef", []),
        (r"(?:JAN|FEB)[A-Z]*\b.*\b20\d{2}", [[["JAN", "FEB"], ["20"]]]),
    ],
)
def test_all_parts_that_a_pattern_needs(pattern, needs):
    assert needs_of(pattern) == needs


@pytest.mark.parametrize("pattern, halves", [(r"\b(?:REF|NO\.?)x", 1), (r"(A|B)\b", 1), (r"\b(?:a|-)b", 0), (r"(?:a|b?)\b", 0), (r"[A-Z]{2,}\b", 1), (r"\b(?:ab)?-", 0)])
def test_boundaries_at_groups_of_words(pattern, halves):
    assert (BOUNDARY not in java(pattern)) == bool(halves)


def test_entities_are_searched_once_and_only_as_asked(spark):
    from docaudit.functions import entities as en

    df = spark.createDataFrame([(1, "a@b.example 12/03/2020, tel 0123 456789"), (2, "A@B.example, 020 7946 0018 at 01/02/2021"), (3, None)], "doc_id long, text string")
    rows = en.entity_table(df, kinds=("email", "phone"))
    assert "date" not in {r.kind for r in rows.collect()}
    out = en.entity_stats(rows.withColumn("value", F.upper("value")))
    assert not any(x in _plan(out).lower() for x in ("regexp", "rlike"))
    got = {r.kind: (r.n, r.n_docs, r.n_values, r.top_values) for r in out.collect()}
    assert got == {"email": (2, 2, 1, "A@B.EXAMPLE"), "phone": (2, 2, 2, "0123 456789, 020 7946 0018")}


def test_keyword_scores_of_the_types_asked(spark):
    df = spark.createDataFrame([(1, "SECURITY CLEARANCE")], "doc_id long, text string")
    out = cl.keyword_scores_long(df, types=("SECURITY_CLEARANCE",))
    assert [r.type for r in out.collect()] == ["SECURITY_CLEARANCE"] and "PASSPORT" not in _plan(out)


def test_a_stream_of_one_file_is_dealt_out(spark, tmp_path):
    from docaudit.streaming import streams

    spark.range(200).selectExpr("id AS doc_id", "'INCOME TAX DEPARTMENT' AS text", "'PAN' AS requested_type", "80 AS ocr_confidence").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.read_stream(spark, f"{tmp_path}/in", "doc_id long, text string, requested_type string, ocr_confidence int")
    out = streams.audit_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 200
    assert len(list((tmp_path / "out").glob("part-*"))) > 1


def test_spaces_are_told_from_printable_signs_by_their_range(spark):
    """The classes of white space, alone, negated and among others, hold what they held, and ask for the range of printable signs first."""
    from docaudit.functions.patterns import MORE_SPACE

    assert java(r"\s").startswith("[[^!-~]&&") and java(r"\S").startswith("[!-~[")
    signs = [chr(k) for k in (*range(1, 0x250), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), *range(0x2FF0, 0x3010), 0xFEFF, 0xFF21, 0x1F600)]
    plain = {r"\s": rf"[\s{MORE_SPACE}]", r"\S": rf"[^\s{MORE_SPACE}]", r"[\d\s.]": rf"[\d\s{MORE_SPACE}.]", r"[^A\s\-]": rf"[^A\s{MORE_SPACE}\-]"}
    df = spark.createDataFrame([(x,) for x in signs], "x string")
    for pattern, same in plain.items():
        for fold in ("", "(?i)"):
            assert df.filter(F.col("x").rlike(fold + java(pattern)) != F.col("x").rlike(fold + same)).count() == 0, pattern
