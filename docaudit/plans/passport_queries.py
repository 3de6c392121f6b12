"""Queries over planted passports in which zone, labels and loose text disagree; what they should give was read off the rules, case by case."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.functions import checks, mrz
from docaudit.operators import extract as ex
from docaudit.operators import passports as pp
from docaudit.plans.registry import query
from docaudit.sources import corpus as co

#: A number by key: its varying digits stand between others, so that no digit stands four times in a row.
_NUMBER = "concat('K1', substr(d, 1, 1), '2', substr(d, 2, 1), '3', substr(d, 3, 1), '9')"
_KEYS = "SELECT c_custkey AS doc_id, lpad(CAST(c_custkey * 37 % 1000 AS {s}), 3, '0') AS d, lpad(CAST(c_custkey % 28 + 1 AS {s}), 2, '0') AS dd FROM customer"


def _planted(spark, sf_dir, cases):
    """(doc_id, num, dd, text): each key has the text of one case, # standing for its number and @ for its day."""
    rows = co.planted(spark, sf_dir, f"SELECT *, {_NUMBER} AS num FROM ({_KEYS.format(s='STRING')})")
    text = F.get(F.array(*[F.lit(c) for c in cases]), (F.col("doc_id") % len(cases)).cast("int"))
    return rows.withColumn("text", F.replace(F.replace(text, F.lit("#"), F.col("num")), F.lit("@"), F.col("dd")))


def _duck(cases: int) -> str:
    return f"SELECT *, {_NUMBER} AS num, doc_id % {cases} AS k FROM ({_KEYS.format(s='VARCHAR')})"


_FILL = "<" * 44
#: (text, record): the record's fields in their order, mrz as its two lines, then confidence at a reading of 80, issues, reasons.
RECORDS = (
    (
        "REPUBLIC OF UTOPIA PASSPORT\nType / Type P Code UTO\nPassport No.: #\nSurname: MARLOWE\nGiven Names: PHILIP\nNationality: UTOPIAN\nDate of Birth: @/03/1975\nPlace of Birth: LAKE TOWN\nSex: M\nDate of Issuance: 10/01/2015\nDate of Expiry: 09/01/2025\nIssuing Authority: CITY OFFICE\nPersonal No. 77123",
        # The words on the line below run on with those beside the label, and the longest name is taken.
        ("#", "P", "UTO", "UTOPIAN", "MARLOWE", "PHILIP NATIONALITY", "@/03/1975", "LAKE TOWN", "MALE", "10/01/2015", "09/01/2025", "LAKE TOWN", "CITY OFFICE", "77123", ("P<UTOMARLOWE<<PHILIP<NATIONALITY", "#<<UTO7503@M250109"), 98, "", "FORMAT_VALID"),
    ),
    (
        f"{('P<INDRAO<<ASHA' + _FILL)[:44]}\n#<0IND8501019F3001012{_FILL[:14]}00\nSurname\nR A O K U M A R\nPassport No: Z9999999\nPlace of Birth\n5\nTRIVANDRUM, KERALA\nPlace of Issue: KOCHI\nDate of Birth 02/02/1990",
        # The zone's short surname gives way to the label's; its birth date does not. The day of issue is ten years and a day back.
        ("#", "P", "IND", "INDIAN", "RAOKUMAR", "ASHA", "01/01/1985", "TRIVANDRUM, KERALA", "FEMALE", "02/01/2020", "01/01/2030", "KOCHI", "MINISTRY OF EXTERNAL AFFAIRS", None, ("P<INDRAO<<ASHA", f"#<0IND8501019F3001012{_FILL[:14]}00"), 96, "", "FORMAT_VALID"),
    ),
    (
        "REPUBLIC OF INDIA\nP IND\n#\nSurname: SHARMA\nGiven Name\nROHAN VIJAY\n44 Z1234567\n15/08/2031 14/08/2021\nDate of Birth: @/07/1991 M",
        # The number below type and country goes before the loose one; a pair of dates is taken as it stands.
        ("#", "P", "IND", "INDIAN", "SHARMA", "ROHAN VIJAY", "@/07/1991", None, "MALE", "15/08/2031", "14/08/2021", None, "MINISTRY OF EXTERNAL AFFAIRS", None, ("P<INDSHARMA<<ROHAN<VIJAY", "#<<IND9107@M210814"), 81, "", "FORMAT_VALID,LOGICAL_INCONSISTENCY"),
    ),
    (
        "PASSPORT\nPassport No: AB12\n#\nSurname: IYER\nGiven Name: MEENA\n1) Born in CHENNAI, TAMIL NADU near PUNE DELHI\nDOB: @/11/1988\ndates 01-06-2028 and 02.06.2018\nIndian citizen FEMALE",
        # What the label says is no number, and the loose one is not asked. Dates are sorted, and the second city of issue is taken.
        (None, None, None, "INDIAN", "IYER", "MEENA", "@/11/1988", "CHENNAI, TAMIL NADU", "FEMALE", "02/06/2018", "01/06/2028", "DELHI", "MINISTRY OF EXTERNAL AFFAIRS", None, None, 69, "MRZ not found,passportNumber not found", "MISSING_MANDATORY_FIELDS"),
    ),
    (
        f"{('P<GBRSMITH<<JOHN<PAUL' + _FILL)[:44]}\n#<4GBR7006155M2901018123456789<<<<<12\nDate of Issuance: 15/06/1970\nType: PD\nSex: MALE",
        # A day of issue that is the birth date is none.
        ("#", "P", "GBR", "GBR", "SMITH", "JOHN PAUL", "15/06/1970", None, "MALE", None, "01/01/2029", None, None, "123456789", ("P<GBRSMITH<<JOHN<PAUL", "#<4GBR7006155M2901018123456789<<<<<12"), 88, "", "FORMAT_VALID"),
    ),
    ("", (None,) * 15 + (16, "MRZ not found,passportNumber not found,surname not found,givenName not found", "EXTRACTION_BELOW_THRESHOLD,MISSING_MANDATORY_FIELDS")),
    (
        "X\n#<0IND8001011M3001015123456789012\nSurname: NAIR\nGiven Name: LATHA\n1\nCountry Code: IND\nType: P\nPlace of Birth: EE 12 KOLLAM|",
        # No zone, but a run like one gives sex, expiry and the personal number.
        ("#", "P", "IND", "INDIAN", "NAIR", "LATHA", None, "12 KOLLAM", "MALE", "02/01/2020", "01/01/2030", "12 KOLLAM", "MINISTRY OF EXTERNAL AFFAIRS", "123456789012", ("P<INDNAIR<<LATHA", "#<<IND<<<<<<M300101"), 96, "", "FORMAT_VALID"),
    ),
    (
        "PASSPORT Type O USA\nLast Name: T H E Stone\nSurname: Stonewell\nGiven Name: S A R A\n9\nSex F 01.02.1999\nDate of Birth\n@.02.1999\nsome 03/03/2020 date",
        # One date is left beside the birth date: the expiry. A labelled sex that is more than a letter counts as none.
        (None, "O", "USA", None, "STONEWELL", "SARA", "@/02/1999", None, "FEMALE", "01/02/1999", "03/03/2020", None, None, None, None, 64, "MRZ not found,passportNumber not found", "MISSING_MANDATORY_FIELDS"),
    ),
)


def _sql(value) -> str:
    if isinstance(value, tuple):
        return f"concat(rpad({_sql(value[0])}, 44, '<'), chr(10), rpad({_sql(value[1])}, 44, '<'))"
    if value is None or isinstance(value, int):
        return "NULL" if value is None else str(value)
    return f"replace(replace('{value}', '#', num), '@', dd)" if "#" in value or "@" in value else f"'{value}'"


def _column(i: int, name: str, kind: str = "VARCHAR") -> str:
    return f"CAST(CASE k {' '.join(f'WHEN {k} THEN {_sql(r[i])}' for k, (_, r) in enumerate(RECORDS))} END AS {kind}) AS {name}"


@query(
    "x3_passport_records",
    f"""SELECT doc_id, {", ".join(_column(i, f) for i, f in enumerate(pp.FIELDS))},
  {_column(15, "confidence", "INTEGER")}, {_column(16, "issues")}, {_column(17, "codes")} FROM ({_duck(len(RECORDS))})""",
)
def passport_records(spark, sf_dir):
    rows = _planted(spark, sf_dir, [text for text, _ in RECORDS]).withColumn("ocr_confidence", F.lit(80))
    out = ex.extract(rows, "PASSPORT")
    codes = F.filter(F.transform("extraction_reasons", lambda r: r["code"]), lambda c: ~c.isin("MANDATORY_FIELDS_COMPLETE", "OCR_SUPPORTS_EXTRACTION"))
    return out.select("doc_id", *pp.FIELDS, F.col("extraction_confidence").alias("confidence"), F.array_join("extraction_issues", ",").alias("issues"), F.array_join(F.array_sort(codes), ",").alias("codes"))


#: Points of a number whose digits meet those of a token that is read without its first digit.
_MET = "({} + 2 * (CAST(a = '1' AS INT) + CAST(a = '2' AS INT) + CAST(b = '2' AS INT) + CAST(b = '3' AS INT) + CAST(c = '3' AS INT) + CAST(c = '9' AS INT)))"
#: (text, number, exact, score) of each case; $ stands for the last six digits of the number.
NUMBERS = (
    ("#", "num", "true", "40 + 200 + 14"),
    ("KI$", f"CASE WHEN {_MET.format(40)} >= 45 THEN num END", "false", _MET.format(40)),  # I for 1: the token's own digits stand one place further on
    ("KA$", "concat('K4', substr(num, 3))", "false", "40 + 35 + 14"),  # A for 4
    ("KX1$", "num", "false", "40 + 14"),  # a letter too many at the second place
    ("KOOOO123", "NULL", "false", "40 + 14 - 30 - 15"),  # four alike: under the least score
    ("#\nV0$<0IND", "concat('V0', substr(num, 3))", "true", "CASE WHEN {d} = 0 THEN 40 + 15 + 200 + 100 + 80 + 24 ELSE 40 + 15 + 200 + 100 + 24 END"),  # the zone's number is trusted
    ("M1$", "NULL", "NULL", "NULL"),  # starts as a sex does
    ("#\nJ1$", "concat('J1', substr(num, 3))", "true", "40 + 15 + 200 + 24"),  # both stand there; J is usual
    ("#XYZ\n12345", "num", "false", "40 + 14"),  # letters after the last digit
    ("U1$\nZ1$", "concat('U1', substr(num, 3))", "true", "40 + 15 + 200 + 24"),  # equal points: the first
)
_V_DIGIT = "(31 * 7 + 0 * 3 + a * 1 + 2 * 7 + b * 3 + 3 * 1 + c * 7 + 9 * 3) % 10"


@query(
    "x14_number_repair",
    f"""SELECT doc_id, CASE k {" ".join(f"WHEN {k} THEN {n}" for k, (_, n, _, _) in enumerate(NUMBERS))} END AS number,
  CAST(CASE k {" ".join(f"WHEN {k} THEN {e}" for k, (_, _, e, _) in enumerate(NUMBERS))} END AS BOOLEAN) AS exact,
  CAST(CASE k {" ".join(f"WHEN {k} THEN {s.format(d=_V_DIGIT.replace('a *', 'CAST(a AS INT) *').replace('b *', 'CAST(b AS INT) *').replace('c *', 'CAST(c AS INT) *'))}" for k, (_, _, _, s) in enumerate(NUMBERS))} END AS INTEGER) AS score
FROM (SELECT *, substr(d, 1, 1) AS a, substr(d, 2, 1) AS b, substr(d, 3, 1) AS c FROM ({_duck(len(NUMBERS))}))""",
)
def number_repair(spark, sf_dir):
    """Of each key's text the likeliest number; $ stands for the number's last six digits."""
    rows = _planted(spark, sf_dir, [text for text, *_ in NUMBERS])
    best = pp.best_number(F.array(F.replace(F.col("text"), F.lit("$"), F.substring("num", 3, 6))))
    return rows.withColumn("b", best).select("doc_id", F.col("b.number").alias("number"), F.when(F.col("b").isNotNull() & F.col("b.score").isNotNull(), F.col("b.exact")).alias("exact"), F.col("b.score").cast("int").alias("score"))


#: What is changed in a zone whose digits are right, and the codes that follow.
ZONES = (
    ("whole", ""),
    ("number", "MRZ_COMPOSITE_CHECK_FAIL,MRZ_PASSPORT_CHECK_FAIL"),
    ("birth", "MRZ_COMPOSITE_CHECK_FAIL,MRZ_DOB_CHECK_FAIL"),
    ("expiry", "MRZ_COMPOSITE_CHECK_FAIL,MRZ_EXPIRY_CHECK_FAIL"),
    ("last", "MRZ_COMPOSITE_CHECK_FAIL"),
    ("one line", "MRZ_PARSE_FAIL"),
    ("none", "MRZ_MISSING"),
    ("run together", ""),
    ("short", "MRZ_COMPOSITE_CHECK_FAIL"),
)


@query(
    "v11_zone_digits",
    f"""SELECT c_custkey AS doc_id, CASE c_custkey % {len(ZONES)} {" ".join(f"WHEN {k} THEN '{codes}'" for k, (_, codes) in enumerate(ZONES))} END AS codes,
  c_custkey % {len(ZONES)} IN (0, 7) AS passed, c_custkey % {len(ZONES)} NOT IN (5, 6) AS present FROM customer""",
)
def zone_digits(spark, sf_dir):
    """Each check digit wrong in turn, a zone of one line, none, one without its line end, and one cut short after the expiry's digit, which is filled up."""
    kind = F.col("doc_id") % len(ZONES)
    rows = co.planted(spark, sf_dir, f"SELECT *, {_NUMBER} AS num FROM ({_KEYS.format(s='STRING')})")
    d = lambda c: checks.mrz_check_digit(c).cast("int")
    wrong = lambda c, k: ((d(c) + F.when(kind == k, 1).otherwise(0)) % 10).cast("string")
    rows = rows.withColumns({"p1": F.concat("num", F.lit("<")), "p2": F.concat(F.lit("8005"), "dd"), "p3": F.concat(F.lit("3105"), "dd")})
    # The last digit is right for what stands there, so that in turn one digit is wrong alone or with the digit over all.
    right = rows.withColumns({"q1": F.concat("p1", d(F.col("p1")).cast("string")), "q2": F.concat("p2", d(F.col("p2")).cast("string")), "q3": F.concat("p3", d(F.col("p3")).cast("string"))})
    all_of = F.concat("q1", "q2", "q3", F.lit("<" * 15))
    two = F.concat("p1", wrong(F.col("p1"), 1), F.lit("IND"), "p2", wrong(F.col("p2"), 2), F.lit("M"), "p3", wrong(F.col("p3"), 3))
    one = F.rpad(F.lit("P<INDROE<<SAM"), 44, "<")
    # The sum over all changes with any other digit: its weight is 1, 3 or 7, none of which is nothing for a step of one.
    filled = F.concat(two, F.lit("<" * 15), wrong(all_of, 4))
    zone = F.when(kind == 5, one).when(kind == 6, F.lit("")).when(kind == 7, F.concat(one, filled)).when(kind == 8, F.concat(one, F.lit("\n"), two)).otherwise(F.concat(one, F.lit("\n"), filled))
    v = right.select("doc_id", mrz.validate_mrz(zone).alias("v"))
    return v.select("doc_id", F.array_join(F.array_sort(F.transform("v.reasons", lambda r: r["code"])), ",").alias("codes"), F.col("v.passed").alias("passed"), F.col("v.checks")["present"].alias("present"))
