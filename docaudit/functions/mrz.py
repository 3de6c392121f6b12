"""Machine-readable zones of passports: two lines of 44 characters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.functions import checks
from docaudit.functions.patterns import REASONS, compact, let, reason, trim

WIDTH = 44


def _clean(line: Column) -> Column:
    return F.regexp_replace(F.upper(line), "[^A-Z0-9<]", "")


def mrz_lines(text: Column) -> Column:
    """Lines that look like a zone's, padded or cut to 44 characters, distinct in order; with its lines run together the zone is cut in two."""
    fit = lambda x: F.substring(F.rpad(x, WIDTH, "<"), 1, WIDTH)
    rows = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), _clean)
    long = F.transform(F.filter(rows, lambda x: ((F.char_length(x) >= 28) & x.rlike(r"\AP[A-Z<]")) | ((F.char_length(x) >= 35) & x.rlike("<{2,}") & x.rlike("[0-9]"))), fit)

    def joined(c: Column) -> Column:
        at = F.instr(c, F.lit("P<"))
        whole = (at > 0) & (F.char_length(c) >= at + 2 * WIDTH - 1)
        return F.when(whole, F.concat(F.array(F.substring(c, at, F.lit(WIDTH))), long, F.array(F.substring(c, at + WIDTH, F.lit(WIDTH))))).otherwise(long)

    return F.array_distinct(let(_clean(F.coalesce(text, F.lit(""))), joined))


def _date(six: Column) -> Column:
    """DD/MM/YYYY of YYMMDD, letters that look like digits repaired; two digits of a year turn at 50."""
    d = F.translate(six, "OQDILBSZG", "000118526")
    year = F.substring(d, 1, 2).cast("int")
    return F.when(d.rlike(r"\A[0-9]{6}\z"), F.concat_ws("/", F.substring(d, 5, 2), F.substring(d, 3, 2), (year + F.when(year >= 50, 1900).otherwise(2000)).cast("string")))


def _plain(x: Column) -> Column:
    return F.nullif(F.regexp_replace(x, "<", ""), F.lit(""))


def parse_mrz(lines: Column) -> Column:
    """Fields of the first pair of lines whose first starts with P and whose second holds a number, else of the first two lines if they start so; null fields where there is none."""

    def pairs(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(a)), lambda i: F.coalesce(F.get(a, i).rlike(r"\AP") & _plain(F.substring(F.get(a, i + 1), 1, 9)).isNotNull(), F.lit(False)))
        first = F.coalesce(F.get(starts, F.lit(0)), F.when((F.size(a) > 1) & F.get(a, F.lit(0)).rlike(r"\AP"), 0))
        return let(first, lambda i: fields(F.get(a, i.cast("int")), F.get(a, i.cast("int") + 1)))

    def fields(one: Column, two: Column) -> Column:
        cut = lambda x, start, n: F.substring(x, start, n)
        names = F.split(cut(one, 6, 39), "<<", -1)
        spaced = lambda k: F.nullif(trim(F.regexp_replace(F.get(names, F.lit(k)), "<+", " ")), F.lit(""))
        return F.struct(
            _plain(cut(one, 1, 2)).alias("type"),
            _plain(cut(one, 3, 3)).alias("country"),
            spaced(0).alias("surname"),
            spaced(1).alias("given"),
            _plain(cut(two, 1, 9)).alias("number"),
            _plain(cut(two, 11, 3)).alias("nationality"),
            _date(cut(two, 14, 6)).alias("birth"),
            _plain(cut(two, 21, 1)).alias("sex"),
            _date(cut(two, 22, 6)).alias("expiry"),
            _plain(cut(two, 29, 14)).alias("personal"),
            F.when(two.isNotNull(), F.concat(one, F.lit("\n"), two)).alias("lines"),
        )

    return let(lines, pairs)


def zone_text(lines: Column) -> Column:
    """What stands for the zone where parse_mrz() has no fields: two lines, or one that starts with P."""
    return F.when(F.size(lines) > 1, F.concat_ws("\n", F.get(lines, F.lit(0)), F.get(lines, F.lit(1)))).when(F.get(lines, F.lit(0)).rlike(r"\AP"), F.get(lines, F.lit(0)))


# Name of a check, its code and message.
DIGIT_CHECKS = (
    ("passportNumberCheck", "MRZ_PASSPORT_CHECK_FAIL", "MRZ passport number check digit mismatch"),
    ("dobCheck", "MRZ_DOB_CHECK_FAIL", "MRZ date-of-birth check digit mismatch"),
    ("expiryCheck", "MRZ_EXPIRY_CHECK_FAIL", "MRZ expiry check digit mismatch"),
    ("compositeCheck", "MRZ_COMPOSITE_CHECK_FAIL", "MRZ composite check digit mismatch"),
)


def validate_mrz(zone: Column) -> Column:
    """Validation of a zone's text: check digits of number, birth, expiry, and of all together.

    The first line is the first of 28 characters or more that starts with P, the second the one after it, else another
    with a digit; without both, the text run together is cut where "P<" stands. Short lines are filled up.
    """
    rows = F.filter(F.transform(F.split(zone, "\n", -1), _clean), lambda x: F.char_length(x) >= 28)

    def second(a: Column) -> Column:
        at = F.get(F.filter(F.sequence(F.lit(0), F.size(a)), lambda i: F.coalesce(F.get(a, i).rlike(r"\AP"), F.lit(False))), F.lit(0)).cast("int")
        other = F.get(F.filter(a, lambda x, i: (i != at) & x.rlike("[0-9]")), F.lit(0))
        flat = _clean(zone)
        p = F.instr(flat, F.lit("P<"))
        run = F.when((p > 0) & (F.char_length(flat) >= p - 1 + 2 * WIDTH), F.substring(flat, p + WIDTH, F.lit(WIDTH)))
        return F.substring(F.rpad(F.coalesce(F.when(at.isNotNull(), F.coalesce(F.get(a, at + 1), other)), run), WIDTH, "<"), 1, WIDTH)

    def judged(two: Column) -> Column:
        cut = lambda start, n: F.substring(two, start, n)
        ok = lambda part, at: F.coalesce(checks.mrz_check_digit(part).cast("string") == cut(at, 1), F.lit(False))
        passed = (ok(cut(1, 9), 10), ok(cut(14, 6), 20), ok(cut(22, 6), 28), ok(F.concat(cut(1, 10), cut(14, 7), cut(22, 22)), 44))
        given, present = F.coalesce(zone != "", F.lit(False)), two.isNotNull()
        reasons = compact(
            reason("MRZ_MISSING", "MRZ not present for checksum validation", "validation", ~given),
            reason("MRZ_PARSE_FAIL", "Could not parse MRZ lines for checksum validation", "validation", given & ~present),
            *[reason(code, text, "validation", present & ~good) for (_, code, text), good in zip(DIGIT_CHECKS, passed, strict=True)],
        )
        named = F.create_map(F.lit("present"), present, *[x for (name, _, _), good in zip(DIGIT_CHECKS, passed, strict=True) for x in (F.lit(name), present & good)])
        return let(reasons.cast(REASONS), lambda r: checks.validation(F.size(r) == 0, named, r, F.lit(None).cast("string")))

    return let(let(rows, second), judged)


def validate_passport(number: Column, birth: Column, issue: Column, expiry: Column, zone: Column, as_of: date) -> Column:
    """Number format, plausible birth, issue before expiry, birth before expiry, and the zone's digits where one is there; without a zone the number alone decides."""
    shaped = F.coalesce(F.regexp_replace(F.upper(number), "[^A-Z0-9]", "").rlike(r"\A[A-Z][0-9]{7}\z"), F.lit(False))
    born = birth.isNull() | checks.plausible_dob(birth, as_of)
    orders = [checks.date_order(issue, expiry, "issue before expiry"), checks.date_order(birth, expiry, "DOB before expiry")]
    real = lambda d: checks.parse_date(d).isNotNull()
    dated = (("dateOfIssue", "Date of issue is invalid", issue), ("dateOfExpiry", "Date of expiry is invalid", expiry))
    there = F.coalesce(zone != "", F.lit(False))

    def judged(m: Column) -> Column:
        found = F.filter(
            F.concat(
                F.array(
                    reason("PASSPORT_NUMBER_FORMAT", F.when(number.isNull(), "Passport number missing").otherwise("Passport number format invalid"), "validation", ~shaped),
                    reason("INVALID_DOB", "Date of birth is invalid or implausible", "validation", ~born),
                    *[F.when(~o["passed"], F.struct(o["code"].alias("code"), o["reason"].alias("message"), F.lit("validation").alias("stage"), F.lit(None).cast("int").alias("impact"))) for o in orders],
                    reason("MRZ_MISSING", "MRZ not found — checksum validation skipped as fail", "validation", ~there),
                ),
                F.when(there, m["reasons"]).otherwise(F.array().cast(REASONS)),
                F.array(*[reason("INVALID_DATE", text, "validation", d.isNotNull() & ~real(d)) for _, text, d in dated]),
            ),
            lambda r: r.isNotNull(),
        )
        passed = shaped & born & orders[0]["passed"] & orders[1]["passed"] & (~there | m["passed"])
        named = F.create_map(F.lit("passportNumberFormat"), shaped, F.lit("dateOfBirth"), born, F.lit("issueBeforeExpiry"), orders[0]["passed"], F.lit("dobBeforeExpiry"), orders[1]["passed"], F.lit("mrzChecksum"), there & m["passed"])
        zone_checks = F.when(there, F.transform_keys(m["checks"], lambda k, v: F.concat(F.lit("mrz_"), k))).otherwise(F.create_map().cast("map<string,boolean>"))
        more = F.map_filter(F.create_map(*[x for name, _, d in dated for x in (F.lit(name), F.when(d.isNotNull(), real(d)))]), lambda k, v: v.isNotNull())
        return checks.validation(passed, F.map_concat(named, zone_checks, more), found.cast(REASONS), F.lit(None).cast("string"))

    return let(validate_mrz(zone), judged)


def rebuild_mrz(surname: Column, given: Column, number: Column, country: Column, birth: Column, sex: Column, expiry: Column, nation: Column | None = None) -> Column:
    """A zone put together from fields, without check digits; it never passes validate_mrz. Null without a surname, a number or a country."""
    pad = lambda x, n: F.substring(F.rpad(x, n, "<"), 1, n)
    six = lambda d: F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(d, r"\d{2}/\d{2}/\d{4}", 0), r"(\d{2})/(\d{2})/\d{2}(\d{2})", "$3$2$1"), F.lit("")), F.lit("<<<<<<"))
    family = F.regexp_replace(F.upper(surname), "[^A-Z]", "")
    own = F.regexp_replace(trim(F.regexp_replace(F.upper(F.coalesce(given, F.lit(""))), r"[^A-Z\s]", "")), r"\s+", "<")
    one = F.concat(F.lit("P<"), pad(country, 3), family, F.lit("<<"), own)
    two = F.concat(pad(F.upper(number), 9), F.lit("<"), pad(F.coalesce(nation, country) if nation is not None else country, 3), six(birth), F.coalesce(F.when(sex.isin("M", "F"), sex), F.lit("<")), six(expiry))
    return F.when(surname.isNotNull() & number.isNotNull() & country.isNotNull(), F.concat(pad(one, WIDTH), F.lit("\n"), pad(two, WIDTH)))
