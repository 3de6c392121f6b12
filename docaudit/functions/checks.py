"""Checks of identifiers and dates, with reason codes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.functions.patterns import REASONS, compact, empty_strings, find_all, java, let, reason, replace, trim

# Tables of the Verhoeff scheme.
VERHOEFF_D = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9),
    (1, 2, 3, 4, 0, 6, 7, 8, 9, 5),
    (2, 3, 4, 0, 1, 7, 8, 9, 5, 6),
    (3, 4, 0, 1, 2, 8, 9, 5, 6, 7),
    (4, 0, 1, 2, 3, 9, 5, 6, 7, 8),
    (5, 9, 8, 7, 6, 0, 4, 3, 2, 1),
    (6, 5, 9, 8, 7, 1, 0, 4, 3, 2),
    (7, 6, 5, 9, 8, 2, 1, 0, 4, 3),
    (8, 7, 6, 5, 9, 3, 2, 1, 0, 4),
    (9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
)
VERHOEFF_P = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9),
    (1, 5, 7, 6, 2, 8, 3, 0, 9, 4),
    (5, 8, 0, 3, 7, 9, 6, 1, 4, 2),
    (8, 9, 1, 6, 0, 4, 3, 5, 2, 7),
    (9, 4, 5, 3, 1, 2, 6, 8, 7, 0),
    (4, 2, 8, 6, 5, 7, 3, 9, 0, 1),
    (2, 7, 9, 3, 8, 0, 6, 4, 1, 5),
    (7, 0, 4, 6, 9, 1, 3, 2, 5, 8),
)
VERHOEFF_INV = (0, 4, 3, 2, 1, 5, 6, 7, 8, 9)
# Shapes of numbers; where twelve digits are looked for, in this order; account numbers as they are printed, spaced, misread, and with zeros for letters.
PAN = r"\A[A-Z]{5}[0-9]{4}[A-Z]\z"
CIN = r"\A[UL][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}\z"
TWELVE_DIGITS = (r"\b\d{4}[\s\-.]?\d{4}[\s\-.]?\d{4}\b", r"\d[\d\s\-.]{10,20}\d", r"\d{12}")
PAN_PRINTED, PAN_SPACED = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", r"\b[A-Z]{5}[\s\-.]*[0-9OISB]{4}[\s\-.]*[A-Z]\b"
#: What each of them is at least.
PAN_ANY = r"[A-Z0]{5}[\s\-.]*[0-9OISB]{4}[\s\-.]*[A-Z]"
PAN_MISREAD, PAN_ZEROS = r"\b[A-Z]{5}[0-9OISB]{4}[A-Z]\b", r"\b[A-Z0]{5}[0-9]{4}[A-Z]\b"
MRZ_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _verhoeff(digits: Column, shift: int) -> Column:
    d = F.array(*[F.lit(x) for row in VERHOEFF_D for x in row])
    p = F.array(*[F.lit(x) for row in VERHOEFF_P for x in row])
    n = F.char_length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    fold = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda c, i: F.get(d, 10 * c + F.get(p, 10 * ((i + shift) % 8) + digit(i))))
    return F.when(digits.rlike(r"\A[0-9]+\z"), fold)


def verhoeff_ok(digits: Column) -> Column:
    return F.coalesce(_verhoeff(digits, 0) == 0, F.lit(False))


def verhoeff_digit(digits: Column) -> Column:
    """The digit that makes `digits` valid when it is put after them."""
    return F.get(F.array(*[F.lit(x) for x in VERHOEFF_INV]), _verhoeff(digits, 1))


def aadhaar_candidates(text: Column) -> Column:
    """Digits of 4-4-4 groups, then of loose runs with 12 of them, then each 12 digits of longer runs; distinct."""
    only = lambda a: F.filter(F.transform(a, lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda x: F.char_length(x) == 12)
    # Groups of four and twelve digits in a row are loose runs as well.
    return F.when(text.rlike(java(TWELVE_DIGITS[1])), F.array_distinct(F.concat(*[only(find_all(text, p)) for p in TWELVE_DIGITS]))).otherwise(empty_strings())


def validation(passed: Column, checks: Column, reasons: Column, normalized: Column) -> Column:
    return F.struct(passed.alias("passed"), checks.alias("checks"), reasons.cast(REASONS).alias("reasons"), normalized.alias("normalized"))


def aadhaar(number: Column) -> Column:
    """Validation of a number: twelve digits, the first neither 0 nor 1, and the Verhoeff residue."""
    n = F.coalesce(replace(number, r"\s", ""), F.lit(""))
    shaped = n.rlike(r"\A[0-9]{12}\z")
    first = n.rlike(r"\A[^01]")
    good = verhoeff_ok(n)
    message = F.when(~shaped, "Aadhaar must be exactly 12 numeric digits").otherwise("Aadhaar cannot start with 0 or 1")
    reasons = compact(
        reason("AADHAAR_MISSING", "Aadhaar number missing", "validation", n == ""),
        reason("AADHAAR_INVALID", message, "validation", (n != "") & ~(shaped & first)),
        reason("CHECKSUM_MISMATCH", "Verhoeff checksum validation failed", "validation", shaped & first & ~good),
    )
    ok = shaped & first & good
    return validation(ok, F.create_map(F.lit("verhoeff"), ok), reasons, F.when(ok, n))


def normalize_pan(number: Column) -> Column:
    """Upper case without spaces; in ten characters, letters and digits that look alike are repaired by their place."""
    n = F.upper(replace(number, r"\s", ""))
    letters = lambda x: F.translate(x, "01", "OI")
    repaired = F.concat(letters(F.substring(n, 1, 5)), F.translate(F.substring(n, 6, 4), "OISB", "0158"), letters(F.substring(n, 10, 1)))
    return F.when(F.char_length(n) == 10, repaired).otherwise(n)


def pan(number: Column) -> Column:
    n = F.coalesce(normalize_pan(number), F.lit(""))
    ok = n.rlike(PAN)
    message = F.when(F.char_length(n) != 10, "PAN must be exactly 10 characters").otherwise("PAN must match pattern AAAAA9999A")
    reasons = compact(reason("PAN_MISSING", "PAN number missing", "validation", n == ""), reason("PAN_FORMAT_INVALID", message, "validation", (n != "") & ~ok))
    return validation(ok, F.create_map(F.lit("panFormat"), ok), reasons, F.when(ok, n))


def pan_candidates(text: Column) -> Column:
    """Exact numbers, spaced ones, those with digits read as letters (S is 5 or 8), those with a zero for an O; distinct."""
    u = F.upper(text)
    valid = lambda a: F.filter(a, lambda x: x.rlike(PAN))
    exact = find_all(u, PAN_PRINTED)
    # Exact ones are found by the other shapes as well, and are what they would be made into.
    others = lambda pattern: F.filter(find_all(u, pattern), lambda x: ~x.rlike(PAN))
    spaced = F.transform(others(PAN_SPACED), lambda x: normalize_pan(replace(x, r"[\s\-.]", "")))
    variants = F.flatten(
        F.transform(
            others(PAN_MISREAD),
            lambda x: F.concat(
                F.array(normalize_pan(x)),
                F.array_compact(F.array(*[F.when(F.substring(x, k, 1) == "S", normalize_pan(F.concat(F.substring(x, 1, k - 1), F.lit("8"), F.substring(x, k + 1, 10)))) for k in range(6, 10)])),
            ),
        )
    )
    zero = F.transform(others(PAN_ZEROS), normalize_pan)
    return F.when(u.rlike(java(PAN_ANY)), F.array_distinct(F.concat(exact, valid(spaced), valid(variants), valid(zero)))).otherwise(empty_strings())


def normalize_cin(number: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(number, F.lit(""))), "[^A-Z0-9]", "")


def cin(number: Column, as_of: date) -> Column:
    """Validation of a corporate number: length, format, listing letter, year from 1850 to the one after as_of's."""

    def judged(n: Column) -> Column:
        shaped = n.rlike(CIN)
        year = F.when(shaped, F.substring(n, 9, 4).cast("int"))
        checks = {
            "length": (F.char_length(n) == 21, "CIN_LENGTH_INVALID", F.concat(F.lit("CIN length "), F.char_length(n).cast("string"), F.lit(" (expected 21)"))),
            "format": (shaped, "CIN_FORMAT_INVALID", F.lit("CIN format invalid")),
            "listingType": (n.rlike(r"\A[UL]"), "CIN_LISTING_INVALID", F.lit("CIN must start with U (unlisted) or L (listed)")),
            "incorporationYear": (F.coalesce(year.between(1850, as_of.year + 1), F.lit(False)), "CIN_YEAR_INVALID", F.concat(F.lit("Implausible incorporation year in CIN ("), F.coalesce(year.cast("string"), F.lit("null")), F.lit(")"))),
        }
        present = n != ""
        reasons = compact(reason("CIN_MISSING", "CIN number missing", "validation", ~present), *[reason(code, text, "validation", present & ~ok) for ok, code, text in checks.values()])
        missing = F.create_map(F.lit("present"), F.lit(False), F.lit("format"), F.lit(False), F.lit("length"), F.lit(False))
        named = F.create_map(*[x for name, (ok, _, _) in checks.items() for x in (F.lit(name), ok)])
        return validation(F.size(reasons) == 0, F.when(present, named).otherwise(missing), reasons, F.when(shaped, n))

    return let(normalize_cin(number), judged)


def mrz_check_digit(field: Column) -> Column:
    """Weights 7, 3, 1; A is 10; fillers are 0, and other characters count nothing but take their weight."""
    value = lambda c: F.greatest(F.instr(F.lit(MRZ_ALPHABET), c) - 1, F.lit(0))
    weights = F.array(F.lit(7), F.lit(3), F.lit(1))
    chars = F.filter(F.split(F.upper(field), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, lambda c, i: value(c) * F.get(weights, i % 3)), F.lit(0), lambda a, x: a + x) % 10


def parse_date(text: Column) -> Column:
    """A date of day/month/year or year-month-day with separators / - or ., of month/day/year where only that is one, or of day, month name and year."""
    t = F.regexp_replace(trim(text), "[-.]", "/")
    forms = ((r"\A\d{1,2}/\d{1,2}/\d{4}\z", "d/M/yyyy"), (r"\A\d{4}/\d{1,2}/\d{1,2}\z", "yyyy/M/d"), (r"\A\d{1,2}/\d{1,2}/\d{4}\z", "M/d/yyyy"), (r"\A\d{1,2} [A-Za-z]{3} \d{4}\z", "d MMM yyyy"))
    return F.coalesce(*[F.when(t.rlike(p), F.try_to_date(t, f)) for p, f in forms])


def date_order(earlier: Column, later: Column, name: str, allow_equal: bool = False) -> Column:
    """(passed, code, reason, skipped) of two strings; skipped where either is missing."""
    a, b = parse_date(earlier), parse_date(later)
    missing = earlier.isNull() | (earlier == "") | later.isNull() | (later == "")
    bad = a.isNull() | b.isNull()
    ok = (a <= b) if allow_equal else (a < b)
    code = F.when(missing, F.lit(None)).when(bad, "INVALID_DATE").when(~ok, "DATE_ORDER_INVALID")
    text = F.when(code == "INVALID_DATE", f"Invalid date(s) for {name}").when(code == "DATE_ORDER_INVALID", f"{name}: expected earlier date before later date")
    return F.struct(F.lit(name).alias("name"), code.isNull().alias("passed"), code.alias("code"), text.alias("reason"), missing.alias("skipped"))


def plausible_dob(text: Column, as_of: date, max_age: int = 120) -> Column:
    age = F.datediff(F.lit(as_of), parse_date(text)) / 365.25
    return F.coalesce((age >= 0) & (age <= max_age), F.lit(False))


def letters_only(pattern: str) -> str:
    return java(pattern, True)
