"""Passport records from the evidence of a page: machine-readable zone, labels and their neighbourhood, loose text; and number repair.

Every field is the first of its pieces of evidence that passes its guard. All of it are column expressions over one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.functions import entities, labels
from docaudit.functions.checks import mrz_check_digit
from docaudit.functions.labels import DAY
from docaudit.functions.mrz import mrz_lines, parse_mrz, rebuild_mrz, zone_text
from docaudit.functions.patterns import find, find_all, has, java, let, replace, squeeze, trim
from docaudit.sources.catalog import LABELS

# Letters read as digits; those of them that count in an overlap; those of the reading that takes A for 4.
MISREAD = (("A", "4"), ("S", "5"), ("O", "0"), ("Q", "0"), ("D", "0"), ("B", "8"), ("Z", "2"), ("G", "6"), ("I", "1"), ("L", "1"), ("T", "7"), ("E", "3"))
OVERLAP = (("A", "4"), ("S", "5"), ("O", "0"), ("T", "7"))
A_FOR_4 = (("A", "4"), ("S", "5"), ("O", "0"))
# What a candidate gets for its shape, its first letter, and each way in which the texts confirm it; the least score.
SHAPE, LETTER, EXACT, TRUSTED, DIGIT, A_READ, PER_DIGIT, MOST_DIGITS, FOUR_ALIKE, RUNS, LEAST = 40, 15, 200, 100, 80, 35, 2, 12, 30, 15, 45
NUMBER = r"\A[A-Z][0-9]{7}\z"
# Cities, those that stand for a place of issue, states, and countries of a compact type and country.
CITIES = (
    "TRIVANDRUM", "THIRUVANANTHAPURAM", "KOCHI", "COCHIN", "CHENNAI", "MUMBAI", "DELHI", "BANGALORE", "BENGALURU", "HYDERABAD",
    "KOLKATA", "AHMEDABAD", "PUNE", "JAIPUR", "LUCKNOW", "CHANDIGARH", "BHOPAL", "PATNA", "KOZHIKODE", "CALICUT",
)
ISSUE_CITIES = ("TRIVANDRUM", "THIRUVANANTHAPURAM", "KOCHI", "CHENNAI", "MUMBAI", "DELHI", "BANGALORE", "BENGALURU", "HYDERABAD", "KOLKATA")
STATES = (r"KERALA", r"TAMIL\s*NADU", r"KARNATAKA", r"MAHARASHTRA", r"DELHI", r"WEST\s*BENGAL", r"GUJARAT", r"RAJASTHAN", r"UTTAR\s*PRADESH", r"TELANGANA", r"ANDHRA\s*PRADESH")
COUNTRIES = ("IND", "USA", "GBR", "ARE", "CAN", "AUS")
# Words that are no name, no part of a surname, no given name, no part of a place.
NO_NAME = r"^(S|M|F|P|IND|NAME|SEX|TEA|LS|RE)$"
NO_SURNAME = r"^(FEY|ATH|IGA|NAME|THE|SIA|EE|PR|RE)$"
NO_GIVEN = r"^(DS|LS|WS|FP|CN|SIR)$"
NO_PLACE = r"\b(RL|EE|VO|OR|WEIF|ENCE|HRD)\b"
AUTHORITY = "MINISTRY OF EXTERNAL AFFAIRS"
# Patterns of single fields.
BIRTH, BIRTH_PLACE, ISSUE_PLACE = r"Date\s*of\s*Birth", r"Place\s*of\s*Birth", r"Place\s*of\s*I(?:ss|bs)ue"
NUMBER_BELOW_COUNTRY = r"\b[PO]\s+[A-Z]{3}\b\s*\n+\s*([A-Za-z0-9]{6,12})"
GIVEN_BELOW, GIVEN_BESIDE = r"Given\s*Name[^\n]*\n+\s*([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,4})", r"Given\s*Nam[^\n]{0,40}?\b([A-Z]{3,}(?:\s+[A-Z]{2,}){0,3})\b"
SEX_AFTER_DATE, SEX_AFTER, SEX_BEFORE, SEX_IN_ZONE = rf"{DAY}\s*([MF])\b", r"Sex[^\n]{0,60}?([MF])\b", r"\b([MF])\b[^\n]{0,30}Sex", r"\d{6}[0-9]?([MF])\d{6}"
INDIAN_TEXT, INDIAN_AUTHORITY = r"INDIAN|REPUBLIC\s+OF\s+INDIA", r"REPUBLIC\s+OF\s+INDIA|भारत\s*गणराज्य|INDIAN"

FIELDS = (
    "passportNumber", "passportType", "countryCode", "nationality", "surname", "givenName", "dateOfBirth", "placeOfBirth", "gender", "dateOfIssue", "dateOfExpiry", "placeOfIssue", "issuingAuthority", "personalNumber", "mrz",
)


# --- Number repair -----------------------------------------------------------------------------------------------------


def _digits(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Letters of pairs as digits; other letters stay."""
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def number_tokens(text: Column) -> Column:
    """Runs of a capital and 5 to 10 capitals and digits that hold a digit and do not start as a sex does; distinct, in order."""
    flat = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[^A-Z0-9\n]", "")
    return F.array_distinct(F.filter(F.regexp_extract_all(flat, F.lit("[A-Z][A-Z0-9]{5,10}"), F.lit(0)), lambda t: t.rlike("[0-9]") & ~t.rlike(r"\A[MF]")))


def readings(token: Column) -> Column:
    """Array of (number, a4): each way to read the token as a letter and seven digits, in the order of trust; a4 when an A became a 4.

    From each start (the token, its first ten characters, the token without trailing letters) letters that look like digits are
    digits and a letter that does not may be left out at the second and third place. Then the token's digits alone, cut to
    seven, and those with A, S and O alone read as digits. A start has one such reading, so a token has five at most.
    """
    usable = F.char_length(token).between(6, 12) & token.rlike(r"\A[A-Z]") & ~token.rlike(r"[MF][0-9]{5}") & ~token.rlike(r"\A[MF]")
    plain = "".join(sorted(set("ABCDEFGHIJKLMNOPQRSTUVWXYZ") - {a for a, _ in MISREAD}))

    def walked(start: Column) -> Column:
        near = F.regexp_replace(F.substring(start, 2, 2), f"[{plain}]", "")
        return F.concat(F.substring(start, 1, 1), _digits(F.concat(near, F.substring(start, 4, 20)), MISREAD))

    def cut(pairs: tuple[tuple[str, str], ...]) -> Column:
        rest = F.regexp_replace(_digits(F.substring(token, 2, 20), pairs), "[^0-9]", "")
        return F.when(F.char_length(rest) >= 7, F.concat(F.substring(token, 1, 1), F.substring(rest, 1, 7)))

    starts = (token, F.substring(token, 1, 10), F.regexp_replace(token, r"(?<=[0-9])[A-Z]+\z", ""))
    holds_a, row = F.contains(token, F.lit("A")), lambda n, a4: F.struct(n.alias("number"), a4.alias("a4"))
    ways = [F.when(usable, row(n, holds_a & F.contains(n, F.lit("4")))) for n in (*map(walked, starts), cut(MISREAD))]
    return F.filter(F.array(*ways, F.when(holds_a, row(cut(A_FOR_4), F.lit(True)))), lambda r: F.coalesce(r["number"].rlike(NUMBER), F.lit(False)))


def trusted_digit(text: Column) -> Column:
    """(number, digit) of a zone's second line: before IND, else before another country, else by place in a line of 44 characters."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    long = F.filter(F.transform(F.split(upper, "\n", -1), lambda x: F.regexp_replace(x, "[^A-Z0-9<]", "")), lambda x: (F.char_length(x) >= 44) & x.rlike(r"\A[A-Z][A-Z0-9<]{8}"))
    shaped = F.get(F.filter(long, lambda x: F.regexp_replace(F.substring(x, 1, 9), "<", "").rlike(NUMBER) & F.substring(x, 10, 1).rlike("[0-9]")), F.lit(0))
    forms = [r"\b([A-Z]\d{7})<?([0-9])IND", r"\b([A-Z]\d{7})<([0-9])[A-Z]{3}"]
    of = lambda k, cut: F.coalesce(*[find(upper, p, k, False) for p in forms], cut)
    return F.struct(of(1, F.regexp_replace(F.substring(shaped, 1, 9), "<", "")).alias("number"), of(2, F.substring(shaped, 10, 1)).alias("digit"))


def best_number(texts: Column) -> Column:
    """(number, score, exact) of the likeliest passport number of an array of texts; the number is null below LEAST points.

    Candidates are the readings of all tokens, the zone's number and the one with a check digit. Points for digits that
    stand at the same place in other tokens come from a count of each digit at each place, so the work is linear in the tokens.
    """
    text = F.array_join(F.filter(texts, lambda x: x.isNotNull() & (x != "")), "\n")
    tokens = F.array_distinct(F.flatten(F.transform(texts, number_tokens)))

    def pick(s: Column) -> Column:
        said, zone, tokens = s["said"], s["zone"], s["tokens"]
        exact = F.array_compact(F.concat(F.filter(tokens, lambda t: t.rlike(NUMBER)), F.array(said["number"])))
        read = F.flatten(F.transform(tokens, readings))
        a4 = F.transform(F.filter(read, lambda r: r["a4"]), lambda r: r["number"])
        every = F.array_distinct(F.array_compact(F.concat(F.filter(tokens, lambda t: t.rlike(NUMBER)), F.transform(read, lambda r: r["number"]), F.array(said["number"], F.when(zone.rlike(NUMBER), zone)))))
        rows = F.transform(tokens, lambda t: F.regexp_replace(_digits(F.substring(t, 2, 20), OVERLAP), "[A-Z]", ""))
        held = let(rows, lambda d: F.transform(F.sequence(F.lit(0), F.lit(69)), lambda k: F.size(F.filter(d, lambda x: F.substring(x, F.floor(k / 10).cast("int") + 1, F.lit(1)) == (k % 10).cast("string")))))

        def points(c: Column, counts: Column) -> Column:
            when = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
            overlap = F.aggregate(F.sequence(F.lit(0), F.lit(6)), F.lit(0), lambda a, i: a + F.get(counts, i * 10 + F.substring(c, i + 2, F.lit(1)).cast("int")))
            good = SHAPE + when(c.rlike(r"\A[UZVSJT]"), LETTER) + when(F.array_contains(exact, c), EXACT) + when(c == said["number"], TRUSTED) + when(mrz_check_digit(c).cast("string") == said["digit"], DIGIT)
            good = good + when(F.array_contains(a4, c), A_READ) + F.least(overlap, F.lit(MOST_DIGITS)) * PER_DIGIT
            return good - when(c.rlike(r"(.)\1{3,}"), FOUR_ALIKE) - when(c.rlike("5555|0000|4444|55544"), RUNS)

        scored = let(held, lambda h: F.transform(every, lambda c, i: F.struct(points(c, h).alias("score"), (-i).alias("k"), c.alias("c"))))
        return let(F.array_max(scored), lambda b: F.struct(F.when(b["score"] >= LEAST, b["c"]).alias("number"), b["score"].alias("score"), F.coalesce(F.array_contains(exact, b["c"]), F.lit(False)).alias("exact")))

    return let(F.struct(tokens.alias("tokens"), trusted_digit(text).alias("said"), parse_mrz(mrz_lines(text))["number"].alias("zone")), pick)


# --- Parts of the page -------------------------------------------------------------------------------------------------


def type_country(text: Column) -> Column:
    """(type, country): the letters after "Type", else a compact pair of a known country."""
    near, pair = r"\bType\b[\s\S]{0,40}?\b([PO])\b[\s\S]{0,20}?\b([A-Z]{3})\b", r"\b([PO])\s+([A-Z]{3})\b"
    # Of compact pairs only the first of the text is looked at.
    known = find(text, pair, 2, False).isin(*COUNTRIES)
    pick = lambda k: F.upper(F.coalesce(find(text, near, k), F.when(known, find(text, pair, k, False))))
    return F.struct(pick(1).alias("type"), pick(2).alias("country"))


def gazetteer_place(text: Column) -> Column:
    """The first known city, with the state that follows it."""
    pattern = rf"\b({'|'.join(CITIES)})(?:\s*[,/]?\s*({'|'.join(STATES)}))?\b"
    city, state = F.upper(find(text, pattern, 1)), F.upper(replace(find(text, pattern, 2), r"\s+", " "))
    return F.when(city.isNotNull(), F.concat_ws(", ", city, state))


def personal_number(text: Column, number: Column) -> Column:
    """Digits after a zone's sex and expiry, in the zone of `number` where it is known, else anywhere."""
    flat = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9<]", "")
    anchored = F.call_function("regexp_extract", flat, F.concat(number, F.lit(r"<\d[A-Z]{3}\d{6}\d?[MF<]\d{6}\d([0-9]{6,14})")), F.lit(1))
    return F.coalesce(F.nullif(anchored, F.lit("")), F.nullif(F.regexp_extract(flat, r"[MF]\d{6}\d([0-9]{9,14})", 1), F.lit("")))


def joined_letters(text: Column) -> Column:
    """Runs of three or more single letters without the spaces between them."""
    return replace(text, r"(?<=\b[A-Za-z])\s+(?=[A-Za-z]\s+[A-Za-z]\b)|(?<=\b[A-Za-z]\s{1,9}[A-Za-z])\s+(?=[A-Za-z]\b)", "")


def plain_name(text: Column) -> Column:
    """Letters and single spaces, in capitals."""
    return F.upper(squeeze(F.regexp_replace(joined_letters(text), r"[^A-Za-z\s]", " ")))


def preferred_name(*names: Column) -> Column:
    """Of the names that are any, the one with the most points for parts and length, the earlier of equals."""
    cleaned = F.transform(F.array(*names), lambda n: plain_name(n))
    real = F.filter(cleaned, lambda n: F.coalesce((F.char_length(n) >= 2) & ~has(n, NO_NAME, False), F.lit(False)))
    return F.array_max(F.transform(real, lambda n, k: F.struct((10 * F.size(F.split(n, " ")) + F.char_length(n)).alias("p"), (-k).alias("k"), n.alias("n"))))["n"]


def clean_place(text: Column) -> Column:
    """A place in capitals, at most 80 characters, without what stands before its first letter and without stray words; null under three."""
    s = squeeze(replace(trim(replace(squeeze(replace(text, r"^[:\-\s]+", "")), r"[|,]+$", "")), r"^[^A-Za-z]+", ""))
    s = squeeze(replace(s, NO_PLACE, " ", True))
    return F.when(F.char_length(s) >= 3, F.upper(F.substring(s, 1, 80)))


def _shaped(value: Column, pattern: str) -> Column:
    """value where it fits the pattern."""
    return F.when(value.rlike(pattern), value)


def _year_first(date: Column) -> Column:
    return F.array_join(F.reverse(F.split(date, "/")), "")


def _surname(zone: Column, labelled: Column) -> Column:
    """The zone's, or of it and the label's the fuller one where it is short or known to be garbled; the first part that is one."""
    sound = (F.char_length(zone) >= 4) & ~has(zone, "SIA|RE A N")
    name = joined_letters(F.coalesce(F.when(sound, zone), preferred_name(labelled, zone)))
    parts = lambda n: F.filter(F.split(n, r"\s+"), lambda p: (F.char_length(p) >= 3) & ~has(p, NO_SURNAME))
    return let(name, lambda n: F.upper(F.coalesce(F.get(parts(n), F.lit(0)), n)))


def _sex(t: Column, zone: Column, labelled: Column) -> Column:
    """MALE or FEMALE of the zone, the label or a word of the text, the first of which counts alone; else of letters near dates and "Sex"."""
    said = F.coalesce(zone, labelled, labels.gender(t))
    said = F.upper(_shaped(trim(said), r"(?i)\A(M|F|MALE|FEMALE)\z"))
    said = F.coalesce(said, *[F.upper(find(t, p, 1)) for p in (SEX_AFTER_DATE, SEX_AFTER, SEX_BEFORE)], find(t, SEX_IN_ZONE, 1, False))
    return F.when(F.startswith(said, F.lit("M")), "MALE").when(F.startswith(said, F.lit("F")), "FEMALE")


def _dates(t: Column, birth: Column, expiry: Column) -> Column:
    """(issue, expiry): of labels and pairs, then of what dates are left in order; never the birth date, and swapped where they are the wrong way round."""
    pair, names = labels.issue_expiry(t), LABELS["PASSPORT"]
    issue = F.coalesce(labels.date_near(t, names["dateOfIssue"]), labels.labeled_date(t, names["dateOfIssue"]), pair["issue"])
    expiry = F.coalesce(expiry, labels.date_near(t, names["dateOfExpiry"]), labels.labeled_date(t, names["dateOfExpiry"]), pair["expiry"])
    in_zone = find(t, r"\d{6}[0-9]?[MF<](\d{6})", 1, False)
    year = F.substring(in_zone, 1, 2).cast("int")
    long = F.concat_ws("/", F.substring(in_zone, 5, 2), F.substring(in_zone, 3, 2), (year + F.when(year >= 50, 1900).otherwise(2000)).cast("string"))
    expiry = F.coalesce(expiry, F.when(in_zone.isNotNull(), entities.normalize_date(long)))

    def rest(s: Column) -> Column:
        loose = F.transform(F.array_sort(F.transform(F.filter(entities.dates(t), lambda d: ~d.eqNullSafe(birth)), lambda d: F.struct(_year_first(d).alias("o"), d.alias("d")))), lambda r: r["d"])
        lacking = s["issue"].isNull() | s["expiry"].isNull()

        def filled(r: Column) -> Column:
            many = lacking & (F.size(r) >= 2)
            a = F.when(many, F.coalesce(s["issue"], F.get(r, F.lit(0)))).otherwise(s["issue"])
            b = F.when(many, F.coalesce(s["expiry"], F.try_element_at(r, F.lit(-1)))).when(F.size(r) == 1, F.coalesce(s["expiry"], F.get(r, F.lit(0)))).otherwise(s["expiry"])
            late = many & (_year_first(a) > _year_first(b))
            return F.struct(F.when(late, b).otherwise(a).alias("issue"), F.when(late, a).otherwise(b).alias("expiry"))

        return let(loose, filled)

    own = lambda d: F.when(~d.eqNullSafe(birth), d)
    return let(let(F.struct(issue.alias("issue"), expiry.alias("expiry")), rest), lambda s: F.struct(own(s["issue"]).alias("issue"), own(s["expiry"]).alias("expiry")))


def _issue_place(t: Column, labelled: Column, birth_place: Column) -> Column:
    """Below its label, else the label's; a known city near the label goes first; else the second city of the page, else that of birth."""
    own = clean_place(F.coalesce(find(t, rf"{ISSUE_PLACE}[^\n]*\n+\s*[:\-]?\s*([A-Z][A-Za-z ,.]{{2,40}})", 1), labelled))
    known = F.regexp_replace(gazetteer_place(find(t, rf"{ISSUE_PLACE}[\s\S]{{0,80}}")), ",.*", "")
    second = F.upper(F.get(find_all(t, rf"\b({'|'.join(ISSUE_CITIES)})\b", 1, True), F.lit(1)))
    return F.coalesce(known, let(own, lambda p: F.when(F.char_length(p) >= 4, p).otherwise(F.coalesce(second, trim(F.regexp_replace(birth_place, ",.*", "")), p))))


def record(text: Column, number_texts: Column | None = None) -> list[Callable]:
    """Steps that add the columns of a passport record to a DataFrame with the text in a column `_t`; a later step reads what earlier ones made.

    number_texts: an array of further readings of the number's place on the page, or null; the likeliest number of them and
    the text then goes before the zone's.
    """
    names = LABELS["PASSPORT"]
    said = lambda field, most=120, clean=squeeze: labels.labeled_value(text, names[field], most, clean=clean)
    z, c = (lambda field: F.col("_zone")[field]), F.col

    def zone(df):
        return df.withColumn("_zone", parse_mrz(mrz_lines(text))).withColumn("_kind", type_country(text))

    def identity(df):
        letters = lambda x, n: F.nullif(F.upper(F.substring(F.regexp_replace(x, "[^A-Za-z]", ""), 1, n)), F.lit(""))
        printed = F.coalesce(said("passportNumber", 20), find(text, NUMBER_BELOW_COUNTRY, 1, False), F.get(entities.passport_numbers(text), F.lit(0)))
        number = F.coalesce(_shaped(z("number"), NUMBER), _shaped(F.regexp_replace(F.upper(printed), "[^A-Z0-9]", ""), NUMBER))
        return df.withColumns(
            {
                "passportNumber": number if number_texts is None else F.coalesce(F.when(number_texts.isNotNull(), best_number(F.concat(number_texts, F.array(text)))["number"]), number),
                "passportType": letters(F.coalesce(z("type"), c("_kind.type"), said("passportType", 4)), 2),
                "countryCode": letters(F.coalesce(_shaped(z("country"), r"\A[A-Z]{3}\z"), c("_kind.country"), said("countryCode", 10)), 3),
                "surname": _surname(F.when(F.char_length(z("surname")) >= 3, z("surname")), said("surname", 40, plain_name)),
                "_below": find(text, GIVEN_BELOW, 1),
                "dateOfBirth": F.coalesce(
                    z("birth"), labels.labeled_date(text, names["dateOfBirth"]), entities.normalize_date(find(text, rf"{BIRTH}[^\n]*\n?\s*({DAY})", 1)), entities.normalize_date(find(text, rf"{BIRTH}[\s\S]{{0,80}}?({DAY})", 1))
                ),
                "gender": _sex(text, F.when(z("sex").isin("M", "F"), z("sex")), said("gender", 12)),
            }
        )

    def derived(df):
        given = preferred_name(c("_below"), find(text, GIVEN_BESIDE, 1), F.when(F.char_length(z("given")) >= 3, z("given")), said("givenName", 60, plain_name))
        nation = F.when((z("nationality") != "ND0") & z("nationality").rlike(r"\A[A-Z]{3,}\z"), z("nationality"))
        born_at = clean_place(F.coalesce(said("placeOfBirth", 80), find(text, rf"{BIRTH_PLACE}[^\n]*\n+\s*[:\-]?\s*([^\n]{{3,60}})", 1)))
        anywhere = let(gazetteer_place(text), lambda p: F.when(F.contains(p, F.lit(",")), p))
        near_birth = gazetteer_place(F.coalesce(find(text, rf"{BIRTH_PLACE}[\s\S]{{0,100}}"), text))
        return df.withColumns(
            {
                "givenName": let(given, lambda g: F.when(has(g, NO_GIVEN, False), F.coalesce(preferred_name(c("_below")), g)).otherwise(g)),
                "nationality": let(F.when(has(text, "INDIAN") | F.coalesce(c("countryCode") == "IND", F.lit(False)), "INDIAN").otherwise(F.coalesce(nation, said("nationality", 40))), lambda n: F.when(n == "IND", "INDIAN").otherwise(n)),
                "placeOfBirth": F.coalesce(near_birth, let(born_at, lambda p: F.when(F.char_length(p) >= 4, p).otherwise(F.coalesce(anywhere, p)))),
                "_dates": _dates(text, c("dateOfBirth"), z("expiry")),
                "issuingAuthority": F.coalesce(said("issuingAuthority", 80), F.when(F.coalesce(c("countryCode") == "IND", F.lit(False)) | has(text, INDIAN_AUTHORITY), AUTHORITY)),
                "personalNumber": F.coalesce(z("personal"), personal_number(text, c("passportNumber")), said("personalNumber")),
            }
        )

    def completed(df):
        indian = F.coalesce(c("countryCode") == "IND", F.lit(False)) | has(text, INDIAN_TEXT)
        zone_lines = F.coalesce(z("lines"), zone_text(mrz_lines(text)))
        starts = F.coalesce(F.exists(F.split(zone_lines, "\n"), lambda x: F.startswith(x, F.coalesce(c("passportNumber"), F.lit("X")))), F.lit(False))
        out = df.withColumns(
            {
                "dateOfExpiry": c("_dates.expiry"),
                "dateOfIssue": F.coalesce(c("_dates.issue"), F.when(indian, labels.infer_issue(c("_dates.expiry")))),
                "placeOfIssue": _issue_place(text, said("placeOfIssue", 60), c("placeOfBirth")),
            }
        )
        made = rebuild_mrz(c("surname"), c("givenName"), c("passportNumber"), c("countryCode"), c("dateOfBirth"), F.substring("gender", 1, 1), c("dateOfExpiry"), F.when(c("nationality") == "INDIAN", "IND").otherwise(c("countryCode")))
        return out.withColumn("mrz", F.when(starts, zone_lines).otherwise(F.coalesce(made, zone_lines))).drop("_zone", "_kind", "_below", "_dates")

    return [zone, identity, derived, completed]
