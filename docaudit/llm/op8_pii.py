"""Personal data: format-preserving Feistel pseudonyms of validated numbers and dates, and keyed pseudonyms of addresses and secrets.

A number is taken apart into its two halves, and each round adds to one half a keyed hash of the other, modulo the number
of values of that half. This permutes the values of a format, needs no table, and gives equal values equal pseudonyms in
every document. Only values that pass their format's check (checksum, ranges, calendar) are replaced; checksums, ranges and
the calendar hold for the pseudonyms as well, but for the ranges of social security numbers. Where a match of a format of
no fixed length fails its check, the text is read again with the longest valid cut at each place in the format's stead.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import fresh, keeping, let, read

# Formats that are looked for, tried in this order at each place.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SECRET = r"(?:AKIA|ASIA)[A-Z0-9]{16}\b|gh[pousr]_[A-Za-z0-9]{36}\b|(?i:password|passwd|secret|token|api_?key)\s*[=:]\s*[\"']?[A-Za-z0-9+/_.-]{8,}[\"']?"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)"
DATE = r"\d{4}-\d{2}-\d{2}\b|\d{2}[/.-]\d{2}[/.-]\d{4}\b"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}\b|\(\d{3}\) ?\d{3}-\d{4}\b|\d{3}-\d{3}-\d{4}\b"
SSN = r"\d{3}-\d{2}-\d{4}\b"
CARD = r"\d(?:[ -]?\d){12,18}\b"
#: Days from 1900-01-01 to 2100-01-01, 150 times 487 of them.
FIRST_DAY, DAYS = "1900-01-01", (150, 487)
KINDS = ("email", "secret", "iban", "ipv4", "date", "phone", "ssn", "card")
ROUNDS = 8
#: What every format has: a digit, an @, a word that names a secret, or the start of a token.
SIGN = r"[0-9@]|(?i:password|passwd|secret|token|key)|AKIA|ASIA|gh[pousr]_"
#: Of the registered query alone.
QUERY_KEY = "test key of the registered query"

_FORMATS = dict(zip(KINDS, (EMAIL, SECRET, IBAN, IPV4, DATE, PHONE, SSN, CARD), strict=True))
#: Formats whose longest match can take in what follows the value.
OPEN = ("iban", "phone", "card")
_STARTS = r"(?<![A-Za-z0-9._%+@-])"
ANY = _STARTS + "(?:" + "|".join(f"(?:{p})" for p in _FORMATS.values()) + ")"


def _keyed(key: str, *parts: Column) -> Column:
    """A number below 2**60 from a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts], F.lit(key)), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, left: Column, right: Column, key: str, tweak: str) -> Column:
    """A permutation of 0 .. left * right - 1, chosen by key and tweak; value, left and right are longs."""
    start = F.struct(F.floor(value / right).cast("long").alias("l"), (value % right).alias("r"))
    if_odd = lambda s, k: F.struct(((s["l"] + _keyed(key, F.lit(tweak), k, s["r"])) % left).alias("l"), s["r"].alias("r"))
    if_even = lambda s, k: F.struct(s["l"].alias("l"), ((s["r"] + _keyed(key, F.lit(tweak), k, s["l"])) % right).alias("r"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, k: F.when(k % 2 == 1, if_odd(s, k)).otherwise(if_even(s, k)))
    return let(done, lambda s: s["l"] * right + s["r"])


def permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """A string of 1 to 18 digits, permuted among the strings of its length."""
    n = F.char_length(digits)
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    half = F.floor(n / 2).cast("int")
    return F.lpad(feistel(digits.cast("long"), power(half), power(n - half), key, tweak).cast("string"), n, "0")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(value: Column, digits: Column) -> Column:
    """value with its digits replaced in order by those of `digits`."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["s"], F.substring(digits, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    return F.aggregate(F.split(value, ""), start, step, lambda a: a["s"])


def luhn_sum(digits: Column, double_last: bool) -> Column:
    at = F.sequence(F.lit(1), F.char_length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = (F.char_length(digits) - i) % 2 == (0 if double_last else 1)
        return total + F.when(doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(at, F.lit(0), add)


def luhn_ok(digits: Column) -> Column:
    return luhn_sum(digits, False) % 10 == 0


def _card(value: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        return let(permuted_digits(F.substring(d, F.lit(1), F.char_length(d) - 1), key, "card"), lambda body: F.concat(body, ((10 - luhn_sum(body, True) % 10) % 10).cast("string")))

    return let(_digits(value), lambda d: F.when(luhn_ok(d), refill(value, new(d))))


def _phone(value: Column, key: str) -> Column:
    """The country code stays."""
    cut = F.char_length(F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0))
    rest = F.substring(value, cut + 1, F.char_length(value))
    new = let(_digits(rest), lambda d: F.when(F.char_length(d).between(7, 15), permuted_digits(d, key, "phone")))
    return let(new, lambda d: F.concat(F.substring(value, F.lit(1), cut), refill(rest, d)))


def _ssn(value: Column, key: str) -> Column:
    ok = ~value.rlike(r"^(?:000|666|9\d\d)|-00-|-0000$")
    return F.when(ok, refill(value, permuted_digits(_digits(value), key, "ssn")))


def _ipv4(value: Column, key: str) -> Column:
    def new(p: Column) -> Column:
        n = F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
        half = F.lit(65536).cast("long")
        return let(feistel(n, half, half, key, "ipv4"), lambda v: F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)]))

    return let(F.split(value, r"\."), lambda p: F.when(~F.exists(p, lambda x: x.cast("int") > 255), new(p)))


def _date(value: Column, key: str) -> Column:
    """Year first, or day first, or month first where the day can't be a month; the order and the separators stay."""
    orders = ("yyyyMMdd", "ddMMyyyy", "MMddyyyy")
    d = _digits(value)
    parsed = [F.try_to_date(d, o) for o in orders]
    iso = value.rlike(r"^\d{4}-")
    which = F.when(iso & parsed[0].isNotNull(), 0).when(~iso & parsed[1].isNotNull(), 1).when(~iso & parsed[2].isNotNull(), 2)

    def new(w: Column) -> Column:
        day = F.datediff(F.coalesce(*[F.when(w == k, p) for k, p in enumerate(parsed)]), F.lit(FIRST_DAY).cast("date")).cast("long")
        left, right = (F.lit(x).cast("long") for x in DAYS)
        moved = let(F.when(day.between(0, DAYS[0] * DAYS[1] - 1), feistel(day, left, right, key, "date")), lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), v.cast("int")))
        return let(moved, lambda m: F.when(m.isNotNull(), refill(value, F.coalesce(*[F.when(w == k, F.date_format(m, o)) for k, o in enumerate(orders)]))))

    return let(which, new)


def _mod97(text: Column) -> Column:
    """Letters count as 10 to 35."""
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda a, c: let(code(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))


def _iban(value: Column, key: str) -> Column:
    """Letters and the country stay; the digits of the account are permuted, 18 at a time, and the check digits are made anew."""

    def new(c: Column) -> Column:
        body = F.substring(c, F.lit(5), F.char_length(c))

        def done(d: Column) -> Column:
            at = F.sequence(F.lit(1), F.char_length(d), F.lit(18))
            moved = F.array_join(F.transform(at, lambda i: permuted_digits(F.substring(d, i, F.lit(18)), key, "iban")), "")
            fresh = F.when(F.char_length(d) > 0, refill(body, moved)).otherwise(body)
            country = F.substring(c, 1, 2)
            return let(fresh, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))

        return let(_digits(body), done)

    def spaced(flat: Column) -> Column:
        start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
        step = lambda a, c: F.when(c == " ", F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))).otherwise(F.struct(F.concat(a["s"], F.substring(flat, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k")))
        return F.aggregate(F.split(value, ""), start, step, lambda a: a["s"])

    flat = F.regexp_replace(value, " ", "")
    ok = lambda c: _mod97(F.concat(F.substring(c, F.lit(5), F.char_length(c)), F.substring(c, 1, 4))) == 1
    return let(flat, lambda c: F.when(F.char_length(c).between(15, 34) & ok(c), spaced(new(c))))


def _email(value: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value), F.lit(key)), 256), 1, 16), F.lit("@example.invalid"))


def _secret(value: Column, key: str) -> Column:
    name = F.regexp_extract(value, r"^(?:[A-Za-z_]+\s*[=:]\s*)?", 0)
    return F.concat(name, F.lit("<"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value, F.lit(key)), 256), 1, 16), F.lit(">"))


_NEW = {"email": _email, "secret": _secret, "iban": _iban, "ipv4": _ipv4, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def _replacement(value: Column, key: str) -> Column:
    """(kind, new) of a match: the first format that it has whole and whose check it passes; null kind where none is."""
    tried = [F.when(_is(kind, value), _as(kind, _NEW[kind](value, key))) for kind in KINDS]
    return F.coalesce(*tried, F.struct(F.lit(None).cast("string").alias("kind"), value.alias("new")))


def _is(kind: str, value: Column) -> Column:
    return value.rlike(rf"\A(?:{_FORMATS[kind]})\z")


def _cut(kind: str, value: Column, key: str) -> Column:
    """The longest part of value, from its start to a separator or its end, that passes the check of kind; null where none does."""

    def first(parts: Column) -> Column:
        cuts = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), ""))
        return F.get(F.filter(cuts, lambda c: _is(kind, c) & _NEW[kind](c, key).isNotNull()), 0)

    return let(F.split(value, r"(?<=[A-Z0-9)])(?=[ .-])"), first)


def _only_valid(text: Column, key: str) -> Column:
    """ANY for one text: instead of the open formats it has the valid values of the text, the longest first.

    A match then ends where a valid value does, and what fails its check takes nothing in, so what is left over is scanned.
    """

    def valid(kind: str) -> Column:
        at = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{_STARTS}(?=({_FORMATS[kind]}))"), F.lit(1)))
        cuts = F.array_distinct(F.array_compact(F.transform(at, lambda v: _cut(kind, v, key))))
        ordered = F.sort_array(F.transform(cuts, lambda c: F.struct(F.char_length(c).alias("n"), c.alias("value"))), False)
        quoted = F.array_join(F.transform(ordered, lambda x: F.concat(F.lit(r"\Q"), x["value"], F.lit(r"\E"))), "|")
        return let(quoted, lambda q: F.when(q == "", "(?!)").otherwise(F.concat(F.lit("(?:"), q, F.lit(r")\b"))))

    parts = [valid(k) if k in OPEN else F.lit(f"(?:{p})") for k, p in _FORMATS.items()]
    return F.concat(F.lit(_STARTS + "(?:"), F.concat_ws("|", *parts), F.lit(")"))


def _as(kind: str, new: Column) -> Column:
    return let(new, lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("new"))))


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """df with text_col rewritten, and n_<kind> for each of KINDS; input columns of these names are replaced, all others come out.

    Whole texts are read, in one narrow step without a shuffle, so copies and hot sources cost what other rows do. Values
    that fail their format's check stay; of a longer match that fails, the longest valid cut at a separator goes, and the
    rest is scanned. Null texts stay null with counts of 0. Phone numbers keep their country code,
    secrets their names. `key` must stay secret: with it pseudonyms can be undone. An empty key raises ValueError.
    """
    if not key:
        raise ValueError("a key is needed: without one anybody could undo the pseudonyms")
    text = F.col(text_col)
    out = keeping(df, *[f"n_{k}" for k in KINDS])
    values, found, pattern = fresh(out, "_values", "_found", "_any")
    # Most texts have no sign that any format needs, and are left before the longer pattern is tried.
    all_of = lambda p: F.coalesce(F.regexp_extract_all(text, p, F.lit(0)), F.array().cast("array<string>"))
    out = out.withColumn(values, F.when(text.rlike(SIGN), all_of(F.lit(ANY))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(found, F.transform(values, lambda v: _replacement(v, key)))
    failed = F.exists(found, lambda x: x["kind"].isNull() & reduce(or_, [_is(k, x["new"]) for k in OPEN]))
    out = out.withColumn(pattern, F.when(failed, _only_valid(text, key)))
    again = F.col(pattern).isNotNull()
    out = out.withColumn(values, F.when(again, all_of(F.col(pattern))).otherwise(F.col(values)))
    out = out.withColumn(found, F.when(again, F.transform(values, lambda v: _replacement(v, key))).otherwise(F.col(found)))
    gaps = F.when(again, F.split(text, F.col(pattern), -1)).otherwise(F.split(text, ANY, -1))
    joined = let(gaps, lambda g: F.array_join(F.transform(g, lambda x, i: F.concat(x, F.coalesce(F.get(F.col(found), i)["new"], F.lit("")))), ""))
    counted = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
    out = out.withColumns({f"n_{k}": counted(k) for k in KINDS})
    return out.withColumn(text_col, F.when(F.size(values) > 0, joined).otherwise(text)).drop(values, found, pattern)


def key_of(spark: SparkSession) -> str:
    """The key that the session names in spark.docaudit.pii.key; an error where it names none."""
    key = spark.conf.get("spark.docaudit.pii.key", None)
    if not key:
        raise ValueError("spark.docaudit.pii.key is not set")
    return key


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query runs on made-up persons and brings a key for them where the session has none; jobs of one's own use key_of()."""
    key = key_of(spark) if spark.conf.get("spark.docaudit.pii.key", None) else QUERY_KEY
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key)
