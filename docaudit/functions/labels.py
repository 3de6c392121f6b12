"""Values that stand after their labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.functions.entities import DATE, normalize_date
from docaudit.functions.patterns import empty_strings, find, has, java, let, replace, squeeze, trim


# Fixed value: a date of digits alone.
DAY = r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}"


def labeled_value(text: Column, labels: tuple[str, ...], max_len: int = 120, next_line: bool = True, strict: bool = False, clean: Callable[[Column], Column] = squeeze) -> Column:
    """The value after the first of the labels that gives one: on the label's line, else on the next line of more than a character.

    A label that is an alternation captures nothing after its first branch, and takes the next line; strict puts labels in
    a group of their own. clean is what is done to a value before it is judged.
    """

    def one(label: str) -> Column:
        label = f"(?:{label})" if strict else label
        pattern = java(rf"{label}\s*[:\-/>|.]?\s*([^\n]{{0,{max_len}}})", True)

        def valued(here: Column) -> Column:
            good = (here != "") & ~has(here, r"^(n/a|na|none|-)$")
            own = F.when(good, F.substring(here, 1, max_len))
            if not next_line:
                return own
            rest = F.substring(text, F.regexp_instr(text, F.lit(pattern)) + F.char_length(F.regexp_extract(text, pattern, 0)), F.char_length(text))
            below = F.get(F.filter(F.split(rest, "\n", -1), lambda x: F.char_length(trim(x)) > 1), F.lit(0))
            return F.coalesce(own, F.when(text.rlike(pattern), F.nullif(F.substring(clean(below), 1, max_len), F.lit(""))))

        # The label's line is searched once; the line below only where that gives nothing.
        return let(clean(F.regexp_extract(text, pattern, 1)), valued)

    return F.coalesce(*[one(x) for x in labels])


def labeled_date(text: Column, labels: tuple[str, ...]) -> Column:
    """The date token after the first of the labels that has one."""
    return F.coalesce(*[normalize_date(find(text, rf"{x}\s*[:\-]?\s*({DATE})", 1)) for x in labels])


def labeled_list(text: Column, labels: tuple[str, ...], most: int = 20) -> Column:
    """Items on the 24 lines below the first label that has any: without numbering, three characters or more, up to a line that starts another block."""

    def one(label: str) -> Column:
        rest = F.substring(text, F.regexp_instr(text, F.lit(java(label, True))), F.char_length(text))
        block = F.slice(F.split(rest, "\n", -1), 2, 24)
        clean = F.transform(block, lambda x: trim(replace(replace(x, r"^[\d.\-)\]\s]+", ""), r"^[-*•]\s*", "")))
        usable = lambda x: (F.char_length(x) >= 3) & ~(has(x, r"^(Director|Signator|Name|S\.?\s*No)") & (F.char_length(x) < 20))

        def upto(a: Column) -> Column:
            ends = F.filter(F.transform(a, lambda x, i: F.when(has(x, r"^(Authorized|Paid|Capital|Address|CIN|ROC)\b"), i + 1)), lambda i: i.isNotNull())
            return F.slice(a, F.lit(1), F.least(F.coalesce(F.get(ends, F.lit(0)), F.size(a)), F.lit(most)))

        items = let(F.filter(clean, usable), upto)
        items = F.filter(items, lambda x: has(x, r"^[A-Z0-9\s.,'&\-]{3,80}$") | has(x, r"[A-Za-z]{3,}"))
        return F.when(has(text, label) & (F.size(items) > 0), F.transform(items, lambda x: F.substring(x, 1, 120)))

    return F.coalesce(*[one(x) for x in labels], empty_strings())


def date_near(text: Column, names: tuple[str, ...], window: int = 120) -> Column:
    """The first date of digits within `window` characters from the start of the first of the labels that has one."""
    at = lambda label: F.regexp_instr(text, F.lit(java(label, True)))
    return F.coalesce(*[F.when(at(x) > 0, normalize_date(find(F.substring(text, at(x), F.lit(window)), DAY))) for x in names])


def issue_expiry(text: Column) -> Column:
    """(issue, expiry) of the first two dates of digits that stand next to each other."""
    pattern = rf"({DAY})\s+({DAY})"
    return F.struct(normalize_date(find(text, pattern, 1)).alias("issue"), normalize_date(find(text, pattern, 2)).alias("expiry"))


def gender(text: Column) -> Column:
    return F.upper(find(text, r"\b(MALE|FEMALE|TRANSGENDER)\b", 1))


def dob(text: Column) -> Column:
    """The labelled date of birth with / between its parts, else the first plausible date of two, two and four digits."""
    labelled = find(text, r"(?:DOB|Date of Birth|जन्म[^\d]{0,24})\s*[:\-]?\s*(\d{1,2}[/\-.\s]\d{1,2}[/\-.\s]\d{4})", 1)
    loose = r"\b(\d{2})[/\-.\s](\d{2})[/\-.\s](\d{4})\b"
    d, m, y = (find(text, loose, k) for k in (1, 2, 3))
    fits = d.cast("int").between(1, 31) & m.cast("int").between(1, 12) & y.cast("int").between(1900, 2100)
    return F.coalesce(replace(labelled, r"[\s.\-/]+", "/"), F.when(fits, F.concat_ws("/", d, m, y)))


def infer_issue(expiry: Column) -> Column:
    """Ten years before DD/MM/YYYY and a day later; of 29 February that is 2 March where the earlier year has no such day."""
    d = F.try_to_date(expiry, "dd/MM/yyyy")
    back = F.add_months(d, -120)
    return F.date_format(F.date_add(back, F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29) & (F.dayofmonth(back) == 28), 2).otherwise(1)), "dd/MM/yyyy")
