"""Entities in free text: each is an array column in first-seen order, equal ones in any case once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions.patterns import empty_strings, exploded, find, find_all, first_seen, has, java, let, lines, replace, squeeze, trim, unique_ci
from docaudit.sources.shared import keep

# Shapes of entities.
EMAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?:\+?\d{1,3}[\s\-.]?)?(?:\(?\d{2,5}\)?[\s\-.]?)?\d{3,5}[\s\-.]?\d{4,6}\b"
REFERENCE = r"\b(?:REF|REFERENCE|REF\.?\s*NO\.?|LETTER\s*NO\.?)[:\s#\-]*([A-Z0-9][A-Z0-9/\-]{3,})\b"
DOCUMENT_NO = r"\b(?:DOC(?:UMENT)?|CLEARANCE|PASSPORT|LETTER)\s*(?:NO\.?|NUMBER|#)[:\s]*([A-Z0-9][A-Z0-9/\-]{3,})\b"
REGISTRATION_NO = r"\b(?:REG(?:ISTRATION)?|CIN)\s*(?:NO\.?|NUMBER|#)?[:\s]*([A-Z0-9][A-Z0-9/\-]{4,})\b"
CIN = r"\b([UL]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6})\b"
PASSPORT_NO = r"\b([A-Z]\d{7,8})\b"
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DATE = rf"\d{{1,2}}[/\-.\s]\d{{1,2}}[/\-.\s]\d{{2,4}}|\d{{1,2}}\s+(?:{'|'.join(MONTHS)})[A-Z]*[.,]?\s+\d{{2,4}}|\d{{4}}[/\-]\d{{2}}[/\-]\d{{2}}"
ORGANIZATION = r"\b([A-Z][A-Za-z0-9&.'\-]+(?:\s+[A-Z][A-Za-z0-9&.'\-]+){0,6}\s+(?:Pvt\.?\s*)?(?:Ltd\.?|Limited|LLC|Inc\.?|Corporation|Company|Airlines?|Airport|Authority|Ministry|Department))\b"
ORGANIZATION_LABEL = r"(?:M/s\.?|Messrs\.?|Organization|Organisation|Company\s*Name)\s*[:\-]?\s*([^\n]{4,80})"
ORGANIZATION_STOP = r"\b(THE|AND|OF|FOR|PRIVATE|LIMITED|LTD|PVT|INC|LLC|CORPORATION|COMPANY|GOVT|GOVERNMENT)\b"


def _some(text: Column, needs: str, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """find_all() of texts that hold what every match needs; most texts are left after that plain search."""
    return F.when(text.rlike(java(needs)), find_all(text, pattern, group, ignore_case)).otherwise(empty_strings())


def emails(text: Column) -> Column:
    # A run of signs before an @ is entered at its start only, or where the last match ended.
    return unique_ci(_some(text, "@", rf"(?:\G|(?<![A-Z0-9._%+-])){EMAIL.replace('+@', '++@')}"))


def phones(text: Column) -> Column:
    """Numbers of 8 to 15 digits."""
    found = F.transform(_some(text, r"\d{3}[\s\-.]?\d{4}", PHONE, 0, False), squeeze)
    return unique_ci(F.filter(found, lambda p: F.regexp_count(p, F.lit("[0-9]")).between(8, 15)))


def references(text: Column) -> Column:
    return unique_ci(_some(text, "(?i)REF|LETTER", REFERENCE, 1))


def document_numbers(text: Column) -> Column:
    return unique_ci(_some(text, "(?i)DOC|CLEARANCE|PASSPORT|LETTER", DOCUMENT_NO, 1))


def registration_numbers(text: Column) -> Column:
    return unique_ci(_some(text, "(?i)REG|CIN", REGISTRATION_NO, 1))


def cins(text: Column) -> Column:
    return unique_ci(F.transform(_some(text, r"(?i)[UL]\d{5}", CIN), F.upper))


def passport_numbers(text: Column) -> Column:
    return unique_ci(F.when(text.rlike(r"\d{7}"), find_all(F.upper(text), PASSPORT_NO)).otherwise(empty_strings()))


def _date_of(day: Column, month: Column, year: Column) -> Column:
    """DD/MM/YYYY of parts (strings), null unless the month is 1 to 12, the day 1 to 31 and the year 1900 to 2100; two digits of a year turn at 50."""
    d, m, y = (x.cast("int") for x in (day, month, year))
    y = F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
    return F.when(m.between(1, 12) & d.between(1, 31) & y.between(1900, 2100), F.concat_ws("/", F.lpad(d.cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0"), y.cast("string")))


def plain_date(token: Column) -> Column:
    """DD/MM/YYYY of a string that is one of the three date shapes and plausible, else null."""
    numeric, named, iso = (rf"(?i)\A{p}\z" for p in (r"(\d{1,2})[/\-.\s](\d{1,2})[/\-.\s](\d{2,4})", rf"(\d{{1,2}})\s+({'|'.join(MONTHS)})[A-Z]*[.,]?\s+(\d{{2,4}})", r"(\d{4})[/\-](\d{2})[/\-](\d{2})"))
    part = lambda p, k: F.regexp_extract(token, p, k)
    month = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.upper(part(named, 2)))
    return F.coalesce(
        F.when(token.rlike(numeric), _date_of(part(numeric, 1), part(numeric, 2), part(numeric, 3))),
        F.when(token.rlike(named), _date_of(part(named, 1), month, part(named, 3))),
        F.when(token.rlike(iso), _date_of(part(iso, 3), part(iso, 2), part(iso, 1))),
    )


def dates(text: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(find_all(text, DATE, 0, True), plain_date)))


def normalize_date(text: Column) -> Column:
    """plain_date of the trimmed text, else its first 40 characters with single spaces; null where that is empty."""
    return F.coalesce(plain_date(trim(text)), F.nullif(F.substring(replace(trim(text), r"\s+", " "), 1, 40), F.lit("")))


def bullets(text: Column) -> Column:
    """Bulleted, lettered and numbered items: 50 of at most 200 characters."""
    pattern = java(r"^\s*(?:[-*•●▪]|[a-z]\)|\d+[.)])\s+(.+)$", True)
    found = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: trim(F.regexp_extract(x, pattern, 1)))
    return F.slice(F.array_distinct(F.transform(F.filter(found, lambda x: F.char_length(x) > 2), lambda x: F.substring(x, 1, 200))), 1, 50)


def headings(text: Column) -> Column:
    """Numbered, all-capital and title-case lines of 4 to 80 characters that are no dates: 40 of them."""

    def is_heading(x: Column) -> Column:
        capitals = has(x, r"^[A-Z0-9][A-Z0-9\s\-:&/]{3,}$", False) & has(x, r"[A-Z]{3,}", False) & (F.size(F.split(x, r"\s+")) <= 10)
        shaped = has(x, r"^\d+(\.\d+)*[.)]\s+\S", False) | capitals | has(x, r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,6}$", False)
        return F.char_length(x).between(4, 80) & shaped & ~has(x, r"^\d{1,2}[/\-]\d{1,2}", False)

    return F.slice(F.array_distinct(F.filter(lines(text), is_heading)), 1, 40)


def header(text: Column) -> Column:
    return F.slice(lines(text), 1, 3)


def footer(text: Column) -> Column:
    return let(lines(text), lambda a: F.slice(a, F.greatest(F.lit(1), F.size(a) - 2), F.lit(3)))


def organizations(text: Column) -> Column:
    """Capitalised runs that end in a word for a company or an authority, then values of organisation labels: 15 of them."""
    labelled = F.transform(find_all(text, ORGANIZATION_LABEL, 1, True), squeeze)
    named = F.filter(labelled, lambda v: ~has(v, ORGANIZATION_STOP) | (F.size(F.split(v, r"\s+")) >= 2))
    return F.slice(unique_ci(F.concat(F.transform(find_all(text, ORGANIZATION, 1, True), squeeze), named)), 1, 15)


def address_after(text: Column, labels: tuple[str, ...] = (r"Address", r"Registered\s*Office", r"पता")) -> Column:
    """Of the first label that gives any: up to 8 lines from the label on, without it, as one string of 400 characters."""

    def block(label: str) -> Column:
        pattern = java(label, True)
        rest = F.substring(text, F.regexp_instr(text, F.lit(pattern)), F.char_length(text))
        first = lambda x: F.regexp_replace(x, rf"\A(?s:(.*?))(?:{pattern})(?s:(.*))\z", "$1$2")
        clean = F.transform(F.slice(F.split(rest, "\n", -1), 1, 8), lambda x: trim(replace(first(x), r"^[:\-\s]+", "")))
        kept = F.filter(clean, lambda x: (F.char_length(x) > 5) & ~has(x, r"^(Address|Registered|Office)$"))
        return F.when(has(text, label) & (F.size(kept) > 0), F.substring(F.array_join(kept, ", "), 1, 400))

    return F.coalesce(*[block(x) for x in labels])


def addresses(text: Column) -> Column:
    """The labelled block, and each line with a six-digit code or a PIN or ZIP, joined to the two lines before it."""

    def near(a: Column) -> Column:
        coded = F.transform(a, lambda x, i: F.when(has(x, r"\b\d{6}\b", False) | has(x, r"\bPIN\b|\bZIP\b"), F.array_join(F.slice(a, F.greatest(F.lit(1), i - 1), F.least(F.lit(3), i + 1)), ", ")))
        return F.transform(F.filter(coded, lambda x: x.isNotNull() & (F.char_length(x) > 15)), lambda x: F.substring(x, 1, 400))

    return first_seen(F.concat(F.array_compact(F.array(address_after(text))), let(lines(text), near)), F.upper)


#: Tables of a document, and rows that are kept of each.
MOST_TABLES, MOST_ROWS = 10, 30


def table_list(text: Column) -> Column:
    """array<struct<rowCount, rows>>: runs of two lines or more that fall into columns, the first 10, each with its first 30 rows.

    Columns are cut at pipes, else at tabs, else at two spaces. Lines that are not cut are the ends of runs; a run lies
    between two of them, so that the work is linear in the lines and stays in the document's row.
    """
    trimmed = lambda x, p: F.filter(F.transform(F.split(x, p, -1), trim), lambda c: c != "")
    pieces = lambda x, p: F.filter(F.split(x, p, -1), lambda c: c != "")
    cut = lambda x: F.when(x.rlike(r"[|\t]|" + java(r"\s{2}")), F.coalesce(*[let(c, lambda a: F.when(F.size(a) >= 2, a)) for c in (trimmed(x, r"\|"), pieces(x, r"\t+"), pieces(x, java(r"\s{2,}")))]))

    def runs(cells: Column) -> Column:
        ends = F.filter(F.transform(cells, lambda c, i: F.when(c.isNull(), i)), lambda i: i.isNotNull())
        ends = F.concat(F.array(F.lit(-1)), ends, F.array(F.size(cells)))
        spans = let(ends, lambda e: F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda b, j: F.struct((b + 1).alias("start"), (F.get(e, j + 1) - b - 1).alias("n"))))
        kept = F.slice(F.filter(spans, lambda s: s["n"] >= 2), 1, MOST_TABLES)
        return F.transform(kept, lambda s: F.struct(s["n"].alias("rowCount"), F.slice(cells, s["start"] + 1, F.least(s["n"], F.lit(MOST_ROWS))).alias("rows")))

    return let(F.transform(lines(text), cut), runs)


def tables(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, table_no, row_count, rows): a row for each table of table_list()."""
    found = exploded(df, table_list(F.col(text_col)), (id_col,))
    return found.select(id_col, (F.col("pos") + 1).alias("table_no"), F.col("item.rowCount").alias("row_count"), F.col("item.rows").alias("rows"))


KINDS = {
    "email": emails,
    "phone": phones,
    "reference": references,
    "document_no": document_numbers,
    "registration_no": registration_numbers,
    "cin": cins,
    "passport_no": passport_numbers,
    "date": dates,
}


def entity_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """(id_col, kind, pos, value): a row for each entity of each document, of the kinds that are wanted; others are not looked for."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), KINDS[k](F.col(text_col)).alias("v")) for k in kinds])
    return df.select(id_col, F.explode(each).alias("e")).select(id_col, "e.kind", F.posexplode("e.v").alias("pos", "value"))


def entity_stats(entities: DataFrame, top: int = 3) -> DataFrame:
    """(kind, n, n_docs, n_values, top_values): counts, and the most frequent values of each kind, ties in value order.

    Entities are written to the shared folder first, as documents and values are counted apart and texts are searched once.
    """
    rows = keep(entities.select("kind", "doc_id", "value"), "entities")
    ranked = rows.groupBy("kind", "value").agg(F.count("*").alias("n"))
    docs = rows.groupBy("kind").agg(F.countDistinct("doc_id").alias("n_docs"))
    counts = ranked.groupBy("kind").agg(F.sum("n").alias("n"), F.count("value").alias("n_values")).join(docs, "kind").select("kind", "n", "n_docs", "n_values")
    # The best of each partition first, so that a kind with a third of all values does not meet whole in one task.
    best = ranked.withColumn("part", F.pmod(F.hash("value"), F.lit(64)))
    for keys in (("kind", "part"), ("kind",)):
        best = best.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "value"))).filter(F.col("r") <= top)
    tops = best.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]), ", ").alias("top_values"))
    return counts.join(tops, "kind")
