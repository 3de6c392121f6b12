"""Person names in text: cleaned, judged, scored and ranked candidates.

Candidates of a text are one array; each is cleaned, judged and scored once, in the struct that carries it from there on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions.patterns import empty_strings, find, find_all, first_seen, has, java, let, replace, squeeze, trim, unique_ci

# Words of forms and authorities, which are no names.
# fmt: off
STOP = (
    "INCOME", "TAX", "DEPARTMENT", "DEPARTME", "DEPAKIMENT", "GOVT", "GOVERNMENT", "OF", "INDIA", "PAN", "PERMANENT", "ACCOUNT", "NUMBER", "CARD", "AADHAAR", "UIDAI",
    "ADDRESS", "GENDER", "YEAR", "BIRTH", "DOB", "MALE", "FEMALE", "FATHER", "SIGNATURE", "AUTHORITY", "UNIQUE", "IDENTIFICATION", "DATE", "ISSUE", "YOURSELF",
    "ELECTRONICALLY", "GENERATED", "DOWNLOAD", "VID", "ENROLLMENT", "CAMSCANNER", "SCANNED", "NAME", "FATHERS",
)
# Tokens that misreadings leave behind.
GARBAGE = (
    "COLD", "NE", "CAR", "OR", "ER", "TEW", "HS", "AY", "GGA", "AIT", "LADY", "LADI", "THE", "AND", "FOR", "WITH", "FROM", "THIS", "THAT", "CARD", "SCANNED", "HELLO",
    "SEE", "EEE", "BEET", "BE", "AT", "IS", "AN", "TO", "ON", "BY", "NAME", "APPLE", "ORANGE", "LAPTOP", "BACKEND", "FASTAPI", "NODEJS", "RANDOM", "PERSON", "MG", "ROAD",
    "BENGALURU", "KARNATAKA", "NOTES", "MEETING", "DISCUSSION", "RY", "CAMSCANNER", "SPIES", "REIS", "SESH", "DL", "GE", "GEE", "TI", "TT", "PERM", "ANENT", "ACC",
    "COUNT", "NUM", "BER", "GOVT", "INDIA", "TAX", "CO", "FI", "NS", "SB", "LAR", "HIYA", "AYE", "INCOMETAXDEPAKIMENT", "INCOMETAXDEPARTMENT", "INCOMETAX",
    "GOVERNMENTOFINDIA", "PERMANENT", "ACCOUNT", "NUMBER", "DEPARTMENT",
)
# fmt: on
# Parts of words and phrases of forms; shapes of names, numbers and dates; labels.
FUSED = "INCOME|TAX|DEPART|GOVT|GOVERNMENT|PERMANENT|ACCOUNT|AADHAAR|UIDAI|CAMSCANNER|ANENT"
PHRASE = "PERM|ANENT|ACCOUNT|NUMBER|INCOME|TAXDEPT|GOVTOF|PERMANENTACCOUNT"
TITLE = r"\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{1,}){1,3})\b"
CAPITALS = r"\b[A-Z]{2,}(?:\s+[A-Z]{1,}){1,4}\b"
PAN_SHAPE = r"\b[A-Z]{5}[0-9OISB]{4}[A-Z]\b"
DOB_SHAPE = r"\d{2}[/\-.]\d{2}[/\-.]\d{4}"
LABEL = r"(?:^|\n|[^\w])(?:Name|नाम)\s*[:\-/>|.]?\s*([^\n]{0,80})"
FATHER = r"(?:Father'?s?\s*Name|पिता[^\nA-Z]{0,30}|Name\s*N)\s*[:\-/>]?\s*([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*){0,4})"
# Names before a number or date, before a date of birth, after an account number; what ends the lines after one, and what a line's label and another's look like.
BEFORE_ID = r"\b([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*){1,4})\s*(?=\d{4}|\d{2}[/\-.]\d{2}|DOB)"
BEFORE_DOB = r"\b([A-Z](?:\s+[A-Z]{2,}){1,3})\s+(?:[A-Z]{2,}(?:\s+[A-Z]+){0,3}\s+)?(\d{2}[/\-.]\d{2}[/\-.]\d{4})"
AFTER_NUMBER = PAN_SHAPE + r"([\s\S]{0,220}?)(?:Father|पिता|Date\s*of\s*Birth|DOB|जन्म)"
NO_MORE, OTHER_LINE = "Father|पिता|DOB|Date|Signature|जन्म", "Father|पिता|DOB|Date"
OWN_LABEL, OWN_LINE = r"^.*?(?:Name|नाम)\s*[:\-/>|.]?\s*", r"(?:Name|नाम)\b"
# Points of each source of a candidate beside the 45 of a labelled one.
SOURCES = {"title-case": 35, "label": 15, "label-title": 35, "label-direct": 15, "before-id": 30, "same-line": 15, "next-line": 20, "after-pan": 30, "after-pan-line": 30, "before-dob": 30, "scan": -15}
UNLABELLED = ("title-case", "before-id", "scan")
#: The place of a name that the text does not have as it was cleaned.
NOWHERE = 99_999


def is_garbage(token: Column) -> Column:
    """Whether a token in capitals is a leftover: a known one, part of a form's words, one letter over and over, without a vowel, or too long."""
    n = F.char_length(token)
    letters = F.array_distinct(F.split(token, ""))
    most = F.array_max(F.transform(letters, lambda c: n - F.char_length(F.replace(token, c, F.lit("")))))
    # A letter that fills three quarters stands beside itself, and leaves few others; most tokens are done with that.
    same = F.when((n >= 3) & token.rlike(r"(?s)(.)\1") & (F.size(letters) <= n / 4 + 2), most / n >= 0.75).otherwise(False)
    return F.when((n == 0) | (n > 18), True).otherwise(token.isin(*GARBAGE) | token.rlike(FUSED) | ((n <= 3) & token.rlike(r"\A[AEIOU]+\z")) | ((n >= 4) & ~token.rlike("[AEIOU]")) | same)


def _parts(name: Column) -> Column:
    return F.filter(F.split(name, r"\s+"), lambda p: p != "")


def is_phrase(name: Column) -> Column:
    """Whether a name is a form's wording in pieces."""
    return replace(F.upper(name), r"\s", "").rlike(PHRASE)


def _sound(p: Column, name: Column) -> Column:
    """Whether parts, none of which is a leftover, make a name: two or more, a solid one among them, not mostly short bits."""
    junky = F.size(F.filter(p, lambda x: (F.char_length(x) <= 3) | x.rlike(r"\A(?:[AEIOUY]+|(.)\1+)\z")))
    solid = F.exists(p, lambda x: F.char_length(x) >= 4)
    return (F.size(p) >= 2) & solid & (junky < F.ceil(F.size(p) * 0.6)) & ~name.rlike("NAME|FATHER|INCOME|TAX|GOVT|CAMSCANNER") & ~is_phrase(name)


def is_real(name: Column) -> Column:
    """Whether a name in capitals is one: as for cleaned ones, and not mostly leftovers."""

    def judged(p: Column) -> Column:
        flagged = F.transform(p, is_garbage)
        clean = F.filter(p, lambda x, i: ~F.get(flagged, i))
        return let(clean, lambda c: (F.size(p) - F.size(c) < F.size(p) - 1) & F.exists(c, lambda x: F.char_length(x) >= 4)) & _sound(p, name)

    return F.coalesce(let(_parts(name), judged), F.lit(False))


def _clean_parts(raw: Column) -> Column:
    """The parts of clean_name(); null where it is."""
    usable = F.filter(_parts(F.upper(F.regexp_replace(raw, r"[^A-Za-z]+", " "))), lambda p: ~p.isin(*STOP) & ~is_garbage(p))

    def take(state: Column, p: Column) -> Column:
        kept, n = state["kept"], F.size(state["kept"])
        length, vowel = F.char_length(p), p.rlike("[AEIOU]")
        last = F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))
        stop = ((n >= 2) & (length == 2)) | ((n >= 3) & ((F.char_length(last) == 1) | (length < 5))) | ((n >= 2) & (length > 1) & ~vowel)
        full = ((n >= 1) & (F.char_length(F.get(kept, F.lit(0))) == 1) & (F.char_length(F.when(n >= 2, F.get(kept, F.lit(1))).otherwise(p)) >= 4)) | (n >= 3)
        return F.when(state["done"] | stop, F.struct(kept.alias("kept"), F.lit(True).alias("done"))).otherwise(F.struct(F.concat(kept, F.array(p)).alias("kept"), full.alias("done")))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done"))

    def whole(k: Column) -> Column:
        number = F.array_join(k, "").rlike(r"\A[A-Z]{5}[OISB]{4}[A-Z]\z")
        return F.when((F.size(k) >= 2) & F.char_length(F.array_join(k, " ")).between(5, 60) & ~number, k)

    return let(F.aggregate(F.slice(usable, 1, 40), start, take, lambda s: s["kept"]), whole)


def clean_name(raw: Column) -> Column:
    """A name in capitals without stop and leftover words, cut where a second name seems to start; null unless two parts and 5 to 60 letters are left, and where letters read as digits make it an account number."""
    return let(_clean_parts(raw), lambda p: F.when(p.isNotNull(), F.array_join(p, " ")))


def _looks(p: Column, name: Column, sound: Column) -> Column:
    """Points for the parts, none of which is a leftover, of a name."""

    def part(a: Column, x: Column) -> Column:
        n = F.char_length(x)
        points = F.when(n == 1, 3).when(n == 2, -8).when(n >= 4, 12).otherwise(2) - F.when((n > 1) & ~x.rlike("[AEIOU]"), 12).otherwise(0)
        return a + points - F.when(x.rlike(r"\A(.)\1{2,}\z"), 40).otherwise(0)

    shape = F.size(p) * 12 + F.least(F.char_length(name), F.lit(30)) + F.when((F.size(p) >= 3) | ((F.size(p) == 2) & F.forall(p, lambda x: F.char_length(x) >= 4)), 15).otherwise(0)
    return F.aggregate(p, shape, part) - F.when(is_phrase(name), 60).otherwise(0) - F.when(sound, 0).otherwise(40)


def confidence_points(avg_conf: Column) -> Column:
    return F.when(avg_conf >= 70, 20).when(avg_conf >= 50, 8).when(avg_conf < 35, -25).otherwise(0)


def name_score(name: Column, labeled: Column, source: Column, avg_conf: Column | None = None) -> Column:
    """Points of a cleaned name: parts and length, its source, the confidence of its words, and each part's looks."""
    looks = let(_parts(name), lambda p: _looks(p, name, F.coalesce(_sound(p, name), F.lit(False))))
    return looks + _source_points(source) + F.when(labeled, 45).otherwise(0) + (F.lit(0) if avg_conf is None else confidence_points(avg_conf))


def _source_points(source: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in SOURCES.items() for x in pair])[source], F.lit(0))


def _raw(text: Column) -> Column:
    """array<struct<raw, source>>: what may be names, in the order in which sources claim them."""
    tag = lambda values, source: F.transform(F.coalesce(values, empty_strings()), lambda x: F.struct(x.alias("raw"), F.lit(source).alias("source")))
    none = F.array().cast("array<struct<raw:string,source:string>>")
    named = has(text, "Name|नाम")

    # Of each label: 140 characters from it on, the rest of its line, and the 24 characters before it, which are looked at where a label stands only.
    here, before = r"(?=(?:^|\n|[^\w])(?:Name|नाम))", r"(?<=(\A[\s\S]{0,24}|[\s\S]{24}))"
    hits = F.struct(find_all(text, rf"{here}(?=([\s\S]{{0,140}})){LABEL}", 1, True).alias("w"), find_all(text, LABEL, 1, True).alias("d"), find_all(text, here + before + LABEL, 1, True).alias("b"))

    def of_label(w: Column, direct: Column) -> Column:
        return F.concat(tag(find_all(w, CAPITALS), "label"), tag(find_all(w, TITLE, 1), "label-title"), tag(F.when(~has(direct, r"^[^A-Za-z]*(?:name)?[^A-Za-z]*$"), F.array(direct)), "label-direct"))

    labelled = let(hits, lambda h: F.flatten(F.transform(h["w"], lambda w, i: F.when(has(F.get(h["b"], i), "FATHER|PITA|पिता"), none).otherwise(of_label(w, F.get(h["d"], i))))))

    def by_line(lines: Column) -> Column:
        def of_line(x: Column, i: Column) -> Column:
            same, below = replace(x, OWN_LABEL, "", True), F.get(lines, i + 1)
            own = F.when(~has(same, r"^\s*(?:name)?\s*$"), F.array(same))
            nxt = F.when((below != "") & ~has(below, OTHER_LINE), F.array(below))
            return F.when(has(x, OWN_LINE) & ~has(x, "Father|पिता"), F.concat(tag(own, "same-line"), tag(nxt, "next-line"))).otherwise(none)

        return F.flatten(F.transform(lines, of_line))

    def after_number(w: Column) -> Column:
        lines = F.slice(F.filter(F.transform(F.split(w, "\n", -1), trim), lambda x: x != ""), 1, 4)
        ends = F.transform(lines, lambda x, i: F.when(has(x, NO_MORE), i))
        return F.concat(tag(find_all(w, CAPITALS), "after-pan"), tag(let(lines, lambda a: F.slice(a, F.lit(1), F.coalesce(F.array_min(ends), F.size(a)))), "after-pan-line"))

    after = find(text, AFTER_NUMBER, 1)
    return F.concat(
        tag(find_all(text, TITLE, 1), "title-case"),
        F.when(named, labelled).otherwise(none),
        tag(find_all(text, BEFORE_ID, 1), "before-id"),
        F.when(named, let(F.split(text, "\n", -1), by_line)).otherwise(none),
        let(after, lambda w: F.when(w.isNotNull(), after_number(w)).otherwise(none)),
        tag(find_all(text, BEFORE_DOB, 1), "before-dob"),
        tag(find_all(F.upper(text), CAPITALS), "scan"),
    )


def _read(parts: Column, words: Column, all_parts: bool) -> Column:
    """The mean confidence of the parts of a name in words (a map of words in capitals to confidences): of those it has, null without any, or of all, a missing one as 0."""
    found = F.transform(parts, lambda p: F.try_element_at(words, p))
    found = F.transform(found, lambda c: F.coalesce(c, F.lit(0.0))) if all_parts else F.array_compact(found)
    return let(found, lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, c: x + c) / F.size(a)))


def candidates(text: Column, words: Column | None = None) -> Column:
    """array<struct<value, source, labeled, real, score>>: cleaned names, each with the first source that gave it, judged and scored.

    With words (map of words in capitals to confidences) how well a name was read counts as well. Sorted once to find equal
    names, so its cost grows as n log n with the number of candidates.
    """

    def cleaned(x: Column) -> Column:
        return let(_clean_parts(x["raw"]), lambda p: F.when(p.isNotNull(), let(F.array_join(p, " "), lambda v: judged(x, p, v))))

    def judged(x: Column, p: Column, v: Column) -> Column:
        labeled = ~x["source"].isin(*UNLABELLED)
        points = _source_points(x["source"]) + F.when(labeled, 45).otherwise(0)
        points = points if words is None else points + confidence_points(_read(p, words, False))
        return let(_sound(p, v), lambda ok: F.struct(v.alias("value"), x["source"].alias("source"), labeled.alias("labeled"), ok.alias("real"), (_looks(p, v, ok) + points).alias("score")))

    good = F.filter(F.transform(_raw(text), cleaned), lambda c: c.isNotNull() & (c["real"] | (c["source"] == "title-case")))
    return first_seen(good, lambda c: c["value"])


def ranked(text: Column, exclude: Column | None = None, words: Column | None = None) -> Column:
    """array<struct<unfit, late, minus, k, value, source, labeled, pos, real, score>>, the best first: candidates with the points of their places in the text.

    Fit are real names of 25 points or more by themselves; late marks the one that is likely the father's.
    """
    up = F.upper(text)
    at = lambda p: F.regexp_instr(up, F.lit(java(p))) - 1
    places = F.struct(up.alias("up"), at(r"FATHER'?S?\s*NAME|पिता").alias("father"), at(DOB_SHAPE).alias("dob"), at(PAN_SHAPE).alias("pan"), F.char_length(up).alias("end"), (exclude if exclude is not None else F.lit(None).cast("string")).alias("ex"))

    def of(p: Column) -> Column:
        other = lambda c: p["ex"].isNull() | ~(F.contains(c["value"], p["ex"]) | F.contains(p["ex"], c["value"]))
        found = F.transform(F.filter(candidates(text, words), other), lambda c, k: F.struct(c.alias("c"), k.alias("k"), let(F.instr(p["up"], c["value"]) - 1, lambda i: F.when(i < 0, NOWHERE).otherwise(i)).alias("pos")))
        return let(found, lambda rows: let(latest(rows, p), lambda k: F.array_sort(F.transform(rows, lambda r: judged(r, p, k)))))

    def latest(rows: Column, p: Column) -> Column:
        """The place of the candidate that is likely the father's: the last after the number, else the last before the date of birth."""
        anchor = F.when(p["father"] > 0, p["father"]).when(p["dob"] > 0, p["dob"]).otherwise(p["end"])
        after = F.filter(rows, lambda r: (p["pan"] >= 0) & (r["pos"] > p["pan"]) & (r["pos"] < anchor) & r["c"]["real"])
        before = F.filter(rows, lambda r: (p["dob"] > 0) & (r["pos"] < p["dob"]))
        last = lambda a: F.array_max(F.transform(a, lambda r: F.struct(r["pos"].alias("pos"), r["k"].alias("k"))))["k"]
        return let(F.struct(after.alias("a"), before.alias("b")), lambda s: F.when(p["father"] < 0, F.when(F.size(s["a"]) >= 2, last(s["a"])).when(F.size(s["b"]) >= 2, last(s["b"]))))

    def judged(r: Column, p: Column, late: Column) -> Column:
        c, points = r["c"], lambda when, n: F.when(when, n).otherwise(0)
        is_late = F.coalesce(r["k"] == late, F.lit(False))
        boost = (
            points((p["father"] > 0) & (r["pos"] < p["father"]), 50)
            + points((p["dob"] > 0) & (r["pos"] < p["dob"]), 25)
            + points((p["pan"] >= 0) & (r["pos"] > p["pan"]), 15)
            + points(c["value"].rlike(r"\A[A-Z]\s+[A-Z]{3,}\z"), 35)
            + points(c["source"].startswith("after-pan"), 25)
            - points(is_late, 80)
            + F.greatest(F.lit(0), 30 - F.floor(r["pos"] / 40).cast("int"))
        )
        fit = (c["score"] >= 25) & c["real"]
        return F.struct((~fit).alias("unfit"), is_late.alias("late"), (-(c["score"] + boost)).alias("minus"), r["k"].alias("k"), c["value"].alias("value"), c["source"].alias("source"), c["labeled"].alias("labeled"), r["pos"].alias("pos"), c["real"].alias("real"), c["score"].alias("score"))

    return let(places, of)


def best_name(text: Column, exclude: Column | None = None, words: Column | None = None) -> Column:
    """The candidate with the most points, the earlier one of equals, one that is likely the father's only where there is no other; null where none is a name."""
    return let(F.get(ranked(text, exclude, words), F.lit(0)), lambda x: F.when(~x["unfit"], x["value"]))


def father_name(text: Column, words: Column | None = None) -> Column:
    """The best name by the father's label; without a label, the last of two real names or more after the account number."""
    first = F.regexp_extract(text, java(FATHER, True), 1)
    start = F.regexp_instr(text, F.lit(java(FATHER, True)))
    soft = squeeze(F.upper(F.regexp_replace(first, "[^A-Za-z]+", " ")))
    rest = F.array_join(F.filter(_parts(soft), lambda p: ~is_garbage(p)), " ")
    bare = F.when((F.char_length(soft) >= 4) & ~soft.rlike(rf"\b(?:{'|'.join(STOP)})\b") & (F.char_length(rest) >= 4), rest)
    runs = find_all(F.substring(text, start, F.lit(120)), r"\b[A-Z]{2,}(?:\s+[A-Z]{1,}){0,3}\b")
    named = F.concat(F.transform(F.concat(runs, F.array(first)), clean_name), F.array(bare))

    read = lambda p: F.lit(0) if words is None else confidence_points(_read(p, words, True))

    def judged(v: Column) -> Column:
        p = _parts(v)
        return let(F.struct(p.alias("p"), _sound(p, v).alias("ok")), lambda s: F.when(s["ok"] | F.exists(s["p"], lambda x: F.char_length(x) >= 5), F.struct((-_looks(s["p"], v, s["ok"]) - read(s["p"])).alias("minus"), v.alias("v"))))

    # Of equals the first stays: its place stands before the name.
    marked = F.filter(F.transform(F.array_distinct(F.array_compact(named)), lambda v, i: let(judged(v), lambda j: F.when(j.isNotNull(), F.struct(j["minus"].alias("minus"), i.alias("i"), v.alias("v"))))), lambda x: x.isNotNull())
    return F.when(start > 0, F.array_min(marked)["v"]).otherwise(_second_name(text))


def _second_name(text: Column) -> Column:
    number = F.regexp_instr(text, F.lit(java(PAN_SHAPE, True)))
    dob = F.regexp_instr(text, F.lit(java(DOB_SHAPE)))
    window = F.substring(text, number + 10, F.when(dob > number + 10, dob - number - 10).otherwise(280))
    found = F.transform(find_all(F.upper(window), CAPITALS), lambda r: let(_clean_parts(r), lambda p: F.when(p.isNotNull(), let(F.array_join(p, " "), lambda v: F.when(_sound(p, v), v)))))
    return let(F.array_distinct(F.array_compact(found)), lambda a: F.when((number > 0) & (F.size(a) >= 2), F.try_element_at(a, F.lit(-1))))


def person_names(text: Column) -> Column:
    """The best name, then title-case runs that are names: 10 of them."""
    real = lambda r: let(_clean_parts(r), lambda p: F.when(p.isNotNull(), let(F.array_join(p, " "), lambda v: F.when(_sound(p, v), v))))
    return F.slice(unique_ci(F.concat(F.array(best_name(text)), F.transform(find_all(text, TITLE, 1), real))), 1, 10)


def fullest(*names: Column) -> Column:
    """The name with the most points for parts and length, the earlier one of equals."""
    rows = F.array_compact(F.array(*[F.when(n.isNotNull() & (n != ""), F.struct((10 * F.size(_parts(n)) + F.char_length(n)).alias("p"), F.lit(-k).alias("k"), F.upper(n).alias("n"))) for k, n in enumerate(names)]))
    return F.array_max(rows)["n"]


def word_confidence(words: DataFrame) -> DataFrame:
    """(doc_id, word, confidence): the greatest confidence of each word, in capitals and of letters only."""
    rows = words.select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("word"), "confidence").filter("word <> ''")
    return rows.groupBy("doc_id", "word").agg(F.max("confidence").alias("confidence"))


def word_map(words: DataFrame) -> DataFrame:
    """(doc_id, word_conf): word_confidence() of a document as a map, which goes with its row."""
    return word_confidence(words).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", F.col("confidence").cast("double")))).alias("word_conf"))


def name_candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: DataFrame | None = None) -> DataFrame:
    """(id_col, value, source, labeled, pos, avg_conf, score, rank): a row for each candidate of each document.

    With words (doc_id, text, confidence) the mean confidence of a name's words counts as well. A document's candidates
    are the largest group of the window.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(id_col, F.explode(ranked(t)).alias("c")).select(id_col, "c.*")
    if words is None:
        rows = rows.withColumn("avg_conf", F.lit(None).cast("double"))
    else:
        parts = rows.select(id_col, "k", F.explode(_parts(F.col("value"))).alias("word")).join(word_confidence(words).withColumnRenamed("doc_id", id_col), [id_col, "word"])
        rows = rows.join(parts.groupBy(id_col, "k").agg(F.avg("confidence").alias("avg_conf")), [id_col, "k"], "left")
    more = confidence_points(F.col("avg_conf"))
    rows = rows.withColumns({"score": F.col("score") + more, "minus": F.col("minus") - more}).withColumn("unfit", (F.col("score") < 25) | ~F.col("real"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy("unfit", "late", "minus", "k")))
    return rows.select(id_col, "value", "source", "labeled", "pos", "avg_conf", "score", "rank")
