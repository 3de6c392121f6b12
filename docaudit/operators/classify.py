"""Type-fit classification: every type is scored on each document in one narrow step, ranked, and judged against the requested one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.config import DEFAULT, Settings
from docaudit.functions import checks, entities
from docaudit.functions.patterns import REASONS, compact, empty_strings, exploded, half_up, has, let, reason, replace
from docaudit.functions.text import cues
from docaudit.sources.catalog import POSITION, RULES, TYPES

SCORE = "struct<type:string,position:int,score:int,signals:array<string>,reasons:array<struct<code:string,message:string,stage:string,impact:int>>>"
STAGE = "classification"


def _score(type_: str, points: Column, signals: Column, messages: Column) -> Column:
    reasons = F.transform(messages, lambda m: F.struct(F.lit("SIGNAL_MATCH").alias("code"), m.alias("message"), F.lit(STAGE).alias("stage"), F.lit(None).cast("int").alias("impact")))
    return F.struct(F.lit(type_).alias("type"), F.lit(POSITION[type_]).alias("position"), F.least(points, F.lit(100)).cast("int").alias("score"), signals.cast("array<string>").alias("signals"), reasons.alias("reasons")).cast(SCORE)


def _hits(rules: list[tuple[str | None, Column, int, str]]) -> Column:
    """Rules (signal, condition, points, message) that hold, as an array of structs."""
    return compact(*[F.when(when, F.struct(F.lit(signal).cast("string").alias("signal"), F.lit(points).alias("points"), F.lit(text).alias("text"))) for signal, when, points, text in rules])


def _total(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda a, h: a + h["points"])


def _signals(hits: Column) -> Column:
    return F.array_compact(F.transform(hits, lambda h: h["signal"]))


def _texts(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["text"])


def _cased(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with _t, the text without null, and _u, that in upper case, once for all patterns."""
    return df.withColumn("_t", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_u", F.upper("_t"))


def _has(t: Column, pattern: str, ignore_case: bool = True) -> Column:
    return has(t, pattern, ignore_case, F.col("_u"))


def keyword_scores(text: Column, type_: str, upper: Column | None = None, instead: dict[str, Column] | None = None) -> Column:
    """Each rule of the type that matches adds its points once, to 100 at most. instead: by signal, what its rule reads in place of text."""
    hits = _hits([(signal, has((instead or {}).get(signal, text), pattern, fold, upper), points, label) for signal, pattern, points, label, fold in RULES[type_]])
    return let(hits, lambda h: _score(type_, _total(h), _signals(h), _texts(h)))


def keyword_scores_long(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", types: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """(id_col, type, score, labels, signals, match_count) for each document and each of types; the rules of others are not tried."""
    each = F.array(*[keyword_scores(F.col("_t"), t, F.col("_u")) for t in types])
    out = _cased(df, text_col).select(id_col, F.explode(each).alias("s"))
    return out.select(id_col, "s.type", "s.score", F.transform("s.reasons", lambda r: r["message"]).alias("labels"), "s.signals", F.size("s.reasons").alias("match_count"))


#: A table of patterns may have so many rows: each becomes a condition of one projection.
MOST_RULES = 1_000


def rule_hits(df: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, and the other columns of rules): a row for each document and each row of rules (pattern, ignore_case, ...) that it matches.

    Rules are a catalogue, not data: its few dozen patterns become literals, compiled once for each task, and documents meet
    them in one narrow step, without a join. More than MOST_RULES are refused.
    """
    known = rules.limit(MOST_RULES + 1).collect()
    if len(known) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    also = [c for c in rules.columns if c not in ("pattern", "ignore_case")]
    kinds = dict(rules.dtypes)
    hits = [F.when(has(F.col("_t"), r["pattern"], bool(r["ignore_case"]), F.col("_u")), F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in also])) for r in known]
    if not hits:
        return df.select(id_col, *[F.lit(None).cast(kinds[c]).alias(c) for c in also]).limit(0)
    return exploded(_cased(df, text_col), compact(*hits), (id_col,)).select(id_col, "item.*")


def _refused(type_: str, message: str) -> Column:
    return _score(type_, F.lit(0), F.array(F.lit("wrongDocType")), F.array(F.lit(message)))


def _aadhaar(t: Column, c: dict[str, Column], qr: Column) -> Column:
    other = _has(t, r"\bPASSPORT\b|P<[A-Z]{3}|SURNAME|GIVEN\s*NAME|DATE\s*OF\s*EXPIRY|<{3,}|\bPERMANENT\s*ACCOUNT|\bPAN\b|INCOME\s*TAX")
    keyword = c["hasAadhaarLabel"] | _has(t, r"AADHA+R|AADHAR")
    uidai = c["hasUidai"] | _has(t, r"UNIQUE\s*ID")

    def judged(numbers: Column) -> Column:
        valid = F.exists(numbers, lambda n: n.rlike(r"\A[^01]") & checks.verhoeff_ok(n))
        rules = [
            ("aadhaarKeyword", keyword, 30, "Matched Aadhaar / आधार keyword"),
            ("uidai", uidai, 25, "Matched UIDAI / Unique ID"),
            ("goi", c["hasGovernmentOfIndia"], 20, "Matched Government of India"),
            ("validAadhaar", valid, 45, "Valid Aadhaar number pattern + Verhoeff checksum"),
            ("aadhaarCandidate", ~valid & (F.size(numbers) > 0) & (keyword | uidai), 20, "12-digit candidate near Aadhaar keywords"),
            (None, _has(t, r"DOB|DATE\s*OF\s*BIRTH|YOB|\d{2}[/\-.]\d{2}[/\-.]\d{4}"), 10, "Matched DOB / YOB field"),
            (None, _has(t, r"MALE|FEMALE|TRANSGENDER"), 5, "Matched gender token"),
            ("qrLike", qr, 5, "QR-like region detected"),
        ]
        return let(_hits(rules), lambda h: _score("AADHAAR", F.when(valid, F.greatest(_total(h), F.lit(40))).otherwise(_total(h)), _signals(h), _texts(h)))

    return F.when(other, _refused("AADHAAR", "Strong non-Aadhaar document signals (passport/PAN) — rejecting Aadhaar match")).otherwise(let(checks.aadhaar_candidates(t), judged))


def _pan(t: Column, c: dict[str, Column], qr: Column, photo: Column) -> Column:
    other = _has(t, r"\bPASSPORT\b|P<[A-Z]{3}|SURNAME|GIVEN\s*NAME|<{3,}|\bAADHA+R\b|आधार|UIDAI")

    def judged(pans: Column) -> Column:
        found = F.size(pans) > 0
        rules = [
            ("panKeyword", c["hasPanLabel"] | _has(t, r"PERMANENT\s*ACCOUNT|P[A4]N\b|PERM[A4]NENT"), 35, "Matched Permanent Account Number / PAN keyword"),
            ("incomeTax", c["hasIncomeTax"] | _has(t, r"INC[O0]ME|1NC[O0]ME"), 30, "Matched Income Tax Department"),
            ("goi", c["hasGovernmentOfIndia"], 15, "Matched Government of India"),
            ("panRegex", found, 50, "Matched PAN regex"),
            ("panFuzzy", ~found & _has(t, r"[A-Z]{5}\s*[0-9OISB]{4}\s*[A-Z]"), 30, "Matched fuzzy PAN pattern"),
            (None, _has(t, r"FATHE|पिता"), 10, "Matched Father's Name field"),
            (None, qr | photo, 10, "Photo / QR-like region detected"),
            (None, c["hasCamScanner"] & found, 10, "CamScanner + PAN pattern"),
        ]
        named = lambda h: F.transform(_texts(h), lambda x: F.when(x == "Matched PAN regex", F.concat(x, F.lit(" ("), F.get(pans, F.lit(0)), F.lit(")"))).otherwise(x))
        return let(_hits(rules), lambda h: _score("PAN", F.when(found, F.greatest(_total(h), F.lit(40))).otherwise(_total(h)), _signals(h), named(h)))

    return F.when(other, _refused("PAN", "Strong non-PAN document signals — rejecting PAN match")).otherwise(let(checks.pan_candidates(t), judged))


def _noted(s: Column, when: Column, text: str | Column, points: Column | None = None, signal: str | None = None) -> Column:
    """s with one more message, and points and a signal, where `when` holds."""
    text = F.lit(text) if isinstance(text, str) else text
    row = F.struct(F.lit("SIGNAL_MATCH").alias("code"), text.alias("message"), F.lit(STAGE).alias("stage"), F.lit(None).cast("int").alias("impact"))
    more = F.struct(
        s["type"].alias("type"),
        s["position"].alias("position"),
        (s["score"] if points is None else F.least(points, F.lit(100))).cast("int").alias("score"),
        (s["signals"] if signal is None else F.array_distinct(F.concat(s["signals"], F.array(F.lit(signal))))).alias("signals"),
        F.concat(s["reasons"], F.array(row)).alias("reasons"),
    ).cast(SCORE)
    return F.when(when, more).otherwise(s)


#: An account number whose letters hold those of the zone's label.
_MRZ_IN_PAN = rf"\b(?=[A-Z0]{{0,2}}MRZ){checks.PAN_ANY}\b"


def _passport(t: Column) -> Column:
    """A zone's label that is a part of an account number tells of no passport."""
    layout = (has(F.col("_u"), r"\bP<[A-Z]{3}", False, F.col("_u")) | _has(t, r"\b[PO]\s+IND\b"))
    base = keyword_scores(t, "PASSPORT", F.col("_u"), {"mrzLabel": replace(t, _MRZ_IN_PAN, "", True)})
    one = lambda s: _noted(s, layout & ~F.array_contains(s["signals"], "mrzHeader"), "Matched passport type / IND layout cue", s["score"] + 15, "indLayout")
    two = lambda s: _noted(s, _has(t, r"Sumame|Surname|Given\s*Name") & ~F.array_contains(s["signals"], "fieldLabels"), "Matched surname / given name layout", s["score"] + 10)
    few = lambda n: lambda s: _noted(s, (n < 2) & (s["score"] < 40), "Insufficient independent passport signals")
    return let(base, lambda b: let(let(let(b, one), two), few(F.size(b["reasons"]))))


def _cin(t: Column) -> Column:
    def judged(found: Column):
        first = F.concat(F.lit("Matched CIN number ("), F.get(found, F.lit(0)), F.lit(")"))
        one = lambda s: _noted(s, F.size(found) > 0, first, F.greatest(s["score"], F.lit(40)), "cinNumber")
        few = lambda n: lambda s: _noted(s, (n < 2) & ~F.arrays_overlap(s["signals"], F.array(F.lit("cinRegex"), F.lit("cinNumber"))), "Fewer than 2 independent CIN signals")
        return let(keyword_scores(t, "CIN", F.col("_u")), lambda b: let(let(b, one), few(F.size(b["reasons"]))))

    return let(entities.cins(t), judged)


def _context(df: DataFrame, settings: Settings) -> list[tuple[str, int, str, Column, Column, Column]]:
    """What the context of a document adds, in this order: (signal, points, code, condition, message, detail).

    df has ocr_confidence, and may have hasPhotoLikeRegion, hasQrLikeRegion, logo_matches (array of names) and aspect_ratio.
    """
    s, conf = settings, F.coalesce(F.col("ocr_confidence"), F.lit(0)).cast("int")
    ratio = F.col("aspect_ratio") if "aspect_ratio" in df.columns else F.lit(None).cast("double")
    logos = F.array_join(F.slice("logo_matches", 1, 2), ", ") if "logo_matches" in df.columns else F.lit("")
    read, w = F.format_string("OCR %d%%", conf), settings.context
    rows = [
        ("highOcrConfidence", "HIGH_OCR_CONFIDENCE", conf >= s.high_ocr, F.format_string("OCR confidence %d%% supports classification", conf), read),
        ("lowOcrConfidence", "LOW_OCR_CONFIDENCE", (conf > 0) & (conf < s.low_ocr), F.format_string("Low OCR confidence %d%% reduces classification confidence", conf), read),
        ("photoLayout", "PHOTO_LAYOUT", _flag(df, "hasPhotoLikeRegion"), F.lit("Photo-like region detected (layout cue)"), F.lit("photo region")),
        ("qrLayout", "QR_LAYOUT", _flag(df, "hasQrLikeRegion"), F.lit("QR-like region detected (layout cue)"), F.lit("QR region")),
        ("logoDetected", "LOGO_DETECTED", F.coalesce(F.size("logo_matches") > 0, F.lit(False)) if "logo_matches" in df.columns else F.lit(False), F.concat(F.lit("Logo match: "), logos), logos),
        ("cardAspect", "CARD_ASPECT", F.coalesce((ratio > 1.3) & (ratio < 1.9), F.lit(False)), F.lit("Document aspect ratio consistent with ID card"), F.format_string("ratio %.2f", ratio)),
    ]
    return [(name, w[name], *rest) for name, *rest in rows]


def _context_hits(df: DataFrame, settings: Settings) -> Column:
    return compact(*[F.when(when, F.struct(F.lit(name).alias("signal"), F.lit(points).alias("points"), F.lit(code).alias("code"), text.alias("text"), detail.alias("detail"))) for name, points, code, when, text, detail in _context(df, settings)])


def context_adjust(score: Column, added: Column) -> Column:
    """A type's score after what the document's context adds, kept within 0 to 100 after each; each one is a signal and a reason."""
    bound = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(100))
    # Only what is subtracted is bounded below, and what is added above, until the end.
    points = F.aggregate(added, score["score"].cast("int"), lambda x, s: F.when(s["points"] < 0, F.greatest(x + s["points"], F.lit(0))).otherwise(F.least(x + s["points"], F.lit(100))), bound)
    more = F.transform(added, lambda s: F.struct(s["code"].alias("code"), s["text"].alias("message"), F.lit(STAGE).alias("stage"), F.lit(None).cast("int").alias("impact")))
    return F.struct(score["type"].alias("type"), score["position"].alias("position"), points.alias("score"), F.concat(score["signals"], F.transform(added, lambda s: s["signal"])).alias("signals"), F.concat(score["reasons"], more).alias("reasons")).cast(SCORE)


def score_only(type_: str, label: str, points: Column, position: int) -> Column:
    """The score of a type that is judged elsewhere and gives a number alone: no signals, and a reason if it is above 0; null counts as 0."""
    said = F.array_compact(F.array(reason("IDENTIFY_SCORE", F.format_string(f"{label} identify score %d", points.cast("int")), STAGE, points > 0)))
    return F.struct(F.lit(type_).alias("type"), F.lit(position).alias("position"), F.coalesce(points.cast("int"), F.lit(0)).alias("score"), empty_strings().alias("signals"), said.cast(REASONS).alias("reasons")).cast(SCORE)


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def score_types(df: DataFrame, settings: Settings = DEFAULT, text_col: str = "text", more: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """df with type_scores: a struct for each type, best first, ties in catalogue order. No shuffle; works on streams.

    Columns of the context are those of _context(). Null text is empty. more: further types by name, each with a label and a
    column of points, which come after the catalogue's.
    """
    t = F.col("_t")
    c = cues(t, F.col("_u"))
    photo, qr = _flag(df, "hasPhotoLikeRegion"), _flag(df, "hasQrLikeRegion")
    base = [_aadhaar(t, c, qr), _pan(t, c, qr, photo), _passport(t), _cin(t), *[keyword_scores(t, x, F.col("_u")) for x in ("SECURITY_CLEARANCE", "SECURITY_PROGRAMME", "AUTHORITY_LETTER")]]
    base += [score_only(name, label, points, len(TYPES) + k) for k, (name, (label, points)) in enumerate((more or {}).items())]
    adjusted = let(_context_hits(df, settings), lambda a: F.transform(F.array(*base), lambda s: context_adjust(s, a)))
    order = F.array_sort(F.transform(adjusted, lambda s: F.struct((-s["score"]).alias("o"), s["position"].alias("p"), s.alias("s"))))
    return _cased(df, text_col).withColumn("type_scores", F.transform(order, lambda x: x["s"])).drop("_t", "_u")


def type_scores_long(df: DataFrame, id_col: str = "doc_id", settings: Settings = DEFAULT) -> DataFrame:
    """(id_col, type, score, rank) for every type."""
    out = exploded(score_types(df, settings), F.col("type_scores"), (id_col,))
    return out.select(id_col, "item.type", "item.score", (F.col("pos") + 1).alias("rank"))


def _verdict(asked: Column, wanted: Column, best: Column, s: Settings) -> dict[str, Column]:
    """How the score of the type asked for stands beside the best one: enough signals, a better type, a mismatch, refused outright, and whether it fits."""
    score = wanted["score"]
    enough = (F.size(F.filter(F.array_distinct(wanted["signals"]), lambda x: x != "wrongDocType")) >= s.min_signals) | (score >= s.decisive_score)
    fits = (score >= s.type_fit) & enough
    other = (best["type"] != asked) & (best["score"] >= s.type_fit)
    mismatch = fits & other & (best["score"] >= score + s.mismatch_margin)
    wrong = F.array_contains(wanted["signals"], "wrongDocType")
    return {"enough": enough, "other": other, "mismatch": mismatch, "wrong": wrong, "fits": fits & ~mismatch & ~wrong}


def _score_of(asked: Column) -> Column:
    """The score of a type among type_scores, null without one."""
    return F.get(F.filter("type_scores", lambda x: x["type"] == asked), F.lit(0))


def classify(df: DataFrame, settings: Settings = DEFAULT, more: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """df (with requested_type) with type_scores, classified, document_type, classification_confidence, class_reasons, signals, best_type.

    An unknown requested type scores 0 and never fits. more: further types, as for score_types().
    """
    return judge_type(score_types(df, settings, more=more), settings, tuple(more or {}))


def judge_type(out: DataFrame, settings: Settings = DEFAULT, more: tuple[str, ...] = ()) -> DataFrame:
    """classify() of rows that have type_scores; more: names of further types."""
    s = settings
    none = F.struct(F.col("requested_type").alias("type"), F.lit(99).alias("position"), F.lit(0).alias("score"), empty_strings().alias("signals"), F.array().cast(REASONS).alias("reasons")).cast(SCORE)
    out = out.withColumn("_r", F.coalesce(_score_of(F.col("requested_type")), none)).withColumn("_b", F.get("type_scores", F.lit(0)))
    score, best = F.col("_r.score"), F.col("_b.score")
    v = _verdict(F.col("requested_type"), F.col("_r"), F.col("_b"), s)
    enough, other, mismatch, wrong = (v[k] for k in ("enough", "other", "mismatch", "wrong"))
    out = out.withColumn("classified", v["fits"])
    failed = ~F.col("classified")
    # What was said before decides whether the threshold is mentioned as well.
    said = F.exists("_r.reasons", lambda r: has(r["message"], r"below threshold|mismatch|rejected|INSUFFICIENT|LAYOUT|WRONG")) | ((score >= s.type_fit) & ~enough) | mismatch
    names = [*[t[0] for t in TYPES], *more]
    said_more = compact(
        reason("INSUFFICIENT_SIGNALS", f"Classification rejected: fewer than {s.min_signals} independent signals (avoid single-keyword guess)", STAGE, (score >= s.type_fit) & ~enough),
        reason("LAYOUT_MISMATCH", F.format_string("Document type mismatch: stronger match for %s (score %d) than requested %s (%d)", F.col("_b.type"), best, F.col("requested_type"), score), STAGE, mismatch),
        reason("WRONG_DOC_TYPE", "Hard negative signals indicate a different document type", STAGE, wrong),
        reason("BELOW_THRESHOLD", F.format_string(f"Classification confidence %d below threshold {s.type_fit} for %s", score, F.col("requested_type")), STAGE, failed & ~said),
        reason("BETTER_ALTERNATIVE", F.format_string("Stronger match for %s (score %d) than requested %s", F.col("_b.type"), best, F.col("requested_type")), STAGE, failed & other),
        reason("INSUFFICIENT_MATCHING_SIGNALS", "Insufficient matching keywords / layout / ID patterns", STAGE, failed & (best < s.type_fit)),
    )
    return out.withColumns(
        {
            "document_type": F.when(F.col("classified") & F.col("requested_type").isin(names), F.col("requested_type")).otherwise("UNKNOWN"),
            "classification_confidence": score,
            "class_reasons": F.concat("_r.reasons", said_more.cast(REASONS)),
            "signals": F.col("_r.signals"),
            "best_type": F.col("_b.type"),
        }
    ).drop("_r", "_b")


def matched_signals(df: DataFrame, id_col: str = "doc_id", settings: Settings = DEFAULT) -> DataFrame:
    """(id_col, pos, id, weight, matched, detail): a row for each distinct signal of the classified rows of df.

    A type's own signals weigh 1 and have the first message that names them, else their name; those of the context, which
    come last, weigh what they add and have a detail of their own.
    """
    context = _context_hits(df, settings)
    own = F.filter(F.array_distinct("signals"), lambda x: ~x.isin(*settings.context))
    named = lambda x: F.get(F.filter(F.transform("class_reasons", lambda r: r["message"]), lambda m: F.contains(F.lower(m), F.lower(x))), F.lit(0))
    rows = F.concat(
        F.transform(own, lambda x: F.struct(x.alias("id"), F.lit(1.0).alias("weight"), F.coalesce(named(x), x).alias("detail"))),
        F.transform(context, lambda s: F.struct(s["signal"].alias("id"), s["points"].cast("double").alias("weight"), s["detail"].alias("detail"))),
    )
    return exploded(df, rows, (id_col,)).select(id_col, "pos", "item.id", "item.weight", F.lit(True).alias("matched"), "item.detail")


def matched_keywords(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, keywords): the messages of the classified rows of df that tell of keywords, patterns or cues."""
    return df.select(id_col, F.filter(F.transform("class_reasons", lambda r: r["message"]), lambda m: has(m, "keyword|matched|regex|pattern|logo|layout|mrz|pan|aadhaar|cin")).alias("keywords"))


def top_reasons(df: DataFrame, id_col: str = "doc_id", most: int = 5) -> DataFrame:
    """(id_col, type, reasons): the first reasons of each type's score."""
    out = exploded(df, F.col("type_scores"), (id_col,))
    return out.select(id_col, "item.type", F.slice("item.reasons", 1, most).alias("reasons"))


#: Types that a document without one is tried as, in order, and the confidence at which a completed try ends the search.
TRIES, SETTLED = ("PASSPORT", "PAN", "AADHAAR", "CIN"), 50


def _settle(a: Column) -> Column:
    """struct<x, tried>: the attempt that is taken of an array of them (try_pos, type, status, confidence) in their order, and how many were made."""
    done = lambda x: x["status"] == "completed"

    def taken(t: Column) -> Column:
        first = F.get(t, F.lit(0))
        best = F.array_max(F.transform(F.filter(t, lambda x: done(x) & (x["confidence"] >= first["confidence"])), lambda x: F.struct(x["confidence"].alias("c"), x["try_pos"].alias("t"), x.alias("x"))))
        return F.struct(F.coalesce(best["x"], first).alias("x"), F.size(t).alias("tried"))

    stop = F.filter(F.transform(a, lambda x, i: F.when(done(x) & (x["confidence"] >= SETTLED), i + 1)), lambda x: x.isNotNull())
    return let(F.slice(a, F.lit(1), F.coalesce(F.get(stop, F.lit(0)), F.size(a))), taken)


def resolve_unknown_type(attempts: DataFrame) -> DataFrame:
    """(doc_id, type, status, confidence, tried) chosen from attempts (doc_id, try_pos, type, status, confidence) in their order.

    A completed attempt of confidence SETTLED or more ends the search. The first attempt is taken, unless a completed one is
    at least as confident: then of those the most confident, the last of equals. A null confidence is 0. A document's
    attempts are few.
    """
    said = F.struct("try_pos", "type", "status", F.coalesce("confidence", F.lit(0)).alias("confidence"))
    rows = attempts.groupBy("doc_id").agg(F.array_sort(F.collect_list(said)).alias("a"))
    return rows.withColumn("s", _settle(F.col("a"))).select("doc_id", "s.x.type", "s.x.status", "s.x.confidence", "s.tried")


def try_types(df: DataFrame, readable: Column, tries: tuple[str, ...] = TRIES, settings: Settings = DEFAULT) -> DataFrame:
    """df (with type_scores) with requested_type, the type that resolve_unknown_type() takes when a row is tried as one type after the other, and tried. No shuffle.

    An attempt completes where the row is readable and fits the type; one that is not readable has no confidence.
    """

    def attempt(k: int, t: str) -> Column:
        fits = let(_score_of(F.lit(t)), lambda r: _verdict(F.lit(t), r, F.get("type_scores", F.lit(0)), settings)["fits"])
        return F.struct(F.lit(k).alias("try_pos"), F.lit(t).alias("type"), F.when(readable & fits, "completed").otherwise("stopped").alias("status"), F.coalesce(F.when(readable, _score_of(F.lit(t))["score"]), F.lit(0)).alias("confidence"))

    out = df.withColumn("_a", F.array(*[attempt(k, t) for k, t in enumerate(tries)])).withColumn("_s", _settle(F.col("_a")))
    return out.withColumns({"requested_type": F.col("_s.x.type"), "tried": F.col("_s.tried")}).drop("_a", "_s")
