"""Text measures, cues, presence flags, read scores and the readability gate, as columns over document rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.config import DEFAULT, Settings
from docaudit.functions.patterns import NON_SPACE, NON_SPACES, REASONS, compact, has, reason, replace, trim

# Cues; each has a pattern, and case is ignored.
CUES = {
    "hasTimestampCue": r"\b(?:JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER)\b.*\b20\d{2}\b|\bat\s+\d{1,2}:\d{2}\s*(AM|PM)?",
    "hasUiChrome": r"MEETING\s*NOTES|COPY|CLIPBOARD|TODAY'?S\s*DISCUSSION|UNTITLED|NOTES",
    "hasExplicitFake": r"FAKE\s*DOCUMENT|THIS\s*IS\s*A\s*FAKE",
    "hasJunkWords": r"\b(APPLE|ORANGE|LAPTOP|BACKEND|FASTAPI|NODEJS|HELLO\s*THIS)\b",
    "hasCamScanner": r"CAMSCANNER|SCANNED\s*BY",
    "hasGovernmentOfIndia": r"GOVERNMENT\s*OF\s*INDIA|GOVT\.?\s*OF\s*INDIA|भारत\s*सरकार",
    "hasUidai": r"UIDAI|UNIQUE\s*IDENTIFICATION|आधार|AADHAAR",
    "hasIncomeTax": r"INCOME\s*TAX|आयकर",
    "hasPanLabel": r"PERMANENT\s*ACCOUNT\s*NUMBER|\bPAN\b",
    "hasAadhaarLabel": r"AADHAAR|आधार",
    "hasNotepadCues": r"NOTEPAD|UNTITLED|LIBREOFFICE|MICROSOFT\s*WORD|\.DOCX|MEETING\s*NOTES",
    "hasScreenshotWords": r"SCREENSHOT|SNIPPING\s*TOOL|SCREEN\s*CAPTURE|STATUS\s*BAR",
}
# Words that show a signature, a stamp, a seal.
SIGNATURE = r"\bSIGNATURE\b|\bSIGNED\b|\bSD/\-|\bAUTHORI[SZ]ED\s*SIGNATORY\b|\bDIGITALLY\s*SIGNED\b"
STAMP = r"\bSTAMP\b|\bSEAL\b|\bCOMPANY\s*SEAL\b|\bOFFICIAL\s*SEAL\b|\bRUBBER\s*STAMP\b|\bEMBOSSED\b"


def _text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def n_lines(text: Column) -> Column:
    """Lines with more than white space: one match each, from the first sign on."""
    return F.regexp_count(text, F.lit(rf"{NON_SPACE}[^\n]*+"))


def _signs(t: Column) -> dict[str, Column]:
    """Counts of a trimmed text, from what is left without letters, digits and spaces: runs go at once."""
    bare = F.regexp_replace(t, "[A-Za-z0-9]+", "")
    return {"alnum_count": F.char_length(t) - F.char_length(bare), "symbol_count": F.char_length(replace(bare, r"\s+", "")), "trimmed_length": F.char_length(t)}


def text_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with word_count, line_count, alnum_count, symbol_count, trimmed_length and symbol_ratio."""
    t = F.col("_t")
    out = df.withColumn("_t", trim(_text(text_col))).withColumns({"word_count": F.regexp_count(t, F.lit(NON_SPACES)), "line_count": n_lines(t)} | _signs(t))
    return out.withColumn("symbol_ratio", F.col("symbol_count") / F.greatest("trimmed_length", F.lit(1))).drop("_t")


def cues(text: Column, upper: Column | None = None) -> dict[str, Column]:
    """The cues that text alone gives; the timestamp is a cue of a screenshot as well."""
    flags = {name: has(text, pattern, upper=upper) for name, pattern in CUES.items()}
    flags["hasScreenshotCues"] = flags.pop("hasScreenshotWords") | flags["hasTimestampCue"]
    return flags


def text_signals(df: DataFrame, text_col: str = "text", dark_ui: str | None = None) -> DataFrame:
    """df with a boolean column for each cue; a dark screen, where dark_ui names it, is a cue of a screenshot."""
    flags = cues(_text(text_col), F.col("_u"))
    if dark_ui:
        flags["hasScreenshotCues"] = flags["hasScreenshotCues"] | F.coalesce(F.col(dark_ui), F.lit(False))
    return df.withColumn("_u", F.upper(_text(text_col))).withColumns(flags).drop("_u")


def presence_flags(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with signature, stamp and seal: whether their words occur."""
    t = _text(text_col)
    return df.withColumns({"signature": has(t, SIGNATURE), "stamp": has(t, STAMP), "seal": has(t, STAMP)})


# What each pattern adds to the score of a reading, and whether case is ignored.
READ_BONUS = (
    (r"[A-Z]{5}[0-9OISB]{4}[A-Z]", 80, True),
    (r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 80, False),
    (r"\bP<[A-Z]{3}|PASSPORT|REPUBLIC\s+OF|<<<<", 70, True),
    (r"\b[A-Z]\d{7}\b", 50, True),
    (r"SURNAME|GIVEN\s*NAME|PLACE\s*OF\s*BIRTH|NATIONALITY", 25, True),
    (r"INCOME\s*TAX|GOVT\.?\s*OF\s*INDIA|GOVERNMENT\s*OF\s*INDIA|आयकर|भारत\s*सरकार", 40, True),
    (r"PERMANENT\s*ACCOUNT|AADHAAR|आधार|UIDAI|FATHER|पिता|DOB|MALE|FEMALE", 30, True),
    (r"\bNAME\b|नाम", 15, True),
    (r"\b(MALE|FEMALE)\b", 25, True),
    (r"\d{2}[/\-.]\d{2}[/\-.]\d{4}", 25, False),
    (r"\b[A-Z]{2,}(?:\s+[A-Z]{1,}){1,3}\b", 15, True),
)
# What shows that a text with a scanner's mark holds an identity number or name of an authority.
MARKED_ID = r"[A-Z]{5}[0-9OISB]{4}[A-Z]|\d{4}[\s\-]?\d{4}[\s\-]?\d{4}|INCOME|AADHAAR|GOVT|PAN|UIDAI"
READABLE = r"SECURITY|PROGRAMME|PROGRAM|CLEARANCE|CERTIFICATE|COMPANY|AUTHORITY|ORGANI[SZ]ATION|DOCUMENT|VERSION|EMPLOYEE|VALID"


#: Tokens of three signs or more, and tokens from four letters in a row on: one match each.
WIDE_TOKEN, LONG_TOKEN = f"{NON_SPACE}{{3}}{NON_SPACE}*+", f"[A-Za-z]{{4}}{NON_SPACE}*+"


def _without(text: Column, signs: str) -> Column:
    """How many signs of a class a text has: what its runs leave when they go."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"{signs}+", ""))


def _shape(text: Column) -> dict[str, Column]:
    """alnum, letters, symbols, tokens, short, long of a text, as columns: counts, and the shares of symbols and of short tokens."""
    signs, tokens = _signs(text), F.regexp_count(text, F.lit(NON_SPACES))
    return {
        "alnum": signs["alnum_count"],
        "letters": _without(text, "[A-Za-z]"),
        "symbols": signs["symbol_count"] / F.greatest(signs["trimmed_length"], F.lit(1)),
        "tokens": tokens,
        "short": (tokens - F.regexp_count(text, F.lit(WIDE_TOKEN))) / F.greatest(tokens, F.lit(1)),
        "long": F.regexp_count(text, F.lit(LONG_TOKEN)),
    }


def _points(when: Column, points: float) -> Column:
    return F.when(when, points).otherwise(0)


def ocr_read_score(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with read_score: a share of the confidence, what the patterns add, and deductions for marks, symbols, sparse and choppy text."""
    t, u, x = _text(text_col), F.col("_u"), _shape(_text(text_col))
    marked = has(t, CUES["hasCamScanner"], upper=u)
    score = 0.4 * F.coalesce(F.col("ocr_confidence"), F.lit(0))
    for pattern, points, fold in READ_BONUS:
        score = score + _points(has(t, pattern, fold, u), points)
    score = score - F.when(marked, F.when(has(t, MARKED_ID, upper=u), 10).otherwise(80)).otherwise(0)
    for when, points in ((x["symbols"] > 0.25, 40), (x["alnum"] < 20, 30), ((x["short"] > 0.55) & (x["tokens"] > 30), 35)):
        score = score - _points(when, points)
    return df.withColumn("_u", F.upper(t)).withColumn("read_score", score).drop("_u")


def readability_score(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with readability: half the confidence, letters and digits, long words and document words, less what garbles a text."""
    t, x = _text(text_col), _shape(_text(text_col))
    score = 0.5 * F.coalesce(F.col("ocr_confidence"), F.lit(0)) + 0.15 * F.least(x["alnum"], F.lit(400)) + 2 * x["long"]
    score = score - _points(x["symbols"] > 0.2, 50) - _points((x["short"] > 0.5) & (x["tokens"] > 20), 60) - _points(x["letters"] < 40, 25)
    return df.withColumn("readability", score + _points(has(t, READABLE), 35))


def weak_reads(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df (with read_score) with weak_read and needs_retry."""
    alnum, conf = _signs(_text(text_col))["alnum_count"], F.coalesce(F.col("ocr_confidence"), F.lit(0))
    return df.withColumns({"weak_read": (alnum < 40) | (F.col("read_score") < 50) | (conf < 45), "needs_retry": (alnum < 40) | ((conf < 20) & (alnum < 80))})


def ocr_gate(df: DataFrame, settings: Settings = DEFAULT, text_col: str = "text", blur_col: str | None = None) -> DataFrame:
    """df with gate_passed, gate_reasons and gate_warnings; without a blur nothing is judged by it. Null text is empty."""
    s, t = settings, trim(_text(text_col))
    conf = F.coalesce(F.col("ocr_confidence"), F.lit(0))
    blur = F.col(blur_col) if blur_col else F.lit(None).cast("double")
    signs = _signs(F.col("_t"))
    alnum, symbols = signs["alnum_count"], signs["symbol_count"] / F.greatest(signs["trimmed_length"], F.lit(1))
    reasons = compact(
        reason("OCR_TEXT_EMPTY", "OCR produced no readable text", "ocr", F.col("_t") == ""),
        reason("OCR_CONFIDENCE_LOW", F.format_string(f"OCR confidence %d%% below threshold {s.ocr_confidence}%%", conf.cast("int")), "ocr", conf < s.ocr_confidence),
        reason("OCR_ALNUM_LOW", F.format_string(f"OCR text too sparse (%d alphanumeric chars; need ≥ {s.ocr_min_alnum})", F.col("_a")), "ocr", F.col("_a") < s.ocr_min_alnum),
        reason("OCR_EXCESSIVE_BLUR", "Excessive blur combined with low OCR confidence", "ocr", (blur < s.ocr_blur) & (conf < s.ocr_confidence + 15)),
    )
    warnings = compact(
        F.when(blur < s.ocr_blur, F.format_string(f"Image blur is high (Laplacian variance %.1f < {s.ocr_blur:g})", blur)),
        F.when((symbols > 0.35) & (conf < 55), F.lit("High symbol-to-text ratio suggests noisy OCR")),
    )
    out = df.withColumn("_t", t).withColumn("_a", alnum).withColumns({"gate_reasons": reasons.cast(REASONS), "gate_warnings": warnings})
    return out.withColumn("gate_passed", F.size("gate_reasons") == 0).drop("_t", "_a")


def normalize_reasons(messages: Column, stage: str) -> Column:
    """Reasons from an array of strings; null ones are left out."""
    kept = F.filter(messages, lambda m: m.isNotNull())
    return F.transform(kept, lambda m: F.struct(F.lit("REASON").alias("code"), m.alias("message"), F.lit(stage).alias("stage"), F.lit(None).cast("int").alias("impact"))).cast(REASONS)
