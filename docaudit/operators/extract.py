"""Fields of each document type, and the confidence in what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.config import DEFAULT, Settings
from docaudit.functions import checks, entities, labels, names
from docaudit.functions.mrz import validate_passport
from docaudit.functions.patterns import REASONS, compact, empty_strings, find, half_up, has, let, reason, squeeze, trim
from docaudit.functions.text import SIGNATURE, STAMP
from docaudit.operators import passports
from docaudit.sources.catalog import LABELS

# Mandatory fields, optional fields, and the weights of both and of the reading.
SPECS = {
    "AADHAAR": (("name", "aadhaar"), ("dob", "yearOfBirth", "gender", "address"), (0.6, 0.25, 0.15)),
    "PAN": (("name", "pan"), ("fatherName", "dob"), (0.7, 0.2, 0.1)),
    "PASSPORT": (("passportNumber", "surname", "givenName"), ("nationality", "dateOfBirth", "dateOfExpiry", "gender", "mrz", "placeOfBirth", "dateOfIssue", "placeOfIssue", "passportType", "countryCode", "issuingAuthority", "personalNumber"), (0.5, 0.3, 0.2)),
    "CIN": (("cinNumber", "companyName"), ("incorporationDate", "registeredOfficeAddress", "roc", "authorizedCapital", "paidUpCapital", "directors"), (0.55, 0.25, 0.2)),
    "SECURITY_CLEARANCE": (("employeeName", "clearanceType"), ("clearanceNumber", "organization", "validFrom", "validUntil", "issuingAuthority", "designation"), (0.55, 0.3, 0.15)),
    "SECURITY_PROGRAMME": (("programmeTitle",), ("organizationName", "documentNumber", "version", "effectiveDate", "preparedBy", "approvedBy", "sectionHeadings"), (0.5, 0.35, 0.15)),
    "AUTHORITY_LETTER": (("authorizedPerson", "companyName"), ("letterReferenceNumber", "letterDate", "designation", "authorityDescription", "validityPeriod"), (0.55, 0.3, 0.15)),
}
#: Lengths of labelled values where they are not 120.
LENGTHS = {
    "CIN": {"cinNumber": 30, "companyName": 150, "registeredOfficeAddress": 300, "roc": 80, "companyStatus": 40, "companyCategory": 60, "companyClass": 60, "authorizedCapital": 40, "paidUpCapital": 40},
    "SECURITY_CLEARANCE": {"purpose": 200},
    "SECURITY_PROGRAMME": {"programmeTitle": 150, "version": 20, "revisionNumber": 20, "classification": 40},
    "AUTHORITY_LETTER": {"authorityDescription": 400, "contactInformation": 150, "validityPeriod": 80},
    "PASSPORT": {},
}
# The format that is checked, its field, and what is said of a good one; texts for missing fields; dates in order.
FORMATS = {
    "AADHAAR": ("aadhaarChecksum", "aadhaar", "Aadhaar checksum valid"),
    "PAN": ("panFormat", "pan", "PAN format valid"),
    "CIN": ("cinFormat", "cinNumber", "CIN format valid"),
    "PASSPORT": ("passportNumber", "passportNumber", "Passport number format valid"),
}
ISSUES = {
    "AADHAAR": (("aadhaar", "Aadhaar number not found"), ("name", "Name not found"), ("dob", "DOB missing"), ("gender", "Gender ambiguous")),
    "PAN": (("pan", "PAN number not found"), ("name", "Name not found"), ("fatherName", "Father's name not found"), ("dob", "DOB missing")),
    "PASSPORT": (("mrz", "MRZ not found"),),
}
SPANS = {
    "SECURITY_CLEARANCE": ("validFrom", "validUntil", "validFrom before validUntil", True),
    "SECURITY_PROGRAMME": ("effectiveDate", "reviewDate", "effective before review", True),
    "PASSPORT": ("dateOfIssue", "dateOfExpiry", "issue before expiry", False),
}
DATES = {"incorporationDate", "validFrom", "validUntil", "effectiveDate", "reviewDate", "letterDate", "dateOfBirth", "dateOfIssue", "dateOfExpiry"}


def _labelled(t: Column, type_: str, strict: bool = False) -> dict[str, Column]:
    """A column for each labelled field of the type."""
    out = {}
    for name, patterns in LABELS[type_].items():
        out[name] = labels.labeled_date(t, patterns) if name in DATES else labels.labeled_value(t, patterns, LENGTHS[type_].get(name, 120), strict=strict)
    return out


def _cin(t: Column) -> dict[str, Column]:
    out = _labelled(t, "CIN")
    out["cinNumber"] = F.coalesce(F.get(entities.cins(t), F.lit(0)), out["cinNumber"])
    out["registeredOfficeAddress"] = F.coalesce(entities.address_after(t, LABELS["CIN"]["registeredOfficeAddress"]), out["registeredOfficeAddress"])
    at = F.instr(F.upper(t), out["cinNumber"])
    before = F.substring(t, F.greatest(at - 200, F.lit(1)), F.greatest(F.least(at - 1, F.lit(200)), F.lit(0)))
    above = F.filter(F.transform(F.split(before, "\n", -1), trim), lambda x: (F.char_length(x) > 4) & ~has(x, r"\bCIN\b"))
    out["companyName"] = F.coalesce(out["companyName"], F.when(at > 1, F.substring(F.try_element_at(above, F.lit(-1)), 1, 150)))
    out["directors"] = labels.labeled_list(t, (r"Directors?", r"Board\s*of\s*Directors"))
    out["authorizedSignatories"] = labels.labeled_list(t, (r"Authori[sz]ed\s*Signator", r"Signator(?:y|ies)"))
    return out


def _clearance(t: Column) -> dict[str, Column]:
    out = _labelled(t, "SECURITY_CLEARANCE")
    out["clearanceType"] = F.coalesce(out["clearanceType"], F.when(has(t, r"SECURITY\s*CLEARANCE"), "Security Clearance"))
    return out | {"signaturePresence": has(t, SIGNATURE), "stampPresence": has(t, STAMP)}


def _programme(t: Column) -> dict[str, Column]:
    out = _labelled(t, "SECURITY_PROGRAMME")
    out["programmeTitle"] = F.coalesce(out["programmeTitle"], squeeze(find(t, r"([^\n]{0,80}SECURITY\s*PROGRAM(?:ME)?[^\n]{0,40})", 1)))
    return out | {"sectionHeadings": entities.headings(t), "bulletLists": entities.bullets(t), "tables": entities.table_list(t)}


def _letter(t: Column) -> dict[str, Column]:
    out = _labelled(t, "AUTHORITY_LETTER")
    out["authorityDescription"] = F.coalesce(out["authorityDescription"], squeeze(find(t, r"(?:hereby\s*(?:authorize|authorise|appoint)[^\n.]{10,300}[.])")))
    out["contactInformation"] = F.coalesce(out["contactInformation"], F.nullif(F.array_join(F.concat(entities.emails(t), entities.phones(t)), ", "), F.lit("")))
    span = F.array_compact(F.array(labels.labeled_date(t, (r"Valid\s*From",)), labels.labeled_date(t, (r"Valid\s*(?:Until|Till|To)", r"Expiry"))))
    out["validityPeriod"] = F.coalesce(out["validityPeriod"], F.nullif(F.array_join(span, " – "), F.lit("")))
    out["letterDate"] = F.coalesce(out["letterDate"], entities.normalize_date(find(t, r"(?:^|\n)\s*Date\s*[:\-]?\s*([^\n]{6,30})", 1)))
    top = F.get(F.filter(F.transform(F.split(t, "\n", -1), trim), lambda x: (F.char_length(x) > 5) & ~has(x, r"TO\s*WHOM|DATE|REF")), F.lit(0))
    out["companyName"] = F.coalesce(out["companyName"], F.substring(top, 1, 120))
    return out | {"signaturePresence": has(t, SIGNATURE), "companySealPresence": has(t, STAMP)}


def _aadhaar(t: Column, words: Column | None = None) -> dict[str, Column]:
    valid = F.filter(checks.aadhaar_candidates(t), lambda n: n.rlike(r"\A[^01]") & checks.verhoeff_ok(n))
    rest = F.substring(t, F.regexp_instr(t, F.lit("(?i)Address|पता")), F.char_length(t))
    block = F.filter(F.slice(F.split(rest, "\n", -1), 1, 6), lambda x: F.char_length(trim(x)) > 5)
    return {
        "name": names.best_name(t, words=words),
        "aadhaar": F.get(valid, F.lit(0)),
        "dob": labels.dob(t),
        "yearOfBirth": find(t, r"(?:YOB|Year of Birth)\s*[:\-]?\s*(\d{4})", 1),
        "gender": labels.gender(t),
        "address": F.when(has(t, "Address|पता") & (F.size(block) > 0), F.substring(F.array_join(block, ", "), 1, 300)),
    }


def _pan(t: Column, words: Column | None = None) -> dict[str, Column]:
    father = names.father_name(t, words)
    return {"name": names.best_name(t, father, words), "fatherName": father, "pan": F.get(checks.pan_candidates(t), F.lit(0)), "dob": labels.dob(t)}


FIELDS = {"AADHAAR": _aadhaar, "PAN": _pan, "CIN": _cin, "SECURITY_CLEARANCE": _clearance, "SECURITY_PROGRAMME": _programme, "AUTHORITY_LETTER": _letter}


def field_names(type_: str) -> list[str]:
    return list(passports.FIELDS if type_ == "PASSPORT" else FIELDS[type_](F.lit("")))


def extract_fields(df: DataFrame, type_: str, text_col: str = "text") -> DataFrame:
    """df with a column for each field of the type; a null text has none but empty lists and false flags.

    Passports are made step by step, as their fields depend on each other; a column number_texts (array of strings), if
    there is one, holds further readings of the number. A column word_conf (names.word_map()), if there is one, lets the
    confidence of their words count for names on cards.
    """
    out = df.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    if type_ == "PASSPORT":
        for step in passports.record(F.col("_t"), F.col("number_texts") if "number_texts" in df.columns else None):
            out = step(out)
        return out.select(*[c for c in df.columns if c not in passports.FIELDS], *passports.FIELDS)
    read = (F.col("word_conf"),) if type_ in ("AADHAAR", "PAN") and "word_conf" in df.columns else ()
    return out.withColumns(FIELDS[type_](F.col("_t"), *read)).drop("_t")


def _present(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if dict(df.dtypes)[name].startswith("array"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(c.cast("string") != "", F.lit(False))


def extraction_confidence(
    df: DataFrame, mandatory: tuple[str, ...], optional: tuple[str, ...], weights: tuple[float, float, float], settings: Settings = DEFAULT, formats: dict[str, tuple[Column, str, Column | str]] | None = None, consistency: dict[str, tuple[Column, Column | str]] | None = None, duplicates: Column | None = None, near_label: Column | None = None, issues: tuple[Column, ...] = ()
) -> DataFrame:
    """df with extraction_confidence, extraction_reasons, extraction_issues and below_threshold.

    formats: by name a condition, null where the check does not apply, and what is said when it holds and when it does not.
    consistency: by name a condition and what is said when it does not hold. issues: texts, null where they do not apply,
    that come before those of missing fields and wrong formats. An empty list of fields is complete; empty strings and
    lists count as missing.
    """
    have = {f: _present(df, f) for f in (*mandatory, *optional)}
    share = lambda fs: sum((have[f].cast("int") for f in fs), F.lit(0)) / len(fs) if fs else F.lit(1.0)
    conf = F.coalesce(F.col("ocr_confidence"), F.lit(0))
    wm, wo, wr = weights
    missing = compact(*[F.when(~have[f], F.lit(f)) for f in mandatory]) if mandatory else empty_strings()
    out = df.withColumns({"_m": share(mandatory), "_o": share(optional), "_r": F.least(F.greatest(conf / 100, F.lit(0.0)), F.lit(1.0)), "_missing": missing})
    score = F.col("_m") * wm * 100 + F.col("_o") * wo * 100 + F.col("_r") * wr * 100
    score = score - F.when((conf > 0) & (conf < 50), 10).otherwise(0)
    reasons = [
        reason("MISSING_MANDATORY_FIELDS", F.concat(F.lit("Missing mandatory fields: "), F.array_join("_missing", ", ")), "extraction", F.size("_missing") > 0, -half_up((1 - F.col("_m")) * wm * 100)),
        reason("MANDATORY_FIELDS_COMPLETE", "All mandatory fields extracted", "extraction", (F.size("_missing") == 0) & F.lit(bool(mandatory)), half_up(F.lit(wm * 100))),
        reason("AMBIGUOUS_OCR", F.format_string("Ambiguous OCR (confidence %d%%) reduces extraction confidence", conf), "extraction", (conf > 0) & (conf < 50), -10),
        reason("OCR_SUPPORTS_EXTRACTION", F.format_string("OCR confidence %d%% supports extraction", conf), "extraction", conf >= 70, half_up(wr * 100 * F.col("_r"))),
    ]
    said = list(issues)
    for ok, good, bad in (formats or {}).values():
        bad = F.lit(bad) if isinstance(bad, str) else bad
        score = score + F.when(ok, 2).when(~ok, -8).otherwise(0)
        reasons += [reason("INVALID_FORMAT", bad, "extraction", ~ok, -8), reason("FORMAT_VALID", good, "extraction", ok, 2)]
    wrong = [F.when(~ok, F.lit(bad) if isinstance(bad, str) else bad) for ok, _, bad in (formats or {}).values()]
    for ok, bad in (consistency or {}).values():
        score = score - F.when(~ok, 10).otherwise(0)
        reasons.append(reason("LOGICAL_INCONSISTENCY", bad, "extraction", ~ok, -10))
    if duplicates is not None:
        score = score - F.when(duplicates, 8).otherwise(0)
        reasons.append(reason("DUPLICATE_VALUES", "Duplicate extracted values detected", "extraction", duplicates, -8))
    if near_label is not None:
        score = score + F.when(near_label, 3).when(~near_label, -5).otherwise(0)
        reasons += [reason("WEAK_LABEL_PROXIMITY", "Some fields lacked nearby label anchors", "extraction", ~near_label, -5), reason("LABEL_PROXIMITY_OK", "Fields aligned with nearby labels", "extraction", near_label, 3)]
    out = out.withColumn("extraction_confidence", half_up(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))))
    out = out.withColumn("below_threshold", F.col("extraction_confidence") < settings.extraction)
    low = F.format_string(f"Extraction confidence %d%% below threshold {settings.extraction}%%", F.col("extraction_confidence"))
    reasons.append(reason("EXTRACTION_BELOW_THRESHOLD", low, "extraction", F.col("below_threshold"), 0))
    found = F.concat(F.array_compact(F.array(*said).cast("array<string>")), F.transform("_missing", lambda f: F.concat(f, F.lit(" not found"))), F.array_compact(F.array(*wrong).cast("array<string>")))
    out = out.withColumns({"extraction_reasons": compact(*reasons).cast(REASONS), "extraction_issues": F.array_distinct(found)})
    return out.drop("_m", "_o", "_r", "_missing")


def extract(df: DataFrame, type_: str, settings: Settings = DEFAULT, bag: bool = False) -> DataFrame:
    """df with the type's fields and the confidence in them; with bag, beside the entities that every type has, which the type's own fields override."""
    out = extract_fields(generic_bag(df) if bag else df, type_)
    absent = lambda field, text: F.when(~_present(out, field), F.lit(text))
    first = lambda v: F.get(v["reasons"], F.lit(0))["message"]
    formats, consistent, issues = {}, {}, ()
    if type_ in FORMATS:
        name, field, good = FORMATS[type_]
        number = F.col(field)
        v = {"CIN": lambda: checks.cin(number, settings.as_of), "AADHAAR": lambda: checks.aadhaar(number), "PAN": lambda: checks.pan(number)}.get(type_)
        ok, bad = (v()["passed"], first(v())) if v else (F.upper(number).rlike(passports.NUMBER), "Passport number format invalid")
        formats[name] = (F.when(number.isNotNull(), ok), good, bad)
    if type_ in ISSUES:
        issues = tuple(absent(field, text) for field, text in ISSUES[type_])
    if type_ in SPANS:
        a, b, label, equal = SPANS[type_]
        order = checks.date_order(F.col(a), F.col(b), label, equal)
        consistent["dateOrder"] = (F.when(~order["skipped"], order["passed"]), order["reason"])
    return extraction_confidence(out, *SPECS[type_], settings, formats, consistent, issues=issues)


def long_fields(df: DataFrame, type_: str) -> DataFrame:
    """df with fields (map of strings) and lists (map of arrays) in place of the type's own columns, so that types can be put together; tables are JSON."""
    kinds = dict(df.dtypes)
    every = [f for f in dict.fromkeys((*field_names(type_), *BAG)) if f in kinds]
    lists = [f for f in every if kinds[f] == "array<string>"]
    plain = [f for f in every if f not in lists]
    said = lambda f: F.when(F.size(f) > 0, F.to_json(f)) if kinds[f].startswith("array") else F.col(f).cast("string")
    one = F.create_map(*[x for f in plain for x in (F.lit(f), said(f))]) if plain else F.create_map().cast("map<string,string>")
    many = F.create_map(*[x for f in lists for x in (F.lit(f), F.col(f))]) if lists else F.create_map().cast("map<string,array<string>>")
    kept = F.map_filter(one, lambda k, v: v.isNotNull())
    return df.withColumns({"fields": kept, "lists": many}).drop(*every)


#: Columns of the bag.
BAG = ("fullOcrText", "names", "organizations", "dates", "addresses", "emailAddresses", "phoneNumbers", "documentNumbers", "registrationNumbers", "referenceNumbers", "qrCodes", "barcodes", "tables", "headers", "footers", "sectionHeadings", "bulletLists", "signaturePresence", "stampPresence")


def generic_bag(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with what every type has: the text, one array column for each kind of entity, tables, signature and stamp.

    Columns of these names are replaced; the fields of a type, put over them afterwards, override them, nulls too.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    bag = {
        "fullOcrText": t,
        "names": names.person_names(t),
        "organizations": entities.organizations(t),
        "dates": entities.dates(t),
        "addresses": entities.addresses(t),
        "emailAddresses": entities.emails(t),
        "phoneNumbers": entities.phones(t),
        "documentNumbers": entities.document_numbers(t),
        "registrationNumbers": entities.registration_numbers(t),
        "referenceNumbers": entities.references(t),
        "qrCodes": F.when(F.col("hasQrLikeRegion"), F.array(F.lit("detected"))).otherwise(empty_strings()) if "hasQrLikeRegion" in df.columns else empty_strings(),
        "barcodes": empty_strings(),
        "tables": entities.table_list(t),
        "headers": entities.header(t),
        "footers": entities.footer(t),
        "sectionHeadings": entities.headings(t),
        "bulletLists": entities.bullets(t),
        "signaturePresence": has(t, SIGNATURE),
        "stampPresence": has(t, STAMP),
    }
    return df.withColumns(bag)


def validate(df: DataFrame, type_: str, settings: Settings = DEFAULT) -> DataFrame:
    """df (with the type's fields) with validation (passed, checks, reasons, normalized) and validation_skipped."""
    skipped = F.lit(type_ == "AUTHORITY_LETTER")
    if type_ == "AADHAAR":
        v = checks.aadhaar(F.col("aadhaar"))
    elif type_ == "PAN":
        v = checks.pan(F.col("pan"))
    elif type_ == "CIN":
        v = checks.cin(F.col("cinNumber"), settings.as_of)
    elif type_ == "PASSPORT":
        v = validate_passport(F.col("passportNumber"), F.col("dateOfBirth"), F.col("dateOfIssue"), F.col("dateOfExpiry"), F.col("mrz"), settings.as_of)
    elif type_ == "AUTHORITY_LETTER":
        v = checks.validation(F.lit(True), F.create_map().cast("map<string,boolean>"), F.array().cast(REASONS), F.lit(None).cast("string"))
    else:
        needed, span, name = {"SECURITY_CLEARANCE": (("employeeName", "clearanceType"), ("validFrom", "validUntil"), "validFrom before validUntil"), "SECURITY_PROGRAMME": (("programmeTitle",), ("effectiveDate", "reviewDate"), "effective before review")}[type_]
        order = checks.date_order(F.col(span[0]), F.col(span[1]), name, True)
        have = {f: F.coalesce(F.col(f) != "", F.lit(False)) for f in needed}
        reasons = compact(*[reason("MISSING_MANDATORY", f"{f} is required", "validation", ~ok) for f, ok in have.items()], F.when(~order["passed"], F.struct(order["code"].alias("code"), order["reason"].alias("message"), F.lit("validation").alias("stage"), F.lit(None).cast("int").alias("impact"))))
        named = F.create_map(*[x for f, ok in have.items() for x in (F.lit(f), ok)], F.lit("dateOrder"), order["passed"])
        v = let(reasons.cast(REASONS), lambda r: checks.validation(F.size(r) == 0, named, r, F.lit(None).cast("string")))
    out = df.withColumn("validation", v).withColumn("validation_skipped", skipped)
    for field in {"AADHAAR": ("aadhaar",), "PAN": ("pan",)}.get(type_, ()):
        out = out.withColumn(field, F.coalesce("validation.normalized", field))
    return out


def validation_audit(df: DataFrame) -> DataFrame:
    """(requested_type, code, n): documents of each type, those that passed, and each reason code; with the totals of all types."""
    codes = F.concat(F.array(F.lit("ALL")), F.when(F.col("validation.passed"), F.array(F.lit("PASSED"))).otherwise(empty_strings()), F.array_distinct(F.transform("validation.reasons", lambda r: r["code"])))
    rows = df.select("requested_type", F.explode(codes).alias("code"))
    out = rows.rollup("code", "requested_type").count().filter("code IS NOT NULL")
    return out.select(F.coalesce("requested_type", F.lit("*")).alias("requested_type"), "code", F.col("count").alias("n"))
