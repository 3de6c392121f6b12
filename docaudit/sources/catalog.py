"""Catalogues as data: document types, identification rules, field labels, confidence specs, detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Type, slug, label, mode, supports validation; the order decides ties.
TYPES = (
    ("AADHAAR", "aadhaar", "Aadhaar Card", "verification", True),
    ("PAN", "pan", "PAN Card", "verification", True),
    ("PASSPORT", "passport", "Passport", "extraction", True),
    ("CIN", "cin", "CIN Document", "extraction", True),
    ("SECURITY_CLEARANCE", "security-clearance", "Security Clearance", "extraction", True),
    ("SECURITY_PROGRAMME", "security-programme", "Security Programme", "extraction", True),
    ("AUTHORITY_LETTER", "authority-letter", "Authority Letter", "extraction", False),
)
POSITION = {t[0]: k for k, t in enumerate(TYPES)}

# Signal, pattern, score, label, ignores case.
RULES = {
    "PASSPORT": (
        ("passportKeyword", r"\bPASSPORT\b", 35, "Matched PASSPORT keyword", True),
        ("republic", r"REPUBLIC\s+OF", 15, "Matched REPUBLIC OF", True),
        ("mrzHeader", r"\bP<[A-Z]{3}", 40, "Matched MRZ header (P<xxx)", False),
        ("mrzFiller", r"<<<<", 20, "Matched MRZ filler (<)", False),
        ("mrzLabel", r"MACHINE\s*READABLE|MRZ", 15, "Matched MRZ / machine-readable", True),
        ("fieldLabels", r"SURNAME|GIVEN\s*NAME|DATE\s*OF\s*EXPIRY|PLACE\s*OF\s*BIRTH", 10, "Matched passport field labels", True),
        ("passportNumber", r"\b[A-Z]\d{7}\b", 15, "Matched passport number pattern", False),
    ),
    "CIN": (
        ("cinKeyword", r"\bCIN\b|Corporate\s*Identity\s*Number", 40, "Matched CIN keyword", True),
        ("roc", r"Registrar\s*of\s*Companies|\bROC\b", 25, "Matched ROC", True),
        ("mca", r"\bMCA\b|Ministry\s*of\s*Corporate\s*Affairs", 20, "Matched MCA", True),
        ("coi", r"Certificate\s*of\s*Incorporation", 30, "Matched Certificate of Incorporation", True),
        ("capital", r"Authorized\s*Capital|Paid[\-\s]?up\s*Capital", 15, "Matched capital fields", True),
        ("cinRegex", r"\b[UL]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}\b", 45, "Matched CIN regex", False),
    ),
    "SECURITY_CLEARANCE": (
        ("clearanceTitle", r"SECURITY\s*CLEARANCE", 45, "Matched SECURITY CLEARANCE", True),
        ("clearanceKind", r"CLEARANCE\s*(?:CERTIFICATE|LETTER|LEVEL)", 30, "Matched clearance certificate/letter/level", True),
        ("clearanceMeta", r"CLEARANCE\s*(?:TYPE|NUMBER|NO)", 20, "Matched clearance type/number", True),
        ("validity", r"VALID\s*(?:FROM|UNTIL|TILL)", 10, "Matched validity dates", True),
        ("issuer", r"ISSUING\s*AUTHORITY", 10, "Matched issuing authority", True),
    ),
    "SECURITY_PROGRAMME": (
        ("programmeTitle", r"SECURITY\s*PROGRAM(?:ME)?", 45, "Matched SECURITY PROGRAMME", True),
        ("aviation", r"AVIATION\s*SECURITY|AIRPORT\s*SECURITY\s*PROGRAM", 30, "Matched aviation/airport security", True),
        ("docControl", r"DOCUMENT\s*(?:CONTROL|NUMBER)|REVISION\s*(?:NUMBER|NO)", 15, "Matched document control fields", True),
        ("approvals", r"PREPARED\s*BY|REVIEWED\s*BY|APPROVED\s*BY", 15, "Matched approval workflow labels", True),
        ("dates", r"EFFECTIVE\s*DATE|REVIEW\s*DATE", 10, "Matched effective/review dates", True),
        ("classification", r"CLASSIFICATION|CONFIDENTIAL|RESTRICTED", 8, "Matched classification marking", True),
    ),
    "AUTHORITY_LETTER": (
        ("signatory", r"AUTHORI[SZ]ED\s*SIGNATORY", 40, "Matched authorised signatory", True),
        ("authorityLetter", r"AUTHORITY\s*(?:LETTER|TO\s*SIGN)", 35, "Matched authority letter", True),
        ("formal", r"TO\s*WHOM\s*IT\s*MAY\s*CONCERN", 20, "Matched formal letter salutation", True),
        ("authorize", r"hereby\s*(?:authorize|authorise|appoint)", 25, "Matched authorize/appoint language", True),
        ("behalf", r"sign(?:ing)?\s*(?:on\s*)?behalf", 20, "Matched signing on behalf", True),
        ("poa", r"power\s*of\s*attorney", 15, "Matched power of attorney", True),
    ),
}

# Labels of each field in the order they are tried; case is ignored.
LABELS = {
    "PASSPORT": {
        "passportNumber": (r"Passport\s*No\.?", r"Passport\s*Number", r"Document\s*No\.?"),
        "passportType": (r"Type\s*[/\\]?\s*Type", r"^\s*Type\b", r"Document\s*Type", r"\bType\b"),
        "countryCode": (r"Country\s*Code", r"Code\s*of\s*Issuing", r"\bCode\b"),
        "nationality": (r"Nationality", r"INDIAN"),
        "surname": (r"Surname", r"Sumame", r"Last\s*Name"),
        "givenName": (r"Given\s*Name", r"First\s*Name", r"Given\s*Names"),
        "dateOfBirth": (r"Date\s*of\s*Birth", r"\bDOB\b"),
        "placeOfBirth": (r"Place\s*of\s*Birth",),
        "gender": (r"Sex\b", r"Gender"),
        "dateOfIssue": (r"Date\s*of\s*I(?:ss|bs)sue", r"Date\s*of\s*Issuance"),
        "dateOfExpiry": (r"Date\s*of\s*Expiry", r"Date\s*of\s*Expiration", r"Valid\s*Until"),
        "placeOfIssue": (r"Place\s*of\s*I(?:ss|bs)sue", r"Place\s*of\s*Issuance"),
        "issuingAuthority": (r"Issuing\s*Authority",),
        "personalNumber": (r"Personal\s*No\.?", r"Personal\s*Number"),
    },
    "CIN": {
        "cinNumber": (r"\bCIN\b", r"Corporate\s*Identity\s*Number"),
        "companyName": (r"Company\s*Name", r"Name\s*of\s*(?:the\s*)?Company"),
        "registrationNumber": (r"Registration\s*Number", r"Registration\s*No\.?"),
        "incorporationDate": (r"Date\s*of\s*Incorporation", r"Incorporation\s*Date"),
        "registeredOfficeAddress": (r"Registered\s*Office", r"Registered\s*Address"),
        "roc": (r"Registrar\s*of\s*Companies", r"\bROC\b"),
        "companyStatus": (r"Company\s*Status", r"Status\s*of\s*Company"),
        "companyCategory": (r"Company\s*Category", r"Category"),
        "companyClass": (r"Company\s*Class", r"Class\s*of\s*Company"),
        "authorizedCapital": (r"Authorized\s*Capital|Authorised\s*Capital",),
        "paidUpCapital": (r"Paid[\-\s]?up\s*Capital",),
    },
    "SECURITY_CLEARANCE": {
        "clearanceNumber": (r"Clearance\s*(?:Number|No\.?)",),
        "referenceNumber": (r"Reference\s*(?:Number|No\.?)", r"\bRef\.?\s*(?:No\.?)?"),
        "employeeName": (r"Employee\s*Name", r"Name\s*of\s*(?:the\s*)?(?:Employee|Holder|Person)", r"^\s*Name\b"),
        "organization": (r"Organisation|Organization", r"Company\s*Name"),
        "department": (r"Department",),
        "designation": (r"Designation", r"Position", r"Title"),
        "clearanceType": (r"Clearance\s*Type", r"Type\s*of\s*Clearance"),
        "clearanceLevel": (r"Clearance\s*Level", r"Level\s*of\s*Clearance"),
        "purpose": (r"Purpose",),
        "validFrom": (r"Valid\s*From", r"Effective\s*From"),
        "validUntil": (r"Valid\s*(?:Until|Till|To)", r"Expiry\s*Date"),
        "issuingAuthority": (r"Issuing\s*Authority", r"Issued\s*By"),
    },
    "SECURITY_PROGRAMME": {
        "organizationName": (r"Organisation|Organization|Operator|Airport",),
        "programmeTitle": (r"Programme\s*Title|Program\s*Title|Title", r"SECURITY\s*PROGRAM(?:ME)?"),
        "documentNumber": (r"Document\s*(?:Number|No\.?)", r"Doc\.?\s*(?:No\.?)?"),
        "version": (r"\bVersion\b", r"\bVer\.?\b"),
        "revisionNumber": (r"Revision\s*(?:Number|No\.?)", r"\bRev\.?\s*(?:No\.?)?"),
        "effectiveDate": (r"Effective\s*Date",),
        "reviewDate": (r"Review\s*Date", r"Next\s*Review"),
        "preparedBy": (r"Prepared\s*By",),
        "reviewedBy": (r"Reviewed\s*By",),
        "approvedBy": (r"Approved\s*By",),
        "classification": (r"Classification", r"Security\s*Classification"),
    },
    "AUTHORITY_LETTER": {
        "companyName": (r"Company\s*Name", r"From\s*:", r"M/s\.?"),
        "letterReferenceNumber": (r"Reference\s*(?:Number|No\.?)", r"\bRef\.?\s*(?:No\.?)?", r"Letter\s*(?:No|Number)"),
        "letterDate": (r"Date\s*:", r"^\s*Date\b"),
        "recipient": (r"To\s*:", r"Addressed\s*To", r"Dear\s+"),
        "authorizedPerson": (r"Authori[sz]ed\s*(?:Person|Signatory)", r"Name\s*of\s*(?:the\s*)?Authori[sz]ed"),
        "designation": (r"Designation",),
        "authorityDescription": (r"hereby\s*(?:authorize|authorise)", r"Authority\s*:", r"Scope\s*of\s*Authority"),
        "validityPeriod": (r"Valid\s*(?:From|Until|Till|for)", r"Validity", r"Period"),
        "contactInformation": (r"Contact", r"Phone", r"Email", r"Tel\.?"),
    },
}

# Category, weight and pass mark of each detector, in their order; hard ones always count as fraud.
DETECTORS = (
    ("layoutDetector", "layoutMatch", 25, 0.45, True),
    ("logoDetector", "logoDetection", 20, 0.45, True),
    ("checksumValidator", "validation", 15, 1.0, True),
    ("screenshotDetector", "tampering", 20, 0.55, True),
    ("blurDetector", "ocrQuality", 10, 0.5, False),
    ("resolutionDetector", "resolution", 10, 0.5, False),
    ("fontDetector", "tampering", 5, 0.4, False),
    ("templateMatcher", "layoutMatch", 12, 0.4, False),
    ("cropDetector", "layoutMatch", 8, 0.5, False),
    ("typedTextDetector", "tampering", 25, 0.5, True),
    ("tamperingDetector", "tampering", 15, 0.5, False),
    ("ocrQualityDetector", "ocrQuality", 8, 0.35, False),
)


def doc_types(spark: SparkSession) -> DataFrame:
    rows = [(*t, k) for k, t in enumerate(TYPES)]
    return spark.createDataFrame(rows, "type string, slug string, label string, mode string, supports_validation boolean, position int").withColumn("endpoint", F.concat(F.lit("/api/"), "slug"))


def resolve_type(df: DataFrame, col: str) -> DataFrame:
    """df with resolved_type: by slug (trimmed, lower case), else by type (trimmed, upper case, - as _), else unsupported_type."""
    by_slug = F.create_map(*[x for t in TYPES for x in (F.lit(t[1]), F.lit(t[0]))])
    name = F.translate(F.upper(F.trim(F.col(col))), "-", "_")
    known = F.when(name.isin([t[0] for t in TYPES]), name)
    return df.withColumn("resolved_type", F.coalesce(by_slug[F.lower(F.trim(F.col(col)))], known, F.lit("unsupported_type")))


def identify_rules(spark: SparkSession) -> DataFrame:
    rows = [(t, k, *r) for t, rules in RULES.items() for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "type string, pos int, signal string, pattern string, score int, label string, ignore_case boolean")


def field_labels(spark: SparkSession) -> DataFrame:
    rows = [(t, f, k, p) for t, fields in LABELS.items() for f, patterns in fields.items() for k, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "type string, field string, pos int, pattern string")


def detector_catalog(spark: SparkSession) -> DataFrame:
    """Detectors that run for each type: five for the two verified types, the first eleven for others."""
    card = ("checksumValidator", "layoutDetector", "logoDetector", "ocrQualityDetector", "screenshotDetector")
    rows = [(t[0], d[0], k, d[1], d[2]) for t in TYPES for k, d in enumerate(DETECTORS) if (d[0] in card if t[0] in ("AADHAAR", "PAN") else d[0] != "ocrQualityDetector")]
    return spark.createDataFrame(rows, "type string, name string, pos int, category string, weight int")
