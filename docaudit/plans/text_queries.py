"""Queries over text: measures, cues, gates, entities, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.functions import entities as en
from docaudit.functions import text as tx
from docaudit.operators import classify as cl
from docaudit.operators import extract as ex
from docaudit.plans.registry import query
from docaudit.sources import catalog
from docaudit.sources import corpus as co

PARTS = (("AADHAAR", co.DUCK_AADHAAR), ("PAN", co.PLANTED_PAN), ("CIN", co.PLANTED_CIN), ("SECURITY_CLEARANCE", co.PLANTED_CLEARANCE), ("SECURITY_PROGRAMME", co.PLANTED_PROGRAMME), ("AUTHORITY_LETTER", co.PLANTED_LETTER))
#: The planted corpus in DuckDB.
MIX = " UNION ALL ".join(f"SELECT doc_id * 10 + {k} AS doc_id, '{t}' AS requested_type, ocr_confidence, text FROM ({q})" for k, (t, q) in enumerate(PARTS))
CORPUS = co.CORPUS
T = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))"


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def matches(pattern: str, fold: bool = True, text: str = "coalesce(text, '')") -> str:
    return f"regexp_matches({text}, {_quote(pattern)}, '{'i' if fold else 'c'}')"


@query(
    "s2_corpus_scan",
    f"SELECT requested_type, count(*) AS n, sum(ocr_confidence)::BIGINT AS confidence, count(blur) AS n_blur FROM ({CORPUS}) GROUP BY requested_type",
)
def corpus_scan(spark, sf_dir):
    return co.read_corpus(spark, sf_dir).groupBy("requested_type").agg(F.count("*").alias("n"), F.sum("ocr_confidence").alias("confidence"), F.count("blur").alias("n_blur"))


_ASKED = "CASE c_custkey % 5 WHEN 0 THEN ' Security-Clearance ' WHEN 1 THEN ' pan' WHEN 2 THEN 'authority-LETTER' WHEN 3 THEN 'SECURITY_PROGRAMME' ELSE 'driving licence' END"


@query(
    "s3_resolve_type",
    "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'SECURITY_CLEARANCE' WHEN 1 THEN 'PAN' WHEN 2 THEN 'AUTHORITY_LETTER' WHEN 3 THEN 'SECURITY_PROGRAMME' ELSE 'unsupported_type' END AS resolved_type FROM customer",
)
def resolve(spark, sf_dir):
    rows = co.planted(spark, sf_dir, f"SELECT c_custkey AS id, {_ASKED} AS asked FROM customer")
    return catalog.resolve_type(rows, "asked").select("id", "resolved_type")


@query(
    "s3_types_in_use",
    f"SELECT t.endpoint, t.mode, n FROM (SELECT requested_type, count(*) AS n FROM ({CORPUS}) GROUP BY 1) JOIN (VALUES "
    + ", ".join(f"('{t[0]}', '/api/{t[1]}', '{t[3]}')" for t in catalog.TYPES)
    + ") t(type, endpoint, mode) ON type = requested_type",
)
def types_in_use(spark, sf_dir):
    counts = co.read_corpus(spark, sf_dir).groupBy("requested_type").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(catalog.doc_types(spark)), F.col("requested_type") == F.col("type")).select("endpoint", "mode", "n")


@query(
    "s4_rule_hits",
    f"SELECT type, signal, count(*) AS n FROM ({MIX}) m JOIN (VALUES "
    + ", ".join(f"('{t}', '{r[0]}', {_quote(('(?i)' if r[4] else '') + r[1])})" for t, rules in catalog.RULES.items() for r in rules)
    + ") v(type, signal, pattern) ON regexp_matches(m.text, v.pattern) GROUP BY type, signal",
)
def rule_hits(spark, sf_dir):
    return cl.rule_hits(co.planted_mix(spark, sf_dir), catalog.identify_rules(spark)).groupBy("type", "signal").agg(F.count("*").alias("n"))


@query(
    "s4_label_hits",
    f"SELECT type, field, count(DISTINCT doc_id) AS n FROM ({MIX}) m JOIN (VALUES "
    + ", ".join(f"('{t}', '{f}', {_quote('(?i)' + p)})" for t, fields in catalog.LABELS.items() for f, patterns in fields.items() for p in patterns)
    + ") v(type, field, pattern) ON regexp_matches(m.text, v.pattern) GROUP BY type, field",
)
def label_hits(spark, sf_dir):
    """Documents with any of a field's labels, by the table of labels."""
    labels = catalog.field_labels(spark).withColumn("ignore_case", F.lit(True))
    return cl.rule_hits(co.planted_mix(spark, sf_dir), labels).groupBy("type", "field").agg(F.countDistinct("doc_id").alias("n"))


@query(
    "f1_text_measures",
    f"""SELECT doc_id, len(regexp_extract_all(t, '\\S+')) AS word_count, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) AS line_count,
  len(regexp_extract_all(t, '[A-Za-z0-9]')) AS alnum_count, length(regexp_replace(t, '[A-Za-z0-9\\s]', '', 'g')) AS symbol_count, length(t) AS trimmed_length,
  round(length(regexp_replace(t, '[A-Za-z0-9\\s]', '', 'g')) / greatest(length(t), 1), 6) AS symbol_ratio FROM (SELECT doc_id, {T} AS t FROM documents)""",
)
def measures(spark, sf_dir):
    out = tx.text_measures(co.read_corpus(spark, sf_dir).select("doc_id", "text"))
    return out.drop("text").withColumn("symbol_ratio", F.round("symbol_ratio", 6))


_FLAGS = {name: matches(p) for name, p in tx.CUES.items()}
_FLAGS["hasScreenshotCues"] = f"({_FLAGS.pop('hasScreenshotWords')} OR {_FLAGS['hasTimestampCue']})"
_BOTH = f"SELECT requested_type, text FROM ({MIX}) UNION ALL SELECT lang, text FROM documents"


@query(
    "f2_text_signals",
    f"SELECT requested_type, {', '.join(f'sum(CAST({sql} AS INT))::BIGINT AS {name}' for name, sql in _FLAGS.items())} FROM ({_BOTH}) GROUP BY requested_type",
)
def signals(spark, sf_dir):
    both = co.planted_mix(spark, sf_dir).select("requested_type", "text").unionByName(co.read_corpus(spark, sf_dir).select(F.col("lang").alias("requested_type"), "text"))
    return tx.text_signals(both).groupBy("requested_type").agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in _FLAGS])


def _points(when: str, points: float) -> str:
    return f"CASE WHEN {when} THEN {points} ELSE 0 END"


_SHAPE = """SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9]')) AS alnum, len(regexp_extract_all(text, '[A-Za-z]')) AS letters, length(regexp_replace(text, '[A-Za-z0-9\\s]', '', 'g')) / greatest(length(text), 1) AS symbols,
  len(w) AS tokens, len(list_filter(w, lambda x: length(x) <= 2)) / greatest(len(w), 1) AS short, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]{4,}'))) AS long FROM (SELECT *, regexp_extract_all(text, '\\S+') AS w FROM %s)"""
_READ = "0.4 * ocr_confidence + " + " + ".join(_points(matches(p, fold), n) for p, n, fold in tx.READ_BONUS)
_READ += f" - CASE WHEN {matches(tx.CUES['hasCamScanner'])} THEN CASE WHEN {matches(tx.MARKED_ID)} THEN 10 ELSE 80 END ELSE 0 END"
_READ += " - " + " - ".join(_points(w, n) for w, n in (("symbols > 0.25", 40), ("alnum < 20", 30), ("short > 0.55 AND tokens > 30", 35)))
_EASE = "0.5 * ocr_confidence + 0.15 * least(alnum, 400) + 2 * long - " + " - ".join(_points(w, n) for w, n in (("symbols > 0.2", 50), ("short > 0.5 AND tokens > 20", 60), ("letters < 40", 25))) + f" + {_points(matches(tx.READABLE), 35)}"


@query(
    "f3_f4_f5_read_scores",
    f"""SELECT doc_id, round(read_score, 4) AS read_score, round(readability, 4) AS readability, alnum < 40 OR read_score < 50 OR ocr_confidence < 45 AS weak_read, alnum < 40 OR (ocr_confidence < 20 AND alnum < 80) AS needs_retry
  FROM (SELECT *, CAST({_READ} AS DOUBLE) AS read_score, CAST({_EASE} AS DOUBLE) AS readability FROM ({_SHAPE % f"({MIX})"}))""",
)
def read_scores(spark, sf_dir):
    out = tx.weak_reads(tx.readability_score(tx.ocr_read_score(co.planted_mix(spark, sf_dir))))
    return out.select("doc_id", F.round(F.col("read_score").cast("double"), 4).alias("read_score"), F.round(F.col("readability").cast("double"), 4).alias("readability"), "weak_read", "needs_retry")


@query(
    "f6_presence",
    f"SELECT requested_type, sum(CAST({matches(tx.SIGNATURE)} AS INT))::BIGINT AS signature, sum(CAST({matches(tx.STAMP)} AS INT))::BIGINT AS stamp, sum(CAST({matches(tx.STAMP)} AS INT))::BIGINT AS seal FROM ({_BOTH}) GROUP BY requested_type",
)
def presence(spark, sf_dir):
    both = co.planted_mix(spark, sf_dir).select("requested_type", "text").unionByName(co.read_corpus(spark, sf_dir).select(F.col("lang").alias("requested_type"), "text"))
    return tx.presence_flags(both).groupBy("requested_type").agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in ("signature", "stamp", "seal")])


@query(
    "f7_ocr_gate",
    f"""SELECT doc_id, concat_ws(',', CASE WHEN t = '' THEN 'OCR_TEXT_EMPTY' END, CASE WHEN ocr_confidence < 40 THEN 'OCR_CONFIDENCE_LOW' END, CASE WHEN alnum < 25 THEN 'OCR_ALNUM_LOW' END, CASE WHEN blur < 40 AND ocr_confidence < 55 THEN 'OCR_EXCESSIVE_BLUR' END) AS codes,
  CAST(coalesce(blur < 40, false) AS INT) + CAST(symbols > 0.35 AND ocr_confidence < 55 AS INT) AS n_warnings, NOT (t = '' OR ocr_confidence < 40 OR alnum < 25 OR coalesce(blur < 40 AND ocr_confidence < 55, false)) AS gate_passed
  FROM (SELECT *, len(regexp_extract_all(t, '[A-Za-z0-9]')) AS alnum, length(regexp_replace(t, '[A-Za-z0-9\\s]', '', 'g')) / greatest(length(t), 1) AS symbols FROM (SELECT *, {T} AS t FROM ({CORPUS})))""",
)
def gate(spark, sf_dir):
    out = tx.ocr_gate(co.read_corpus(spark, sf_dir), blur_col="blur")
    return out.select("doc_id", F.array_join(F.transform("gate_reasons", lambda r: r["code"]), ",").alias("codes"), F.size("gate_warnings").alias("n_warnings"), "gate_passed")


@query(
    "f7_gate_by_label",
    f"""SELECT coalesce(CAST(quality AS VARCHAR), 'none') AS quality, count(*) AS n, sum(CAST(NOT (t = '' OR ocr_confidence < 40 OR len(regexp_extract_all(t, '[A-Za-z0-9]')) < 25) AS INT))::BIGINT AS n_passed
  FROM (SELECT *, {T} AS t FROM ({CORPUS})) c LEFT JOIN labels ON c.doc_id = labels.doc_id GROUP BY 1""",
)
def gate_by_label(spark, sf_dir):
    labels = co.read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = tx.ocr_gate(co.read_corpus(spark, sf_dir)).select("doc_id", "gate_passed").join(labels, "doc_id", "left")
    return out.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("quality")).agg(F.count("*").alias("n"), F.sum(F.col("gate_passed").cast("int")).alias("n_passed"))


@query(
    "f8_normalized_reasons",
    "SELECT message, count(*) AS n FROM (SELECT unnest([lang, source]) AS message FROM documents) WHERE message IS NOT NULL GROUP BY message",
)
def reasons(spark, sf_dir):
    docs = co.read_table(spark, sf_dir, "documents")
    out = docs.select(F.explode(tx.normalize_reasons(F.array("lang", "source"), "ocr")).alias("r")).filter("r.code = 'REASON' AND r.stage = 'ocr'")
    return out.groupBy("r.message").agg(F.count("*").alias("n"))


def _duck_unique(pattern: str, group: int = 0, fold: bool = True, text: str = "text") -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, {_quote(pattern)}, {group}{', ' + repr('i') if fold else ''}), lambda x: upper(trim(x))))"


_ENTITY = {
    "email": _duck_unique(en.EMAIL),
    "phone": f"list_distinct(list_filter(list_transform(regexp_extract_all(text, {_quote(en.PHONE)}, 0), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: len(regexp_extract_all(x, '[0-9]')) BETWEEN 8 AND 15))",
    "reference": _duck_unique(en.REFERENCE, 1),
    "document_no": _duck_unique(en.DOCUMENT_NO, 1),
    "registration_no": _duck_unique(en.REGISTRATION_NO, 1),
    "cin": _duck_unique(en.CIN),
    "passport_no": _duck_unique(en.PASSPORT_NO, 0, False, "upper(text)"),
}
_TEXTS = f"SELECT doc_id, text FROM ({MIX}) UNION ALL SELECT -1 - doc_id, coalesce(text, '') FROM documents"


@query(
    "e1_e7_entities",
    " UNION ALL ".join(f"SELECT '{k}' AS kind, sum(len(v))::BIGINT AS n, count(*) FILTER (WHERE len(v) > 0) AS n_docs FROM (SELECT {sql} AS v FROM ({_TEXTS})) HAVING sum(len(v)) > 0" for k, sql in _ENTITY.items()),
)
def entity_counts(spark, sf_dir):
    docs = co.read_table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    rows = en.entity_table(co.planted_mix(spark, sf_dir).select("doc_id", "text").unionByName(docs), kinds=tuple(_ENTITY))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(
    "e18_entity_stats",
    " UNION ALL ".join(
        f"""SELECT '{k}' AS kind, (SELECT count(*) FROM e_{k}) AS n, (SELECT count(DISTINCT doc_id) FROM e_{k}) AS n_docs, (SELECT count(*) FROM t_{k}) AS n_values, (SELECT string_agg(value, ', ' ORDER BY n DESC, value) FROM (SELECT * FROM t_{k} ORDER BY n DESC, value LIMIT 3)) AS top_values WHERE EXISTS (SELECT * FROM e_{k})"""
        for k in _ENTITY
    ).join(["WITH " + ", ".join(f"e_{k} AS (SELECT doc_id, unnest({sql}) AS value FROM ({_TEXTS})), t_{k} AS (SELECT value, count(*) AS n FROM e_{k} GROUP BY value)" for k, sql in _ENTITY.items()) + " ", ""]),
)
def entity_stats(spark, sf_dir):
    docs = co.read_table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    rows = en.entity_table(co.planted_mix(spark, sf_dir).select("doc_id", "text").unionByName(docs), kinds=tuple(_ENTITY))
    return en.entity_stats(rows.withColumn("value", F.upper("value")))


@query("e8_dates", f"SELECT doc_id, array_to_string(d, ',') AS dates FROM (SELECT doc_id, list_transform(list_filter(range(1, len(a) + 1), lambda i: list_position(a, a[i]) = i), lambda i: a[i]) AS d FROM (SELECT doc_id, regexp_extract_all(text, '\\d{{2}}/\\d{{2}}/\\d{{4}}') AS a FROM ({MIX})))")
def dates(spark, sf_dir):
    return co.planted_mix(spark, sf_dir).select("doc_id", F.array_join(en.dates(F.col("text")), ",").alias("dates"))


_SHAPES = """SELECT o_orderkey AS id, o_orderdate AS d, CASE o_orderkey % 6 WHEN 0 THEN {dmy} WHEN 1 THEN {dmy2} WHEN 2 THEN {named} WHEN 3 THEN {iso} WHEN 4 THEN concat('  about  ', {iso}, ' or so') ELSE '45/13/1999' END AS raw FROM orders"""


@query(
    "e9_normalized_dates",
    """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 4 THEN concat('about ', strftime(o_orderdate, '%Y-%m-%d'), ' or so') WHEN 5 THEN '45/13/1999' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS normalized FROM orders""",
)
def normalized_dates(spark, sf_dir):
    rows = co.read_table(spark, sf_dir, "orders")
    f = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, f("dd/MM/yyyy")).when(k == 1, f("d-M-yy")).when(k == 2, F.concat(f("d"), F.lit(" "), F.upper(f("MMMM")), F.lit(" "), f("yyyy"))).when(k == 3, f("yyyy-MM-dd")).when(k == 4, F.concat(F.lit("  about  "), f("yyyy-MM-dd"), F.lit(" or so"))).otherwise("45/13/1999")
    return rows.select(F.col("o_orderkey").alias("id"), en.normalize_date(raw).alias("normalized"))


_PLACE = "SELECT c_custkey AS doc_id, concat('Header', chr(10), 'Registered Office: ', CAST(c_custkey AS STRING), ' High Street', chr(10), 'Ward Five', chr(10), 'Bengaluru 560', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), chr(10), 'We are Acme Tools Limited') AS text FROM customer"


@query(
    "e10_addresses",
    """SELECT c_custkey AS doc_id, concat(': '[3:], CAST(c_custkey AS VARCHAR), ' High Street, Ward Five, Bengaluru 560', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), ', We are Acme Tools Limited') AS labelled,
  concat('Registered Office: ', CAST(c_custkey AS VARCHAR), ' High Street, Ward Five, Bengaluru 560', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')) AS coded FROM customer""",
)
def addresses(spark, sf_dir):
    # A key of six digits makes the line of the street a coded one too; the block of the postal code is the last.
    a = en.addresses(F.col("text"))
    return co.planted(spark, sf_dir, _PLACE).select("doc_id", F.get(a, F.lit(0)).alias("labelled"), F.element_at(a, -1).alias("coded"))


_FIRM = "CASE c_custkey % 4 WHEN 0 THEN 'Tools Limited' WHEN 1 THEN 'Air Authority' WHEN 2 THEN 'Trading Company' ELSE 'Freight Pvt Ltd' END"


@query(
    "e11_organizations",
    f"SELECT c_custkey AS doc_id, concat('Acme', CAST(c_custkey AS VARCHAR), ' ', {_FIRM}, CASE WHEN c_custkey % 3 = 0 THEN concat(';the Guild of ', chr(CAST(65 + c_custkey % 26 AS INT))) ELSE ';: of' END) AS organizations FROM customer",
)
def organizations(spark, sf_dir):
    rows = co.planted(spark, sf_dir, f"SELECT c_custkey AS doc_id, concat('dear all, Acme', CAST(c_custkey AS STRING), ' ', {_FIRM}, ' wrote', chr(10), CASE WHEN c_custkey % 3 = 0 THEN concat('Organisation: the Guild of ', chr(CAST(65 + c_custkey % 26 AS INT))) ELSE 'Organisation: of' END) AS text FROM customer")
    return rows.select("doc_id", F.array_join(en.organizations(F.col("text")), ";").alias("organizations"))


@query("e13_tables", "SELECT c_custkey AS doc_id, 1 AS table_no, 3 AS row_count, concat('Post,Count;North,', CAST(c_custkey % 50 AS VARCHAR), ';South,3') AS cells FROM customer")
def tables(spark, sf_dir):
    out = en.tables(co.planted(spark, sf_dir, co.PLANTED_PROGRAMME))
    return out.select("doc_id", "table_no", "row_count", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("cells"))


_SP = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _duck_cells(split: str) -> str:
    return f"len(list_filter({split}, lambda c: regexp_replace(c, '{_SP}+', '', 'g') <> ''))"


@query(
    "e13_document_tables",
    f"""WITH l AS (SELECT doc_id, pos, regexp_replace(line, '^{_SP}+|{_SP}+$', '', 'g') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
  c AS (SELECT doc_id, pos, {_duck_cells("string_split(line, '|')")} >= 2 OR len(list_filter(regexp_split_to_array(line, '\t+'), lambda x: x <> '')) >= 2 OR len(list_filter(regexp_split_to_array(line, '{_SP}{{2,}}'), lambda x: x <> '')) >= 2 AS cut FROM l WHERE line <> ''),
  i AS (SELECT doc_id, cut, sum(CAST(NOT cut AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM c), t AS (SELECT doc_id, island, count(*) AS n FROM i WHERE cut GROUP BY doc_id, island HAVING count(*) >= 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS k FROM t)
  SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_tables, sum(n)::BIGINT AS n_rows FROM r WHERE k <= 10""",
)
def document_tables(spark, sf_dir):
    docs = co.read_table(spark, sf_dir, "documents")
    return en.tables(docs).agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_tables"), F.sum("row_count").alias("n_rows"))


#: Lines by key: a table at pipes, one at tabs or spaces, lines that are none, and a long one of which 30 rows are kept.
_TABLED = "concat('Post | Count', chr(10), 'North | ', c_custkey % 50, ' |', chr(10), 'just a line', chr(10), 'alone | here', chr(10), 'no', chr(10), 'a', chr(9), chr(9), 'b ', c_custkey, chr(10), '  c   d  e', chr(10), repeat('x  y' || chr(10), CAST(CASE c_custkey % 3 WHEN 0 THEN 40 ELSE c_custkey % 3 END AS INT)), 'end')"


@query(
    "x6_e13_table_columns",
    f"""WITH l AS (SELECT k, i AS pos, regexp_replace(a[i], '^{_SP}+|{_SP}+$', '', 'g') AS line FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT c_custkey AS k, string_split({_TABLED}, chr(10)) AS a FROM customer))),
  p AS (SELECT *, list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') AS pc, list_filter(regexp_split_to_array(line, '\t+'), lambda x: x <> '') AS tc, list_filter(regexp_split_to_array(line, '{_SP}{{2,}}'), lambda x: x <> '') AS sc FROM l WHERE line <> ''),
  c AS (SELECT k, pos, CASE WHEN len(pc) >= 2 THEN pc WHEN len(tc) >= 2 THEN tc WHEN len(sc) >= 2 THEN sc END AS cells FROM p),
  g AS (SELECT *, sum(CAST(cells IS NULL AS INT)) OVER (PARTITION BY k ORDER BY pos) AS island FROM c),
  t AS (SELECT k, island, count(*) AS n, list(array_to_string(cells, ',') ORDER BY pos)[1:30] AS r FROM g WHERE cells IS NOT NULL GROUP BY k, island HAVING count(*) >= 2)
  SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY island) AS table_no, CAST(n AS INT) AS row_count, array_to_string(r, ';') AS cells FROM t""",
)
def table_columns(spark, sf_dir):
    """Tables as a column of extraction: of a programme, and in the bag of a letter."""
    text = F.expr(_TABLED)
    rows = co.read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    even = ex.extract_fields(rows.filter("doc_id % 2 = 0"), "SECURITY_PROGRAMME").select("doc_id", "tables")
    every = even.unionByName(ex.generic_bag(rows.filter("doc_id % 2 = 1")).select("doc_id", "tables"))
    out = every.select("doc_id", F.posexplode("tables").alias("k", "t"))
    return out.select("doc_id", (F.col("k") + 1).cast("long").alias("table_no"), F.col("t.rowCount").alias("row_count"), F.array_join(F.transform("t.rows", lambda r: F.array_join(r, ",")), ";").alias("cells"))


@query(
    "e14_e15_e16_layout",
    "SELECT c_custkey AS doc_id, 'Purpose;guards;gates' AS bullets, 'AIRPORT SECURITY PROGRAMME;1. Purpose' AS headings, concat('AIRPORT SECURITY PROGRAMME;Programme Title: Plan ', CAST(c_custkey AS VARCHAR), ';Organisation: ACME Airport') AS header, concat('Post | Count;North | ', CAST(c_custkey % 50 AS VARCHAR), ';South | 3') AS footer FROM customer",
)
def layout(spark, sf_dir):
    t = F.col("text")
    rows = co.planted(spark, sf_dir, co.PLANTED_PROGRAMME)
    return rows.select("doc_id", *[F.array_join(f(t), ";").alias(n) for n, f in (("bullets", en.bullets), ("headings", en.headings), ("header", en.header), ("footer", en.footer))])


@query(
    "e0_unique_words",
    "SELECT doc_id, len(list_distinct(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''), lambda x: lower(trim(x))))) AS n FROM documents",
)
def unique_lines(spark, sf_dir):
    from docaudit.functions.patterns import unique_ci

    docs = co.read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(unique_ci(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("n"))


def _duck_keyword(type_: str) -> str:
    rules = catalog.RULES[type_]
    return f"least(100, {' + '.join(_points(matches(r[1], r[4]), r[2]) for r in rules)})", " + ".join(_points(matches(r[1], r[4]), 1) for r in rules)


@query(
    "c1_keyword_scores",
    " UNION ALL ".join(f"SELECT doc_id, '{t}' AS type, {_duck_keyword(t)[0]} AS score, {_duck_keyword(t)[1]} AS match_count FROM ({MIX})" for t in catalog.RULES),
)
def keyword_scores(spark, sf_dir):
    return cl.keyword_scores_long(co.planted_mix(spark, sf_dir)).select("doc_id", "type", "score", "match_count")


@query(
    "c6_keyword_types_fit",
    f"SELECT type, count(*) FILTER (WHERE score >= 35) AS fits, count(*) AS n FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{t}{chr(39)} AS type, {_duck_keyword(t)[0]} AS score FROM documents' for t in ('SECURITY_CLEARANCE', 'SECURITY_PROGRAMME', 'AUTHORITY_LETTER'))}) GROUP BY type",
)
def keyword_fits(spark, sf_dir):
    rows = cl.keyword_scores_long(co.read_corpus(spark, sf_dir), types=("SECURITY_CLEARANCE", "SECURITY_PROGRAMME", "AUTHORITY_LETTER"))
    return rows.groupBy("type").agg(F.sum((F.col("score") >= 35).cast("int")).alias("fits"), F.count("*").alias("n"))


_CIN_POINTS = "CASE WHEN k % 10 = 4 THEN 0 WHEN k % 10 = 3 THEN 50 WHEN k % 10 = 1 THEN 90 ELSE 100 END"
_CONF = "CAST(30 + (c_custkey * 37) % 70 AS INT)"


@query(
    "c5_c7_cin_scores",
    f"SELECT k AS doc_id, CASE WHEN conf >= 70 THEN least(100, p + 5) WHEN conf < 45 THEN greatest(0, p - 8) ELSE p END AS score FROM (SELECT *, {_CIN_POINTS} AS p FROM (SELECT c_custkey AS k, {_CONF} AS conf FROM customer))",
)
def cin_scores(spark, sf_dir):
    return cl.type_scores_long(co.planted(spark, sf_dir, co.PLANTED_CIN)).filter("type = 'CIN'").select("doc_id", "score")


_FIT = "CASE WHEN k % 10 = 5 AND t IN (0, 1) THEN 'UNKNOWN' WHEN k % 10 = 4 AND t = 2 THEN 'UNKNOWN' ELSE requested_type END"


@query(
    "c9_classified",
    f"SELECT doc_id, requested_type, {_FIT} AS document_type FROM (SELECT *, doc_id // 10 AS k, doc_id % 10 AS t FROM ({MIX}))",
)
def classified(spark, sf_dir):
    return cl.classify(co.planted_mix(spark, sf_dir)).select("doc_id", "requested_type", "document_type")


@query(
    "c2_c3_card_scores",
    f"""SELECT doc_id, requested_type, CASE WHEN p = 0 AND conf < 45 THEN 0 WHEN conf >= 70 THEN least(100, p + 5) WHEN conf < 45 THEN greatest(0, p - 8) ELSE p END AS score FROM (
  SELECT doc_id, requested_type, ocr_confidence AS conf, CASE WHEN k % 10 = 5 THEN 0 WHEN t = 0 THEN CASE WHEN k % 10 = 3 THEN 30 + 25 + 20 + 10 + 5 WHEN k % 10 IN (1, 2) THEN 100 ELSE 100 END ELSE CASE WHEN k % 10 = 3 THEN 35 + 30 + 15 + 10 ELSE 100 END END AS p
  FROM (SELECT *, doc_id // 10 AS k, doc_id % 10 AS t FROM ({MIX})) WHERE t IN (0, 1))""",
)
def card_scores(spark, sf_dir):
    mix = co.planted_mix(spark, sf_dir).filter(F.col("requested_type").isin("AADHAAR", "PAN"))
    return cl.classify(mix).select("doc_id", "requested_type", F.col("classification_confidence").alias("score"))


# A text without any cue ties at 0, and the first type of the catalogue leads; so does a card that both types refuse. A card
# that names income tax and the government but no authority of the other kind is an account card.
@query(
    "c8_best_types",
    f"SELECT doc_id, CASE WHEN t = 2 AND k % 10 = 4 OR t = 1 AND k % 10 = 5 THEN 'AADHAAR' WHEN t = 0 AND k % 10 = 5 THEN 'PAN' ELSE requested_type END AS best FROM (SELECT *, doc_id // 10 AS k, doc_id % 10 AS t FROM ({MIX}))",
)
def best_types(spark, sf_dir):
    return cl.type_scores_long(co.planted_mix(spark, sf_dir)).filter("rank = 1").select("doc_id", F.col("type").alias("best"))


@query(
    "c10_matched_signals",
    " UNION ALL ".join(
        f"SELECT '{name}' AS id, count(*) AS n FROM (SELECT c_custkey AS k, {_CONF} AS conf FROM customer) WHERE {when}"
        for name, when in (("cinKeyword", "k % 10 NOT IN (3, 4)"), ("mca", "k % 10 <> 4"), ("coi", "k % 10 <> 4"), ("cinRegex", "k % 10 NOT IN (1, 3, 4)"), ("cinNumber", "k % 10 NOT IN (1, 3, 4)"), ("highOcrConfidence", "conf >= 70"), ("lowOcrConfidence", "conf < 45"))
    ),
)
def matched(spark, sf_dir):
    rows = co.planted(spark, sf_dir, co.PLANTED_CIN).withColumn("requested_type", F.lit("CIN"))
    return cl.matched_signals(cl.classify(rows)).groupBy("id").agg(F.count("*").alias("n"))


_TRIES = "SELECT doc_id, p AS try_pos, CASE p WHEN 1 THEN 'PASSPORT' WHEN 2 THEN 'PAN' WHEN 3 THEN 'AADHAAR' ELSE 'CIN' END AS type, CASE WHEN (doc_id * 7 + p * 3) % 4 < 2 THEN 'completed' ELSE 'stopped' END AS status, CAST((doc_id * 13 + p * 29) % 100 AS INT) AS confidence FROM documents CROSS JOIN (VALUES (1), (2), (3), (4)) AS v(p)"


@query(
    "c11_resolved_types",
    f"""WITH a AS ({_TRIES}), s AS (
    SELECT *, min(CASE WHEN status = 'completed' AND confidence >= 50 THEN try_pos END) OVER (PARTITION BY doc_id) AS stop, min(CASE WHEN try_pos = 1 THEN confidence END) OVER (PARTITION BY doc_id) AS first FROM a
  ), c AS (
    SELECT *, status = 'completed' AND confidence >= first AS good FROM s WHERE try_pos <= coalesce(stop, 4)
  ), r AS (
    SELECT *, max(try_pos) OVER (PARTITION BY doc_id) AS tried, row_number() OVER (PARTITION BY doc_id ORDER BY good DESC, CASE WHEN good THEN confidence END DESC NULLS LAST, CASE WHEN good THEN -try_pos ELSE try_pos END) AS k FROM c
  )
  SELECT doc_id, type, status, confidence, tried FROM r WHERE k = 1""",
)
def resolved(spark, sf_dir):
    docs = co.read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).alias("p"))
    d, p = F.col("doc_id"), F.col("p")
    rows = docs.select("doc_id", p.alias("try_pos"), F.element_at(F.array(*[F.lit(x) for x in ("PASSPORT", "PAN", "AADHAAR", "CIN")]), p).alias("type"), F.when((d * 7 + p * 3) % 4 < 2, "completed").otherwise("stopped").alias("status"), ((d * 13 + p * 29) % 100).cast("int").alias("confidence"))
    return cl.resolve_unknown_type(rows)

