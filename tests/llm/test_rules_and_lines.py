import hashlib
import re
from collections import Counter, defaultdict

from docaudit.llm import op1_quality_rules as rules
from docaudit.llm import op5_line_dedup as lines
from tests.llm.fixtures import documents, odd_texts, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"


def _lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _base(text):
    text = text or ""
    words = WORD.findall(text)
    held = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(held) - len(set(held)), len(hit)


def test_base_rules_match_plain_python(spark):
    texts = odd_texts()
    got = table(rules.base_rules(documents(spark, texts)))
    for k, text in enumerate(texts):
        n, chars, symbols, dup, rep = _base(text)
        assert tuple(got[k])[1:] == (n, chars, symbols, dup, rep, n < 50 or 100 * rep > 50 * n), text


def test_documents_of_boilerplate_are_depleted(spark):
    menu = "Home About Contact Imprint Privacy Terms Help Search"
    texts = [f"{menu}\n" * 8 + f"own {k}" for k in range(3)] + [menu + "\n" + " ".join(f"v{k}x{i}" for i in range(60)) for k in range(3)]
    texts += [" ".join(f"u{k}x{i}" for i in range(60)) for k in range(30)]
    df = documents(spark, texts).withColumn("source", rules.F.lit("host"))
    got = table(rules.apply_rules(df, min_docs=3, min_percent=10))
    assert [got[k].depleted for k in range(6)] == [True] * 3 + [False] * 3
    assert all(got[k].n_lost_words == 8 for k in (3, 4, 5))
    assert all(got[k].kept for k in range(3, 36))
    assert not any(r.depleted for r in rules.apply_rules(df, min_docs=7, min_percent=10).collect())


def test_boilerplate_lines_leave_the_text(spark):
    own = [" ".join(f"v{k}x{i}" for i in range(60)) for k in range(4)]
    texts = [f"Home About\n{x}\n\n \thome ABOUT \nend {k}" for k, x in enumerate(own)]
    df = documents(spark, [*texts, None, ""]).withColumn("source", rules.F.lit("host"))
    got = table(rules.apply_rules(df, min_docs=3, min_percent=10))
    assert [got[k].text for k in range(6)] == [f"{x}\n\nend {k}" for k, x in enumerate(own)] + [None, ""]
    assert all((got[k].n_lost_words, got[k].n_lost_lines, got[k].kept) == (4, 2, True) for k in range(4))
    other = df.withColumn("source", rules.F.when(rules.F.col("doc_id") == 3, "other").otherwise("host"))
    assert table(rules.apply_rules(other, min_docs=3, min_percent=10))[3].text == texts[3]


def test_rules_on_empty_and_repeated_rows(spark):
    df = documents(spark)
    assert rules.apply_rules(df.filter("false")).count() == 0
    assert rules.apply_rules(df.unionByName(df)).count() == 2 * df.count()


def _dedup(rows, min_chars=20, min_docs=3):
    holds = defaultdict(set)
    key = lambda x: _lower(x.strip(BLANK))
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holds[key(x)].add(d)
    out = {}
    for d, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(holds[key(x)]) < min_docs or max(holds[key(x)]) == d]
        out[d] = (len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup_matches_plain_python(spark):
    texts = odd_texts()
    want = _dedup(list(enumerate(texts)))
    got = lines.dedup_lines(documents(spark, texts)).select("doc_id", "n_lines", "n_dropped", lines.F.sha2("text", 256))
    assert {k: tuple(r)[1:] for k, r in table(got).items()} == want
    assert sum(x[1] for x in want.values()) > 5


def test_line_dedup_on_empty_and_repeated_rows(spark):
    df = documents(spark)
    assert lines.dedup_lines(df.filter("false")).count() == 0
    twice = documents(spark, ["a line that two rows of one id hold"]).unionByName(documents(spark, ["a line that two rows of one id hold"]))
    assert [r.n_dropped for r in lines.dedup_lines(twice, min_docs=2).collect()] == [0, 0]
    assert set(df.columns) | {"n_lines", "n_dropped"} == set(lines.dedup_lines(df).columns)


def test_line_dedup_of_clashing_names_and_texts_that_repeat_an_id(spark):
    line = "a line that is long enough to count"
    docs = documents(spark, [line, line, f"x\n{line}\n{line} ", "y"]).withColumns({c: lines.F.lit(c) for c in ("_id", "_t", "_lost", "_left")})
    other = docs.withColumn("text", lines.F.concat(lines.F.lit("first\n"), "text"))
    got = lines.dedup_lines(docs.unionByName(other)).collect()
    assert all((r["_id"], r["_t"], r["_lost"], r["_left"]) == ("_id", "_t", "_lost", "_left") for r in got)
    assert sorted((r.doc_id, r.text) for r in got) == [(0, ""), (0, "first"), (1, ""), (1, "first"), (2, f"first\nx\n{line}\n{line} "), (2, f"x\n{line}\n{line} "), (3, "first\ny"), (3, "y")]
