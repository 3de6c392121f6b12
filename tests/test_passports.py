"""Number repair against a plain walk over the letters, and odd texts through the passport record."""

import random
import re

from pyspark.sql import functions as F

from docaudit.operators import extract as ex
from docaudit.operators import passports as pp

AS_DIGIT = dict(pp.MISREAD)


def _tokens(text):
    flat = re.sub(r"[^A-Z0-9\n]", "", text.upper())
    return list(dict.fromkeys(t for t in re.findall(r"[A-Z][A-Z0-9]{5,10}", flat) if re.search(r"\d", t) and t[0] not in "MF"))


def _walk(token):
    """Every branch is tried, with letters that may stay letters or be left out; only a letter and seven digits are kept."""
    if not 6 <= len(token) <= 12 or re.search(r"[MF]\d{5}", token):
        return []
    out = []

    def step(made, rest, depth):
        if not rest:
            if re.fullmatch(r"[A-Z]\d{7}", made) and made not in out:
                out.append(made)
            return
        if len(made) > 8:
            return
        c = rest[0]
        for reading in [c] if c.isdigit() else [AS_DIGIT[c]] if c in AS_DIGIT else []:
            step(made + reading, rest[1:], depth + 1)
        if depth < 3 and c.isalpha() and c not in AS_DIGIT:
            step(made, rest[1:], depth + 1)

    for start in dict.fromkeys([token, token[:10], re.sub(r"(?<=\d)[A-Z]+$", "", token)]):
        step(start[0], start[1:], 1)
    digits = "".join(c if c.isdigit() else AS_DIGIT.get(c, "") for c in token[1:])
    if len(digits) >= 7 and token[0] + digits[:7] not in out:
        out.append(token[0] + digits[:7])
    return out


def _best(text):
    tokens = _tokens(text)
    exact = [t for t in tokens if re.fullmatch(r"[A-Z]\d{7}", t)]
    every, a4 = list(exact), set()
    for t in tokens:
        for n in _walk(t):
            every.append(n)
            if "A" in t and "4" in n:
                a4.add(n)
        digits = re.sub(r"\D", "", t[1:].replace("A", "4").replace("S", "5").replace("O", "0"))
        if "A" in t and len(digits) >= 7:
            every.append(t[0] + digits[:7])
            a4.add(t[0] + digits[:7])
    best, most = None, None
    for n in dict.fromkeys(every):
        score = 40 + 15 * (n[0] in "UZVSJT") + 200 * (n in exact) + 35 * (n in a4)
        same = 0
        for t in tokens:
            d = re.sub(r"[A-Z]", "", t[1:].translate(str.maketrans("ASOT", "4507")))
            same += sum(x == y for x, y in zip(n[1:], d, strict=False))
        score += 2 * min(same, 12) - 30 * bool(re.search(r"(.)\1{3,}", n)) - 15 * bool(re.search("5555|0000|4444|55544", n))
        if most is None or score > most:
            best, most = n, score
    return (best if most is not None and most >= 45 else None, most)


def test_numbers_equal_a_plain_walk(spark):
    rng = random.Random(1)
    letters = "".join(AS_DIGIT) * 3 + "UKXNZ0123456789" * 2
    texts = ["\n".join("".join(rng.choice(letters) for _ in range(rng.randrange(4, 14))) for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    texts += ["", " ", "KAAAAAAA", "K5554412", "UIIIIIII\nUIIIIIII", "ASOQDBZGILTE", "K1234567\n" * 3, "\n".join(f"K{k:07d}" for k in range(1500))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("b", pp.best_number(F.array("text")))
    got = {r["id"]: (r["b"]["number"], r["b"]["score"]) if r["b"] else (None, None) for r in df.collect()}
    assert got == {k: _best(t) for k, t in enumerate(texts)}
    assert sum(x[0] is not None for x in got.values()) > 100


def test_further_readings_of_the_number_decide(spark):
    rows = [(1, "PASSPORT\nSurname: RAO", ["UI234567", None], 80), (2, "PASSPORT K7654321", None, 80), (3, None, None, None)]
    got = {r["id"]: r for r in ex.extract(spark.createDataFrame(rows, "id int, text string, number_texts array<string>, ocr_confidence int"), "PASSPORT").collect()}
    assert got[1]["passportNumber"] == "U1234567" and got[2]["passportNumber"] == "K7654321"
    assert got[3]["passportNumber"] is None and got[3]["extraction_confidence"] == 0


def test_spaced_letters_and_places(spark):
    rows = [("R A N E X", "5 Pune"), ("A B", "|, 12 |"), ("R A N Rao S U", ": EE Kochi,,"), (None, "x" * 100)]
    got = spark.createDataFrame(rows, "name string, place string").select(pp.joined_letters(F.col("name")), pp.clean_place(F.col("place"))).collect()
    assert [tuple(r) for r in got] == [("RANEX", "PUNE"), ("A B", None), ("RAN Rao S U", "KOCHI"), (None, "X" * 80)]
