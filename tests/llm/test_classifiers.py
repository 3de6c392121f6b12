import numpy as np

from docaudit.llm import op2_quality_classifier as quality
from docaudit.llm import op10_language_id as language
from tests.llm.fixtures import documents, odd_texts, table

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    got = quality.op2_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted[got.quality == 1] == 1).mean() > 0.95
    assert (got.predicted[got.quality == 0] == 0).mean() > 0.8


def test_scores_of_odd_texts(spark):
    docs = documents(spark)
    weights = quality.train(docs, spark.createDataFrame([(7, 1), (20, None), (21, 0), (21, 0)], "doc_id long, quality int"))
    got = table(quality.score(docs, weights).select("doc_id", "score", "predicted", "text"))
    assert len(got) == len(odd_texts())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[0].score == got[1].score
    assert not quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")).any()
    assert quality.score(docs.filter("false"), weights).count() == 0


def test_score_is_a_dot_product():
    known = quality._Tokens()
    at, x = quality.features("a b a b !! c", known, 18)
    assert at[0] == 0 and x[0] == 1.0 and len(set(at)) == len(at)
    assert np.isclose((x[1:] ** 2).sum(), 1.0)


def test_held_out_languages(spark):
    got = language.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_languages_of_odd_texts(spark):
    docs = documents(spark, [None, "", "12 !! 34", "der die das und nicht", "the and of to", "thing", "x" * 40_000, "the " * 60_000])
    train = spark.createDataFrame([(1, "der die das und nicht ein zu", "de"), (2, "the and of to is thing", "en"), (3, None, "fr"), (4, "no lang", None)], "doc_id long, text string, lang string")
    settings = language.Settings(min_count=1)
    got = table(language.identify(docs, language.train(train, settings=settings)).select("doc_id", "lang_pred", "score"))
    assert [got[k].lang_pred for k in range(6)] == ["und", "und", "und", "de", "en", "en"]
    assert got[7].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    empty = language.identify(docs, language.train(train.filter("false"))).collect()
    assert {r.lang_pred for r in empty} == {"und"}


def test_unseen_words_back_off(spark):
    m = language.Model(["a", "b"], {"known": 0}, {"ab": 1, "a": 2}, np.array([[0.0, -1.0], [-1.0, -3.0], [-2.0, -2.0]]), 2)
    known = language._Known(m)
    assert known["known"] == 0
    assert np.allclose(known.rows[known["abx"]], [-1.0, -3.0])
    assert np.allclose(known.rows[known["ax"]], [-2.0, -2.0])


def _plain_features(text, bits=18):
    """{bucket: value} in plain Python."""
    import math
    import re
    import zlib
    from collections import Counter

    h = [zlib.crc32(t.encode()) * 0x9E3779B1 % 2**32 for t in re.findall(r"\w+|[^\w\s]+", text or "")]
    every = list(h)
    every += [((a * 0x85EBCA6B + b * 0xC2B2AE35 + 1) % 2**32) * 0x27D4EB2F % 2**32 for a, b in zip(h, h[1:], strict=False)]
    every += [0x9E3779B1 * k % 2**32 for k in range(1, 7) for a, b in zip(h, h[k:], strict=False) if a == b]
    counts = Counter(x >> (32 - bits) for x in every)
    norm = math.sqrt(sum(counts.values())) or 1.0
    return {0: 1.0} | {k: math.sqrt(n) / norm for k, n in counts.items() if k}


def test_learning_and_scores_match_plain_python(spark):
    """An independent learner and scorer over all of sf0.001."""
    import math
    import struct

    import xxhash

    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{at}/labels.parquet").filter(~quality.held_out())
    got = table(quality.score(docs, quality.train(docs, labels)).select("doc_id", "score", "predicted"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = lambda k: struct.unpack("<q", xxhash.xxh64(struct.pack("<q", k), seed=42).digest()[::-1])[0]
    rows = sorted((order(r.doc_id), _plain_features(texts[r.doc_id]), r.quality) for r in labels.collect() if r.quality is not None and r.doc_id in texts)
    s = quality.Settings()
    z, n = {}, {}
    weight = lambda k: -z.get(k, 0.0) / ((s.beta + math.sqrt(n.get(k, 0.0))) / s.alpha + s.l2)
    squash = lambda x: 1 / (1 + math.exp(-max(-35, min(35, x))))
    for _ in range(s.epochs):
        for _, x, y in rows:
            w = {k: weight(k) for k in x}
            p = squash(sum(w[k] * v for k, v in x.items()))
            for k, v in x.items():
                g = (p - y) * v
                was = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / s.alpha * w[k]
                n[k] = was + g * g
    assert len(got) == len(texts)
    for k, text in texts.items():
        want = squash(sum(weight(b) * v for b, v in _plain_features(text).items()))
        assert abs(got[k].score - want) < 1e-5 and (got[k].predicted == int(want >= 0.3) or abs(want - 0.3) < 1e-5), k


def test_scores_at_the_threshold_are_predicted(spark):
    docs = documents(spark, ["a", None])
    weights = np.zeros(1 << 18, np.float32)
    assert [r.predicted for r in quality.score(docs, weights, threshold=0.5).collect()] == [1, 1]
    assert [r.predicted for r in quality.score(docs, weights, threshold=np.nextafter(0.5, 1).item()).collect()] == [0, 0]


def _plain_words(text):
    import regex

    return regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())


def _plain_model(rows, s):
    """(languages, words, n-grams): log frequencies of each in each language, in plain Python."""
    import math
    from collections import Counter

    counts = Counter((lang, w) for text, lang in rows for w in _plain_words(text))
    langs = sorted({lang for lang, _ in counts})
    # As many languages share the model's room as have a text at all.
    n_langs = len({lang for _, lang in rows})

    def kept(of, most, least):
        total = Counter()
        for (_, key), n in of.items():
            total[key] += n
        best = set()
        for lang in langs:
            own = sorted((-n, key) for (of_lang, key), n in of.items() if of_lang == lang and total[key] >= least)
            best |= {key for _, key in own[: max(1, most // n_langs)]}
        sums = [max(sum(of[lang, key] for key in best), 1) for lang in langs]
        return {key: [math.log(max(of[lang, key], 0.5) / t) for lang, t in zip(langs, sums, strict=True)] for key in best}

    words, grams = kept(counts, s.max_words, s.min_count), {}
    for size in range(1, s.longest + 1):
        of = Counter()
        for (lang, w), n in counts.items():
            for i in range(len(w) + 2 - size + 1):
                of[lang, f"_{w}_"[i : i + size]] += n
        grams |= kept(of, s.max_grams, 1)
    return langs, words, grams


def _plain_identify(text, model, longest=4):
    import math

    langs, words, grams = model
    found = _plain_words(text)
    if not found:
        return "und", 0.0
    total = [0.0] * len(langs)
    for w in found:
        logs = words.get(w)
        if logs is None:
            p, hits = f"_{w}_", []
            for i in range(len(p)):
                hits += next(([grams[p[i : i + k]]] for k in range(min(longest, len(p) - i), 0, -1) if p[i : i + k] in grams), [])
            logs = [sum(x) / max(len(hits), 1) for x in zip(*hits, strict=True)] if hits else [0.0] * len(langs)
        total = [a + b for a, b in zip(total, logs, strict=True)]
    mean = [x / len(found) for x in total]
    best = max(range(len(langs)), key=lambda k: (total[k], -k))
    return langs[best], 1 / sum(math.exp(x - mean[best]) for x in mean)


def test_languages_match_plain_python(spark):
    """Counts, vocabulary and scores of all of sf0.001, with room enough and too little."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    every = docs.collect()
    held = {r.doc_id for r in docs.filter(language.held_out()).collect()}
    for settings in (language.Settings(), language.Settings(max_words=400, max_grams=300)):
        model = _plain_model([(r.text, r.lang) for r in every if r.doc_id not in held and r.lang is not None and r.text is not None], settings)
        got = table(language.identify(docs.select("doc_id", "text"), language.train(docs.filter(~language.held_out()), settings=settings)).select("doc_id", "lang_pred", "score"))
        for r in every:
            lang, score = _plain_identify(r.text, model)
            assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-9, r.doc_id


def test_words_with_combining_marks_are_learned_and_scored_alike(spark):
    import unicodedata

    hindi, marathi, french = "हिन्दी भाषा में लिखा हुआ वाक्य है", "मराठी भाषेत लिहिलेले वाक्य आहे", unicodedata.normalize("NFD", "les élèves ont été réveillés très tôt")
    train = spark.createDataFrame([(1, hindi, "hi"), (2, marathi, "mr"), (3, french, "fr")], "doc_id long, text string, lang string")
    model = language.train(train, settings=language.Settings(min_count=1))
    assert {"हिन्दी", "मराठी", unicodedata.normalize("NFD", "élèves")} <= set(model.words)
    docs = documents(spark, [hindi, marathi, french.upper(), "क", "zzz"])
    got = table(language.identify(docs, model).select("doc_id", "lang_pred"))
    assert [got[k].lang_pred for k in range(3)] == ["hi", "mr", "fr"]
    model = _plain_model([(hindi, "hi"), (marathi, "mr"), (french, "fr")], language.Settings(min_count=1))
    assert all(got[k].lang_pred == _plain_identify(t, model)[0] for k, t in ((3, "क"), (4, "zzz")))


def test_equal_languages_give_the_first(spark):
    train = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id long, text string, lang string")
    docs = documents(spark, ["same words", "other"]).withColumn("_found", language.F.lit("kept"))
    got = language.identify(docs, language.train(train, settings=language.Settings(min_count=1))).collect()
    assert [(r.lang_pred, r.score, r["_found"]) for r in got] == [("a", 0.5, "kept")] * 2


def _invented(n, rng):
    """n languages of 2,000 words each over the same letters, a tenth of them shared by all, and texts of them."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    shared = [word() for _ in range(200)]
    rows, k = [], 0
    for lang in range(n):
        own = shared + [word() for _ in range(1800)]
        for _ in range(30):
            # Words are used as often as one over their place.
            rows.append((k, " ".join(own[min(1999, int(2000 ** rng.random()) - 1)] if rng.random() < 0.3 else own[rng.randrange(2000)] for _ in range(60)), f"l{lang:03d}"))
            k += 1
    return rows


def test_held_out_accuracy_by_number_of_languages(spark):
    """The model's room is shared out: with more languages each has fewer words, and what that leaves out is counted."""
    import random

    rng, cuts = random.Random(9), []
    for n in (4, 40):
        docs = spark.createDataFrame(_invented(n, rng), "doc_id long, text string, lang string")
        settings = language.Settings(max_words=20_000, max_grams=8_000, min_count=1)
        model = language.train(docs.filter(~language.held_out()), settings=settings, count_cut=True)
        got = language.identify(docs, model).filter(language.held_out()).toPandas()
        assert (got.lang == got.lang_pred).mean() > 0.9
        cuts.append(model.cut)
    assert 0 < cuts[0] < cuts[1]
    every = language.train(docs.limit(200), settings=language.Settings(max_words=None, max_grams=None, min_count=1), count_cut=True)
    assert every.cut == 0 and len(every.words) > 1000
    tight = language.train(docs.limit(200), settings=language.Settings(max_bytes=40_000, min_count=1), count_cut=True)
    assert tight.logs.nbytes <= 40_000 and tight.cut > 0
