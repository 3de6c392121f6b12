import corpus_pipeline
from docaudit.llm.common import Workspace
from tests.llm.fixtures import documents

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    ws = Workspace(spark, "test")
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = ws.keep(stage(spark, docs, SF), f"s{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == first.columns and docs.dtypes == first.dtypes
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] == counts[5] > 0.5 * counts[0]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect()))


def test_stages_on_odd_and_empty_rows(spark):
    odd = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (odd, odd.filter("false")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= docs.count()


def test_near_copies_are_found_as_they_were_before_lines_went(spark, tmp_path):
    """Of three near copies line dedup leaves the text to the last, and other parts to the others; that with the text stays."""
    lines = [f"this is line number {k} of a longer text that three documents have" for k in range(12)]
    copies = {k: "\n".join([*lines[:6], f"own words of copy number {k}, which no other one has, at all", *lines[6:]]) for k in (3, 5, 8)}
    other = {1: "a text of its own with some more words in it", 9: "another one that has nothing to do with the rest of them"}
    rows = [(k, t, "en", "s", len(t)) for k, t in (copies | other).items()]
    documents_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents_.write.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.drop_repeated_lines(spark, documents_, str(tmp_path))
    kept = {r.doc_id: r.text for r in corpus_pipeline.keep_one_of_near_copies(spark, left, str(tmp_path)).collect()}
    assert sorted(kept) == [1, 8, 9] and kept[8] == copies[8]


def test_near_copies_that_line_dedup_makes_are_found(spark, tmp_path):
    """Two texts that differ in one word, each under lines of others: alike, not equal, and only once those lines are gone."""
    own = " ".join(f"own{k}" for k in range(60))
    heads = ["\n".join(f"head {h} line {k} with some words that only head {h} has in line {k}" for k in range(12)) for h in "pq"]
    rest = {k: " ".join(f"text{k}word{n}" for n in range(400)) for k in (21, 22, 31, 32)}
    texts = {2: f"{heads[0]}\n{own} end", 4: f"{heads[1]}\n{own} ending", 7: f"{own.replace('own', 'other')} end"} | {k: f"{heads[k > 30]}\n{t}" for k, t in rest.items()}
    documents_ = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    documents_.write.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.drop_repeated_lines(spark, documents_, str(tmp_path))
    kept = {r.doc_id: r.text for r in corpus_pipeline.keep_one_of_near_copies(spark, left, str(tmp_path)).collect()}
    assert sorted(kept) == [4, 7, 21, 22, 31, 32] and kept[4] == f"{own} ending"
    # The join alone, over the texts before, does not link them: that is the work of line dedup.
    assert len(corpus_pipeline.keep_one_of_near_copies(spark, documents_, str(tmp_path)).collect()) == len(texts)
