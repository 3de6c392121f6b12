import base64
import hashlib
import random

import public_tokenizers
import pytest

from docaudit.llm import op3_byte_bpe as bpe
from docaudit.llm import op4_warc as warc
from docaudit.llm import op7_suffix_dedup as repeats
from docaudit.llm.common import Workspace
from docaudit.llm.loser_tree import merged
from tests.llm.fixtures import documents, odd_texts

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _mixed(seed=3, n=120):
    rng = random.Random(seed)
    parts = ["a", "bé", "  ", "\n\n", "\t", "'s", "12", "!!", " x", " ", "日本", "😀", " ", "The "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 300))) for _ in range(n)]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (21, 7), (32_768, 1_024)])
def test_encoding_is_that_of_the_whole_text(spark, chunk, overlap):
    texts = [*odd_texts(), *_mixed(), "a" * 300, " " * 300, "x y" * 200]
    whole = bpe.encoding(RANKS, PATTERN)
    docs = documents(spark, texts).withColumn("ids", bpe.F.lit("clash")).withColumn("decoded", bpe.F.lit(1))
    out = bpe.decode(bpe.encode(docs, RANKS, PATTERN, chunk=chunk, overlap=overlap), RANKS, PATTERN).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.ids == whole.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_encoding_keeps_repeated_rows(spark):
    docs = documents(spark, ["w " * 100] * 3).withColumns({"_row": bpe.F.lit("r"), "_r": bpe.F.lit("s")})
    assert {(r["_row"], r["_r"], len(r.ids)) for r in bpe.encode(docs, RANKS, PATTERN, chunk=50, overlap=10).collect()} == {("r", "s", len(bpe.encoding(RANKS, PATTERN).encode_ordinary("w " * 100)))}
    assert bpe.encode(docs.unionByName(docs), RANKS, PATTERN, chunk=50, overlap=10).count() == 6
    assert bpe.encode(docs.filter("false"), RANKS, PATTERN).count() == 0


def test_removal_matches_plain_python(spark):
    rng = random.Random(5)
    texts = list(odd_texts())
    for _ in range(120):
        k = rng.random()
        if k < 0.4:
            t = rng.choice(texts) or ""
            a = rng.randrange(0, len(t) + 1)
            texts.append(t[:a][:3000] + rng.choice(["x", "é", ""]) + t[a : a + 2000])
        elif k < 0.5:
            texts.append(rng.choice(["ab", "a", "xyz ", "日本"]) * rng.randrange(0, 200))
        else:
            texts.append("".join(rng.choice(["foo ", "bar ", "é", "\n", "qux"]) for _ in range(rng.randrange(0, 300))))
    texts = [t if t is None else t[:20_000] for t in texts]
    want = repeats.brute_force(list(enumerate(texts)))
    got = repeats.remove_repeats(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == want


def test_removal_of_empty_and_repeated(spark):
    docs = documents(spark, ["z" * 300, None])
    assert repeats.remove_repeats(docs.filter("false")).count() == 0
    got = {r.doc_id: r for r in repeats.remove_repeats(docs.unionByName(docs)).collect()}
    assert (got[0].n_removed, got[1].n_bytes) == (299, 0)


def _pages(spark, htmls):
    rows = [(k, None if k == 1 else f"https://www.Site{k % 3}.example.org:443/p?q={k}#f", t, "clash") for k, t in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")


def test_archives_round_trip(spark):
    htmls = ["<p>é</p>", None, "", "<p>é</p>", "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", "<p>é</p>", "b" * 100_000, "\r\n\r\n"]
    index = warc.archive_pages(_pages(spark, htmls), file_records=3).collect()
    assert [tuple(r[:3]) for r in index] == sorted(tuple(r[:3]) for r in index)
    got = {r.page_id: r for r in index}
    first = {}
    for k, t in enumerate(htmls):
        data = (t or "").encode()
        origin = first.setdefault(data, k)
        r = got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if origin == k else ("revisit", origin))
    assert got[0].url_key == "org,example,site0)/p?q=0"


def test_small_payloads_are_responses_and_empty_tables_have_no_records(spark):
    pages = _pages(spark, ["aa", "aa", "bbbb", "bbbb"])
    assert [r.record_type for r in sorted(warc.archive_pages(pages, min_bytes=3).collect(), key=lambda r: r.page_id)] == ["response"] * 3 + ["revisit"]
    assert warc.archive_pages(pages.filter("false")).count() == 0


def test_merge_of_many_runs(spark):
    rows = [(f"k{random.Random(k).randrange(9)}", f"t{k % 4}", k, "u", "response", 1, "d", None, "f", 0, 1) for k in range(500)]
    random.Random(1).shuffle(rows)
    out = warc.merge_index(Workspace(spark, "test"), spark.createDataFrame(rows, warc.INDEX), merge_rows=100).collect()
    assert [tuple(r[:3]) for r in out] == sorted(r[:3] for r in rows)


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        assert list(merged([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_registered_query_merges_runs(spark, monkeypatch):
    """The merge of op4_warc itself has several runs in each range, as files are as many as partitions at least."""
    seen = []
    whole = warc.archive_pages
    monkeypatch.setattr(warc, "archive_pages", lambda pages: seen.append(whole(pages)) or seen[-1])
    assert warc.op4_warc(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert all(r.runs > 1 for r in seen[0].select("runs").distinct().collect())


def test_records_can_be_read_at_their_offsets(spark):
    import gzip

    ws = Workspace(spark, "test")
    big = "é" * (9 << 20)  # more than 16 MiB in UTF-8
    warc.write_archives(ws, _pages(spark, ["aa", None, big, "aa"]), "archives")
    content = {r.path.rpartition("/")[2]: bytes(r.content) for r in spark.read.format("binaryFile").load(ws.path("archives")).collect()}
    index = warc.read_archives(spark, ws.path("archives")).collect()
    assert len(index) == 4
    for r in index:
        data = gzip.decompress(content[r.file][r.offset : r.offset + r.length])
        assert data.startswith(b"WARC/1.1\r\n") and f"<urn:page:{r.page_id}>".encode() in data
    assert {r.page_id: r.payload_bytes for r in index}[2] == len(big.encode())


def test_repeated_and_null_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (1, "http://a/", "x"), (2, None, "x"), (None, "http://b/", "x")], "page_id long, url string, html string").withColumn("refers_to", warc.F.lit("clash")).withColumn("payload", warc.F.lit(1))
    got = sorted((r.page_id, r.record_type, r.refers_to, r.url) for r in warc.archive_pages(pages).collect())
    assert got == [(1, "response", None, "http://a/"), (1, "response", None, "http://a/"), (2, "revisit", 1, "")]
