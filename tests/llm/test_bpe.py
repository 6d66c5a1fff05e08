"""Byte-level BPE against a plain version: the pattern's matches, then the merge of least rank until none is left."""

import hashlib
import random

import public_tokenizers
import pytest
import regex
from orrery.llm import bpe, queries
from pyspark.sql import functions as F

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOC = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def shared(spark):
    return bpe.coder(spark, PATH, public_tokenizers.PATTERN)


def plain(text, ranks):
    out = []
    for m in regex.findall(public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in m.encode()]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out += [ranks[p] for p in parts]
    return out


def made(seed, n):
    random.seed(seed)
    bits = ["don't", "'s", "''s", "we'll", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "\x1c", "é", "日本", "1", "12", "a1", "!", "...", "<|endoftext|>", "\U0001f600", "é", "word", "Word", "'", "​"]
    return ["".join(random.choice(bits) for _ in range(random.randint(0, 60))) for _ in range(n)]


def test_encode_brute_force(spark, shared):
    ranks = bpe.read_ranks(spark, PATH)
    texts = made(1, 150)
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOC).repartition(3)
    got = bpe.decode(bpe.encode(rows, shared), shared).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == plain(texts[r.doc_id], ranks)
        assert bytes(r.decoded) == texts[r.doc_id].encode()


def test_pieces_change_nothing(spark):
    ranks = bpe.read_ranks(spark, PATH)
    own = bpe.Coder(ranks, public_tokenizers.PATTERN)
    for text in [*made(2, 300), " " * 50, "x" + " " * 50 + "y", "\n" * 40 + "x", "x" + "\n" * 40, " " * 9 + "\n" * 9 + "é", "a" * 70, " \n" * 20 + "'s"]:
        whole = own.by_match.encode_ordinary(text)
        for size in (1, 2, 5, 17):
            assert own.encode(text, size) == whole
            assert "".join(p for p, _ in bpe.pieces(text, size)) == text


def test_long_texts(spark, shared):
    """Runs on which the regex engine overflows by itself, a word and a number without end, and many words."""
    texts = ["\n" * 2_000_000 + "x", "a" * 300_000, "7" * 300_000, "one two " * 100_000, "x" + " " * 1_500_000]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(rows, shared), shared).select("doc_id", F.size("ids").alias("n"), F.sha2("decoded", 256).alias("h")).collect()}
    assert [got[i].h for i in range(5)] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert got[3].n == 200_001 and got[1].n < 100_000


def test_odd_rows(spark, shared):
    rows = [(None, "a b", None), (None, "a b", None), (1, None, "en"), (2, "", "en"), (2, "", "en")]
    clash = spark.createDataFrame(rows, DOC).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit("clash")).withColumn("__in", F.lit(1))
    got = bpe.decode(bpe.encode(clash, shared, keep_text=True), shared)
    assert sorted((repr(r.doc_id), r.text, len(r.ids), bytes(r.decoded)) for r in got.where("text is not null").collect()) == [("2", "", 0, b""), ("2", "", 0, b""), ("None", "a b", 2, b"a b"), ("None", "a b", 2, b"a b")]
    assert [(r.ids, bytes(r.decoded)) for r in got.where("text is null").collect()] == [([], b"")]
    assert bpe.encode(clash.limit(0), shared).count() == 0
    ids = spark.createDataFrame([(1, [65, 99_999]), (2, None), (3, [65, None]), (4, [-1])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(ids, shared).collect()] == [None] * 4
    bad = spark.sql("select 1L doc_id, cast(x'61ff62' as string) text")
    assert bytes(bpe.decode(bpe.encode(bad, shared), shared).first().decoded) == "a�b".encode()


def test_query_brute_force(spark):
    d = "/root/testdata/sf0.001"
    ranks = bpe.read_ranks(spark, PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op11_byte_bpe"](spark, d).collect()}
    assert got.keys() == texts.keys()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert all(r.decoded_sha256 == digest(texts[i].encode()) for i, r in got.items())
    for i in sorted(texts, key=lambda i: len(texts[i]))[:60]:
        ids = plain(texts[i], ranks)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), digest(" ".join(map(str, ids)).encode()))
