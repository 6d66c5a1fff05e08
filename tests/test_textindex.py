"""Scored text against a plain BM25, pruning, and what a search reads."""

import math
import random
import re

import pytest
from orrery.operators import textindex
from orrery.operators.search import Scope

SHAPE = "knowledge_id string, relative_path string, purpose string, summary string, business_context string"


def plain(files, query, k=10**9, keep=lambda f: True):
    docs = {f[:2]: re.findall(r"\w+", " ".join(x for x in f[2:4] if x is not None).lower()) for f in files if None not in f[:2]}
    n, mean = len(docs), sum(map(len, docs.values())) / max(1, len(docs))
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = []
    for key, words in docs.items():
        score = 0
        for t in set(query.lower().split()):
            parts = [words.count(w) * 2.2 / (words.count(w) + 1.2 * (0.25 + 0.75 * len(words) / mean)) * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in set(words) if t in w]
            score += max(parts, default=0)
        if score and keep(key):
            out.append((*key, round(score, 6)))
    return sorted(out, key=lambda r: (-r[2], r[1], r[0]))[:k]


def corpus(seed, n=80):
    random.seed(seed)
    vocabulary = [f"{a}{b}" for a in ("read", "écrit", "x", "parse", "日本", "a_b") for b in ("", "er", "ing", "9")]
    text = lambda m: random.choice([None, " ".join(random.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=random.randint(0, m)))])
    return [(f"k{i % 3}", f"src/f{i}", text(8), text(30), text(5)) for i in range(n)]


@pytest.mark.parametrize("query", ["a", "parse ing", "READ 9 zzz", "écrit 日本 x", "no-word", "  "])
def test_scores(spark, query):
    files = corpus(1)
    index = textindex.build(spark.createDataFrame(files, SHAPE))
    got = [tuple(r)[1:] for r in textindex.search(index, "purpose", query, cap=1000).collect()]
    assert got == plain(files, query)


@pytest.mark.parametrize("cap", [1, 5])
def test_top_k_leaves_out_what_cannot_reach_it(spark, tmp_path, cap):
    files = corpus(2, 300)
    textindex.build(spark.createDataFrame(files, SHAPE)).save(str(tmp_path / "i"))
    index = textindex.load(spark, str(tmp_path / "i"))
    for query in ("日本9 read", "a_b9 a_bing read e", "x9 xer r"):
        assert [tuple(r)[1:] for r in textindex.search(index, "purpose", query, cap=cap).collect()] == plain(files, query, cap)
    scope = Scope(knowledge_id="k1", prefix="src/f1")
    got = [tuple(r)[1:] for r in textindex.search(index, "purpose", "read x9", scope, cap).collect()]
    assert got == plain(files, "read x9", cap, lambda f: f[0] == "k1" and f[1].startswith("src/f1"))


def test_a_search_reads_postings_of_its_words_only(spark, tmp_path):
    textindex.build(spark.createDataFrame(corpus(3), SHAPE)).save(str(tmp_path / "i"))
    found = textindex.search(textindex.load(spark, str(tmp_path / "i")), "purpose", "parse")
    assert found.inputFiles() and all(re.search("/i/(postings|words|grams|totals)/", f) for f in found.inputFiles())
    assert "purpose" not in found._jdf.queryExecution().optimizedPlan().output().toString() and "summary" not in found._jdf.queryExecution().toString()


def test_replaced(spark):
    files = corpus(4)
    new = [(k, p, "entirely new read", None, None) for k, p, *_ in files[:20]] + [("k9", "added", "read", "parse", None)]
    gone = [f[:2] for f in files[60:]]
    index = textindex.replace(textindex.build(spark.createDataFrame(files, SHAPE)), spark.createDataFrame(new, SHAPE), spark.createDataFrame(gone, "knowledge_id string, relative_path string"))
    # Texts without any word stay counted; here none of those named is empty.
    empty = [f for f in files[:20] + files[60:] if not (f[2] or "") and not (f[3] or "")]
    after = files[20:60] + new + [("k0", f"counted{i}", None, None, None) for i in range(len(empty))]
    for query in ("read", "entire", "parse x"):
        assert [tuple(r)[1:] for r in textindex.search(index, "purpose", query, cap=1000).collect()] == plain(after, query)


def test_odd_rows(spark):
    rows = [(None, "p", "word", None, None), ("k", None, "word", None, None), ("k", "p", None, None, None), ("k", "q", "", "", ""), ("k", "long", "word " * 20_000, None, None)]
    index = textindex.build(spark.createDataFrame(rows, SHAPE))
    assert [r.relative_path for r in textindex.search(index, "purpose", "word").collect()] == ["long"]
    assert textindex.search(textindex.build(spark.createDataFrame([], SHAPE)), "purpose", "word x").collect() == []
