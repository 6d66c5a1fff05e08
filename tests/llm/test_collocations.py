"""Collocations against a plain count, with blocks, chunks and ranges of a few words, and on odd rows."""

import collections
import random
import re

import numpy as np
import pytest
from orrery.llm import collocations as C
from pyspark.sql import functions as F

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(docs, least, top=2000):
    """The query's rows of (lang, text) pairs."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    longest = collections.Counter()
    for (lang, *w), a in f.items():
        if len(w) == 3 and a >= least:
            for part in (w[:2], w[1:]):
                longest[(lang, *part)] = max(longest[(lang, *part)], a)
    by_lang = collections.defaultdict(list)
    for (lang, *w), a in f.items():
        if len(w) > 1 and a >= least and not (len(w) == 2 and longest[(lang, *w)] and 100 * longest[(lang, *w)] >= 50 * a):
            score, _, left, right = min((1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
            by_lang[lang].append((" ".join(w), a, left, right, n[lang], score))
    out = []
    for lang, rows in by_lang.items():
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return out


def result(spark, docs, least, top=2000, parts=3):
    rows = spark.createDataFrame(docs, "lang string, text string").withColumn("word", F.lit("clash")).withColumn("block", F.lit("clash")).repartition(parts)
    out = C.first_of_langs(C.collocations(rows, least), top)
    return [tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, monkeypatch, seed):
    """Blocks that end within pieces, texts split into chunks, many ranges."""
    random.seed(seed)
    if seed:
        for name, value in (("BLOCK", (7, 40)[seed - 1]), ("CHUNK", (3, 50)[seed - 1]), ("RANGE", 20), ("SAMPLED_KEY", 3)):
            monkeypatch.setattr(C, name, value)
    vocabulary = ["New", "York", "new", "é", "日本", "a|b", " x", "the", "of", "it's"] + [f"w{i}" for i in range(12)]
    ends = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "; ", "?", "\x0b", "\r\n"]
    docs = [(random.choice(["en", "en", "en", "de", None, ""]), "".join(random.choice(vocabulary) + random.choice(ends) for _ in range(random.choice([0, 1, 5, 80])))) for _ in range(300)]
    docs += [("en", "hot phrase here " * 200), ("en", "hot phrase " * 150 + "."), (None, None), ("fr", None), ("fr", "")]
    want = plain(docs, 4)
    assert len(want) > 50 and len({r[0] for r in want}) == 4
    assert sorted(result(spark, docs, 4)) == sorted(want)
    assert sorted(result(spark, docs, 4, top=5)) == sorted(plain(docs, 4, top=5))


def test_odd_rows(spark):
    assert result(spark, [], 2) == []
    assert result(spark, [(None, None), ("en", ""), ("en", " \t.\n"), ("en", "one")], 1) == []
    long = "x" * 3_000_000
    assert result(spark, [("en", f"{long} end {long} end")], 2) == [("en", 1, f"{long} end", 2, 2, 2, 4, 1_000_000)]
    same = [("en", "repeated rows count"), ("und", "Repeated rows count")] * 6 + [(None, "repeated ROWS count")] * 6
    assert sorted(result(spark, same, 6)) == [("en", 1, "repeated rows count", 6, 6, 6, 18, 1_000_000), ("und", 1, "repeated rows count", 12, 12, 12, 36, 1_000_000)]


def test_exact_scores(spark):
    """Products of over 64 bits: counts of 10**12 and more."""
    cuts = spark.createDataFrame([(10**12 + 1, 10**12 + 7, 10**12 + 3), (999_999_999_999, 10**15 - 1, 10**12)], "a long, l long, r long")
    got = cuts.selectExpr("a", "l", "r", "(1000000BD * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0))) s").collect()
    assert [r.s for r in got] == [1000000 * r.a * r.a // (r.l * r.r) for r in got]


def test_keys():
    """Radix order is the order of the numbers; keys hold three numbers of 42 bits."""
    random.seed(1)
    pairs = [(random.choice([0, 1, 1 << 63, random.getrandbits(64)]), random.choice([0, 5, random.getrandbits(64)])) for _ in range(500)]
    hi, lo = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
    h, low, n = C.run_lengths(hi, lo, np.ones(500, np.int64))
    assert list(zip(h.tolist(), low.tolist(), n.tolist(), strict=True)) == [(*k, c) for k, c in sorted(collections.Counter(pairs).items())]
    big = (1 << 42) - 1
    h, low, n = C._keys(np.array([0, 1, 2, 1, 3], np.int32), 1, np.array([0, 1, 2]), np.array([big, big - 5, 7], np.uint64))
    keys = [(a << 22 | b >> 20) << 64 | (b & (1 << 20) - 1) << 42 | c for a, b, c in ((big, big - 5, 0), (big, big - 5, big), (big - 5, big, 0), (big - 5, big, 7), (big, 7, 0))]
    assert [(int(a) << 64 | int(b)) for a, b in zip(h, low, strict=True)] == sorted(keys) and n.tolist() == [1] * 5
    assert [x.tolist() for x in C.unpacked(C.packed(hi, lo), 500, np.uint64, np.uint64)] == [hi.tolist(), lo.tolist()]
