"""The Merkle manifest against a plain tree, on odd rows, and its pieces for themselves."""

import hashlib
import random
import zlib

import pytest
from orrery.llm import merkle
from pyspark.sql import functions as F

DOC = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, proofs as lists of (side, sibling) or None) of hex leaves."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    proofs = []
    for i in range(len(leaves)):
        proof = []
        for own in levels[:-1]:
            j = i ^ 1
            proof.append(("L" if j < i else "R", own[j]) if j < len(own) else None)
            i >>= 1
        proofs.append(proof)
    return levels[-1][0], proofs


def fold(leaf, proof):
    for s in proof:
        leaf = h(leaf) if s is None else h(s[1], leaf) if s[0] == "L" else h(leaf, s[1])
    return leaf


def plain(rows):
    """The query's rows, as tuples."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    of = lambda r, add=0: h(*map(field, (r[0], r[1], r[2], r[3] if r[3] is None else r[3] + add, r[4])))
    null_first = lambda v: (v is not None, v if v is not None else 0)
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((null_first(r[0]), of(r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([leaf for _, leaf, _ in by_lang[x]]) for x in langs if by_lang[x].sort(key=lambda t: t[:2]) is None}
    if not langs:
        return []
    root, tops = plain_tree([trees[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for (_, leaf, r), low in zip(by_lang[x], trees[x][1], strict=True):
            given = of(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf
            proof = low + top
            folded = fold(given, proof)
            out.append((r[0], leaf, trees[x][0], root, h(*[s[1] for s in proof if s]), folded, folded == root))
    return out


def result(spark, tmp_path, rows, parts=3):
    spark.createDataFrame(rows, DOC).withColumn("leaf", F.lit("clash")).withColumn("g", F.lit("clash")).repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()]


def test_query_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in merkle.op13_merkle_manifest(spark, d).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 7, 700])
def test_sizes(spark, tmp_path, n):
    """A hot group, groups of one row, groups over many partitions."""
    random.seed(n)
    rows = [(i, f"s{i % 3}", random.choice(["en"] * 20 + ["de", "é", None, f"x{i}"]), i if i % 5 else None, f"text {i}") for i in random.sample(range(10 * n), n)]
    assert sorted(result(spark, tmp_path, rows), key=repr) == sorted(plain(rows), key=repr)


def test_odd_rows(spark, tmp_path):
    """Nulls everywhere, repeated ids and repeated rows, a long text, the largest number."""
    rows = [(None, None, None, None, None)] * 3 + [(7, "a", "en", 2**63 - 1, "x")] * 40 + [(7, "b", "en", 1, ""), (7, "b", "en", 1, None), (None, "é", "en", 0, "日"), (8, "a", "", 1, "w " * 500_000), (9, "-", "fr", -1, "1:x")]
    rows += [(i, "a", "en", i, "y") for i in range(30)]
    assert sorted(result(spark, tmp_path, rows), key=repr) == sorted(plain(rows), key=repr)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    assert merkle.op13_merkle_manifest(spark, str(tmp_path)).collect() == []


def test_columns_and_proofs(spark):
    """Other columns stay, and a kept proof shows a row to belong to the root, no other row."""
    rows = spark.createDataFrame([(str(i % 2), i, f"v{i}", "x") for i in range(9)], "group string, key long, value string, root string")
    out = merkle.manifest(rows.withColumn("leaf", merkle.leaf_of(F.col("key"), F.col("value"))))
    assert out.columns == ["group", "key", "value", "leaf", "subroot", "root", "proof"]
    out = out.withColumn("own", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("other", merkle.fold(merkle.leaf_of(F.col("key"), F.lit("v")), F.col("proof")))
    assert out.where("own = root and other <> root").count() == 9


def test_boundary_nodes():
    """Subtrees of a range, joined by their ragged nodes, are the whole tree; two ragged nodes of a level at most."""
    for leaves in (1, 2, 5, 8, 13, 64, 100):
        digests = [bytes([i]) * 32 for i in range(leaves)]
        root = plain_tree([d.hex() for d in digests])[0]
        for begin in range(0, leaves, 3):
            for end in range(begin + 1, leaves + 1, 4):
                nodes = merkle.ragged(merkle.subtrees(begin, digests[begin:end], leaves))
                assert sum(min(leaves, (i + 1) << k) - (i << k) for k, i, _ in nodes) == end - begin
                assert all(sum(k == level for level, _, _ in nodes) <= 2 for k in range(8))
                if end - begin == leaves:
                    assert [(k, d.hex()) for k, _, d in nodes] == [(merkle.height(leaves), root)]
