"""Ancestry against walks over small graphs, on deep chains and on successive merges."""

import random

import pytest
from orrery.operators import ancestry


def frame(spark, parents):
    rows = [(c, p) for c, ps in parents.items() for p in (ps or [None])]
    return spark.createDataFrame(rows, "commit_hash string, parent_hash string")


def walk(parents, start):
    depth, now = {start: 0}, [start]
    while now:
        now = [p for c in now for p in parents.get(c, []) if p not in depth and depth.setdefault(p, depth[c] + 1)]
    return depth


def bases(parents, a, b):
    up = {c: set(walk(parents, c)) for c in {*parents, *(p for ps in parents.values() for p in ps), a, b}}
    common = up[a] & up[b]
    return {c for c in common if not any(c != d and c in up[d] for d in common)}


def pairs_frame(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string")


@pytest.mark.parametrize("seed", range(1))
def test_random_histories(spark, tmp_path, seed):
    random.seed(seed)
    names = [f"c{i}" for i in range(40)]
    parents = {c: random.sample(names[:i], min(i, random.choice([0, 1, 1, 1, 2, 2, 3]))) for i, c in enumerate(names)}
    h = ancestry.history(frame(spark, parents))
    got = {(r.start, r.commit_hash): r.depth for r in h.ancestors(spark.createDataFrame([(c,) for c in names], "commit_hash string")).collect()}
    assert got == {(c, a): d for c in names for a, d in walk(parents, c).items()}
    longest = {}
    for c in names:
        longest[c] = max((longest[p] + 1 for p in parents[c]), default=0)
    assert {r.commit_hash: r.generation for r in h.generations().collect()} == longest
    pairs = [(a, b) for a in names[20:30] for b in names[30:]]
    want = {(a, b, x) for a, b in pairs for x in bases(parents, a, b)}
    assert {tuple(r) for r in h.merge_bases(pairs_frame(spark, pairs)).collect()} == want
    one = {(r.a, r.b): r.base for r in h.merge_base(pairs_frame(spark, pairs)).collect()}
    assert one.keys() == {(a, b) for a, b, _ in want} and all((*k, v) in want for k, v in one.items())
    h.save(str(tmp_path / "h"))
    again = ancestry.load(spark, str(tmp_path / "h"))
    assert {tuple(r) for r in again.merge_bases(pairs_frame(spark, pairs)).collect()} == want


def test_chain_of_5000(spark):
    parents = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(5000)}
    h = ancestry.history(frame(spark, parents))
    assert len(h.levels) == 13
    got = {r.commit_hash: r.depth for r in h.ancestors(spark.createDataFrame([("c4999",)], "commit_hash string")).collect()}
    assert got == {f"c{i}": 4999 - i for i in range(5000)}
    assert [tuple(r) for r in h.merge_bases(pairs_frame(spark, [("c4999", "c17")])).collect()] == [("c4999", "c17", "c17")]


def test_successive_diamonds(spark):
    """2**30 paths, 91 commits."""
    parents = {"m0": []}
    for i in range(30):
        parents |= {f"l{i}": [f"m{i}"], f"r{i}": [f"m{i}"], f"m{i + 1}": [f"l{i}", f"r{i}"]}
    h = ancestry.history(frame(spark, parents))
    got = {r.commit_hash: r.depth for r in h.ancestors(spark.createDataFrame([("m30",)], "commit_hash string")).collect()}
    assert got == walk(parents, "m30") and len(got) == 91
    assert {tuple(r) for r in h.merge_bases(pairs_frame(spark, [("l29", "r29"), ("m30", "r3")])).collect()} == {("l29", "r29", "m29"), ("m30", "r3", "r3")}


def test_merge_bases_of_crossed_branches(spark):
    """Criss-cross: two bases; a nearer way around a base doesn't make its ancestor one."""
    crossed = {"o": [], "a1": ["o"], "b1": ["o"], "a2": ["a1", "b1"], "b2": ["b1", "a1"]}
    h = ancestry.history(frame(spark, crossed))
    assert {r.base for r in h.merge_bases(pairs_frame(spark, [("a2", "b2")])).collect()} == {"a1", "b1"}
    around = {"X": [], "Y": ["X"], "p": ["Y"], "q": ["p"], "r": ["Y"], "s": ["r"], "a": ["X", "q"], "b": ["X", "s"]}
    h = ancestry.history(frame(spark, around))
    assert [r.base for r in h.merge_base(pairs_frame(spark, [("a", "b")])).collect()] == ["Y"]


def test_odd_histories(spark):
    """No rows, no parents, repeated rows, nulls, unknown commits, a cycle."""
    empty = ancestry.history(frame(spark, {}))
    start = spark.createDataFrame([("x",), (None,), ("x",)], "commit_hash string")
    assert [tuple(r) for r in empty.ancestors(start).collect()] == [("x", "x", 0)]
    assert empty.merge_bases(pairs_frame(spark, [("x", "y"), ("x", "x")])).collect() == [("x", "x", "x")] and empty.generations().count() == 0
    rows = spark.createDataFrame([("b", "a"), ("b", "a"), ("b", None), (None, "a"), ("c", "gone")], "commit_hash string, parent_hash string")
    h = ancestry.history(rows)
    asked = spark.createDataFrame([("a", "b"), ("b", "a"), ("gone", "c"), ("a", None), (None, "b"), ("z", "z")], "commit_hash string, head string")
    assert sorted(((r.commit_hash, r.head, r.reachable) for r in h.reachable(asked).collect()), key=repr) == sorted([("a", "b", True), ("b", "a", False), ("gone", "c", True), ("a", None, False), (None, "b", False), ("z", "z", True)], key=repr)
    with pytest.raises(ValueError, match="cycle"):
        ancestry.history(frame(spark, {"a": ["b"], "b": ["c"], "c": ["a"]}))
