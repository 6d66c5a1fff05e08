"""The tree source and admission in two passes."""

import os

import pytest
from orrery.operators import admission
from orrery.sources import tree
from pyspark.sql import functions as F

FILES = "relative_path string, sha string, content string"


def put(root, path, data=b"x"):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(data)


def test_outcomes_and_text(spark, tmp_path):
    root = tmp_path / "r"
    put(root, "a/b/c.xyz", "é\n".encode())
    put(root, "a/d.lock")
    put(root, "a/.DS_Store")
    put(root, "a/zero.q", b"a\0b")
    put(root, "a/late.q", b"a" * 4096 + b"\0")
    put(root, "big.q", b"a" * 101)
    put(root, "lines.q", b"\n" * 50)
    put(root, "bad.q", b"\xff")
    put(root, "empty.q", b"")
    put(root, "build/x.q")
    put(root, ".git/y.q")
    os.symlink(root, root / "loop")
    rows = tree.scan(spark, str(root), maxBytes=5000, maxLines=40).collect()
    got = {r.relative_path: r.outcome for r in rows}
    assert got == {"a/b/c.xyz": None, "a/d.lock": "reject-static", "a/.DS_Store": "reject-static", "a/zero.q": "binary", "a/late.q": None, "big.q": None, "lines.q": "oversized", "bad.q": None, "empty.q": None}
    assert {r.relative_path: r.content for r in rows}["a/b/c.xyz"] == "é\n"
    assert {r.relative_path: r.outcome for r in tree.scan(spark, str(root), maxBytes=100, maxLines=40).collect()}["big.q"] == "oversized"
    assert tree.scan(spark, str(tmp_path / "none")).count() == 0


def test_ignored_folders_are_never_listed(spark, tmp_path):
    root, log = tmp_path / "r", tmp_path / "log"
    for i in range(10_000):
        put(root, f"node_modules/p{i // 1000}/f{i}")
    for i in range(30):
        put(root, f"src/m{i % 7}/deep/er/f{i}.q")
    for folders in (1, 4, 256):
        log.write_text("")
        rows = tree.scan(spark, str(root), folders=folders, log=str(log)).collect()
        assert len({r.relative_path for r in rows}) == len(rows) == 30
        listed = log.read_text().split("\n")[:-1]
        assert listed and not any("node_modules" in x for x in listed)
        assert max(map(listed.count, listed)) <= 3  # by the driver while it shares out, for its files, and by Spark's planning
    other = tree.scan(spark, str(root), directories=["src"]).collect()
    assert len(other) == 10_000


def rule(calls):
    def decide(rows):
        with open(calls, "a") as f:
            f.writelines(r["relative_path"] + "\n" for r in rows)
        return [None if r["content"] == "unsure" else r["content"].startswith("ok") for r in rows]

    return decide


def test_each_content_is_decided_once(spark, tmp_path):
    rows = [(f"d/{i:02}.xyz", f"h{i % 4}", ("ok one", "no two", "unsure", "ok " + "z" * 9000)[i % 4]) for i in range(40)] + [("a.ts", "h9", "no"), ("b.lock", "h9", "ok"), ("n.xyz", None, None)]
    files, calls, log = spark.createDataFrame(rows, FILES).repartition(5), str(tmp_path / "calls"), str(tmp_path / "log")
    open(calls, "w").close()
    got = {r.relative_path: r.decision for r in admission.two_passes(files, rule(calls), log, "repo").collect()}
    want = {p: ("accept-llm", "reject-llm", "reject-llm", "accept-llm")[int(h[1])] for p, h, _ in rows[:40]} | {"a.ts": "accept", "b.lock": "reject-static", "n.xyz": "reject-llm"}
    assert got == want
    assert sorted(open(calls).read().split()) == ["d/00.xyz", "d/01.xyz", "d/02.xyz", "d/03.xyz"]
    # A second run asks only for what had no verdict.
    again = {r.relative_path: r.decision for r in admission.two_passes(files, rule(calls), log, "repo").collect()}
    assert again == want and sorted(open(calls).read().split())[2:4] == ["d/02.xyz", "d/02.xyz"]
    kept = {r.sha: r for r in admission.read_verdicts(spark, log).collect()}
    assert {h: (r.ignore, r.source, r.repository_name, r.files) for h, r in kept.items()} == {"h0": (False, "llm", "repo", ["d/00.xyz"]), "h1": (True, "llm", "repo", ["d/01.xyz"]), "h3": (False, "llm", "repo", ["d/03.xyz"])}
    assert {r.outcome: r.n for r in admission.outcomes(admission.two_passes(files, rule(calls), log)).collect()} == {"accept": 1, "accept-llm": 20, "reject-static": 1, "reject-llm": 21, "oversized": 0, "binary": 0}


def test_verdicts(spark, tmp_path):
    """The last verdict stands, files add up, malformed rows are left out; a closed gate asks nobody."""
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"sha":"h","ignore":true,"files":["b"],"at":"2024-01-01T00:00:00"}\n{"sha":"h","ignore":false,"files":["a","b"],"at":"2024-01-02T00:00:00"}\n{"sha":"x"}\nnonsense\n{"ignore":true}\n')
    assert [(r.sha, r.ignore, r.files) for r in admission.read_verdicts(spark, str(log)).collect()] == [("h", False, ["a", "b"])]
    files = spark.createDataFrame([("p.xyz", "h", "c")], FILES).withColumn("decision", F.lit("clash"))
    never = lambda rows: pytest.fail("asked")
    assert [r.decision for r in admission.two_passes(files, never, gate=False).collect()] == ["accept"]
    assert [r.decision for r in admission.two_passes(files, never, str(log)).collect()] == ["accept-llm"]
    assert admission.two_passes(files.limit(0), never).count() == 0


def test_copy(spark, tmp_path):
    root, to = tmp_path / "r", tmp_path / "to"
    put(root, "a/b.bin", b"\0binary")
    put(root, "a/.DS_Store")
    put(root, "dist/x.q")
    put(root, "c.txt", b"text")
    put(to, "c.txt", b"old")
    assert sorted(tuple(r) for r in tree.copy(spark, str(root), str(to)).collect()) == [("a/b.bin", True), ("c.txt", True)]
    found = {os.path.relpath(os.path.join(d, f), to) for d, _, names in os.walk(to) for f in names}
    assert found == {"a/b.bin", "c.txt"} and (to / "c.txt").read_bytes() == b"text" and (to / "a/b.bin").read_bytes() == b"\0binary"
