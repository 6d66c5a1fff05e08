"""Tolerant readers of JSON artifacts and of skill folders."""

import json
import re

import pytest
from orrery.sources import artifacts
from pyspark.sql import functions as F


def docs(spark, tmp_path, rows):
    at = str(tmp_path / "docs")
    artifacts.write_documents(spark.createDataFrame(rows, "k string, doc string"), at, ["k"])
    return artifacts.read_documents(spark, at)


def test_round_trip_and_types(spark, tmp_path):
    good = {"folderPath": "a/b", "purpose": "p", "summary": 5, "keywords": ["x", "", 3, None, "y"], "classes": {"no": 1}, "dependencyGraph": None, "extra": [1]}
    rows = docs(spark, tmp_path, [("k1", json.dumps(good)), ("k1", "{}"), ("k2", "[1]"), ("k2", "{broken"), ("k2", '"text"'), ("k3", None)])
    assert tuple(artifacts.health(rows).first()) == (2, 3)
    got = {r.folder_path: r for r in artifacts.folder_summaries(rows).collect()}
    assert (got["a/b"].k, got["a/b"].purpose, got["a/b"].summary, got["a/b"].keywords, got["a/b"].classes, got["a/b"].dependency_graph) == ("k1", "p", "", ["x", "y"], [], "")
    assert got[""].keywords == [] and got[""].purpose == ""


def test_writing_again_replaces_its_folders_only(spark, tmp_path):
    docs(spark, tmp_path, [("k1", '{"folderPath":"old"}'), ("k2", '{"folderPath":"kept"}')])
    rows = docs(spark, tmp_path, [("k1", '{"folderPath":"new"}')])
    assert {r.folder_path for r in artifacts.folder_summaries(rows).collect()} == {"new", "kept"}


def test_envelopes_and_bare_records(spark, tmp_path):
    record = {"architecture": "a", "dataFlow": 1, "keyPatterns": ["p", 2, ""], "majorSubsystems": [{"name": "s", "responsibility": "r"}, {"name": ""}, {"responsibility": "x"}, "text", {"name": "t", "responsibility": 3}]}
    rows = docs(spark, tmp_path, [("bare", json.dumps(record)), ("inside", json.dumps({"repoSummary": record, "architecture": "outside"})), ("null", json.dumps({"repoSummary": None, **record})), ("odd", json.dumps({"majorSubsystems": "no"}))])
    got = {r.k: (r.repo_architecture, r.repo_data_flow, r.repo_key_patterns, [tuple(s) for s in r.major_subsystems]) for r in artifacts.repo_summaries(rows).collect()}
    want = ("a", "", ["p", ""], [("s", "r"), ("t", "")])
    assert got == {"bare": want, "inside": want, "null": want, "odd": ("", "", [], [])}


def test_registries(spark, tmp_path):
    rows = docs(spark, tmp_path, [("o", json.dumps({"b": 2, "a": 2, "c": 10.5, "text": "9", "none": None, "list": [1]})), ("p", "[]")])
    got = {r.k: [tuple(e) for e in r.entries] for r in artifacts.registry_counts(rows, ["k"], top=2).collect()}
    assert got == {"o": [("c", 10.5), ("a", 2.0)]}
    registries = artifacts.registry_counts(rows, ["k"]).select(F.col("k").alias("org_id"), F.lit("side-effects").alias("registry"), "entries")
    none = spark.createDataFrame([], "knowledge_id string, repo_architecture string, repo_data_flow string, repo_key_patterns array<string>, major_subsystems array<struct<name:string,responsibility:string>>")
    out = {r.knowledge_id: r for r in artifacts.enrichment(spark.createDataFrame([("k", "o"), ("m", None)], "knowledge_id string, org_id string"), none, registries).collect()}
    assert [e.keyword for e in out["k"].side_effects] == ["c", "a", "b"] and out["k"].top_keywords == [] and out["m"].side_effects == [] and out["m"].repo_architecture == ""


def plain(content):
    """The description, by a walk over lines."""
    if not content.startswith("---") or (end := content.find("\n---", 3)) < 0:
        return ""
    value, folding = "", False
    for raw in content[3:end].split("\n"):
        line = raw.removesuffix("\r")
        if folding:
            if re.match(r"\s", line) and line.strip():
                value += (" " if value else "") + line.strip()
                continue
            folding = False
        if m := re.match(r"description:\s*(.*)$", line):
            after = m[1].strip()
            if after in (">", "|"):
                folding = True
            else:
                value = re.sub("^[\"']|[\"']$", "", after)
    return value


def test_front_matter(spark):
    heads = ["description: plain", "description: 'quoted'", 'description: "a: b"', "description: >\n  one\n  two\n\n  three", "description: |\r\n  one\r\n  two\r\nname: x", "name: x", "description:\nname: y", "description: first\ndescription: second", "  description: indented", "description: >\nname: z\n  not this", "description: >\n  a\ndescription: b"]
    texts = [f"---\n{h}\n---\nbody\ndescription: no" for h in heads] + ["", "no front matter", "---\ndescription: unclosed", "---\n---", " ---\ndescription: x\n---"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.d for r in rows.select("i", artifacts.front_matter_text(F.col("t")).alias("d")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_skills(spark):
    files = [("one/SKILL.md", 5, "---\ndescription: d\n---"), ("one/b.md", 1, "x"), ("one/a.md", 2, "x"), ("one/c.txt", 3, "x"), ("one/deep/SKILL.md", 4, "x"), ("two/readme.md", 1, "x"), ("SKILL.md", 1, "x"), ("three/SKILL.md", 0, None)]
    got = artifacts.skills(spark.createDataFrame(files, "relative_path string, size_bytes long, content string")).orderBy("name").collect()
    assert [(r.name, r.description, r.install_path, [tuple(f) for f in r.files]) for r in got] == [("one", "d", "~/.claude/skills/one", [("SKILL.md", 5), ("a.md", 2), ("b.md", 1)]), ("three", "", "~/.claude/skills/three", [("SKILL.md", 0)])]


@pytest.mark.parametrize("value", [None, "", "---\r\ndescription: x\r\n---\r\n"])
def test_front_matter_odd(spark, value):
    got = spark.createDataFrame([(value,)], "t string").select(artifacts.front_matter_text(F.col("t"))).first()[0]
    assert got == plain(value or "")
