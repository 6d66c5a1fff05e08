"""Job payloads and the texts built of enrichment."""

import json

from orrery.functions import text as X
from orrery.operators import payloads
from orrery.sources import artifacts
from pyspark.sql import functions as F


def test_narrow(spark):
    rows = [
        ("github_index", {"knowledgeId": "k", "repoUrl": "u", "branch": "", "commitHash": 5, "orgId": "o", "llmModel": "m", "rootDir": "r", "ignoreOverrides": {"globs": {"add": ["*.x", "", 1], "remove": "no"}, "extensions": {}, "other": {"add": ["y"]}}}),
        ("github_index", {"knowledgeId": "other", "repoUrl": "u", "ignoreOverrides": []}),
        ("github_index", {"knowledgeId": "k"}),
        ("github_index", {"repoUrl": "u"}),
        ("local_ingest", {"knowledgeId": "k", "rootDir": "r", "repoUrl": "u", "ignoreOverrides": {"globs": {"add": ["x"]}}}),
        ("local_ingest", {"knowledgeId": "k", "rootDir": ""}),
        ("local_ingest", [1]),
        ("else", {"knowledgeId": "k"}),
    ]
    jobs = spark.createDataFrame([(i, "k", t, json.dumps(p)) for i, (t, p) in enumerate(rows)] + [(8, "k", None, None), (9, "k", "local_ingest", "{broken")], "id int, knowledge_id string, type string, payload string")
    got = {r.id: r for r in payloads.narrow(jobs).collect()}
    assert [got[i].problem for i in range(10)] == [None, None, "missing repoUrl", "missing knowledgeId", None, "missing rootDir", "not an object", "unknown type", "unknown type", "not an object"]
    a = got[0]
    assert (a.knowledge_id, a.coherent, a.repo_url, a.branch, a.commit_hash, a.org_id, a.llm_model, a.root_dir) == ("k", True, "u", None, None, "o", "m", None)
    assert a.ignore_overrides.globs.add == ["*.x"] and a.ignore_overrides.globs["remove"] is None and a.ignore_overrides.extensions is None
    assert got[1].coherent is False and got[1].ignore_overrides is None and (got[4].root_dir, got[4].repo_url, got[4].ignore_overrides) == ("r", None, None)


def test_enrichment_text(spark):
    knowledge = spark.createDataFrame([("k", "o"), ("m", "none")], "knowledge_id string, org_id string")
    summaries = spark.createDataFrame([("k", "layers", "", ["p", "q"], [("s", "r")])], "knowledge_id string, repo_architecture string, repo_data_flow string, repo_key_patterns array<string>, major_subsystems array<struct<name:string,responsibility:string>>")
    registries = spark.createDataFrame([("o", "keywords", [("a", 3.0), ("b", 1.5)])], "org_id string, registry string, entries array<struct<keyword:string,count:double>>")
    rows = artifacts.enrichment(knowledge, summaries, registries)
    got = {r.knowledge_id: r for r in rows.select("knowledge_id", X.enrichment_text("product").alias("p"), X.enrichment_text("technical").alias("t"), X.enrichment_text().alias("s"), X.enrichment_text(most=5).alias("c")).collect()}
    product = "TOP REPOSITORY KEYWORDS (by frequency):\n  a (3)\n  b (1.5)\n\nMAJOR SUBSYSTEMS:\n  s: r"
    technical = "REPOSITORY ARCHITECTURE:\nlayers\n\nKEY PATTERNS:\n  p, q"
    assert (got["k"].p, got["k"].t, got["k"].s) == (product, technical, f"{product}\n\n{technical}")
    assert (got["m"].p, got["m"].s) == ("", "") and got["k"].s.startswith(got["k"].c) and len(got["k"].c) <= 20


def test_prompt_lines(spark):
    rows = spark.createDataFrame([([("", "p", "s", ["a", "b"]), ("x", "q", "t", [])], ["one", "two"])], "f array<struct<folder_path:string,purpose:string,summary:string,keywords:array<string>>>, p array<string>")
    r = rows.select(X.folder_lines(F.col("f")), X.partial_lines(F.col("p"))).first()
    assert r[0] == 'Folder count: 2\n\nFolder summaries (sorted shallowest-first):\n\n- <root>\n  purpose: p\n  summary: s\n  keywords: ["a","b"]\n\n- x\n  purpose: q\n  summary: t\n  keywords: []'
    assert r[1] == "--- Partial 1 ---\none\n\n--- Partial 2 ---\ntwo"
