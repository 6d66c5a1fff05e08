"""The whole answer of a search, and the engine's facade."""

import re

import pytest
from orrery.api import Engine
from orrery.operators import answer, search
from orrery.plans import views as v


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The fixture's tables, written, so that scans can be counted."""
    d, at = "/root/testdata/sf0.001", tmp_path_factory.mktemp("tables")
    for name in ("file", "edge", "knowledge", "concept_edge"):
        getattr(v, f"v_{name}")(spark, d).write.parquet(str(at / name))
    return {name: spark.read.parquet(str(at / name)) for name in ("file", "edge", "knowledge", "concept_edge")}


def test_one_scan_of_each_table(tables):
    out = answer.answer(tables["file"], tables["edge"], tables["knowledge"], "tion er", concepts=tables["concept_edge"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) == 4
    assert {r.section for r in out.collect()} == {"hit", "repo", "folder", "concept"}


def test_sections_follow_from_the_hits(tables):
    out = answer.answer(tables["file"], tables["edge"], tables["knowledge"], "tion er", page=2, size=20, concepts=tables["concept_edge"]).collect()
    fused = search.fused_search(tables["file"], tables["edge"], "tion er")
    want = [(r.knowledge_id, r.relative_path) for r in search.page(fused, 2, 20).collect()]
    hits = sorted((r for r in out if r.section == "hit"), key=lambda r: r.pos)
    assert [(r.knowledge_id, r.relative_path) for r in hits] == want and [r.pos for r in hits] == list(range(21, 41))
    assert {r.total_matches for r in out} == {fused.count()}
    repos = [r.name for r in sorted((r for r in out if r.section == "repo"), key=lambda r: r.pos)]
    assert repos == list(dict.fromkeys(h.name for h in hits))


def test_missing_channels_are_empty(tables):
    """Without edges, or without a text column, the other channels answer."""
    out = answer.answer(tables["file"].drop("business_context"), None, tables["knowledge"], "tion")
    assert {c for r in out.collect() for c in r.channels_used.split(",")} <= {"purpose", "paths"} and out.count() > 0
    assert answer.answer(tables["file"].select(*search.ID), None, tables["knowledge"], "tion", channels=("purpose",)).count() == 0
    assert answer.answer(tables["file"], tables["edge"], tables["knowledge"], "zzzqqq").count() == 0


def test_engine(tables):
    e = Engine(tables["file"], tables["edge"], tables["knowledge"], tables["concept_edge"])
    assert e.list_knowledge().count() == tables["knowledge"].count()
    found = e.smart_search("tion", page_size=5)
    assert 0 < found.count() <= 10
    assert e.answer("tion").where("section = 'hit'").count() <= 30
    assert e.keyword_lookup("tion").select("name").distinct().count() <= 20
    assert {r.page for r in e.list_knowledge(1).collect()} == {1} and {r.page for r in e.keyword_lookup("e", page=99).collect()} == {r.pages for r in e.keyword_lookup("e", page=2).collect()}
    asked = tables["file"].orderBy("relative_path").limit(3).selectExpr("knowledge_id", "relative_path", "doc_id ord").unionByName(tables["file"].limit(1).selectExpr("knowledge_id", "'none' relative_path", "-1L ord"))
    assert sorted(r.found for r in e.retrieve_file("metadata", asked).collect()) == [False, True, True, True]
    assert e.retrieve_file("content", asked, first=1, last=2).count() == 3 and e.retrieve_file("content", asked, search="the").count() == 3
    assert {r.section for r in e.retrieve_file("bulk_search", asked, search="zzzqqq").collect()} == {"no_match", "errored"}
    with pytest.raises(ValueError):
        e.retrieve_file("erase", asked)
    paths = tables["file"].select("relative_path").limit(3)
    assert e.metadata(paths).count() >= 3
    assert e.read(1, 2).groupBy(*search.ID).count().where("count > 2").count() == 0
    assert e.bulk_search("the").count() == tables["file"].count()
    assert e.search_lines("the").count() > 0 and e.folder_rollup().count() > 0
    assert e.folder_clusters("tion").where("file_count < 2").count() == 0 and e.concept_clusters("tion").count() <= 20
