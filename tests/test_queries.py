"""Every registered query of the engine against its SQL, and facts about single functions."""

import pytest
from conftest import rows_of
from orrery.functions import text as X
from orrery.operators import lifecycle, scan
from orrery.plans.catalogue import QUERIES, SQL
from orrery.sources import files as sources
from orrery.streaming import usage
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    want = duck.sql(SQL[name])
    names = want.columns
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.collect(), df.columns) == rows_of(want.fetchall(), names)


def test_overlay():
    assert scan.effective(("a", "b"), ("c",), ("b",)) == ["a", "c"]


def test_scan_repository(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.ts").write_text("x")
    (tmp_path / "src/b.dat").write_bytes(b"a\0b")
    (tmp_path / "node_modules/c.ts").write_text("x")
    got = {r.relative_path: r.outcome for r in sources.scan_repository(spark, str(tmp_path)).collect()}
    assert got == {"src/a.ts": "small", "src/b.dat": "binary", "node_modules/c.ts": "rejected"}


def test_safe_path(spark):
    rows = spark.createDataFrame([("a/b",), ("",), ("/a",), ("a/../b",), ("..",), ("a..b",)], "p string")
    assert [r[0] for r in rows.select(sources.safe_path(F.col("p"))).collect()] == [True, False, False, False, False, True]


def test_analyses_skip_malformed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"relativePath": "x", "language": "go", "analysedAt": "1"}')
    (tmp_path / "b.json").write_text('{"relativePath": "x", "language": "rust", "analysedAt": "2"}')
    (tmp_path / "c.json").write_text("{nonsense")
    assert [(r.relativePath, r.language) for r in sources.read_analyses(spark, str(tmp_path)).collect()] == [("x", "rust")]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "2024-01-05 10:00:00", 2, 3), ("u1", "2024-01-06 10:00:00", 1, 1), ("u2", "2024-02-01 00:00:00", 5, 5)], "identity_id string, created_at string, input_tokens long, output_tokens long").withColumn("created_at", F.to_timestamp("created_at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = usage.metered(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    got = usage.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert rows_of(got.collect(), got.columns) == rows_of((b := usage.metered(rows)).collect(), b.columns)


def test_one_change_of_a_key_counts(spark):
    table = spark.createDataFrame([("k", "A"), ("m", "B"), (None, "C")], "key string, state string")
    changes = spark.createDataFrame([("k", "late", 2), ("k", "early", 1), ("z", "none", 1), (None, "null", 1)], "key string, to_state string, at int")
    got = lifecycle.update(table, changes, "key", order="at", state=F.col("to_state"))
    assert sorted(map(tuple, got.collect()), key=repr) == [("k", "late"), ("m", "B"), (None, "C")]
    assert lifecycle.update(table, changes, "key", state=F.col("to_state")).count() == 3


def test_patterns_end_at_the_end(spark):
    rows = spark.createDataFrame([("abc",), ("abc\n",), ("abc\r\n",)], "t string")
    assert [tuple(r) for r in rows.select(X.is_slug(F.col("t")), X.is_branch_name(F.col("t"))).collect()] == [(True, True), (False, False), (False, False)]


def test_json_set_keeps_what_it_does_not_name(spark):
    docs = ['{"state":"A","n":1,"other":"keep","deep":{"x":[1,2.5,null]}}', "[1]", "nonsense", None, "{}"]
    rows = spark.createDataFrame([(d,) for d in docs], "d string")
    got = [r[0] for r in rows.select(X.json_set(F.col("d"), state=F.lit("B"), m=F.lit(2))).collect()]
    assert got[0] == '{"state":"B","n":1,"other":"keep","deep":{"x":[1,2.5,null]},"m":2}'
    assert got[1:] == ['{"state":"B","m":2}'] * 4
