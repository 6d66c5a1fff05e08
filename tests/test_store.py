"""The store after pulls against the store built anew, and bulk loads."""

import random

import pytest
from orrery.functions import values as V
from orrery.operators import pull, store
from orrery.sources import bulk
from pyspark.sql import functions as F

LISTS = [c for c in V.MIRROR_CHANNELS if c != "data_flow_direction"]
SHAPE = "knowledge_id string, relative_path string, sha string, org_id string, data_flow_direction string, " + ", ".join(f"{c} array<string>" for c in LISTS)


def made(rng, key, path):
    words = ["Alpha", " beta ", "", " ", "gamma", "Alpha", "delta\t", None]
    some = lambda: rng.choice([None, [rng.choice(words) for _ in range(rng.randint(0, 4))]])
    return (key, path, f"s{rng.randrange(10**6)}", rng.choice([None, "o1", "o2"]), rng.choice([None, "", "in"]), *[some() for _ in LISTS])


def sets(s):
    return {name: sorted(map(repr, (tuple(sorted(r.asDict(True).items())) for r in t.collect()))) for name, t in s.tables().items()}


@pytest.mark.parametrize("seed", range(1))
def test_pulls_equal_a_rebuild(spark, seed):
    """Two pulls in turn, with renames, deletions and folders that come and go."""
    rng = random.Random(seed)
    paths = [f"{a}/{b}/f{i}" if b else f"{a}f{i}" for i, (a, b) in enumerate((rng.choice(["src", "lib", "doc/x"]), rng.choice(["", "one", "two"])) for _ in range(30))]
    files = {(k, p): made(rng, k, p) for k in ("k1", "k2") for p in paths[:20]}
    now = store.build(spark.createDataFrame(list(files.values()), SHAPE))
    for turn in range(2):
        old = dict(files)
        for key in rng.sample(sorted(files), 8):
            row = files.pop(key)
            if rng.random() < 0.5:  # renamed, as the content is the same
                moved = (key[0], f"new{turn}/{key[1]}")
                files[moved] = (*moved, *row[2:])
        for k in ("k1", "k2"):
            for p in rng.sample(paths, 6):
                files[k, p] = made(rng, k, p)
        before, after = [spark.createDataFrame(list(x.values()), SHAPE) for x in (old, files)]
        now, counts = store.pull(now, pull.diff(before, after), after)
        assert sets(now) == sets(store.build(after))
        got = {r.name: r.n for r in counts.collect()}
        assert got["files_upserted"] == sum(old.get(k) != x for k, x in files.items()) and got["files_deleted"] == len(old.keys() - files.keys())


def test_channels(spark):
    rows = spark.createDataFrame([("k", "a", "s", None, " out ", *[["A b ", "a B", "A b"]] * len(LISTS))], SHAPE)
    got = {(r.type, r.keyword) for r in store.build(rows).mirror.collect()}
    assert got == {(t, "out" if c == "data_flow_direction" else w) for c, t in V.MIRROR_CHANNELS.items() for w in (["a b"] if c == "keywords" else ["A b", "a B"])}
    assert {r.org_id for r in store.build(rows).mirror.collect()} == {"local"}


def test_skipped_files_and_summaries(spark):
    """A changed file without an analysis keeps its old row; only named folders get new summaries."""
    none = (None,) * (len(LISTS) + 1)
    files = spark.createDataFrame([("k", "a/f", "1", None, *none), ("k", "b/g", "1", None, *none)], SHAPE)
    told = lambda *rows: spark.createDataFrame([("k", *r) for r in rows], "knowledge_id string, folder_path string, summary string")
    changes = spark.createDataFrame([("k", "modified", "a/f", None), ("k", "added", "a/h", None)], "knowledge_id string, status string, relative_path string, old_path string")
    new = spark.createDataFrame([("k", "a/h", "2", None, *none)], SHAPE)
    after, _ = store.pull(store.build(files, told(("a", "old a"), ("b", "old b"))), changes, new, told(("a", "new a"), ("b", "new b")))
    assert {(r.relative_path, r.sha) for r in after.file.collect()} == {("a/f", "1"), ("b/g", "1"), ("a/h", "2")}
    assert {(r.folder_path, r.summary, r.direct_files, r.all_files) for r in after.folder.collect()} == {("", "", 0, 3), ("a", "new a", 2, 2), ("b", "old b", 1, 1)}


def test_empty_store(spark):
    empty = spark.createDataFrame([], SHAPE)
    no_changes = spark.createDataFrame([], "knowledge_id string, status string, relative_path string, old_path string")
    after, counts = store.pull(store.build(empty), no_changes, empty)
    assert all(t.count() == 0 for t in after.tables().values()) and {r.n for r in counts.collect()} == {0}


def test_bulk_load(spark, tmp_path):
    """Joins without an exchange; a load that breaks off leaves the last one readable."""
    root = str(tmp_path / "store")
    assert bulk.open_tables(spark, root) == {}
    file = spark.range(1000).select(F.lit("k").alias("knowledge_id"), F.concat(F.lit("f"), "id").alias("relative_path"), "id")
    edge = file.select("knowledge_id", "relative_path", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("dst"))
    assert bulk.load_tables(spark, root, {"file": file, "edge": edge}, 8) == 1
    t = bulk.open_tables(spark, root)
    joined = t["file"].join(t["edge"].groupBy(*bulk.FILE).agg(F.count("*").alias("n")).hint("merge"), list(bulk.FILE))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.where("n = 2").count() == 1000
    bad = file.withColumn("id", F.when(F.col("id") == 700, F.raise_error(F.lit("broken"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        bulk.load_tables(spark, root, {"file": file.limit(1), "edge": bad}, 8)
    assert bulk.open_tables(spark, root)["file"].count() == 1000
    assert bulk.load_tables(spark, root, {"file": file.limit(5)}, 8) == 2
    assert bulk.open_tables(spark, root)["file"].count() == 5 and bulk.open_tables(spark, root, 1)["file"].count() == 1000
    with pytest.raises(ValueError):
        bulk.load_tables(spark, root, {"a; b": file}, 8)
    assert [bulk.buckets_for(n) for n in (0, bulk.BUCKET_BYTES, 5 * bulk.BUCKET_BYTES)] == [1, 1, 8]
