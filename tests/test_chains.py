"""Greedy groups and throttling against plain folds."""

import random

import pytest
from orrery.operators import chains
from pyspark.sql import functions as F


def fold(costs, budget):
    out, group, total = [], 0, None
    for c in costs:
        c = max(c or 0, 0)
        if total is None or total + c > budget:
            group, total = group + 1, 0
        total += c
        out.append(group)
    return out


def test_greedy(spark):
    random.seed(2)
    groups = {f"k{k}": [random.choice([0, 1, 3, 7, 30, None]) for _ in range(n)] for k, n in enumerate((1, 2, 40, 150))} | {None: [5, 5]}
    rows = [(k, i, c) for k, costs in groups.items() for i, c in enumerate(costs) if k is not None]
    got = chains.greedy(spark.createDataFrame(rows, "k string, i long, c long"), ["k"], ["i"], F.col("c"), 20).collect()
    assert {(r.k, r.i): r.group for r in got} == {(k, i): g for k, costs in groups.items() if k is not None for i, g in enumerate(fold(costs, 20))}
    assert chains.greedy(spark.createDataFrame([], "k string, i long, c long"), ["k"], ["i"], F.col("c"), 20).count() == 0


def test_a_large_group(spark):
    """60,000 rows of one key, none of them gathered into a row."""
    rows = spark.range(60_000).select(F.lit("k").alias("k"), "id", (F.col("id") % 7 + 1).alias("c"))
    out = chains.greedy(rows, ["k"], ["id"], F.col("c"), 1_000)
    want = fold([i % 7 + 1 for i in range(60_000)], 1_000)
    assert [r.group for r in out.orderBy("id").collect()] == want


@pytest.mark.parametrize("every", [0, 250, 10_000])
def test_throttled(spark, every):
    random.seed(every)
    runs = {f"r{k}": sorted(random.randrange(3_000) for _ in range(n)) for k, n in enumerate((1, 5, 60))}
    rows = [(r, at, i, 40) for r, times in runs.items() for i, at in enumerate(times)]
    want = []
    for r, times in runs.items():
        last = None
        for i, at in enumerate(times):
            if last is None or at - last > every or i >= 40:
                last = at
                want.append((r, at, i, 40))
    got = chains.throttled(spark.createDataFrame(rows, "run_id string, at_ms long, done long, total long"), every)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def throttle_fold(rows, every):
    """rows(run, at, done, total) in order, one run."""
    out, last = [], None
    for r in rows:
        if last is None or r[1] - last > every or r[2] >= r[3]:
            last = r[1]
            out.append(r)
    return out


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_long_run(spark):
    """The work of 2,000 rows that are all stored takes no more rounds than that of 20."""
    shape, n_jobs = "run_id string, at_ms long, done long, total long", []
    for n in (20, 2_000):
        rows = [("r", i * 40, i, 5) for i in range(n)]
        got, k = jobs(spark, f"throttle {n}", lambda: chains.throttled(spark.createDataFrame(rows, shape)).collect())  # noqa: B023
        assert sorted(map(tuple, got)) == throttle_fold(rows, 250)
        n_jobs.append(k)
    assert n_jobs[1] <= n_jobs[0] + 4, n_jobs


@pytest.mark.parametrize("step", [1, 2, 3, 5])
def test_a_run_without_pauses(spark, step):
    """What is stored in a bucket of time depends on all buckets before; times from below zero, one row completes the run."""
    rows = [("r", i * step - 9_001, i, 6_000) for i in range(6_001)] + [("s", i * step, i, 10**6) for i in range(6_001)]
    got = chains.throttled(spark.createDataFrame(rows, "run_id string, at_ms long, done long, total long"), 3)
    assert sorted(map(tuple, got.collect())) == throttle_fold(rows[:6_001], 3) + throttle_fold(rows[6_001:], 3)


def test_rows_without_time_or_run(spark):
    rows = [("a", None, 9, 5), ("a", 10, 1, 5), ("a", None, 2, 5), ("a", 20, 2, 5), ("b", None, 3, 5), ("b", None, 2, 5), ("b", None, None, 5), (None, 1, 9, 5)]
    got = chains.throttled(spark.createDataFrame(rows, "run_id string, at_ms long, done long, total long"))
    assert sorted(map(tuple, got.collect()), key=repr) == [("a", 10, 1, 5), ("a", None, 9, 5), ("b", None, 2, 5)]


def test_progress_of_no_user(spark, tmp_path):
    """As in its SQL, events without a user are a run too."""
    from orrery.plans.catalogue import QUERIES

    spark.createDataFrame([(1, None), (2, None), (9, None), (3, 4)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["progress_writes"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("r", 40, 1, 777), ("r", 360, 9, 777), ("r4", 120, 3, 777)]
