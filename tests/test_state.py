"""State over streams against batch folds, restarts from the checkpoint included."""

import random

import pytest
from orrery.functions import values as V
from orrery.operators import chains
from orrery.streaming import state, usage


@pytest.fixture
def rocks(spark):
    for k, x in state.session_settings().items():
        spark.conf.set(k, x)
    yield spark
    for k in state.session_settings():
        spark.conf.unset(k)


def test_transitions(rocks, tmp_path):
    """Two runs over one checkpoint; refused events are a part of the table."""
    spark, rng = rocks, random.Random(1)
    states = ["CREATED", "QUEUED", "PROCESSING", "PROCESSED", "HALTED", "FAILED", "nonsense"]
    events = [(f"k{rng.randrange(6)}", seq, rng.choice(states)) for seq in range(120)] + [("k0", 3, "QUEUED"), (None, 1, "CREATED"), ("k1", None, "CREATED")]
    want, at = [], {}
    for k, seq, to in events[:60] + events[60:]:
        if k is None or seq is None:
            continue
        before = at[k][0] if k in at else None
        at[k], good = state.settle(at.get(k), seq, to, V.TRANSITIONS)
        at = {k: x for k, x in at.items() if x is not None}
        want.append((k, seq, before, to, good))
    shape = "knowledge_id string, seq long, state string"
    got = None
    for part in (events[:60], events[60:]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        got = state.run_available(state.transitions(stream), str(tmp_path / "out"), str(tmp_path / "check"), by="accepted")
    rows = sorted((r.knowledge_id, r.seq, r.from_state, r.to_state, r.accepted) for r in got.collect() if r.seq != 3 or r.knowledge_id != "k0")
    assert rows == sorted(w for w in want if w[1] != 3 or w[0] != "k0")
    assert {r.accepted for r in got.where("knowledge_id = 'k0' AND seq = 3 AND to_state = 'QUEUED'").collect()} >= {False}
    refused = spark.read.parquet(str(tmp_path / "out" / "accepted=false"))
    assert refused.count() == got.where("NOT accepted").count() > 0


def test_progress(rocks, tmp_path):
    spark, rng = rocks, random.Random(2)
    runs = {f"r{k}": sorted(rng.sample(range(5_000), 50)) for k in range(4)}
    rows = [(r, at, i, 45) for r, times in runs.items() for i, at in enumerate(times)]
    rows.sort(key=lambda x: x[1])
    shape, got = "run_id string, at_ms long, done long, total long", None
    for part in (rows[:90], rows[90:]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        got = state.run_available(state.written_progress(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    want = chains.throttled(spark.createDataFrame(rows, shape))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_live_jobs(spark, tmp_path):
    rows = [("a", "k", "2024-01-01 10:00:00"), ("a", "k", "2024-01-01 10:05:00"), ("b", "k", "2024-01-01 10:00:00")]
    spark.createDataFrame(rows, "type string, knowledge_id string, at string").selectExpr("type", "knowledge_id", "CAST(at AS TIMESTAMP) created_at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("type string, knowledge_id string, created_at timestamp").parquet(str(tmp_path / "in"))
    got = usage.run_available(usage.live_jobs(stream), str(tmp_path / "out"), str(tmp_path / "check"), "append")
    assert sorted((r.type, r.knowledge_id) for r in got.collect()) == [("a", "k"), ("b", "k")]
