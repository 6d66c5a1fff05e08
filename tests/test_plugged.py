"""Plugged analysis: asked once, retried, kept; roll-ups in rounds; cancellation."""

import threading
import time

import pytest
from orrery.operators import lifecycle, plugged
from pyspark.sql import functions as F


def test_retries():
    waits, calls = [], []

    def fails(times, error=ValueError):
        def op():
            calls.append(1)
            if len(calls) <= times:
                raise error("no")
            return "yes"

        calls.clear()
        return op

    assert plugged.retried(fails(2), sleep=waits.append) == "yes" and waits == [1.5, 3.0]
    with pytest.raises(ValueError):
        plugged.retried(fails(3), sleep=lambda s: None)
    with pytest.raises(plugged.CancelledError):
        plugged.retried(fails(1, plugged.CancelledError), sleep=waits.append)
    assert len(calls) == 1


def asker(log):
    def ask(row):
        with open(log, "a") as f:
            f.write(row["cache_key"] + "\n")
        if row["text"] == "breaks":
            raise RuntimeError("down")
        return None if row["text"] == "nothing" else row["text"].upper()

    return ask


def test_each_key_is_asked_once(spark, tmp_path):
    log, calls = str(tmp_path / "log"), str(tmp_path / "calls")
    rows = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "breaks"), ("c", "nothing"), (None, "null"), ("a", "one")], "cache_key string, text string").withColumn("error", F.lit("clash")).repartition(3)
    got = [(r.cache_key, r.text, r.answer, r.error, r.cached) for r in plugged.answered(rows, asker(calls), log, 2, 0).collect()]
    assert sorted(got, key=repr) == sorted([("a", "one", "ONE", None, False)] * 2 + [("a", "two", "ONE", None, False), ("b", "breaks", None, "RuntimeError: down", False), ("c", "nothing", None, None, False), (None, "null", None, None, False)], key=repr)
    assert sorted(open(calls).read().split()) == ["a", "b", "b", "c"]
    again = {r.cache_key: (r.answer, r.cached) for r in plugged.answered(rows, asker(calls), log, 1, 0).collect()}
    assert again["a"] == ("ONE", True) and sorted(open(calls).read().split()) == ["a", "b", "b", "b", "c", "c"]
    assert plugged.answered(rows.limit(0), asker(calls)).count() == 0


def test_setup_errors_end_the_run(spark):
    def ask(row):
        raise plugged.SetupError("no key")

    with pytest.raises(Exception, match="no key"):
        plugged.answered(spark.createDataFrame([("a", "x")], "cache_key string, text string"), ask, back_off_s=0)


def test_roll_ups(spark):
    """Never more than `size` records at a time, in order, whatever the group's size."""

    def reduce(records):
        assert 2 <= len(records) <= 3
        return "".join(records)

    groups = {"a": 1, "b": 2, "c": 3, "d": 28, "e": 9}
    rows = [(g, i, chr(65 + i)) for g, n in groups.items() for i in range(n)] + [("z", 0, None)]
    got = {r.g: (r.n, r.record) for r in plugged.rolled_up(spark.createDataFrame(rows, "g string, i long, r string"), ["g"], "i", "r", reduce, 3).collect()}
    assert got == {g: (n, "".join(chr(65 + i) for i in range(n))) for g, n in groups.items()}
    assert plugged.rolled_up(spark.createDataFrame([], "g string, i long, r string"), ["g"], "i", "r", reduce, 3).count() == 0


def test_cancellation(spark):
    """Ends the jobs of its name only."""

    def slow(batches):
        for b in batches:
            time.sleep(12)
            yield b

    failed = []

    def run():
        with plugged.cancellable(spark, "slow"):
            try:
                spark.range(4).mapInArrow(slow, "id long").count()
            except Exception as error:
                failed.append(str(error))

    t = threading.Thread(target=run)
    began = time.time()
    t.start()
    while not spark.sparkContext.statusTracker().getJobIdsForGroup("slow") and time.time() - began < 20:
        time.sleep(0.2)
    plugged.cancel(spark, "other")
    assert spark.range(10).count() == 10 and t.is_alive()
    plugged.cancel(spark, "slow")
    t.join(11)
    assert not t.is_alive() and failed and "cancel" in failed[0].lower()


def test_a_source_that_is_gone_is_corrupted(spark):
    k = spark.createDataFrame([("a", "PROCESSED", None), ("b", "PROCESSED", None)], "knowledge_id string, state string, failure struct<category:string,reason:string>")
    errors = spark.createDataFrame([("a", "repo", None), ("b", "llm", 429)], "knowledge_id string, error string, status_code int")
    assert {r.knowledge_id: (r.state, r.failure.category) for r in lifecycle.record_failures(k, errors).collect()} == {"a": ("CORRUPTED", "repo_unavailable"), "b": ("HALTED", "llm_rate_limit")}
