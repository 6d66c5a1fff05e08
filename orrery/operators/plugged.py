"""Analysis by functions that are passed in: answers asked for once, retried, kept in a log; roll-ups in rounds; cancellation.

The functions run on the executors over Arrow batches.  They take and give plain records,
so a model, a rule table or a stand-in of `analyse` can be plugged in.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut

ATTEMPTS, BACK_OFF_S = 3, 1.5
ANSWER = "cache_key string, answer string, error string"


class CancelledError(Exception):
    """Not tried again: the run is to end."""


class SetupError(Exception):
    """Not tried again: no attempt can succeed."""


def retried(op: Callable, attempts: int = ATTEMPTS, back_off_s: float = BACK_OFF_S, sleep: Callable = time.sleep):
    """What op gives; after a failure it is tried again, `attempts` times in all, with waits that grow by back_off_s."""
    for attempt in range(1, attempts + 1):
        try:
            return op()
        except (CancelledError, SetupError):
            raise
        except Exception:
            if attempt == attempts:
                raise
            sleep(back_off_s * attempt)


def read_answers(spark: SparkSession, path: str | None) -> DataFrame:
    """(cache_key, answer) of a log; of several answers of one key the least stands, malformed rows are left out."""
    rows = spark.createDataFrame([], ANSWER)
    if path is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            rows = spark.read.schema(ANSWER).option("mode", "DROPMALFORMED").json(path)
    return rows.where("cache_key IS NOT NULL AND answer IS NOT NULL").groupBy("cache_key").agg(F.min("answer").alias("answer"))


def _asker(ask: Callable[[dict], str | None], names: list[str], attempts: int, back_off_s: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.select(names).to_pylist():
                try:
                    out.append((retried(lambda: ask(row), attempts, back_off_s), None))  # noqa: B023
                except (CancelledError, SetupError):
                    raise
                except Exception as error:
                    out.append((None, f"{type(error).__name__}: {error}"[:500]))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("cache_key")), pa.array([a for a, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], ["cache_key", "answer", "error"])

    return run


def answered(requests: DataFrame, ask: Callable[[dict], str | None], path: str | None = None, attempts: int = ATTEMPTS, back_off_s: float = BACK_OFF_S) -> DataFrame:
    """requests(cache_key, and what ask takes) with answer, error and cached.

    Each distinct key that the log at `path` doesn't have is asked for once, with the least
    of its rows, and its answer appended to the log.  A request that fails in all attempts,
    or gives None, has no answer; it isn't kept, so the next run asks again, and all others
    go on.  CancelledError and SetupError end the run.  Null keys aren't asked for.
    """
    spark, names = requests.sparkSession, [c for c in requests.columns if c not in ("answer", "error", "cached")]
    known = read_answers(spark, path)
    one = requests.select(*names).where("cache_key IS NOT NULL").join(known.select("cache_key"), "cache_key", "left_anti")
    rest = [c for c in names if c != "cache_key"]
    one = one.groupBy("cache_key").agg(F.min(F.struct(*rest)).alias("__row")).select("cache_key", "__row.*") if rest else one.distinct()
    said = cut(one.mapInArrow(_asker(ask, names, attempts, back_off_s), ANSWER))
    new = said.where("answer IS NOT NULL")
    if path is not None and not new.isEmpty():
        new.select("cache_key", "answer").write.mode("append").json(path)
    every = known.select("cache_key", "answer", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached")).unionByName(said.withColumn("cached", F.lit(False)))
    return requests.select(*names).join(every, "cache_key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def rolled_up(rows: DataFrame, keys: list[str], order: str, record: str, reduce: Callable[[list[str]], str], size: int = 10) -> DataFrame:
    """(keys, n, record) of rows(keys, order, record string): each group's records made one by reduce, up to `size` in order at a time.

    The records that come out are rolled up again in rounds, so no task holds more than
    `size` of a group's; a group of one record keeps it.  Null records are left out.
    """
    shape = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in keys) + ", pos long, record string"
    counts = rows.where(F.col(record).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    left = counts.agg(F.max("n")).first()[0] or 0
    now = rows.where(F.col(record).isNotNull()).select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(order, record)).cast("long").alias("pos"), F.col(record).alias("record"))

    def one(table):
        import pyarrow as pa

        parts = table.sort_by("pos")
        made = parts["record"].to_pylist()
        return pa.table({**{k: parts[k].slice(0, 1) for k in keys}, "pos": pa.array([parts["part"][0].as_py() + 1], pa.int64()), "record": pa.array([made[0] if len(made) == 1 else reduce(made)], pa.string())})

    while left > 1:
        now = cut(now.withColumn("part", F.floor((F.col("pos") - 1) / size)).groupBy(*keys, "part").applyInArrow(one, shape))
        left = -(-left // size)
    return counts.join(now.select(*keys, "record"), keys)


@contextmanager
def cancellable(spark: SparkSession, name: str):
    """Jobs that are started inside can be ended by `cancel`, from any thread."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, name: str) -> None:
    """Ends the running jobs of that name, and none else; none running: nothing happens."""
    spark.sparkContext.cancelJobGroup(name)
