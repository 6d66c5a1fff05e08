"""State over streams: transitions of knowledge bases, and progress that is written now and then.

Both keep one small value a key in the state store, so they go on after a restart from the
checkpoint.  A stream needs the RocksDB state store; see `session_settings`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import values as V


def session_settings() -> dict[str, str]:
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def settle(state: tuple | None, seq: int, to: str, allowed: dict) -> tuple[tuple | None, bool]:
    """(state after, accepted) of one event: later than the last one, and allowed from where the base stands."""
    at, last = state if state is not None else (None, None)
    good = (last is None or seq > last) and to in allowed.get(at, ())
    return ((to, seq), True) if good else (state, False)


class _Transitions(StatefulProcessor):
    def __init__(self, allowed: dict):
        self.allowed = allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        state = self.state.get() if self.state.exists() else None
        out = []
        for e in pd.concat(list(rows)).sort_values(["seq", "state"], kind="stable").itertuples():
            before = state[0] if state is not None else None
            state, good = settle(tuple(state) if state is not None else None, int(e.seq), e.state, self.allowed)
            out.append((key[0], int(e.seq), before, e.state, good))
        if state is not None:
            self.state.update(tuple(state))
        yield pd.DataFrame(out, columns=["knowledge_id", "seq", "from_state", "to_state", "accepted"])

    def close(self) -> None:
        pass


def transitions(events: DataFrame, allowed: dict = V.TRANSITIONS) -> DataFrame:
    """Of events(knowledge_id, seq, state): knowledge_id, seq, from_state, to_state, accepted.

    An event is refused if the transition isn't among the allowed ones (None: the first
    state), or if its seq isn't above that of the last accepted one.  Within a micro-batch
    events of a base are taken by seq; a base's events of one micro-batch meet in one task.
    Rows without a key, seq or state are left out.
    """
    rows = events.where("knowledge_id IS NOT NULL AND seq IS NOT NULL AND state IS NOT NULL").select("knowledge_id", F.col("seq").cast("long").alias("seq"), "state")
    shape = "knowledge_id string, seq long, from_state string, to_state string, accepted boolean"
    return rows.groupBy("knowledge_id").transformWithStateInPandas(_Transitions(allowed), outputStructType=shape, outputMode="Append", timeMode="None")


class _Throttle(StatefulProcessor):
    def __init__(self, every: int, keep: int):
        self.every, self.keep = every, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for e in pd.concat(list(rows)).sort_values(["at_ms", "done"], kind="stable").itertuples():
            if last is None or e.at_ms - last > self.every or e.done >= e.total:
                last = int(e.at_ms)
                out.append((key[0], int(e.at_ms), int(e.done), int(e.total)))
        if last is not None:
            self.last.update((last,))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last + self.keep)
        yield pd.DataFrame(out, columns=["run_id", "at_ms", "done", "total"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        self.last.clear()
        yield pd.DataFrame([], columns=["run_id", "at_ms", "done", "total"])

    def close(self) -> None:
        pass


def written_progress(progress: DataFrame, every: int = 250, keep: str = "1 day", late: str = "1 minute") -> DataFrame:
    """Of a stream of progress(run_id, at_ms, done, total) the rows to write, as `chains.throttled` gives them of a batch.

    What a run wrote last is forgotten by a timer, once the event time is `keep` past it.
    """
    ms = int(milliseconds(keep))
    rows = progress.where("run_id IS NOT NULL AND at_ms IS NOT NULL").select("run_id", F.col("at_ms").cast("long").alias("at_ms"), F.col("done").cast("long").alias("done"), F.col("total").cast("long").alias("total"), F.timestamp_millis(F.col("at_ms").cast("long")).alias("at"))
    shape = "run_id string, at_ms long, done long, total long"
    return rows.withWatermark("at", late).groupBy("run_id").transformWithStateInPandas(_Throttle(every, ms), outputStructType=shape, outputMode="Append", timeMode="EventTime")


def milliseconds(text: str) -> float:
    import pandas as pd

    return pd.Timedelta(text).total_seconds() * 1000


def run_available(df: DataFrame, path: str, checkpoint: str, by: str | None = None) -> DataFrame:
    """Runs an appending stream over what there is now into a table, parted by a column: a side output is a part of it.  Returns all rows so far."""
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (writer.partitionBy(by) if by else writer).format("parquet").start(path).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
