"""Greedy groups and throttles over ordered rows.

Groups: each row points to where the next group would begin, and the chain of pointers from
the first row is followed by doubling.  No group is gathered into a row or folded by one
function: positions, running sums and pointers are windows that stream, and a chain of n
groups takes log2(n) joins.

Throttles: a run is dealt out by buckets of time.  What a bucket stores depends on the last
stored time before it only, so buckets are read side by side twice: for what each comes to
from all times that may precede it, and, with the time that does, for the rows it stores.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .shared import cut

#: A bucket of a throttle is so many intervals wide.
WIDE = 1_000


def on_chain(pointers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos) of the rows that the chain from pos 1 meets; pointers(keys, pos, next), next greater than pos or null at the end."""
    far = cut(pointers.where("next IS NOT NULL").select(*keys, "pos", "next"))
    met = pointers.where("pos = 1").select(*keys, "pos")
    while not far.isEmpty():
        step = met.join(far, [*keys, "pos"]).select(*keys, F.col("next").alias("pos"))
        met = cut(met.unionByName(step).distinct())
        on = far.select(*keys, F.col("pos").alias("next"), F.col("next").alias("after"))
        far = cut(far.join(on, [*keys, "next"]).select(*keys, "pos", F.col("after").alias("next")))
    return met


def _first_beyond(rows: DataFrame, keys: list[str], value: str, bound: str) -> DataFrame:
    """rows(keys, pos, value, bound) with `at`: the least pos whose value is over the row's bound; value must not fall with pos."""
    ends = rows.select(*keys, F.col(value).alias("v"), F.col("pos").alias("at"), F.lit(None).cast("long").alias("asks"))
    asks = rows.select(*keys, F.col(bound).alias("v"), F.lit(None).cast("long").alias("at"), F.col("pos").alias("asks"))
    # Sorted from the greatest value; of equal ones those that ask come first, so they don't see them.
    w = Window.partitionBy(*keys).orderBy(F.desc("v"), F.col("asks").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ends.unionByName(asks).withColumn("at", F.min("at").over(w)).where("asks IS NOT NULL").select(*keys, F.col("asks").alias("pos"), "at")
    return rows.join(found, [*keys, "pos"])


def greedy(rows: DataFrame, keys: list[str], order: list, cost: Column, budget: int) -> DataFrame:
    """rows with pos and group, from 1 in each key: a group takes rows in order while their costs sum to no more than budget, one row at least.

    order must tell the rows of a key apart, else equal ones may change places.  Null costs
    count as 0, negative ones too.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    c = F.greatest(F.coalesce(cost, F.lit(0)), F.lit(0)).cast("long")
    rows = cut(rows.withColumn("pos", F.row_number().over(w).cast("long")).withColumn("__cost", c).withColumn("__upto", F.sum("__cost").over(Window.partitionBy(*keys).orderBy("pos"))))
    asked = rows.select(*keys, "pos", F.col("__upto").alias("upto"), (F.col("__upto") - F.col("__cost") + budget).alias("bound"))
    last = F.max("pos").over(Window.partitionBy(*keys))
    found = _first_beyond(asked, keys, "upto", "bound").withColumn("last", last)
    pointers = found.select(*keys, "pos", F.when(F.col("pos") < F.col("last"), F.when(F.col("at").isNotNull(), F.greatest("at", F.col("pos") + 1))).alias("next"))
    starts = on_chain(pointers, keys).withColumn("__start", F.lit(1))
    out = rows.join(starts, [*keys, "pos"], "left")
    return out.withColumn("group", F.sum(F.coalesce("__start", F.lit(0))).over(Window.partitionBy(*keys).orderBy("pos"))).drop("__start", "__cost", "__upto")


def page(rows: DataFrame, order: list, number: int = 1, chars: int = 20_000) -> DataFrame:
    """The rows of a page of so many characters of JSON, one row at least, with page and pages; past the last page the last one.

    For lists that a user turns over: their rows have one order, so they are one key.
    """
    names = rows.columns
    cost = F.char_length(F.to_json(F.struct(*names)))
    out = greedy(rows.withColumn("__all", F.lit(0)), ["__all"], order, cost, chars)
    out = out.withColumn("pages", F.max("group").over(Window.partitionBy("__all")))
    return out.where(F.col("group") == F.least(F.lit(max(number, 1)), F.col("pages"))).select(*names, F.col("group").alias("page"), "pages")


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _marks(batch, every: int, before: tuple | None):
    """Of rows in order, as arrays: bucket, time, whether a row is its bucket's first and whether it is stored whatever precedes the bucket; and the last row, which the next batch takes as before."""
    import numpy as np
    import pyarrow.compute as pc

    run_id, bucket, at, ends = (batch.column(batch.schema.names.index(c)) for c in ("run_id", "__bucket", "__at", "__ends"))
    bucket, at, ends = (c.to_numpy(zero_copy_only=False) for c in (bucket, at, ends))
    begins, earlier = np.ones(len(at), bool), at.copy()
    begins[1:] = (bucket[1:] != bucket[:-1]) | pc.not_equal(run_id[1:], run_id[:-1]).to_numpy(zero_copy_only=False)
    earlier[1:] = at[:-1]
    if before is not None:
        begins[0], earlier[0] = (run_id[0].as_py(), bucket[0]) != before[:2], before[2]
    return bucket, at, begins, ends | (~begins & (at - earlier > every)), (run_id[-1].as_py(), bucket[-1], at[-1])


class _Outcome:
    """What is stored last in a bucket, by the row that is stored first in it, while its rows pass in order."""

    def __init__(self, first: int, upto: int, every: int):
        #: `live` are (last stored time, the starts that lead to it) by time; up to `upto` some time before the bucket may still wait for its start.
        self.first, self.last, self.upto, self.every = first, None, upto, every
        self.starts, self.live, self.waiting = [], deque(), True

    def fix(self, at: int) -> None:
        """A row that is stored in any case: from here on all are one."""
        self.starts, self.live, self.waiting, self.last = [], deque([(at, [0])]), False, at

    def read(self, times: list[int]) -> None:
        live, every = self.live, self.every
        for at in times:
            if self.waiting and self.last is not None and self.last >= self.upto:
                self.waiting = False
            moved = []
            while live and at - live[0][0] > every:
                moved += live.popleft()[1]
            if self.waiting and at != self.last:
                moved.append(len(self.starts))
                self.starts.append(at)
            if moved and not live and not self.waiting:
                self.starts, moved = [], [0]
            if moved:
                live.append((at, moved))
            self.last = at

    def row(self) -> tuple:
        if len(self.live) == 1:
            return self.first, self.last, [], [self.live[0][0]]
        ends_at = {i: at for at, those in self.live for i in those}
        return self.first, self.last, self.starts, [ends_at[i] for i in range(len(self.starts))]


def _outcomes(every: int, width: int):
    """Of rows(run_id, bucket, at, ends) in order a row a bucket: its first and last time, and what is stored last in it.

    That depends on which row is stored first: `starts` are the times of those that may be,
    `stored` the last times stored after each.  Where all come to the same, starts is empty.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key = now = before = schema = None
        for batch in (b for b in batches if b.num_rows):
            schema = schema or pa.schema([("run_id", batch.schema.field("run_id").type), ("__bucket", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("starts", pa.list_(pa.int64())), ("stored", pa.list_(pa.int64()))])
            bucket, at, begins, sure, before = _marks(batch, every, before)
            out, edges = [], sorted({0, *np.flatnonzero(begins).tolist(), len(at)})
            for lo, hi in zip(edges, edges[1:]):
                if begins[lo]:
                    if now is not None:
                        out.append((*key, *now.row()))
                    key = batch.column("run_id")[lo].as_py(), int(bucket[lo])
                    now = _Outcome(int(at[lo]), key[1] * width + every, every)
                fixed = np.flatnonzero(sure[lo:hi])
                if len(fixed):
                    lo += int(fixed[-1]) + 1  # noqa: PLW2901
                    now.fix(int(at[lo - 1]))
                now.read(at[lo:hi].tolist())
            if out:
                yield _batch(out, schema)
        if now is not None:
            yield _batch([(*key, *now.row())], schema)

    return run


def _carried(every: int):
    """Of outcomes(run_id, bucket, meets, carried, starts, stored) in order the last stored time before those buckets whose predecessor has several."""

    def run(batches):
        import pyarrow as pa

        last = None
        for batch in batches:
            schema, out = pa.schema([("run_id", batch.schema.field(0).type), ("__bucket", pa.int64()), ("__at", pa.int64())]), []
            for run_id, bucket, meets, carried, starts, stored in zip(*(c.to_pylist() for c in batch.columns)):
                if not meets:
                    last = None
                elif len(carried) == 1:
                    last = carried[0]
                else:
                    out.append((run_id, bucket, last))
                # Past the last start nothing is stored here, and the next bucket is too late to meet this one.
                last = stored[min(0 if last is None else bisect_right(starts, last + every), len(stored) - 1)]
            if out:
                yield _batch(out, schema)

    return run


def _stored(every: int, names: list[str]):
    """The rows that are stored, of rows in order; those of __carries only tell the last stored time before their bucket."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        before = last = None
        for batch in (b for b in batches if b.num_rows):
            _, at, begins, sure, before = _marks(batch, every, before)
            keep = sure | begins
            for i in np.flatnonzero(~keep).tolist():
                if i and keep[i - 1]:
                    last = at[i - 1]
                keep[i] = at[i] - last > every
            if keep[-1]:
                last = at[-1]
            carries = batch.column(batch.schema.names.index("__carries")).to_numpy(zero_copy_only=False)
            yield batch.select(names).filter(pa.array(keep & ~carries))

    return run


def throttled(progress: DataFrame, every: int = 250) -> DataFrame:
    """Of progress(run_id, at_ms, done, total) the rows that are stored: the first of a run, then each that comes over `every` ms after the last stored one or completes the run.

    A run's rows are taken by time, then done, nulls last.  A row without a time is stored
    only if it completes the run or the run has none with a time and it is the first.  Rows
    without a run are left out.

    A bucket that begins over `every` ms after its predecessor's last row begins anew; most
    others follow one that comes to one time whatever precedes it.  The rest are walked in
    order, a run in a task, as one outcome a bucket: a bucket that needs it has a row every
    `every` ms, WIDE rows or so, and at most `every` + 1 times in its outcome.
    """
    names, near, width = progress.columns, ["run_id", "__bucket"], WIDE * (max(every, 0) + 1)
    order = [F.col(c).asc_nulls_last() for c in ("done", "total")]
    rows = progress.where("run_id IS NOT NULL").withColumn("__at", F.col("at_ms").cast("long")).withColumn("__ends", F.coalesce(F.col("done") >= F.col("total"), F.lit(False)))
    dated = rows.where("__at IS NOT NULL").withColumn("__bucket", F.expr(f"__at DIV {width} - IF(__at % {width} < 0, 1, 0)"))

    times = dated.select(*near, "__at", "__ends").repartition(*near).sortWithinPartitions(*near, "__at")
    shape = StructType([progress.schema["run_id"], *[StructField(c, LongType()) for c in ("__bucket", "first", "last")], *[StructField(c, ArrayType(LongType())) for c in ("starts", "stored")]])
    found = cut(times.mapInArrow(_outcomes(every, width), shape))
    before = found.select("run_id", (F.col("__bucket") + 1).alias("__bucket"), F.col("last").alias("until"), F.col("stored").alias("carried"))
    met = found.join(before, near, "left").withColumn("meets", F.coalesce(F.col("first") - F.col("until") <= every, F.lit(False)))
    known = met.where("meets AND size(carried) = 1").select(*near, F.col("carried")[0].alias("__at"))
    walked = met.where("size(stored) > 1 OR meets AND size(carried) > 1").select(*near, "meets", "carried", "starts", "stored").repartition("run_id").sortWithinPartitions(*near)
    carried = known.unionByName(walked.mapInArrow(_carried(every), StructType([*shape.fields[:2], StructField("__at", LongType())])))
    carried = carried.withColumns({"__ends": F.lit(False), "__carries": F.lit(True)})

    dealt = dated.withColumn("__carries", F.lit(False)).unionByName(carried, allowMissingColumns=True).repartition(*near).sortWithinPartitions(*near, "__at", *order)
    stored = dealt.mapInArrow(_stored(every, names), progress.schema)
    undated = rows.where("__at IS NULL")
    alone = undated.join(found.select("run_id").distinct(), "run_id", "left_anti")
    first = alone.withColumn("__pos", F.row_number().over(Window.partitionBy("run_id").orderBy(*order))).where("__pos = 1 AND NOT __ends")
    return stored.unionByName(undated.where("__ends").select(*names)).unionByName(first.select(*names))
