"""Shared pieces of the corpus operators: reading, cutting lineage, skew-safe joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white space characters that the text contracts name, as a regex class body.
SPACES = r"\x20\x09-\x0D"
#: Keys are heavy that hold over 1/HEAVY of all rows, in large tables over ROWS_OF_A_KEY of them, which a
#: task can take; as these hold over 1/MOST_HEAVY of all rows, no more than MOST_HEAVY are ever broadcast.
HEAVY, ROWS_OF_A_KEY, MOST_HEAVY = 512, 100_000, 1 << 16
#: Bits by which rows are sifted, and in a row of them: 8 MB at most, however many keys there are.
SIFT_BITS, BITS_A_ROW = 1 << 26, 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a folder of our own only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, where any executor can read it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def dir_of(spark: SparkSession) -> str:
    """A folder name of its own below the shared folder, for tables that are written."""
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def word_count(text) -> F.Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def heavy_from(total: int) -> float:
    """Rows above which a key of a table of so many rows is heavy: total / MOST_HEAVY at least."""
    return min(total / HEAVY, max(total / MOST_HEAVY, ROWS_OF_A_KEY))


def attach(rows: DataFrame, groups: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """Inner join of rows to one row per group, where one group may hold most of the rows.

    groups: unique in `on`, with the group's number of rows in `n`; total: of all rows.
    Groups of over heavy_from(total) rows, MOST_HEAVY at most, are broadcast; the others, none
    of them large, meet their rows in a shuffle.  rows is used twice: pass a cut one.
    """
    least = heavy_from(total)
    heavy, light = groups.where(F.col(n) > least), groups.where(F.col(n) <= least)
    hot = rows.join(F.broadcast(heavy), on)
    cold = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on)
    return hot.unionByName(cold)


def marked(rows: DataFrame, on: str, keys: DataFrame) -> DataFrame:
    """rows with `__maybe`: true where keys, one column of longs, has the value of `on`, and for some others by chance; else false.

    A hash of each key sets a bit, and the bits are broadcast.  Many keys only make `__maybe`
    true more often, so what follows it must be an exact join, to which fewer rows then go.
    """
    spot = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(SIFT_BITS))
    place = spot(keys[keys.columns[0]])
    bits = keys.select((place / BITS_A_ROW).cast("long").alias("__at"), (place % BITS_A_ROW).alias("__bit"))
    bits = bits.groupBy("__at").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    place = spot(rows[on])
    out = rows.join(F.broadcast(bits), (place / BITS_A_ROW).cast("long") == F.col("__at"), "left")
    bit = place % BITS_A_ROW
    byte = F.conv(F.hex(F.substring("__bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return out.select(*[rows[c] for c in rows.columns], F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)).alias("__maybe"))


def sifted(rows: DataFrame, on: str, keys: DataFrame) -> DataFrame:
    """rows without most of those whose `on` is not in keys; see marked."""
    return marked(rows, on, keys).where("__maybe").drop("__maybe")


def share(spark: SparkSession, value):
    """value for all executors, pickled with its class, so that they need no copy of this package; see shared_value."""
    from pyspark import cloudpickle

    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(shared):
    import pickle

    return pickle.loads(shared.value)


def bare(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that extra columns with clashing names stay out."""
    return docs.select(*[docs[c] for c in names])
