"""Bulk loads: tables bucketed and sorted by file, staged and then taken over by one change of the manifest.

A load writes all its tables to a folder of its own and appends one row to the manifest
last, so a load that breaks off is never seen and the one before stays readable.  Tables
bucketed alike join and group by their key without an exchange.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = ("knowledge_id", "relative_path")
MANIFEST = "load long, id string, tables array<struct<name:string,shape:string,keys:array<string>,buckets:int>>"
#: Bytes that a bucket should hold, about.
BUCKET_BYTES = 256 << 20


def buckets_for(total_bytes: int) -> int:
    """A power of two, so that tables of different sizes share bucket borders."""
    n = 1
    while n * BUCKET_BYTES < total_bytes:
        n *= 2
    return n


def loads(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of a store: a row a complete load, none where nothing was loaded yet."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def _name(load_id: str, table: str) -> str:
    return f"load_{load_id}_{table}"


def load_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame], buckets: int, keys: tuple = FILE) -> int:
    """Writes tables and makes them the store's; the number of the load.

    Each table is bucketed and sorted by those of the keys that it has, one file a bucket.
    Two loads at once both take the next number; the greater id is then the one that counts.
    """
    for name in tables:
        if not re.fullmatch("[a-z_]+", name):
            raise ValueError(f"not a table name: {name}")
    number, own = (loads(spark, root).agg(F.max("load")).first()[0] or 0) + 1, uuid.uuid4().hex
    made = []
    for name, rows in tables.items():
        on = [k for k in keys if k in rows.columns] or [rows.columns[0]]
        rows.repartition(buckets, *on).write.format("parquet").bucketBy(buckets, *on).sortBy(*on).option("path", f"{root}/data/{own}/{name}").saveAsTable(_name(own, name))
        made.append((name, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes), on, buckets))
    spark.createDataFrame([(number, own, made)], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return number


def open_tables(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last load, or of the numbered one; none where there is none."""
    rows = loads(spark, root)
    rows = rows if number is None else rows.where(F.col("load") == number)
    last = rows.orderBy(F.desc("load"), F.desc("id")).limit(1).collect()
    out = {}
    for t in last[0].tables if last else []:
        name, on = _name(last[0].id, t.name), ", ".join(f"`{k}`" for k in t["keys"])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({t.shape}) USING parquet CLUSTERED BY ({on}) SORTED BY ({on}) INTO {t.buckets} BUCKETS LOCATION '{root}/data/{last[0].id}/{t.name}'")
        out[t.name] = spark.table(name)
    return out
