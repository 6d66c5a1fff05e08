"""Mixing sources to target weights (operator 1), in DataFrame operations only.

Rows get hash-random keys; within each source they are ordered by key, and a two-level
prefix sum of their sizes (over key ranges, then within one range) says where the exact
budget of the source falls.  Budgets over a source's size repeat it in epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bare, cut, table, word_count

#: Rows of one (source, key range) that one sort holds, about.
RANGE_ROWS = 20_000
MAX_EPOCHS = 3


def source_targets(sizes: DataFrame, max_epochs: float = MAX_EPOCHS, weights: tuple = (1, 2, 3)) -> DataFrame:
    """One row per source: named (0 and the name, or 1 for null: so sorted), source_size, target (double), from rows (named, size).

    Sources in code point order, null last, weigh `weights` in turn and share the sum of
    all sizes; no target passes max_epochs times its source's size, and what it leaves is
    shared among the others by weight.  Sorted by size per weight, the capped sources are
    a prefix, so one running sum finds them: no loop.  One row per source meets in one
    task, as source names are configuration, not data.  A total of 0 gives targets of 0.
    """
    by_name, by_ratio = Window.orderBy(F.col("named")), Window.orderBy("ratio", "pos")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("pos") - 1) % len(weights) + 1).cast("int"))
    s = sizes.groupBy("named").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    s = s.withColumn("pos", F.row_number().over(by_name)).withColumn("w", w)
    s = s.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double"))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("w").over(onward)).withColumn("capped", F.col("ratio") <= F.col("level"))
    first_open = F.min(F.when(~F.col("capped"), F.struct("ratio", "pos", "level"))).over(every)["level"]
    s = s.withColumn("final", F.coalesce(first_open, F.lit(0.0)))
    return s.select("named", "source_size", "n_docs", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * F.col("final")).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", max_epochs: float = MAX_EPOCHS, weights: tuple = (1, 2, 3), size=None) -> DataFrame:
    """Per row of docs(doc_id, source, text): doc_id, source, size, source_size, target, taken.

    taken: words that the mix takes of the row, whole epochs first; the row on which the
    budget falls gives a part, so each source's sum is its target rounded down.  Keys are
    md5(doc_id as text, seed): reruns agree.  Null ids share one key and are ordered by
    size; rows alike in id and size are interchangeable.  Null or empty texts have size 0
    and are taken 0 times.  No rows give no rows.  Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    n = word_count(docs["text"]) if size is None else size
    key = F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    named = F.when(docs["source"].isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), docs["source"].cast("string")))
    rows = cut(docs.select(docs["doc_id"], docs["source"], named.alias("named"), n.alias("size"), key.alias("key")))
    goals = cut(source_targets(rows, max_epochs, weights))
    # Ranges of the key: its first `digits` hex digits, so that a range has about RANGE_ROWS rows of the largest source.
    largest = goals.agg(F.max("n_docs")).first()[0] or 0
    digits = 1
    while largest / 16**digits > RANGE_ROWS:
        digits += 1
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    sums = rows.groupBy("named", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("named").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    sums = sums.join(goals.select("named", "source_size", "target"), "named")
    within = Window.partitionBy("named", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within)).join(sums, ["named", "range"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor("target") - whole * F.col("source_size")
    start = F.col("ahead") + F.col("upto") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    taken = (whole * F.col("size") + part).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = bare(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(COALESCE(doc_id::VARCHAR, '') || ':mix') AS key FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM g),
w AS (SELECT *, ((pos - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM p),
l AS (SELECT *, cap / w AS ratio FROM w),
v AS (SELECT *, (total - COALESCE(sum(cap) OVER (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(w) OVER (ORDER BY ratio, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
f AS (SELECT arg_min(level, (ratio, pos)) AS final FROM v WHERE ratio > level),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE w * COALESCE(final, 0.0) END AS target FROM v, f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END * size
   + greatest(0, least(size, floor(target) - CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END * source_size - start)))::BIGINT AS taken
FROM r
"""
