"""Line dedup (operator 5), in DataFrame operations only.

Each document gives one row per distinct line key (its md5, never the text).  Keys that
hold a large share of all rows are found and decided by partial sums.  The other rows are
dealt out by ranges of the hash and sorted by hash, then document (largest first) and
position; a streaming pass over that order meets each key's keeper first.  What comes
back to a document is the set of its dropped keys, and from it a run-length bitmap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, bare, cut, heavy_from, table

MIN_CHARS, MIN_DOCS = 20, 3


def line_hashes(text, min_chars: int = MIN_CHARS) -> F.Column:
    """array<string>: of each line the md5 of its key, or "" where the key is under min_chars.

    Key: the line without white space at both ends, A-Z lower-cased.  Null text: one empty line.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), upper, lower), "\n", -1)
    spaces = "".join(chr(c) for c in (32, 9, 10, 11, 12, 13))

    def key(line):
        trimmed = F.btrim(line, F.lit(spaces))
        return F.when(F.char_length(trimmed) >= min_chars, F.md5(trimmed.cast("binary"))).otherwise(F.lit(""))

    return F.transform(lines, key)


def fingerprint(text) -> F.Column:
    """Tells rows of one doc_id apart; rows alike in both are one and the same."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, fp, gone array<int>) of the documents that lose lines: their sorted positions, from 0.

    A key counts once per doc_id; rows with a null doc_id neither count nor lose lines.
    """
    rows = docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"], fingerprint(docs["text"]).alias("fp"), F.posexplode(line_hashes(docs["text"], min_chars)).alias("pos", "h"))
    rows = cut(rows.where(F.col("h") != ""))
    # Heavy keys, of which there are few, are decided by partial sums and broadcast.
    heavy = rows.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") > max(heavy_from(rows.count()), min_docs))
    heavy = cut(heavy.select("h", "keeper"))
    holders = rows.join(F.broadcast(heavy), "h").groupBy("h", "doc_id").agg(F.lit(1)).groupBy("h").agg(F.count("*").alias("n_docs"))
    decided = heavy.join(F.broadcast(holders), "h").where(F.col("n_docs") >= min_docs)
    hot = rows.join(F.broadcast(decided.select("h", "keeper")), "h").where(F.col("doc_id") < F.col("keeper"))
    # The range exchange serves the windows too: they need the rows of one h together, in this order.
    rest = rows.join(F.broadcast(heavy.select("h")), "h", "left_anti").repartitionByRange("h").sortWithinPartitions("h", F.col("doc_id").desc(), "pos")
    rest = rest.withColumn("nth", F.dense_rank().over(Window.partitionBy("h").orderBy(F.col("doc_id").desc())))
    rest = rest.withColumn("n_docs", F.max("nth").over(Window.partitionBy("h")))
    cold = rest.where((F.col("n_docs") >= min_docs) & (F.col("nth") > 1))
    both = hot.select("doc_id", "fp", "pos").unionByName(cold.select("doc_id", "fp", "pos"))
    return both.groupBy("doc_id", "fp").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of docs: its columns, n_lines, n_dropped, keep_runs.

    keep_runs: the keep bitmap, run-length coded: lengths of the runs of lines kept (0 if
    line 1 goes) and dropped in turn, a kept run last.  Repeated doc_ids: each row has its
    own bitmap, the ids count as one document.  Null doc_id: all lines stay.  Null or empty
    text: one empty line.  No rows give no rows; extra columns
    of docs stay, but for those that have the names of results.
    """
    gone = dropped_lines(bare(docs, "doc_id", "text"), min_chars, min_docs).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), "gone")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "keep_runs", "__first", "__last")]
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("__row"))
    text = F.col("__row")["text"]
    out = rows.join(gone.hint("shuffle_hash"), (rows["__row"]["doc_id"] == gone["__id"]) & (fingerprint(text) == gone["__fp"]), "left")
    n = F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1))
    gone = F.coalesce(F.col("gone"), F.array().cast("array<int>"))
    # First and last positions of the dropped runs.
    first = F.filter(gone, lambda p, i: (i == 0) | (F.get(gone, i - 1) != p - 1))
    last = F.filter(gone, lambda p, i: (i == F.size(gone) - 1) | (F.get(gone, i + 1) != p + 1))
    pairs = F.transform(first, lambda p, i: F.array(p - F.coalesce(F.get(last, i - 1) + 1, F.lit(0)), F.get(last, i) - p + 1))
    tail = n - F.coalesce(F.get(last, F.size(last) - 1) + 1, F.lit(0))
    runs = F.concat(F.flatten(pairs), F.array(tail))
    return out.select("__row.*", n.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), runs.alias("keep_runs"), first.alias("__first"), last.alias("__last"))


def kept_text(text) -> F.Column:
    """The text that a row of `keep_bitmaps` keeps: its kept lines, joined by \\n."""
    lines, first, last = F.split(F.coalesce(text, F.lit("")), "\n", -1), F.col("__first"), F.col("__last")
    after = lambda i: F.coalesce(F.get(last, i - 1) + 1, F.lit(0))
    parts = F.transform(first, lambda p, i: F.slice(lines, after(i) + 1, p - after(i)))
    tail = F.slice(lines, after(F.size(last)) + 1, F.size(lines))
    joined = F.array_join(F.concat(F.flatten(parts), tail), "\n")
    return F.when(F.size(first) == 0, F.coalesce(text, F.lit(""))).otherwise(joined)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = keep_bitmaps(bare(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text")).cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, rid, i, line,
         translate(trim(line, E' \t\n\v\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, rid, unnest(parts) AS line, unnest(range(len(parts))) AS i
        FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(COALESCE(text, ''), chr(10)) AS parts FROM documents))),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, (k.key IS NOT NULL AND l.doc_id < k.keeper) AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
