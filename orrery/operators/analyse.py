"""Deterministic analysis: files, chunks, folders, repositories, caches and backfills.

These stand where a model can be plugged in: they take and give the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from ..functions import values as V
from . import scan

KEY = ["knowledge_id", "relative_path"]
WORD = "([a-z]{7,})"


def _words(text: Column, most: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1)))), 1, most)


def files(rows: DataFrame, keywords: int = 10) -> DataFrame:
    """Purpose (first line), summary (600 characters) and keywords (least words of seven letters and more) of contents."""
    text = F.coalesce("content", F.lit(""))
    return rows.select(*KEY, F.split_part(text, F.lit("\n"), F.lit(1)).alias("purpose"), F.substring(text, 1, 600).alias("summary"), _words(text, keywords).alias("keywords"))


def chunks(rows: DataFrame, chars: int, keywords: int = 10) -> DataFrame:
    """Each stretch of `chars` characters analysed by itself: chunk number, summary, keywords."""
    text = F.coalesce("content", F.lit(""))
    n = F.greatest(F.lit(1), F.ceil(F.char_length(text) / chars)).cast("int")
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * chars + 1, F.lit(chars)))).alias("chunk", "part")
    return rows.select(*KEY, cut).select(*KEY, "chunk", F.substring("part", 1, 100).alias("summary"), _words(F.col("part"), keywords).alias("keywords"))


def condense(parts: DataFrame) -> DataFrame:
    """One record of a file's chunks: how many, the first one's summary, all keywords sorted, each once."""
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords"))))
    return parts.groupBy(*KEY).agg(F.count("*").alias("n_chunks"), F.min_by("summary", "chunk").alias("summary"), words.alias("keywords"))


def folders(analysed: DataFrame, affected: DataFrame | None = None, keywords: int = 10) -> DataFrame:
    """A summary of each folder's own files, of the affected folders only where those are given.

    Words come from the files' own sorted lists and are counted, so no file's text is gathered.
    """
    rows = analysed.withColumn("folder_path", S.direct_folder(F.col("relative_path")))
    if affected is not None:
        rows = rows.join(affected.select("knowledge_id", "folder_path").distinct(), ["knowledge_id", "folder_path"], "left_semi")
    size = rows.groupBy("knowledge_id", "folder_path").agg(F.count("*").alias("n_files"), F.min_by("purpose", "relative_path").alias("summary"))
    held = rows.select("knowledge_id", "folder_path", F.explode("keywords").alias("w")).groupBy("knowledge_id", "folder_path", "w").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("knowledge_id", "folder_path").orderBy(F.desc("n"), "w"))
    top = held.withColumn("nth", nth).where(F.col("nth") <= keywords).groupBy("knowledge_id", "folder_path").agg(F.array_sort(F.collect_list("w")).alias("keywords"))
    return size.join(top, ["knowledge_id", "folder_path"], "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def repositories(folder_rows: DataFrame, batch: int = 10) -> DataFrame:
    """A summary of each repository from partial ones of `batch` folders: files, folders, partials, first and last summary."""
    nth = F.row_number().over(Window.partitionBy("knowledge_id").orderBy("folder_path"))
    part = folder_rows.withColumn("part", F.floor((nth - 1) / batch))
    partial = part.groupBy("knowledge_id", "part").agg(F.sum("n_files").alias("n_files"), F.count("*").alias("n_folders"), F.min_by("summary", "folder_path").alias("summary"))
    return partial.groupBy("knowledge_id").agg(F.sum("n_files").alias("n_files"), F.sum("n_folders").alias("n_folders"), F.count("*").alias("n_partials"), F.min_by("summary", "part").alias("summary"))


def outcome(path: Column, content: Column, size: Column, context: int = V.CONTEXT_TOKENS) -> Column:
    """Where a changed file leaves the cascade: ignored, empty, oversized, binary, big, small."""
    static = scan.admission(path) == "reject-static"
    out = F.when(F.coalesce(static, F.lit(False)), "ignored").when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > V.MAX_FILE_BYTES, "oversized")
    out = out.when(scan.is_binary(content), "binary").when(S.count_lines(content) > V.MAX_LINES, "oversized")
    return out.when(S.token_len(content) > context, "big").otherwise("small")


def scan_counters(rows: DataFrame, context: int = V.CONTEXT_TOKENS) -> DataFrame:
    """How many files leave the cascade where, per knowledge base, one column each."""
    kind = outcome(F.col("relative_path"), F.col("content"), F.col("size_bytes"), context)
    names = ("ignored", "empty", "oversized", "binary", "big", "small")
    return rows.select("knowledge_id", kind.alias("kind")).groupBy("knowledge_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in names])


def memo(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(cache_key, …) answered from cache(cache_key, answer, hits): the answered rows, and the cache with its hits."""
    asked = requests.groupBy("cache_key").agg(F.count("*").alias("n"))
    known = cache.join(asked, "cache_key", "left").select("cache_key", "answer", (F.col("hits") + F.coalesce("n", F.lit(0))).alias("hits"))
    return requests.join(cache.select("cache_key", "answer"), "cache_key", "left"), known


def backfill(rows: DataFrame, found: DataFrame, arrays: tuple[str, ...], texts: tuple[str, ...]) -> DataFrame:
    """rows with empty fields filled from found (same key and names), where that has something; `missing` names what was empty."""
    other = found.select(*KEY, *[F.col(c).alias(f"__{c}") for c in arrays + texts])
    empty = {c: F.coalesce(F.size(X.nonempty(F.col(c))) <= 0, F.lit(True)) for c in arrays} | {c: F.coalesce(F.col(c) == "", F.lit(True)) for c in texts}
    has = {c: F.size(X.nonempty(F.col(f"__{c}"))) > 0 for c in arrays} | {c: F.col(f"__{c}") != "" for c in texts}
    take = {c: X.nonempty(F.col(f"__{c}")) if c in arrays else F.col(f"__{c}") for c in arrays + texts}
    names = F.concat_ws(",", *[F.when(empty[c], F.lit(c)) for c in arrays + texts])
    fixed = [F.when(empty[c] & F.coalesce(has[c], F.lit(False)), take[c]).otherwise(F.col(c)).alias(c) for c in arrays + texts]
    return rows.join(other, KEY, "left").select(*KEY, *fixed, names.alias("missing"))


SHAPE = "language string, purpose string, keywords array<string>, sections array<struct<name:string,description:string,start:long,end:long>>"


def shape(raw: Column) -> Column:
    """A tolerant record of a model's JSON answer: texts or "", non-empty words, sections that have a name or a description.

    Lines of sections that are not positive are null; what does not parse gives the empty record.
    """
    r = F.from_json(S.lenient_json(raw), SHAPE)
    text = lambda x: F.coalesce(x, F.lit(""))
    line = lambda x: F.when(x > 0, x)
    kept = F.filter(r["sections"], lambda s: (text(s["name"]) != "") | (text(s["description"]) != ""))
    sections = F.transform(kept, lambda s: F.struct(text(s["name"]).alias("name"), text(s["description"]).alias("description"), line(s["start"]).alias("start"), line(s["end"]).alias("end")))
    none = lambda kind: F.array().cast(kind)
    return F.struct(text(r["language"]).alias("language"), text(r["purpose"]).alias("purpose"), F.coalesce(X.nonempty(r["keywords"]), none("array<string>")).alias("keywords"), F.coalesce(sections, none("array<struct<name:string,description:string,start:bigint,end:bigint>>")).alias("sections"))
