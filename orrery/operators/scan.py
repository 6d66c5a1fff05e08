"""Admission and classification of scanned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V


def effective(base: tuple, add: tuple = (), remove: tuple = ()) -> list[str]:
    """Sorted base and additions, less removals."""
    return sorted((set(base) | set(add)) - set(remove))


def overlaid(base: tuple, add: Column, remove: Column) -> Column:
    """Like `effective`, with additions and removals as columns; null ones change nothing."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.array_union(F.array(*map(F.lit, base)), F.coalesce(add, none)), F.coalesce(remove, none)))


def admission(path: Column, directories=V.IGNORED_DIRECTORIES, filenames=V.IGNORED_FILENAMES, extensions=V.IGNORED_EXTENSIONS, globs=(), gate: bool = True, verdict: Column | None = None) -> Column:
    """reject-static, accept, accept-llm, reject-llm, or null where a cached verdict is still wanting.

    In order: an ignored folder on the way, file name, extension, glob; a known language; a
    gate that is off; the cached verdict (true: ignore).
    """
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    bad = F.arrays_overlap(folders, F.array(*map(F.lit, directories))) | S.basename(path).isin(*filenames) | S.extension(path).isin(*extensions)
    for g in globs:
        bad = bad | S.basename(path).rlike(S.glob_regex(g))
    out = F.when(bad, "reject-static").when(S.language_from_path(path) != "unknown", "accept")
    if not gate:
        return out.otherwise("accept")
    return out if verdict is None else out.when(verdict, "reject-llm").when(~verdict, "accept-llm")


def kind(content: Column, max_bytes: int = V.MAX_FILE_BYTES, max_lines: int = V.MAX_LINES, context: int = V.CONTEXT_TOKENS) -> Column:
    big = (F.octet_length(content) > max_bytes) | (S.count_lines(content) > max_lines)
    return F.when(big, "oversized").when(S.token_len(content) > context, "big").otherwise("small")


def is_binary(content: Column) -> Column:
    """A NUL byte among the first 4096."""
    return F.coalesce(F.hex(F.substring(content.cast("binary"), 1, 4096)).rlike("^(?:..)*?00"), F.lit(False))


def manifest_summary(files: DataFrame, chunk: int = V.CHUNK_TOKENS) -> DataFrame:
    rows = files.select(kind(F.col("content")).alias("kind"), S.token_len(F.col("content")).alias("tokens"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / chunk)).cast("long")
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}_count")
    total = F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens")
    return rows.agg(F.count("*").alias("total_files"), count("small"), count("big"), count("oversized"), total, F.coalesce(F.sum(F.when(F.col("kind") == "big", chunks)), F.lit(0)).cast("long").alias("estimated_big_chunks"))


def content_decisions(files: DataFrame) -> DataFrame:
    """One row for each distinct content, to decide on once: its key, how many files, the first of them."""
    return files.groupBy("sha").agg(F.count("*").alias("n_files"), F.min("relative_path").alias("first_path")).select(F.concat(F.lit("file:"), "sha").alias("decision_key"), "n_files", "first_path")
