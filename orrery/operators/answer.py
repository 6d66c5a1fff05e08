"""The whole answer of a search in one plan: hits are found once, and page, repositories, folders and concepts are taken from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from . import search
from .search import ID, Scope

#: What every row of an answer has.
COLUMNS = ("section", "pos", "knowledge_id", "relative_path", "score", "channels", "name", "kind", "n", "total_matches", "channels_used")


def available(files: DataFrame, edges: DataFrame | None, channels: tuple) -> tuple:
    """The channels whose tables and columns there are; one that isn't is empty, as a failed one."""
    has = lambda c: set(search.TEXTS[c]) <= set(files.columns) if c in search.TEXTS else edges is not None
    return tuple(c for c in channels if has(c))


def answer(files: DataFrame, edges: DataFrame | None, knowledge: DataFrame, query: str, scope: Scope = Scope(), page: int = 1, size: int = V.PAGE_SIZE, concepts: DataFrame | None = None, channels: tuple = tuple(V.CHANNEL_WEIGHTS), most: int = 20, sample: int = 5) -> DataFrame:
    """Rows by section: `hit`s of the page, and of these `repo`s, `folder`s and `concept`s with two and more hits.

    pos numbers a section's rows: hits by rank, repositories as they first appear, folders
    and concepts by their number of hits n.  name: the repository of a hit, the folder, the
    concept; relative_path: the hit, the folder's best, the concept's first few.  Each row
    has the number of all matches and the channels that had any.  Hits are at most the
    channels' caps together, so their windows need no key.
    """
    size = min(max(size, V.PAGE_MIN), V.PAGE_MAX)
    use = available(files, edges, channels)
    if not use:
        return _nothing(files)
    fused = search.fuse(search.best_of_channels(search.matches(files, edges, query, scope, use)))
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "relative_path", "knowledge_id"))
    used = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("channels", ",")).over(every)))), ",")
    rows = fused.select("*", rank.alias("rank"), F.count("*").over(every).alias("total_matches"), used.alias("channels_used"))
    rows = rows.where(F.col("rank").between((page - 1) * size + 1, page * size))
    rows = search.with_repo_names(rows, knowledge).withColumn("folder", S.top_two_segments(F.col("relative_path")))
    if concepts is None:
        rows = rows.withColumn("kind", F.lit(None).cast("string")).withColumn("slug", F.lit(None).cast("string"))
    else:
        named = concepts.where(F.col("kind").isin("role", "pattern", "domain")).select(*ID, "kind", "slug")
        rows = rows.join(named, ID, "left").distinct()
    hit = ["rank", "knowledge_id", "relative_path", "score", "channels", "repo_name"]
    whole = ["total_matches", "channels_used"]
    # One pass over a page's rows, each grouped as a hit, by repository, by folder and by concept.
    sets = [[*whole, *hit], [*whole, "repo_name"], [*whole, "knowledge_id", "folder"], [*whole, "kind", "slug"]]
    columns = list(dict.fromkeys(c for s in sets for c in s))
    first = F.col("copy_rank"), F.col("copy_path")
    grouped = rows.withColumn("copy_rank", F.col("rank")).withColumn("copy_path", F.col("relative_path")).groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    out = grouped.agg(F.grouping("rank").alias("g_hit"), F.grouping("repo_name").alias("g_repo"), F.grouping("folder").alias("g_folder"), F.countDistinct(first[0]).alias("count"), F.min(first[0]).alias("first"), F.min_by(first[1], first[0]).alias("best"), F.array_join(F.slice(F.array_sort(F.collect_set(first[1])), 1, sample), ",").alias("some"))
    section = F.when(F.col("g_hit") == 0, "hit").when(F.col("g_repo") == 0, "repo").when(F.col("g_folder") == 0, "folder").otherwise("concept")
    out = out.withColumn("section", section)
    keep = (F.col("section") == "hit") | ((F.col("section") == "repo") & (F.col("repo_name") != "")) | ((F.col("section") == "folder") & (F.col("count") >= 2)) | ((F.col("section") == "concept") & F.col("slug").isNotNull() & (F.col("count") >= 2))
    by = F.when(F.col("section").isin("hit", "repo"), F.col("first")).otherwise(-F.col("count"))
    pos = F.row_number().over(Window.partitionBy("section").orderBy(by, "kind", F.coalesce("folder", "slug"), "knowledge_id"))
    out = out.where(keep).withColumn("pos", pos).where((F.col("section") != "concept") | (F.col("pos") <= most))
    is_hit = F.col("section") == "hit"
    return out.select(
        "section", F.when(is_hit, F.col("first")).otherwise(F.col("pos")).alias("pos"), "knowledge_id", F.when(is_hit, F.col("relative_path")).when(F.col("section") == "folder", F.col("best")).when(F.col("section") == "concept", F.col("some")).alias("relative_path"),
        "score", "channels", F.coalesce("folder", "slug", "repo_name").alias("name"), "kind", F.when(~is_hit, F.col("count")).alias("n"), *whole,
    )


def _nothing(files: DataFrame) -> DataFrame:
    return files.sparkSession.createDataFrame([], "section string, pos int, knowledge_id string, relative_path string, score double, channels string, name string, kind string, n long, total_matches long, channels_used string")

