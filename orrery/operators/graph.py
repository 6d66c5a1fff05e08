"""Graph tables: folders, edges, mirrors, versions, keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def folder_tree(files: DataFrame) -> DataFrame:
    """Every ancestor folder of the files with its level, parent and number of direct files, and the root ""."""
    parts = F.split("relative_path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))
    folders = files.select("knowledge_id", F.explode(up).alias("folder_path")).distinct()
    direct = files.groupBy("knowledge_id", S.direct_folder(F.col("relative_path")).alias("folder_path")).agg(F.count("*").alias("n"))
    out = folders.join(direct, ["knowledge_id", "folder_path"], "left")
    p = F.col("folder_path")
    return out.select("knowledge_id", "folder_path", S.folder_level(p).cast("int").alias("level"), S.parent_folder(p).alias("parent_path"), F.coalesce("n", F.lit(0)).alias("direct_files"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n_edges"), F.countDistinct("dst").alias("n_entities"))


def merge(old: DataFrame, new: DataFrame, keys: list[str], order: str, first: tuple[str, ...] = ()) -> DataFrame:
    """Keyed upsert: of each key the latest row by `order`; columns in `first` keep their earliest value.

    Of rows that are equal in `order` those of new come later, and then the greater in their columns.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    order = F.struct(order, "__new", *[c for c in rest if c != order])
    pick = [F.min_by(c, order).alias(c) if c in first else F.max_by(c, order).alias(c) for c in rest]
    return both.groupBy(*keys).agg(*pick)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new: files of a delta, or all edges of a source."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def cascade_delete(tables: dict[str, DataFrame], knowledge_id: str) -> dict[str, DataFrame]:
    """Tables without a knowledge base; versions, concepts, contracts and guideposts are kept as history."""
    kept = {"file_version", "concept", "contract", "guidepost"}
    return {k: t if k in kept else t.where(F.col("knowledge_id") != knowledge_id) for k, t in tables.items()}


def orphan_files(files: DataFrame, knowledge: DataFrame) -> DataFrame:
    return files.join(knowledge.select("knowledge_id"), "knowledge_id", "left_anti").select("knowledge_id", "relative_path")


def orphan_entities(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entities that edges before had and edges after have no more."""
    return before.select("edge_type", "dst").distinct().join(after.select("edge_type", "dst").distinct(), ["edge_type", "dst"], "left_anti")


def keyword_mirror(edges: DataFrame) -> DataFrame:
    """(keyword, type, file) rows, trimmed, without blanks, keywords in lower case, each once with frequency 1."""
    word = F.trim(F.when(F.col("edge_type") == "HAS_KEYWORD", F.lower("dst")).otherwise(F.col("dst")))
    return edges.select(word.alias("keyword"), F.col("edge_type").alias("type"), "knowledge_id", "relative_path").where("keyword <> ''").distinct().withColumn("frequency", F.lit(1))


def keyword_counters(mirror: DataFrame) -> DataFrame:
    files = F.countDistinct("knowledge_id", "relative_path")
    return mirror.groupBy("keyword", "type").agg(F.sum(F.coalesce("frequency", F.lit(0))).alias("total_frequency"), files.alias("file_count"))


def snapshot(files: DataFrame, commit: str, done: DataFrame | None = None) -> DataFrame:
    """Versions of all files at a commit; a version that is there already is not made again."""
    rows = files.withColumn("commit_hash", F.lit(commit))
    if done is None:
        return rows
    return rows.join(done.select("knowledge_id", "relative_path", "commit_hash"), ["knowledge_id", "relative_path", "commit_hash"], "left_anti")


def guidepost_targets(rows: DataFrame) -> DataFrame:
    """Rows with exactly one of file_id, concept_id, contract_id, and which it is."""
    ids = ["file_id", "concept_id", "contract_id"]
    n = sum((F.col(c).isNotNull().cast("int") for c in ids), F.lit(0))
    target = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c.removesuffix("_id"))) for c in ids])
    return rows.where(n == 1).withColumn("target", target)


def first_seen(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", nth).where("__n = 1").drop("__n")


def key_counts(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows and distinct keys of each table: they are equal where the key is unique."""
    out = None
    for name, (rows, keys) in tables.items():
        one = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")).select(F.lit(name).alias("name"), "n_rows", "n_keys")
        out = one if out is None else out.unionByName(one)
    return out
