"""Incremental pulls: differences with renames, what they change, delete and touch, and storing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .stats import PATH, snapshot_diff

CHANGE = ["knowledge_id", "status", "relative_path"]


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """knowledge_id, status, relative_path, old_path of what differs between two snapshots (knowledge_id, relative_path, sha).

    A path that is gone and a new one of the same content are one rename; where several
    have that content they pair in order of their paths, and the rest stay as they are.
    """
    rows = snapshot_diff(old, new).where("status <> 'unchanged'").withColumn("sha", F.coalesce("new_sha", "old_sha"))
    nth = F.row_number().over(Window.partitionBy("knowledge_id", "status", "sha").orderBy("relative_path"))
    moved = rows.where(F.col("status").isin("added", "deleted") & F.col("sha").isNotNull()).withColumn("nth", nth)
    gone = moved.where("status = 'deleted'").select("knowledge_id", "sha", "nth", F.col("relative_path").alias("old_path"))
    renamed = moved.where("status = 'added'").join(gone, ["knowledge_id", "sha", "nth"]).select("knowledge_id", "relative_path", "old_path")
    ends = renamed.select("knowledge_id", "relative_path").unionByName(renamed.select("knowledge_id", F.col("old_path").alias("relative_path")))
    rest = rows.join(ends.distinct(), PATH, "left_anti").select(*CHANGE, F.lit(None).cast("string").alias("old_path"))
    return rest.unionByName(renamed.select("knowledge_id", F.lit("renamed").alias("status"), "relative_path", "old_path"))


def union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Each change of two differences once; of two renames to one path the second's stands."""
    both = first.withColumn("turn", F.lit(0)).unionByName(second.withColumn("turn", F.lit(1)))
    return both.groupBy(*CHANGE).agg(F.max_by("old_path", "turn").alias("old_path"))


def changed_paths(changes: DataFrame) -> DataFrame:
    """Paths to analyse: added, modified, and the new ones of renames."""
    return changes.where("status IN ('added', 'modified', 'renamed')").select(*PATH).distinct()


def deleted_paths(changes: DataFrame) -> DataFrame:
    """Paths to delete: those gone, and the old ones of renames."""
    gone = changes.where("status = 'deleted'").select(*PATH)
    return gone.unionByName(changes.where("status = 'renamed'").select("knowledge_id", F.col("old_path").alias("relative_path"))).distinct()


def affected_folders(changes: DataFrame) -> DataFrame:
    """Direct folders of all paths that a difference names, old and new."""
    paths = F.explode(F.array_compact(F.array("relative_path", "old_path"))).alias("path")
    return changes.select("knowledge_id", paths).select("knowledge_id", S.direct_folder(F.col("path")).alias("folder_path")).distinct()


def store(files: DataFrame, changes: DataFrame, analysed: DataFrame) -> DataFrame:
    """files after a pull: without what is deleted, with the analysed rows of what changed."""
    gone = deleted_paths(changes).unionByName(changed_paths(changes)).distinct()
    return files.join(gone, PATH, "left_anti").unionByName(analysed.join(changed_paths(changes), PATH, "left_semi"))


def fork_archive(archive: DataFrame, previous: str, commit: str, changes: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of a commit's partition: the previous one's, less what was removed, with what changed put over them."""
    kept = store(archive.where(F.col("commit_hash") == previous).drop("commit_hash"), changes, files)
    return kept.withColumn("commit_hash", F.lit(commit))


def push_archive(archive: DataFrame, commit: str, files: DataFrame) -> DataFrame:
    """The archive with files(knowledge_id, relative_path, …) put over those of a commit; other commits and files stay."""
    old = archive.join(files.select(*PATH).withColumn("commit_hash", F.lit(commit)), [*PATH, "commit_hash"], "left_anti")
    return old.unionByName(files.withColumn("commit_hash", F.lit(commit)).select(*archive.columns))


def remove_from_archive(archive: DataFrame, commit: str, paths: DataFrame) -> DataFrame:
    """The archive without paths(knowledge_id, relative_path) of a commit; ones that it hasn't are passed over."""
    return archive.join(paths.select(*PATH).withColumn("commit_hash", F.lit(commit)), [*PATH, "commit_hash"], "left_anti")


def pending(files: DataFrame, completed: DataFrame) -> DataFrame:
    """Files that a run has not completed yet."""
    return files.join(completed.select(*PATH), PATH, "left_anti")


def store_folders(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every ancestor folder of the files with its summary, an empty one where none was made."""
    from .graph import folder_tree

    return folder_tree(files).join(summaries, ["knowledge_id", "folder_path"], "left").select("knowledge_id", "folder_path", "level", "parent_path", F.coalesce("summary", F.lit("")).alias("summary"))


def copy_edges(edges: DataFrame, versions: DataFrame) -> DataFrame:
    """Keyword edges of files on to their versions of a commit, frequency 1 where none is known."""
    rows = edges.join(versions.select(*PATH, "commit_hash"), PATH)
    return rows.select(*PATH, "commit_hash", "dst", F.coalesce("frequency", F.lit(1)).alias("frequency"))


def describes(descriptions: DataFrame, versions: DataFrame) -> DataFrame:
    """(description, file version) of the same knowledge base and commit."""
    return descriptions.select("knowledge_id", "commit_hash", "version_id").join(versions.select(*PATH, "commit_hash"), ["knowledge_id", "commit_hash"])


def commit_indexed(knowledge: DataFrame, versions: DataFrame, files: DataFrame) -> DataFrame:
    """Per knowledge base whether it has versions of the commit, or files at all."""
    count = lambda rows, name: rows.groupBy("knowledge_id").agg(F.count("*").alias(name))
    out = knowledge.select("knowledge_id").join(count(versions, "n_versions"), "knowledge_id", "left").join(count(files, "n_files"), "knowledge_id", "left")
    return out.na.fill(0).withColumn("indexed", (F.col("n_versions") > 0) | (F.col("n_files") > 0))
