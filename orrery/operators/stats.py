"""Statistics, usage, roll-ups, diffs, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

PATH = ["knowledge_id", "relative_path"]


def commit_stats(commits: DataFrame) -> DataFrame:
    n = lambda c: S.parse_number(F.col(c)).alias(c)
    return commits.select("knowledge_key", "commit_hash", n("input_tokens"), n("output_tokens"), n("cost_usd"))


def stats_rollup(commits: DataFrame) -> DataFrame:
    """Sums per knowledge base and over all (knowledge_key null), cost to 6 places."""
    total = lambda c: F.round(F.sum(c), 6).alias(c)
    return commit_stats(commits).rollup("knowledge_key").agg(F.count("*").alias("n_commits"), total("input_tokens"), total("output_tokens"), total("cost_usd"))


def commit_entries(knowledge: DataFrame) -> DataFrame:
    """(knowledge_id, pos, commit_hash, input_tokens, output_tokens, cost_usd) of knowledge(knowledge_id, source: JSON text).

    Of source's list commitHashes the objects whose hash is a string; amounts that aren't
    strings count as 0, of strings the numeric prefix counts.
    """
    from ..sources import artifacts as A

    doc = F.try_parse_json("source")
    rows = knowledge.select("knowledge_id", F.posexplode(A.items(doc, "$.commitHashes")).alias("pos", "x"))
    is_text = lambda path: F.schema_of_variant(F.try_variant_get("x", path, "variant")) == "STRING"
    amount = lambda name: F.when(is_text(f"$.{name}"), S.parse_number(F.try_variant_get("x", f"$.{name}", "string"))).otherwise(0.0)
    kept = rows.where(F.schema_of_variant("x").startswith("OBJECT") & F.coalesce(is_text("$.hash"), F.lit(False)))
    return kept.select("knowledge_id", "pos", F.try_variant_get("x", "$.hash", "string").alias("commit_hash"), F.coalesce(amount("inputTokens"), F.lit(0.0)).alias("input_tokens"), F.coalesce(amount("outputTokens"), F.lit(0.0)).alias("output_tokens"), F.coalesce(amount("costUsd"), F.lit(0.0)).alias("cost_usd"))


def repo_stats(knowledge: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """Per row of knowledge(knowledge_id, repo_name, source_kind) type, file_count, n_commits and sums of its commits, 0 where there are none; with a row of totals (knowledge_id null)."""
    sums = entries.groupBy("knowledge_id").agg(F.count("*").alias("n_commits"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost_usd")])
    counts = files.groupBy("knowledge_id").agg(F.count("*").alias("file_count"))
    kind = F.when(F.col("source_kind") == "github", "GITHUB").otherwise("LOCAL")
    rows = knowledge.join(counts, "knowledge_id", "left").join(sums, "knowledge_id", "left").select("knowledge_id", "repo_name", kind.alias("type"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("file_count", "n_commits", "input_tokens", "output_tokens", "cost_usd")])
    out = rows.rollup(F.struct("knowledge_id", "repo_name", "type").alias("k")).agg(F.count("*").alias("n_repos"), F.sum("file_count").alias("file_count"), F.sum("n_commits").alias("n_commits"), *[F.round(F.sum(c), 6).alias(c) for c in ("input_tokens", "output_tokens", "cost_usd")])
    return out.select("k.knowledge_id", "k.repo_name", "k.type", "n_repos", "file_count", "n_commits", "input_tokens", "output_tokens", "cost_usd")


def monthly_usage(activity: DataFrame) -> DataFrame:
    t = F.col("created_at")
    return activity.groupBy("identity_id", F.year(t).alias("year"), F.month(t).alias("month")).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def global_usage(activity: DataFrame) -> DataFrame:
    """One row of sums; none where there is no activity."""
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return activity.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(tokens).alias("total_tokens")).where("calls > 0")


def folder_rollup(files: DataFrame) -> DataFrame:
    folder = S.direct_folder(F.col("relative_path")).alias("folder_path")
    languages = F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages")
    return files.groupBy("knowledge_id", folder).agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("size_bytes"), languages)


def folder_batches(rollup: DataFrame, large: int = 15, size: int = 10) -> DataFrame:
    """Folders of over `large` files by themselves (batch null), the others in batches of `size` by path."""
    w = Window.partitionBy("knowledge_id").orderBy("folder_path")
    small = rollup.where(F.col("file_count") <= large).withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    return small.unionByName(rollup.where(F.col("file_count") > large).withColumn("batch", F.lit(None).cast("int"))).select("knowledge_id", "folder_path", "file_count", "batch")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths by what happened to them: added, deleted, modified, unchanged."""
    both = old.withColumnRenamed("sha", "old_sha").join(new.withColumnRenamed("sha", "new_sha"), PATH, "full_outer")
    status = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "deleted").when(F.col("old_sha") != F.col("new_sha"), "modified").otherwise("unchanged")
    return both.select(*PATH, status.alias("status"), "old_sha", "new_sha")


def apply_diff(old: DataFrame, diff: DataFrame) -> DataFrame:
    kept = old.join(diff.where(F.col("status").isin("deleted", "modified")).select(*PATH), PATH, "left_anti")
    return kept.unionByName(diff.where(F.col("status").isin("added", "modified")).select(*PATH, F.col("new_sha").alias("sha")))


def affected_folders(diff: DataFrame) -> DataFrame:
    changed = diff.where("status <> 'unchanged'")
    return changed.select("knowledge_id", S.direct_folder(F.col("relative_path")).alias("folder_path")).distinct().withColumn("length", F.length("folder_path"))


def parse_name_status(text: DataFrame) -> DataFrame:
    """Lines of `git diff --name-status`: status (A, M, D, R; copies count as added), path, old_path."""
    p = F.split("line", "\t")
    s = F.substring(F.get(p, F.lit(0)), 1, 1)
    two = s.isin("R", "C")
    path = F.when(two, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1)))
    return text.select(F.when(s == "C", "A").otherwise(s).alias("status"), path.alias("path"), F.when(s == "R", F.get(p, F.lit(1))).alias("old_path")).where("status IN ('A', 'M', 'D', 'R') AND path IS NOT NULL")


def dequeue(jobs: DataFrame, n: int = 10) -> DataFrame:
    """The next n jobs of each type: higher priority first, then older, then smaller id."""
    w = Window.partitionBy("type").orderBy(F.desc("priority"), "created_at", "id")
    return jobs.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).select("type", "position", "id", "knowledge_id", "priority")


def live_jobs(jobs: DataFrame) -> DataFrame:
    """One live job per (type, knowledge_id): the oldest."""
    w = Window.partitionBy("type", "knowledge_id").orderBy("created_at", "id")
    return jobs.withColumn("n", F.row_number().over(w)).where("n = 1").select("type", "knowledge_id", "id")


def dead_letters(jobs: DataFrame, attempts: int = 3) -> DataFrame:
    return jobs.where(F.col("attempts") >= attempts).groupBy("type").agg(F.count("*").alias("dead"), F.max("attempts").alias("most_attempts"))


def commit_history(commits: DataFrame) -> DataFrame:
    """Per knowledge base the head, how many commits, and their hashes, oldest first, each once."""
    once = commits.groupBy("knowledge_key", "commit_hash").agg(F.min("committed_at").alias("at"))
    order = F.array_sort(F.collect_list(F.struct("at", "commit_hash")))
    return once.groupBy("knowledge_key").agg(F.count("*").alias("n_commits"), F.max_by("commit_hash", F.struct("at", "commit_hash")).alias("head"), F.array_join(F.transform(order, lambda x: x["commit_hash"]), ",").alias("history"))


def fresh_usage(rows: DataFrame) -> DataFrame:
    """Totals less the cached share, never under 0."""
    return rows.agg(F.sum("total").alias("total"), F.sum("cached").alias("cached")).select("total", "cached", F.greatest(F.lit(0), F.col("total") - F.col("cached")).alias("fresh"))


def order_folders(folders: DataFrame, by: Column) -> DataFrame:
    """The place of each folder in its knowledge base, by a measure and then by name."""
    nth = F.row_number().over(Window.partitionBy("knowledge_id").orderBy(by, "folder_path"))
    return folders.select("knowledge_id", "folder_path", nth.alias("place"))


def narrow_payloads(jobs: DataFrame) -> DataFrame:
    """id, knowledge_id, branch of jobs(id, payload) whose JSON payload names a knowledge base; empty branches are none."""
    p = F.from_json("payload", "knowledgeId string, branch string")
    text = lambda c: F.nullif(F.trim(p[c]), F.lit(""))
    return jobs.select("id", text("knowledgeId").alias("knowledge_id"), text("branch").alias("branch")).where("knowledge_id IS NOT NULL")
