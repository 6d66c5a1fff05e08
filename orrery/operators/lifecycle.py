"""Knowledge bases over their life: states, heads, branches, failures, ledgers; and their jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V


def last_change(changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One change of each key: the last by `order`, of equal ones the greatest row; without an order the greatest row.  Null keys are left out."""
    rest = [c for c in changes.columns if c != key]
    if not rest:
        return changes.where(F.col(key).isNotNull()).distinct()
    rank = F.struct(*([order] if order else []), *[c for c in rest if c != order])
    return changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(rank).alias("__last")).select(key, "__last.*")


def update(table: DataFrame, changes: DataFrame, key: str, order: str | None = None, **fields: Column) -> DataFrame:
    """The rows whose key is in changes with those fields set; all others as they are, keys that are missing ignored.

    Of several changes of a key one counts; see `last_change`.
    """
    hit = last_change(changes, key, order).withColumn("__hit", F.lit(True))
    rows = table.join(hit, key, "left")
    return rows.select(*[F.when(F.col("__hit"), fields[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns])


def missing(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Keys to change that the table has not: a document store reports them, a graph stays silent."""
    return changes.select(key).distinct().join(table.select(key), key, "left_anti")


def advance_branches(knowledge: DataFrame, heads: DataFrame) -> DataFrame:
    """knowledge(knowledge_id, branches) after heads(knowledge_id, name, commit, at): one head for each knowledge base, the last by `at` if there are more.

    branches: array of (name, head, commits).  A branch that is there moves on to the commit
    and takes it into its commits, once; one that is not is appended.
    """
    rows = knowledge.join(last_change(heads, "knowledge_id", "at" if "at" in heads.columns else None), "knowledge_id", "left")
    old, name, commit = F.coalesce("branches", F.array().cast(knowledge.schema["branches"].dataType)), F.col("name"), F.col("commit")
    moved = F.transform(old, lambda b: F.when(b["name"] == name, F.struct(b["name"].alias("name"), commit.alias("head"), F.array_union(b["commits"], F.array(commit)).alias("commits"))).otherwise(b))
    fresh = F.array(F.struct(name.alias("name"), commit.alias("head"), F.array(commit).alias("commits")))
    new = F.when(name.isNull(), old).when(F.exists(old, lambda b: b["name"] == name), moved).otherwise(F.concat(old, fresh))
    return rows.select(*[new.alias("branches") if c == "branches" else F.col(c) for c in knowledge.columns])


def record_failures(knowledge: DataFrame, errors: DataFrame) -> DataFrame:
    """State and failure(category, reason) of the knowledge bases in errors(knowledge_id, error, status_code).

    A source that is gone makes them CORRUPTED, failures worth another try HALTED, all others FAILED.
    """
    kind = X.failure_category(F.col("error"), F.col("status_code"))
    told = errors.select("knowledge_id", kind.alias("category"), F.when(kind == "repo_unavailable", "CORRUPTED").when(X.is_retryable(kind), "HALTED").otherwise("FAILED").alias("new_state"))
    return update(knowledge, told, "knowledge_id", state=F.col("new_state"), failure=F.struct("category", F.concat(F.lit("failed: "), "category").alias("reason")))


def promote_halted(knowledge: DataFrame) -> DataFrame:
    """HALTED becomes FAILED; `changed` tells where."""
    halted = F.col("state") == "HALTED"
    return knowledge.withColumn("changed", F.coalesce(halted, F.lit(False))).withColumn("state", F.when(halted, "FAILED").otherwise(F.col("state")))


def deletion_counts(knowledge: DataFrame, tables: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """For each id how many rows of each table go with it, and whether it is there at all."""
    out = ids.join(knowledge.select("knowledge_id", F.lit(True).alias("found")), "knowledge_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    for name, rows in tables.items():
        out = out.join(rows.join(ids, "knowledge_id", "left_semi").groupBy("knowledge_id").agg(F.count("*").alias(f"n_{name}")), "knowledge_id", "left")
    return out.na.fill(0)


def ledger(events: DataFrame) -> DataFrame:
    """Enrichment ledgers of runs, from events(run_id, at, path, error): each path's latest event says whether it is done.

    completed and failures: sorted paths; a path that failed and completed later is completed.
    """
    last = events.groupBy("run_id", "path").agg(F.max_by("error", F.struct("at", "error")).alias("error"))
    paths = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("path"))))
    return last.groupBy("run_id").agg(paths(F.col("error").isNull()).alias("completed"), paths(F.col("error").isNotNull()).alias("failures"))


def recent(knowledge: DataFrame, n: int = 200) -> DataFrame:
    return knowledge.orderBy(F.desc("updated_seq"), "knowledge_id").limit(n)


def lease(jobs: DataFrame, now: Column, seconds: int = V.LEASE_S) -> DataFrame:
    """jobs(…, owner, heartbeat_at) with a lease state: owned while the last heartbeat is within the visibility, else open."""
    alive = F.col("owner").isNotNull() & (now - F.col("heartbeat_at") <= seconds)
    return jobs.withColumn("lease", F.when(alive, "owned").when(F.col("owner").isNotNull(), "expired").otherwise("open"))


def acknowledge(jobs: DataFrame, acks: DataFrame) -> DataFrame:
    """Leased jobs less those acknowledged by the owner whose lease still holds; other acknowledgements do nothing."""
    return jobs.join(acks.join(jobs.where("lease = 'owned'").select("id", "owner"), ["id", "owner"], "left_semi").select("id"), "id", "left_anti")


def retry(jobs: DataFrame, failures: DataFrame, now: Column, attempts: int = V.ATTEMPTS, back_off: int = V.BACK_OFF_S) -> DataFrame:
    """Failed jobs: when each runs again, or that it is dead: after all attempts, or at once if not worth another."""
    rows = jobs.join(failures, "id").withColumn("attempts", F.col("attempts") + 1)
    again = (F.col("attempts") < attempts) & F.col("retryable")
    return rows.select("id", "type", "attempts", F.when(again, "waiting").otherwise("dead").alias("state"), F.when(again, now + back_off).alias("run_at"))


def cancel(jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """jobs without those of the knowledge bases in ids, and how many each of these lost."""
    lost = ids.join(jobs.select("knowledge_id", "id"), "knowledge_id", "left").groupBy("knowledge_id").agg(F.count("id").alias("n_cancelled"))
    return jobs.join(ids, "knowledge_id", "left_anti"), lost


def resume(knowledge: DataFrame) -> DataFrame:
    """How many queued knowledge bases there are, how many go back to the queue, how many can't for want of an address."""
    can = (F.col("source_kind") == "github") & F.col("source_url").isNotNull()
    return knowledge.where("state = 'QUEUED'").agg(F.count("*").alias("scanned"), F.count_if(can).alias("resumed"), F.count_if(~F.coalesce(can, F.lit(False))).alias("skipped"))


def throttle(progress: DataFrame, every: int = 250) -> DataFrame:
    """Of progress(run_id, at_ms, done, total) the rows to store: the last of each interval, and every completion."""
    slot = F.floor(F.col("at_ms") / every)
    nth = F.row_number().over(Window.partitionBy("run_id", slot).orderBy(F.desc("at_ms"), F.desc("done")))
    return progress.withColumn("__nth", nth).where((F.col("__nth") == 1) | (F.col("done") == F.col("total"))).drop("__nth")
