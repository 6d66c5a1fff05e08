"""Registered queries of pulls, lifecycles, enrichment, analysis and their scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from ..functions import values as V
from ..operators import analyse, ancestry, enrich, graph, lifecycle, pull, retrieve, search, stats
from . import views as v
from .registry import query

# --- pulls ----------------------------------------------------------------------------------


def _diff_sql(new: str) -> str:
    """Text of common tables d0, r0, diff: what pull.diff gives from v_snapshot_prev to new."""
    n = new.rsplit("_", 1)[1]
    return f"""d_{n} AS (SELECT COALESCE(o.knowledge_id, n.knowledge_id) AS knowledge_id, COALESCE(o.relative_path, n.relative_path) AS relative_path,
  CASE WHEN o.relative_path IS NULL THEN 'added' WHEN n.relative_path IS NULL THEN 'deleted' WHEN o.sha <> n.sha THEN 'modified' ELSE 'unchanged' END AS status, COALESCE(n.sha, o.sha) AS sha
  FROM v_snapshot_prev o FULL JOIN {new} n ON o.knowledge_id = n.knowledge_id AND o.relative_path = n.relative_path),
m_{n} AS (SELECT *, row_number() OVER (PARTITION BY knowledge_id, status, sha ORDER BY relative_path) AS nth FROM d_{n} WHERE status IN ('added', 'deleted') AND sha IS NOT NULL),
r_{n} AS (SELECT a.knowledge_id, a.relative_path, x.relative_path AS old_path FROM m_{n} a JOIN m_{n} x ON a.status = 'added' AND x.status = 'deleted' AND a.knowledge_id = x.knowledge_id AND a.sha = x.sha AND a.nth = x.nth),
diff_{n} AS (SELECT knowledge_id, status, relative_path, NULL::VARCHAR AS old_path FROM d_{n} WHERE status <> 'unchanged'
    AND (knowledge_id, relative_path) NOT IN (SELECT (knowledge_id, relative_path) FROM r_{n} UNION ALL SELECT (knowledge_id, old_path) FROM r_{n})
  UNION ALL SELECT knowledge_id, 'renamed', relative_path, old_path FROM r_{n})"""


_MOVED = _diff_sql("v_snapshot_moved")
_CHANGED = "SELECT DISTINCT knowledge_id, relative_path FROM diff_moved WHERE status IN ('added', 'modified', 'renamed')"
_GONE = "SELECT knowledge_id, relative_path FROM diff_moved WHERE status = 'deleted' UNION SELECT knowledge_id, old_path FROM diff_moved WHERE status = 'renamed'"
_FOLDERS = "SELECT DISTINCT knowledge_id, regexp_replace(regexp_replace(p, '[^/]*$', ''), '/$', '') AS folder_path FROM (SELECT knowledge_id, unnest([relative_path, old_path]) AS p FROM diff_moved) WHERE p IS NOT NULL"


def _moved(spark, d):
    return pull.diff(v.v_snapshot_prev(spark, d), v.v_snapshot_moved(spark, d))


@query("diff_renames", f"WITH {_MOVED} SELECT * FROM diff_moved")
def diff_renames(spark, d):
    return _moved(spark, d)


@query("diff_union", f"WITH {_MOVED}, {_diff_sql('v_snapshot_next')} SELECT knowledge_id, status, relative_path, max(old_path) AS old_path FROM (SELECT * FROM diff_next UNION ALL SELECT * FROM diff_moved) GROUP BY 1, 2, 3")
def diff_union(spark, d):
    return pull.union(pull.diff(v.v_snapshot_prev(spark, d), v.v_snapshot_next(spark, d)), _moved(spark, d))


@query("changed_paths", f"WITH {_MOVED} {_CHANGED}")
def changed_paths(spark, d):
    return pull.changed_paths(_moved(spark, d))


@query("deleted_paths", f"WITH {_MOVED} {_GONE}")
def deleted_paths(spark, d):
    return pull.deleted_paths(_moved(spark, d))


@query("affected_folders_renames", f"WITH {_MOVED} {_FOLDERS}")
def affected_folders_renames(spark, d):
    return pull.affected_folders(_moved(spark, d))


@query("folders_by_length", f"WITH {_MOVED} SELECT knowledge_id, folder_path, row_number() OVER (PARTITION BY knowledge_id ORDER BY length(folder_path), folder_path) AS place FROM ({_FOLDERS})")
def folders_by_length(spark, d):
    return stats.order_folders(pull.affected_folders(_moved(spark, d)), F.length("folder_path"))


@query("folders_by_depth", f"WITH {_MOVED} SELECT knowledge_id, folder_path, row_number() OVER (PARTITION BY knowledge_id ORDER BY CASE WHEN folder_path = '' THEN 0 ELSE len(string_split(folder_path, '/')) END, folder_path) AS place FROM ({_FOLDERS})")
def folders_by_depth(spark, d):
    return stats.order_folders(pull.affected_folders(_moved(spark, d)), S.folder_level(F.col("folder_path")))


@query("store_pull", f"WITH {_MOVED}, gone AS ({_GONE} UNION {_CHANGED}) SELECT * FROM v_snapshot_prev WHERE (knowledge_id, relative_path) NOT IN (SELECT (knowledge_id, relative_path) FROM gone) UNION ALL SELECT n.* FROM v_snapshot_moved n SEMI JOIN ({_CHANGED}) c ON n.knowledge_id = c.knowledge_id AND n.relative_path = c.relative_path")
def store_pull(spark, d):
    return pull.store(v.v_snapshot_prev(spark, d), _moved(spark, d), v.v_snapshot_moved(spark, d))


@query("archive_fork", "SELECT knowledge_id, relative_path, sha, 'c2' AS commit_hash FROM v_snapshot_moved")
def archive_fork(spark, d):
    old = v.v_snapshot_prev(spark, d).withColumn("commit_hash", F.lit("c1"))
    return pull.fork_archive(old, "c1", "c2", _moved(spark, d), v.v_snapshot_moved(spark, d))


@query("folder_summaries_affected", f"""WITH {_MOVED}, f AS (SELECT *, regexp_replace(regexp_replace(relative_path, '[^/]*$', ''), '/$', '') AS folder_path FROM v_file)
SELECT f.knowledge_id, f.folder_path, count(*) AS n_files, arg_min(split_part(COALESCE(content, ''), chr(10), 1), relative_path) AS summary FROM f SEMI JOIN ({_FOLDERS}) a ON a.knowledge_id = f.knowledge_id AND a.folder_path = f.folder_path GROUP BY 1, 2""")
def folder_summaries_affected(spark, d):
    return analyse.folders(analyse.files(v.v_file(spark, d)), pull.affected_folders(_moved(spark, d))).drop("keywords")


@query("enrichment_pending", "SELECT knowledge_id, relative_path FROM v_file ANTI JOIN v_concept_edge USING (knowledge_id, relative_path)")
def enrichment_pending(spark, d):
    return pull.pending(v.v_file(spark, d), v.v_concept_edge(spark, d)).select("knowledge_id", "relative_path")


_SUMMED = "SELECT knowledge_id, regexp_replace(regexp_replace(relative_path, '[^/]*$', ''), '/$', '') AS folder_path, count(*) AS n, arg_min(split_part(COALESCE(content, ''), chr(10), 1), relative_path) AS summary FROM v_file GROUP BY 1, 2"


@query("store_folders", f"""WITH s AS ({_SUMMED}), f AS (SELECT DISTINCT knowledge_id, unnest(list_transform(range(0, len(string_split(relative_path, '/'))), lambda i: array_to_string(list_slice(string_split(relative_path, '/'), 1, i), '/'))) AS folder_path FROM v_file)
SELECT f.knowledge_id, f.folder_path, CASE WHEN f.folder_path = '' THEN 0 ELSE len(string_split(f.folder_path, '/')) END AS level, nullif(regexp_extract(f.folder_path, '^(.*)/[^/]*$', 1), '') AS parent_path, COALESCE(summary, '') AS summary FROM f LEFT JOIN s USING (knowledge_id, folder_path)""")
def store_folders(spark, d):
    files = v.v_file(spark, d)
    return pull.store_folders(files, analyse.folders(analyse.files(files)).select("knowledge_id", "folder_path", "summary"))


@query("version_edges", "SELECT knowledge_id, relative_path, 'c1' AS commit_hash, dst, 1 AS frequency FROM v_edge WHERE edge_type = 'HAS_KEYWORD'")
def version_edges(spark, d):
    edges = v.v_edge(spark, d).where("edge_type = 'HAS_KEYWORD'").withColumn("frequency", F.lit(None).cast("int"))
    return pull.copy_edges(edges, graph.snapshot(v.v_file(spark, d), "c1"))


_CONTEXT = """SELECT knowledge_id, concat('c', CAST(updated_seq % 3 AS VARCHAR)) AS commit_hash, concat(' ', repo_name, ' ') AS title, [' search ', '', NULL, branch] AS features, [state, '  '] AS risks FROM v_knowledge"""


def _context(spark, d):
    k = v.v_knowledge(spark, d)
    none = F.lit(None).cast("string")
    return k.select("knowledge_id", F.concat(F.lit("c"), (F.col("updated_seq") % 3).cast("string")).alias("commit_hash"), F.concat(F.lit(" "), "repo_name", F.lit(" ")).alias("title"), F.array(F.lit(" search "), F.lit(""), none, F.col("branch")).alias("features"), F.array("state", F.lit("  ")).alias("risks"))


@query("context_versions", f"SELECT knowledge_id, commit_hash, concat(knowledge_id, '@', commit_hash) AS version_id, trim(title) AS title, concat('search | ', features[4]) AS features, risks[1] AS risks FROM ({_CONTEXT})")
def context_versions(spark, d):
    return enrich.context_versions(_context(spark, d))


@query("context_keywords", f"SELECT DISTINCT concat(knowledge_id, '@', commit_hash) AS version_id, unnest(['search', features[4], risks[1]]) AS keyword FROM ({_CONTEXT})")
def context_keywords(spark, d):
    return enrich.context_keywords(_context(spark, d))


@query("context_describes", f"SELECT c.knowledge_id, c.commit_hash, concat(c.knowledge_id, '@', c.commit_hash) AS version_id, relative_path FROM ({_CONTEXT}) c JOIN v_file f ON f.knowledge_id = c.knowledge_id AND c.commit_hash = 'c1'")
def context_describes(spark, d):
    return pull.describes(enrich.context_versions(_context(spark, d)), graph.snapshot(v.v_file(spark, d), "c1"))


@query("commit_indexed", "SELECT k.knowledge_id, COALESCE(a.n, 0) AS n_versions, COALESCE(b.n, 0) AS n_files, COALESCE(a.n, 0) > 0 OR COALESCE(b.n, 0) > 0 AS indexed FROM v_knowledge k LEFT JOIN (SELECT knowledge_id, count(*) AS n FROM v_snapshot_moved WHERE starts_with(relative_path, 'moved/') GROUP BY 1) a USING (knowledge_id) LEFT JOIN (SELECT knowledge_id, count(*) AS n FROM v_file WHERE language = 'xx' GROUP BY 1) b USING (knowledge_id)")
def commit_indexed(spark, d):
    return pull.commit_indexed(v.v_knowledge(spark, d), v.v_snapshot_moved(spark, d).where(F.col("relative_path").startswith("moved/")), v.v_file(spark, d).where("language = 'xx'"))


_PARENTS = "SELECT commit_hash, lag(commit_hash) OVER (PARTITION BY knowledge_key ORDER BY committed_at, commit_hash) AS parent_hash, row_number() OVER (PARTITION BY knowledge_key ORDER BY committed_at DESC, commit_hash DESC) AS back, knowledge_key FROM v_commit"


def _parents(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("knowledge_key")
    rows = v.v_commit(spark, d)
    return rows.select("commit_hash", F.lag("commit_hash").over(w.orderBy("committed_at", "commit_hash")).alias("parent_hash"), F.row_number().over(w.orderBy(F.desc("committed_at"), F.desc("commit_hash"))).alias("back"), "knowledge_key")


@query("commit_ancestors", f"WITH RECURSIVE c AS ({_PARENTS}), up AS (SELECT commit_hash AS start, commit_hash, 0 AS depth FROM c WHERE back = 1 UNION ALL SELECT up.start, c.parent_hash, up.depth + 1 FROM up JOIN c ON c.commit_hash = up.commit_hash WHERE c.parent_hash IS NOT NULL) SELECT start, commit_hash, min(depth)::BIGINT AS depth FROM up GROUP BY 1, 2")
def commit_ancestors(spark, d):
    c = _parents(spark, d)
    return ancestry.history(c).ancestors(c.where("back = 1"))


@query("merge_bases", f"WITH c AS ({_PARENTS}) SELECT a.commit_hash AS a, b.commit_hash AS b, b.commit_hash AS base FROM c a JOIN c b ON a.knowledge_key = b.knowledge_key AND a.back = 1 AND b.back = 3")
def merge_bases(spark, d):
    c = _parents(spark, d)
    ends = c.where("back IN (1, 3)")
    pairs = ends.where("back = 1").select("knowledge_key", F.col("commit_hash").alias("a")).join(ends.where("back = 3").select("knowledge_key", F.col("commit_hash").alias("b")), "knowledge_key").select("a", "b")
    return ancestry.history(c).merge_base(pairs)


# --- lifecycle ------------------------------------------------------------------------------


@query("set_state", "SELECT knowledge_id, CASE WHEN updated_seq % 2 = 0 THEN 'PROCESSING' ELSE state END AS state, branch FROM v_knowledge")
def set_state(spark, d):
    k = v.v_knowledge(spark, d).select("knowledge_id", "state", "branch", "updated_seq")
    changes = k.where("updated_seq % 2 = 0").select("knowledge_id", F.lit("PROCESSING").alias("to_state"))
    changes = changes.unionByName(changes.limit(1).select(F.lit("none").alias("knowledge_id"), "to_state"))
    return lifecycle.update(k.drop("updated_seq"), changes, "knowledge_id", state=F.col("to_state"))


@query("set_state_missing", "SELECT concat(knowledge_id, '?') AS knowledge_id FROM v_knowledge")
def set_state_missing(spark, d):
    k = v.v_knowledge(spark, d)
    asked = k.select("knowledge_id").unionByName(k.select(F.concat("knowledge_id", F.lit("?")).alias("knowledge_id")))
    return lifecycle.missing(k, asked, "knowledge_id")


@query("set_head", "SELECT knowledge_id, CASE WHEN updated_seq % 2 = 1 THEN concat('head-', CAST(updated_seq AS VARCHAR)) END AS head FROM v_knowledge")
def set_head(spark, d):
    k = v.v_knowledge(spark, d)
    heads = k.where("updated_seq % 2 = 1").select("knowledge_id", F.concat(F.lit("head-"), F.col("updated_seq").cast("string")).alias("commit"))
    return lifecycle.update(k.select("knowledge_id", F.lit(None).cast("string").alias("head")), heads, "knowledge_id", head=F.col("commit"))


@query("branch_heads", """SELECT knowledge_id, 'main' AS name, CASE WHEN updated_seq % 2 = 0 THEN 'c2' ELSE 'c1' END AS head, CASE WHEN updated_seq % 2 = 0 THEN 'c0,c1,c2' ELSE 'c0,c1' END AS commits FROM v_knowledge
UNION ALL SELECT knowledge_id, 'dev', 'c2', 'c2' FROM v_knowledge WHERE updated_seq % 2 = 1""")
def branch_heads(spark, d):
    k = v.v_knowledge(spark, d)
    text = F.lit
    main = F.array(F.struct(text("main").alias("name"), text("c1").alias("head"), F.array(text("c0"), text("c1")).alias("commits")))
    heads = k.select("knowledge_id", F.when(F.col("updated_seq") % 2 == 0, "main").otherwise("dev").alias("name"), F.lit("c2").alias("commit"))
    out = lifecycle.advance_branches(k.select("knowledge_id", main.alias("branches")), heads)
    return out.select("knowledge_id", F.inline("branches")).withColumn("commits", F.array_join("commits", ","))


_ERRORS = "SELECT id, knowledge_id, type, CASE CAST(id % 5 AS INT) WHEN 0 THEN 'usage_limit' WHEN 1 THEN 'config' WHEN 2 THEN 'repo' WHEN 3 THEN 'llm' ELSE 'other' END AS error, CASE CAST(id % 7 AS INT) WHEN 0 THEN 401 WHEN 1 THEN 402 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 404 END AS status_code FROM v_job"
_CATEGORY = "CASE error WHEN 'usage_limit' THEN 'usage_limit_exceeded' WHEN 'config' THEN 'llm_config' WHEN 'repo' THEN 'repo_unavailable' WHEN 'llm' THEN CASE WHEN status_code IN (401, 403) THEN 'llm_auth' WHEN status_code = 402 THEN 'llm_quota' WHEN status_code = 429 THEN 'llm_rate_limit' ELSE 'llm_unreachable' END ELSE 'internal' END"
_RETRYABLE = "category IN ('llm_rate_limit', 'llm_unreachable', 'internal')"


def _pick(column, *names):
    """names[i] where column is i; null beyond them."""
    return F.get(F.array(*map(F.lit, names)), column.cast("int"))


def _errors(spark, d):
    return v.v_job(spark, d).select("id", "knowledge_id", "type", _pick(F.col("id") % 5, "usage_limit", "config", "repo", "llm", "other").alias("error"), _pick(F.col("id") % 7, 401, 402, 403, 429, 503, 404).alias("status_code"))


@query("failure_categories", f"WITH e AS ({_ERRORS}) SELECT id, category, {_RETRYABLE} AS retryable FROM (SELECT id, {_CATEGORY} AS category FROM e)")
def failure_categories(spark, d):
    category = X.failure_category(F.col("error"), F.col("status_code"))
    return _errors(spark, d).select("id", category.alias("category"), X.is_retryable(category).alias("retryable"))


_FAILED = f"""WITH k AS (SELECT *, CASE CAST(updated_seq % 3 AS INT) WHEN 0 THEN 'llm' WHEN 1 THEN 'config' END AS error FROM v_knowledge), c AS (SELECT knowledge_id, state, error, CASE error WHEN 'llm' THEN 'llm_rate_limit' WHEN 'config' THEN 'llm_config' END AS category FROM k)"""


def _failed(spark, d):
    k = v.v_knowledge(spark, d)
    none = F.lit(None).cast("struct<category:string,reason:string>").alias("failure")
    errors = k.select("knowledge_id", _pick(F.col("updated_seq") % 3, "llm", "config").alias("error"), F.lit(429).alias("status_code")).where("error IS NOT NULL")
    return lifecycle.record_failures(k.select("knowledge_id", "state", none), errors)


@query("mark_failed", f"{_FAILED} SELECT knowledge_id, CASE error WHEN 'llm' THEN 'HALTED' WHEN 'config' THEN 'FAILED' ELSE state END AS state, category, CASE WHEN category IS NOT NULL THEN concat('failed: ', category) END AS reason FROM c")
def mark_failed(spark, d):
    return _failed(spark, d).select("knowledge_id", "state", "failure.category", "failure.reason")


@query("promote_halted", f"{_FAILED} SELECT knowledge_id, CASE WHEN error IS NOT NULL THEN 'FAILED' ELSE state END AS state, error IS NOT NULL AND error = 'llm' AS changed FROM c")
def promote_halted(spark, d):
    return lifecycle.promote_halted(_failed(spark, d)).select("knowledge_id", "state", "changed")


@query("progress_update", "SELECT knowledge_id, CASE WHEN updated_seq % 2 = 0 THEN 'scan' ELSE 'clone' END AS phase, CASE WHEN updated_seq % 2 = 0 THEN 7 ELSE 1 END AS done, 10 AS total FROM v_knowledge")
def progress_update(spark, d):
    k = v.v_knowledge(spark, d)
    old = k.select("knowledge_id", F.struct(F.lit("clone").alias("phase"), F.lit(1).alias("done"), F.lit(10).alias("total")).alias("progress"))
    new = k.where("updated_seq % 2 = 0").select("knowledge_id", F.lit("scan").alias("phase"), F.lit(7).alias("done"))
    changed = F.col("progress").withField("phase", F.col("phase")).withField("done", F.col("done"))
    return lifecycle.update(old, new, "knowledge_id", progress=changed).select("knowledge_id", "progress.*")


@query("deletion_counts", "WITH i AS (SELECT knowledge_id FROM v_knowledge WHERE updated_seq % 2 = 0 UNION ALL SELECT 'none') SELECT i.knowledge_id, k.knowledge_id IS NOT NULL AS found, COALESCE((SELECT count(*) FROM v_file f WHERE f.knowledge_id = i.knowledge_id), 0) AS n_file, COALESCE((SELECT count(*) FROM v_edge f WHERE f.knowledge_id = i.knowledge_id), 0) AS n_edge FROM i LEFT JOIN v_knowledge k USING (knowledge_id)")
def deletion_counts(spark, d):
    k = v.v_knowledge(spark, d)
    ids = k.where("updated_seq % 2 = 0").select("knowledge_id").unionByName(spark.sql("SELECT 'none' AS knowledge_id"))
    return lifecycle.deletion_counts(k, {"file": v.v_file(spark, d), "edge": v.v_edge(spark, d)}, ids)


@query("enrichment_ledger", """WITH l AS (SELECT concat('run', CAST(doc_id % 4 AS VARCHAR)) AS run_id, relative_path AS path, CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'timeout' END AS error FROM v_file)
SELECT run_id, string_agg(path, ',' ORDER BY path) FILTER (error IS NULL) AS completed, string_agg(path, ',' ORDER BY path) FILTER (error IS NOT NULL) AS failures FROM l GROUP BY 1""")
def enrichment_ledger(spark, d):
    f, run = v.v_file(spark, d), F.concat(F.lit("run"), (F.col("doc_id") % 4).cast("string")).alias("run_id")
    first = f.select(run, F.lit(1).alias("at"), F.col("relative_path").alias("path"), F.when(F.col("doc_id") % 5 == 0, "timeout").alias("error"))
    second = f.where("doc_id % 2 = 1").select(run, F.lit(2).alias("at"), F.col("relative_path").alias("path"), F.lit(None).cast("string").alias("error"))
    out = lifecycle.ledger(first.unionByName(second))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)
    return out.select("run_id", text("completed"), text("failures"))


@query("recent_knowledge", "SELECT knowledge_id, updated_seq FROM v_knowledge ORDER BY updated_seq DESC, knowledge_id LIMIT 200")
def recent_knowledge(spark, d):
    return lifecycle.recent(v.v_knowledge(spark, d)).select("knowledge_id", "updated_seq")


_LEASED = "SELECT id, type, CASE WHEN id % 3 <> 0 THEN concat('w', CAST(id % 4 AS VARCHAR)) END AS owner, CASE WHEN id % 5 < 2 THEN 900 ELSE 500 END AS heartbeat_at FROM v_job"


def _leased(spark, d):
    rows = v.v_job(spark, d).select("id", "type", F.when(F.col("id") % 3 != 0, F.concat(F.lit("w"), (F.col("id") % 4).cast("string"))).alias("owner"), F.when(F.col("id") % 5 < 2, 900).otherwise(500).alias("heartbeat_at"))
    return lifecycle.lease(rows, F.lit(1000))


_LEASE = "CASE WHEN owner IS NULL THEN 'open' WHEN 1000 - heartbeat_at <= 300 THEN 'owned' ELSE 'expired' END"


@query("job_leases", f"SELECT type, {_LEASE} AS lease, count(*) AS n FROM ({_LEASED}) GROUP BY 1, 2")
def job_leases(spark, d):
    return _leased(spark, d).groupBy("type", "lease").agg(F.count("*").alias("n"))


@query("job_acknowledge", f"SELECT id, {_LEASE} AS lease FROM ({_LEASED}) WHERE NOT (owner IS NOT NULL AND 1000 - heartbeat_at <= 300 AND owner = 'w1')")
def job_acknowledge(spark, d):
    jobs = _leased(spark, d)
    return lifecycle.acknowledge(jobs, jobs.select("id", F.lit("w1").alias("owner"))).select("id", "lease")


@query("job_retry", f"WITH e AS ({_ERRORS}), c AS (SELECT id, type, {_CATEGORY} AS category FROM e), r AS (SELECT c.id, c.type, j.attempts + 1 AS attempts, {_RETRYABLE} AND j.attempts + 1 < 3 AS again FROM c JOIN v_job j ON j.id = c.id) SELECT id, type, attempts, CASE WHEN again THEN 'waiting' ELSE 'dead' END AS state, CASE WHEN again THEN 1005 END AS run_at FROM r")
def job_retry(spark, d):
    failed = _errors(spark, d).select("id", X.is_retryable(X.failure_category(F.col("error"), F.col("status_code"))).alias("retryable"))
    return lifecycle.retry(v.v_job(spark, d).select("id", "type", "attempts"), failed, F.lit(1000))


@query("job_cancel", "SELECT knowledge_id, count(*) AS n_cancelled FROM v_job WHERE priority = 2 GROUP BY 1")
def job_cancel(spark, d):
    jobs = v.v_job(spark, d).where("priority = 2")
    return lifecycle.cancel(jobs, jobs.select("knowledge_id").distinct())[1]


@query("job_cancel_left", "SELECT id, knowledge_id FROM v_job WHERE knowledge_id NOT IN (SELECT knowledge_id FROM v_job WHERE priority = 2)")
def job_cancel_left(spark, d):
    jobs = v.v_job(spark, d)
    return lifecycle.cancel(jobs, jobs.where("priority = 2").select("knowledge_id").distinct())[0].select("id", "knowledge_id")


@query("orphan_resume", "SELECT count(*) AS scanned, count(*) FILTER (updated_seq % 2 = 0) AS resumed, count(*) FILTER (updated_seq % 2 = 1) AS skipped FROM v_knowledge WHERE state = 'QUEUED'")
def orphan_resume(spark, d):
    k = v.v_knowledge(spark, d)
    return lifecycle.resume(k.withColumn("source_url", F.when(F.col("updated_seq") % 2 == 0, F.col("source_url"))))


@query("progress_throttle", "WITH p AS (SELECT concat('r', CAST(user_id % 5 AS VARCHAR)) AS run_id, event_id * 40 AS at_ms, event_id AS done, 777 AS total FROM events) SELECT run_id, at_ms, done, total FROM p QUALIFY row_number() OVER (PARTITION BY run_id, at_ms // 250 ORDER BY at_ms DESC, done DESC) = 1 OR done = total")
def progress_throttle(spark, d):
    rows = v.base(spark, d, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("run_id"), (F.col("event_id") * 40).alias("at_ms"), F.col("event_id").alias("done"), F.lit(777).alias("total"))
    return lifecycle.throttle(rows)


# --- enrichment -----------------------------------------------------------------------------

_ITEMS = """SELECT knowledge_id, relative_path, 'concept' AS family, concat(language, '-', CAST(doc_id % 7 AS VARCHAR), CASE WHEN doc_id % 11 = 0 THEN '_' ELSE '' END) AS slug, CASE WHEN doc_id % 3 = 0 THEN 'role' ELSE 'domain' END AS kind, concat('Name ', CAST(doc_id AS VARCHAR)) AS name, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'why' END AS note, 'HAS_CONCEPT' AS edge FROM v_file
UNION ALL SELECT knowledge_id, relative_path, 'contract', concat('api-', CAST(doc_id % 5 AS VARCHAR)), CASE WHEN doc_id % 6 = 0 THEN 'role' ELSE 'schema' END, 'Schema', NULL, CASE WHEN doc_id % 10 = 0 THEN 'USES' ELSE 'DEFINES' END FROM v_file
UNION ALL SELECT knowledge_id, relative_path, 'guidepost', 'note-1', 'warning', CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 'area' END, 'see here', NULL FROM v_file"""


def _enrichments(spark, d):
    i, text = F.col("doc_id"), F.lit
    item = lambda *a: F.array(F.struct(*[x.cast("string").alias(n) for x, n in zip(a, ("slug", "kind", "name", "note", "edge"), strict=True)]))
    none = text(None)
    concept = item(F.concat("language", text("-"), (i % 7).cast("string"), F.when(i % 11 == 0, "_").otherwise("")), F.when(i % 3 == 0, "role").otherwise("domain"), F.concat(text("Name "), i.cast("string")), F.when(i % 4 == 0, "").otherwise("why"), text("HAS_CONCEPT"))
    contract = item(F.concat(text("api-"), (i % 5).cast("string")), F.when(i % 6 == 0, "role").otherwise("schema"), text("Schema"), none, F.when(i % 10 == 0, "USES").otherwise("DEFINES"))
    guidepost = item(text("note-1"), text("warning"), F.when(i % 9 != 0, "area"), text("see here"), none)
    return v.v_file(spark, d).select("knowledge_id", "relative_path", concept.alias("concepts"), contract.alias("contracts"), guidepost.alias("guideposts"))


@query("enrichment_fan_out", f"SELECT * FROM ({_ITEMS})")
def enrichment_fan_out(spark, d):
    return enrich.fan_out(_enrichments(spark, d))


@query("enrichment_problems", f"""SELECT knowledge_id, relative_path, family, slug, CASE WHEN NOT COALESCE(regexp_full_match(slug, '[a-z0-9]([a-z0-9-]{{0,62}}[a-z0-9])?'), FALSE) THEN 'slug' WHEN family = 'contract' AND kind = 'role' THEN 'kind' WHEN name IS NULL THEN 'name' WHEN family = 'concept' AND note = '' THEN 'note' WHEN edge = 'USES' THEN 'edge' END AS problem FROM ({_ITEMS})""")
def enrichment_problems(spark, d):
    return enrich.problems(enrich.fan_out(_enrichments(spark, d))).select("knowledge_id", "relative_path", "family", "slug", "problem")


@query("enrichment_over_limits", f"SELECT knowledge_id, 'all' AS relative_path, family, count(*) AS n FROM ({_ITEMS}) GROUP BY 1, 3 HAVING count(*) > CASE family WHEN 'guidepost' THEN 10 ELSE 20 END")
def enrichment_over_limits(spark, d):
    return enrich.over_limits(enrich.fan_out(_enrichments(spark, d)).withColumn("relative_path", F.lit("all")))


_CONCEPTS = """SELECT knowledge_id, relative_path, slug, edge_type AS edge, CAST(f.doc_id AS BIGINT) AS "at" FROM v_concept_edge JOIN v_file f USING (knowledge_id, relative_path)"""


@query("concept_attach", f"""SELECT knowledge_id, relative_path, slug, edge, min("at") AS created_at, max("at") + 5 AS updated_at FROM ({_CONCEPTS}) WHERE slug <> 'quality-0' AND "at" % 3 <> 0 GROUP BY 1, 2, 3, 4""")
def concept_attach(spark, d):
    files = v.v_file(spark, d)
    edges = v.v_concept_edge(spark, d).withColumnRenamed("edge_type", "edge").join(files.select("knowledge_id", "relative_path", F.col("doc_id").alias("at")), ["knowledge_id", "relative_path"])
    known = edges.select("slug").distinct().where("slug <> 'quality-0'")
    there = files.where("doc_id % 3 <> 0")
    old = enrich.attach(there, known, edges).withColumn("at", F.col("created_at"))
    return enrich.attach(there, known, edges.withColumn("at", F.col("at") + 5), old)


@query("contract_upsert", "SELECT slug, arg_min(kind, t) AS kind, arg_max(name, t) AS name, min(t) AS created_at, max(t) AS updated_at FROM (SELECT concat('api-', CAST(doc_id % 5 AS VARCHAR)) AS slug, CASE WHEN doc_id % 6 = 0 THEN 'event' ELSE 'schema' END AS kind, relative_path AS name, doc_id AS t FROM v_file) GROUP BY 1")
def contract_upsert(spark, d):
    rows = v.v_file(spark, d).select(F.concat(F.lit("api-"), (F.col("doc_id") % 5).cast("string")).alias("slug"), F.when(F.col("doc_id") % 6 == 0, "event").otherwise("schema").alias("kind"), F.col("relative_path").alias("name"), F.col("doc_id").alias("at"))
    return enrich.upsert(rows.where("at % 2 = 0"), rows.where("at % 2 = 1"), ("kind",), ("name",))


@query("guidepost_upsert", "SELECT concat('note-', CAST(doc_id % 4 AS VARCHAR)) AS slug, arg_min(language, doc_id) AS kind, arg_max(relative_path, doc_id) AS note, arg_max(sha, doc_id) AS area, min(doc_id) AS created_at, max(doc_id) AS updated_at FROM v_file GROUP BY 1")
def guidepost_upsert(spark, d):
    rows = v.v_file(spark, d).select(F.concat(F.lit("note-"), (F.col("doc_id") % 4).cast("string")).alias("slug"), F.col("language").alias("kind"), F.col("relative_path").alias("note"), F.col("sha").alias("area"), F.col("doc_id").alias("at"))
    return enrich.upsert(rows, rows.limit(0), ("kind",), ("note", "area"))


@query("test_edges", "SELECT f.knowledge_id, f.relative_path, t.target_path FROM v_file f JOIN (SELECT knowledge_id, min(relative_path) AS target_path FROM v_file GROUP BY 1) t USING (knowledge_id) WHERE doc_id % 6 = 4")
def test_edges(spark, d):
    f = v.v_file(spark, d)
    first = f.groupBy("knowledge_id").agg(F.min("relative_path").alias("first"))
    target = _pick(F.col("doc_id") % 3, "  ").alias("blank")
    rows = f.join(first, "knowledge_id").select("knowledge_id", "relative_path", F.when(F.col("doc_id") % 6 == 4, F.col("first")).when(F.col("doc_id") % 6 == 5, F.concat("first", F.lit("?"))).otherwise(target).alias("target_path"))
    return enrich.tests(f, rows)


@query("merge_fields", "SELECT knowledge_id, CASE WHEN updated_seq % 2 = 0 THEN repo_name ELSE 'untitled' END AS title, CASE WHEN updated_seq % 3 = 0 THEN 'c' ELSE 'a' END AS summary, '' AS risks FROM v_knowledge")
def merge_fields(spark, d):
    k = v.v_knowledge(spark, d)
    a = k.select("knowledge_id", F.lit("a").alias("summary"))
    b = k.where("updated_seq % 2 = 0").select("knowledge_id", F.col("repo_name").alias("title"))
    c = k.where("updated_seq % 3 = 0").select("knowledge_id", F.lit("c").alias("summary"), F.lit(None).cast("string").alias("risks"))
    return enrich.merge_fields([a, b, c], ["knowledge_id"], {"title": F.lit("untitled"), "summary": F.lit(""), "risks": F.lit("")})


@query("repo_summaries", """WITH s AS (SELECT knowledge_id, folder_path, n, summary, (row_number() OVER (PARTITION BY knowledge_id ORDER BY folder_path) - 1) // 10 AS part FROM (""" + _SUMMED + """))
SELECT knowledge_id, sum(n)::BIGINT AS n_files, count(*) AS n_folders, count(DISTINCT part) AS n_partials, arg_min(summary, folder_path) AS summary FROM s GROUP BY 1""")
def repo_summaries(spark, d):
    return analyse.repositories(analyse.folders(analyse.files(v.v_file(spark, d))))


@query("repo_upsert", "SELECT knowledge_id, repo_name, CASE WHEN updated_seq % 2 = 0 THEN 'new' ELSE 'old' END AS summary FROM v_knowledge")
def repo_upsert(spark, d):
    k = v.v_knowledge(spark, d)
    old = k.select("knowledge_id", "repo_name", F.lit("old").alias("summary"), F.lit(1).alias("at"))
    new = k.where("updated_seq % 2 = 0").select("knowledge_id", "repo_name", F.lit("new").alias("summary"), F.lit(2).alias("at"))
    return graph.merge(old, new, ["knowledge_id"], "at").select("knowledge_id", "repo_name", "summary")


# --- analysis -------------------------------------------------------------------------------

_WORDS = "array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(lower({0}), '([a-z]{{7,}})', 1))), 1, 10), ',')"


@query("analyse_files", f"SELECT knowledge_id, relative_path, split_part(COALESCE(content, ''), chr(10), 1) AS purpose, substring(COALESCE(content, ''), 1, 600) AS summary, {_WORDS.format('COALESCE(content, chr(10))')} AS keywords FROM v_file")
def analyse_files(spark, d):
    return analyse.files(v.v_file(spark, d)).withColumn("keywords", F.array_join("keywords", ","))


_CHUNKS = "SELECT knowledge_id, relative_path, i AS chunk, substring(COALESCE(content, ''), i * 1000 + 1, 1000) AS part FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(COALESCE(content, '')) / 1000.0) AS BIGINT)))) AS i FROM v_file)"


@query("analyse_chunks", f"SELECT knowledge_id, relative_path, count(*) AS n_chunks, arg_min(substring(part, 1, 100), chunk) AS summary, COALESCE(array_to_string(list_sort(list_distinct(flatten(list(list_slice(list_sort(list_distinct(regexp_extract_all(lower(part), '([a-z]{{7,}})', 1))), 1, 10))))), ','), '') AS keywords FROM ({_CHUNKS}) GROUP BY 1, 2")
def analyse_chunks(spark, d):
    return analyse.condense(analyse.chunks(v.v_file(spark, d), 1000)).withColumn("keywords", F.array_join("keywords", ","))


_OUTCOME = """CASE WHEN ends_with(relative_path, '.lock') THEN 'ignored' WHEN COALESCE(size_bytes, 0) = 0 THEN 'empty' WHEN contains(substring(content, 1, 4096), chr(0)) THEN 'binary' WHEN length(content) - length(replace(content, chr(10), '')) + 1 > 2000 THEN 'oversized' WHEN ceil(length(content) / 4.0) > 1000 THEN 'big' ELSE 'small' END"""


@query("scan_counters", "SELECT knowledge_id, " + ", ".join(f"count(*) FILTER (o = '{k}') AS {k}" for k in ("ignored", "empty", "oversized", "binary", "big", "small")) + f" FROM (SELECT knowledge_id, {_OUTCOME} AS o FROM v_file) GROUP BY 1")
def scan_counters(spark, d):
    return analyse.scan_counters(v.v_file(spark, d), context=1000)


@query("analyse_changed", f"WITH {_MOVED} SELECT f.knowledge_id, f.relative_path, {_OUTCOME} AS outcome FROM v_file f SEMI JOIN ({_CHANGED}) c ON f.knowledge_id = c.knowledge_id AND f.relative_path = c.relative_path")
def analyse_changed(spark, d):
    rows = v.v_file(spark, d).join(pull.changed_paths(_moved(spark, d)), ["knowledge_id", "relative_path"], "left_semi")
    return rows.select("knowledge_id", "relative_path", analyse.outcome(F.col("relative_path"), F.col("content"), F.col("size_bytes"), 1000).alias("outcome"))


_ASKED = "SELECT relative_path, concat('k', CAST(doc_id % 50 AS VARCHAR)) AS cache_key FROM v_file"


def _memo(spark, d):
    asked = v.v_file(spark, d).select("relative_path", F.concat(F.lit("k"), (F.col("doc_id") % 50).cast("string")).alias("cache_key"))
    cache = asked.where("cache_key < 'k3'").select("cache_key", F.upper("cache_key").alias("answer"), F.lit(1).alias("hits")).distinct()
    return analyse.memo(asked, cache)


@query("memo_answers", f"SELECT cache_key, relative_path, CASE WHEN cache_key < 'k3' THEN upper(cache_key) END AS answer FROM ({_ASKED})")
def memo_answers(spark, d):
    return _memo(spark, d)[0]


@query("memo_hits", f"SELECT cache_key, upper(cache_key) AS answer, count(*) + 1 AS hits FROM ({_ASKED}) WHERE cache_key < 'k3' GROUP BY 1")
def memo_hits(spark, d):
    return _memo(spark, d)[1]


@query("cached_analysis", "SELECT relative_path, sha FROM v_file WHERE sha IS NOT NULL AND doc_id % 2 = 0")
def cached_analysis(spark, d):
    f = v.v_file(spark, d)
    doc = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"analysis": {"sha": "'), "sha", F.lit('"}}'))).when(F.col("doc_id") % 3 == 0, F.lit("{broken")).otherwise('{"other": 1}')
    return f.select("relative_path", F.get_json_object(doc, "$.analysis.sha").alias("sha")).where("sha IS NOT NULL")


@query("backfill", """SELECT knowledge_id, relative_path, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'w' WHEN doc_id % 2 = 0 THEN '' ELSE 'k' END AS keywords, CASE WHEN doc_id % 5 = 0 THEN 'in' ELSE 'out' END AS flow,
concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'keywords' END, CASE WHEN doc_id % 5 = 0 THEN 'flow' END) AS missing FROM v_file""")
def backfill(spark, d):
    f, i = v.v_file(spark, d), F.col("doc_id")
    words = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    rows = f.select("knowledge_id", "relative_path", F.when(i % 2 == 0, words("", None)).otherwise(words("k")).alias("keywords"), F.when(i % 5 == 0, "").otherwise("out").alias("flow"))
    found = f.select("knowledge_id", "relative_path", F.when(i % 3 == 0, words("", "w")).otherwise(words()).alias("keywords"), F.lit("in").alias("flow"))
    return analyse.backfill(rows, found, ("keywords",), ("flow",)).withColumn("keywords", F.array_join(X.nonempty(F.col("keywords")), ","))


@query("shape_analysis", """SELECT relative_path, CASE WHEN doc_id % 5 = 0 THEN '' ELSE language END AS language, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'a,b' END AS keywords, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END AS n_sections, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 > 0 THEN doc_id % 7 END AS first_line FROM v_file""")
def shape_analysis(spark, d):
    whole = F.concat(F.lit('```json\n{"language": "'), "language", F.lit('", "keywords": ["a", "", null, "b"], "sections": [{"name": "x", "start": '), (F.col("doc_id") % 7).cast("string"), F.lit('}, {"name": ""}, {"description": "d", "end": -1}]}\n```'))
    r = v.v_file(spark, d).select("relative_path", analyse.shape(F.when(F.col("doc_id") % 5 == 0, "{nothing").otherwise(whole)).alias("r"))
    return r.select("relative_path", "r.language", F.array_join("r.keywords", ",").alias("keywords"), F.size("r.sections").alias("n_sections"), F.get("r.sections", F.lit(0))["start"].alias("first_line"))


@query("folder_prompt_batches", """WITH f AS (SELECT knowledge_id, folder_path, row_number() OVER (PARTITION BY knowledge_id ORDER BY folder_path) - 1 AS i FROM (""" + _SUMMED + """)) SELECT knowledge_id, i // 3 AS batch, count(*) AS n, min(folder_path) AS first_folder FROM f GROUP BY 1, 2""")
def folder_prompt_batches(spark, d):
    rows = analyse.folders(analyse.files(v.v_file(spark, d))).select("knowledge_id", "folder_path")
    return retrieve.batches(rows, "knowledge_id", "folder_path", 3).groupBy("knowledge_id", "batch").agg(F.count("*").alias("n"), F.min("folder_path").alias("first_folder"))


# --- scalars and answers --------------------------------------------------------------------


@query("fulltext_queries", r'''SELECT relative_path, concat('*', regexp_replace(relative_path, '([+\-&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g'), '* *', language, '\+*') AS q FROM v_file''')
def fulltext_queries(spark, d):
    return v.v_file(spark, d).select("relative_path", X.fulltext_query(F.array(F.col("relative_path"), F.concat("language", F.lit("+")))).alias("q"))


@query("stats_repo_names", "SELECT knowledge_id, CASE WHEN updated_seq % 2 = 0 THEN knowledge_id ELSE repo_name END AS name FROM v_knowledge")
def stats_repo_names(spark, d):
    kind = F.when(F.col("updated_seq") % 2 == 0, "local").otherwise("github")
    return v.v_knowledge(spark, d).select("knowledge_id", X.stats_repo_name(kind, F.concat(F.lit("/data/"), "knowledge_id", F.lit("/")), F.col("source_url")).alias("name"))


@query("repo_urls", "SELECT knowledge_id, CASE WHEN updated_seq % 3 < 2 THEN 'org' END AS owner, CASE WHEN updated_seq % 3 < 2 THEN knowledge_id END AS repo, CASE WHEN updated_seq % 3 = 1 THEN 'feat/x' END AS branch FROM v_knowledge")
def repo_urls(spark, d):
    url, i = F.regexp_replace("source_url", r"\.git$", ""), F.col("updated_seq") % 3
    r = X.parse_repo_url(F.when(i == 0, F.col("source_url")).when(i == 1, F.concat(url, F.lit("/tree/feat/x"))).otherwise(F.concat(F.lit("https://elsewhere.org/a/"), "knowledge_id")))
    return v.v_knowledge(spark, d).select("knowledge_id", r.alias("r")).select("knowledge_id", "r.*")


@query("name_rules", "SELECT relative_path, regexp_full_match(relative_path, '[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?') AS path_is_slug, regexp_full_match(lower(language), '[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?') AS language_is_slug, sha IS NOT NULL AND FALSE AS long_is_commit, regexp_full_match(substring(sha, 1, 40), '[0-9a-f]{40}') AS is_commit, regexp_full_match(relative_path, '[\\w./-]+') AS path_is_branch, regexp_full_match(purpose, '[\\w./-]+') AS purpose_is_branch FROM v_file".replace("\\\\", "\\"))
def name_rules(spark, d):
    sha = F.col("sha")
    return v.v_file(spark, d).select("relative_path", X.is_slug(F.col("relative_path")).alias("path_is_slug"), X.is_slug(F.lower("language")).alias("language_is_slug"), F.coalesce(X.is_commit_hash(sha), F.lit(False)).alias("long_is_commit"), X.is_commit_hash(F.substring(sha, 1, 40)).alias("is_commit"), X.is_branch_name(F.col("relative_path")).alias("path_is_branch"), X.is_branch_name(F.col("purpose")).alias("purpose_is_branch"))


@query("cache_keys", """SELECT relative_path, sha256(concat('["', language, '","', relative_path, '"]')) AS cache_key FROM v_file""")
def cache_keys(spark, d):
    return v.v_file(spark, d).select("relative_path", X.cache_key(F.col("language"), F.col("relative_path")).alias("cache_key"))


@query("list_labels", "SELECT knowledge_id, concat(substring(sha256(knowledge_id), 1, 8), '…') AS short_id, CASE WHEN updated_seq % 2 = 0 THEN concat('github:', repo_name, '@main') ELSE concat('local:/data/', knowledge_id) END AS source FROM v_knowledge")
def list_labels(spark, d):
    kind = F.when(F.col("updated_seq") % 2 == 0, "github").otherwise("local")
    return v.v_knowledge(spark, d).select("knowledge_id", X.short_id(F.sha2("knowledge_id", 256)).alias("short_id"), X.source_label(kind, F.col("source_url"), F.col("branch"), F.concat(F.lit("/data/"), "knowledge_id")).alias("source"))


@query("cost_labels", "SELECT commit_hash, CASE WHEN CAST(commit_hash AS BIGINT) % 9 = 0 THEN 'unknown' ELSE concat('$', CAST(CAST(cost_usd AS DECIMAL(20,6)) AS VARCHAR)) END AS cost FROM v_commit")
def cost_labels(spark, d):
    cost = F.when(F.col("commit_hash").cast("long") % 9 == 0, F.lit(-1).cast("decimal(20,6)")).otherwise(F.col("cost_usd").cast("decimal(20,6)"))
    return v.v_commit(spark, d).select("commit_hash", X.cost_label(cost).alias("cost"))


@query("capped_sections", "SELECT relative_path, CASE WHEN ceil(length(content) / 4.0) > 300 THEN substring(content, 1, CAST(floor(length(content) * (300.0::DOUBLE / ceil(length(content) / 4.0)::DOUBLE)) AS BIGINT)) ELSE content END AS section FROM v_file")
def capped_sections(spark, d):
    return v.v_file(spark, d).select("relative_path", X.cap_tokens(F.col("content"), 300).alias("section"))


@query("numbered_lines", "SELECT relative_path, concat('1. ', language, chr(10), '2. ', relative_path) AS lines FROM v_file")
def numbered_lines(spark, d):
    return v.v_file(spark, d).select("relative_path", X.numbered(F.array("language", "relative_path")).alias("lines"))


@query("model_chains", "SELECT knowledge_id, concat(knowledge_id, ',', branch) AS chain FROM v_knowledge")
def model_chains(spark, d):
    return v.v_knowledge(spark, d).select("knowledge_id", F.array_join(X.model_chain(F.col("knowledge_id"), F.array(F.lit(""), F.col("branch"), F.col("knowledge_id"))), ",").alias("chain"))


@query("json_predicate", "SELECT relative_path FROM v_file WHERE doc_id % 4 = 1")
def json_predicate(spark, d):
    doc = F.to_json(F.struct((F.col("doc_id") % 4).alias("year"), "language"))
    return v.v_file(spark, d).where(F.get_json_object(doc, "$.year") == "1").select("relative_path")


@query("json_mutate", """SELECT relative_path, concat('{"state":"FAILED","n":', CAST(doc_id % 4 AS VARCHAR), '}') AS doc FROM v_file""")
def json_mutate(spark, d):
    doc = F.to_json(F.struct(F.lit("QUEUED").alias("state"), (F.col("doc_id") % 4).alias("n")))
    return v.v_file(spark, d).select("relative_path", X.json_set(doc, state=F.lit("FAILED")).alias("doc"))


@query("job_payloads", "SELECT id, knowledge_id, CASE WHEN id % 3 = 0 THEN 'main' END AS branch FROM v_job WHERE id % 4 <> 3")
def job_payloads(spark, d):
    i = F.col("id")
    raw = F.when(i % 4 == 3, F.lit('{"branch": 5}')).otherwise(F.to_json(F.struct(F.col("knowledge_id").alias("knowledgeId"), F.when(i % 3 == 0, "main").otherwise("").alias("branch"), F.lit(1).alias("extra"))))
    return stats.narrow_payloads(v.v_job(spark, d).select("id", raw.alias("payload")))


@query("list_projection", "SELECT knowledge_id, state, concat('github:', source_url, '@', branch) AS source, COALESCE(CASE WHEN updated_seq % 2 = 0 THEN 5 END, n) AS total_files FROM v_knowledge LEFT JOIN (SELECT knowledge_id, count(*) AS n FROM v_file GROUP BY 1) USING (knowledge_id)")
def list_projection(spark, d):
    k = v.v_knowledge(spark, d).withColumn("total_files", F.when(F.col("updated_seq") % 2 == 0, F.lit(5).cast("long")))
    return search.list_projection(k, v.v_file(spark, d).groupBy("knowledge_id").agg(F.count("*").alias("file_count")))


@query("branch_suggestions", "WITH n AS (SELECT DISTINCT split_part(relative_path, '/', 3) AS name FROM v_file), a AS (SELECT name FROM n WHERE contains(lower(name), 'mod1') ORDER BY name LIMIT 10) SELECT 'MOD1' AS asked, name FROM a UNION ALL SELECT 'zzz', name FROM (SELECT name FROM n ORDER BY name LIMIT 20)")
def branch_suggestions(spark, d):
    names = v.v_file(spark, d).select(F.split_part("relative_path", F.lit("/"), F.lit(3)).alias("name")).distinct()
    asked = spark.sql("SELECT explode(array('MOD1', 'zzz')) AS asked")
    return search.suggest(names, asked)


@query("lookup_capped", "WITH r AS (SELECT DISTINCT dst, knowledge_id, relative_path FROM v_edge WHERE edge_type = 'HAS_KEYWORD' AND dst IN (SELECT DISTINCT dst FROM v_edge WHERE edge_type = 'HAS_KEYWORD' AND contains(lower(dst), 'a') ORDER BY dst LIMIT 5)) SELECT r.dst AS name, r.knowledge_id, r.relative_path, k.repo_name, f.purpose FROM r JOIN v_knowledge k USING (knowledge_id) JOIN v_file f ON f.knowledge_id = r.knowledge_id AND f.relative_path = r.relative_path ORDER BY name, knowledge_id, relative_path LIMIT 50")
def lookup_capped(spark, d):
    found = search.keyword_lookup(v.v_edge(spark, d), v.v_knowledge(spark, d), "a", k=5, per=50)
    return search.capped(search.with_purpose(found, v.v_file(spark, d)), 50).select("name", "knowledge_id", "relative_path", "repo_name", "purpose")


@query("knowledge_groups", "SELECT CASE WHEN updated_seq % 2 = 0 THEN source_url ELSE knowledge_id END AS entry, count(*) AS n FROM v_knowledge GROUP BY 1")
def knowledge_groups(spark, d):
    k = v.v_knowledge(spark, d)
    return search.group_entries(k.select("knowledge_id", F.when(F.col("updated_seq") % 2 == 0, F.col("source_url")).alias("source_url"), F.lit(None).cast("string").alias("source_path")))


@query("page_clamp", "WITH p AS (SELECT knowledge_id, relative_path, row_number() OVER (ORDER BY relative_path, knowledge_id) AS n, count(*) OVER () AS total FROM v_file WHERE language = 'en') SELECT knowledge_id, relative_path, (total + 29) // 30 AS page, (total + 29) // 30 AS pages FROM p WHERE (n - 1) // 30 + 1 = (total + 29) // 30")
def page_clamp(spark, d):
    return search.clamped_page(v.v_file(spark, d).where("language = 'en'").select("knowledge_id", "relative_path"), ["relative_path", "knowledge_id"], 1_000_000, 30)


@query("commit_limits", "SELECT o_orderkey AS asked, CASE WHEN o_orderkey % 7 = 0 THEN 200 ELSE least(greatest(o_orderkey - 10, 1), 2000) END AS n FROM orders")
def commit_limits(spark, d):
    rows = v.base(spark, d, "orders").select(F.col("o_orderkey").alias("asked"))
    return rows.select("asked", search.commit_limit(F.when(F.col("asked") % 7 != 0, F.col("asked") - 10)).alias("n"))


@query("trimmed_results", "WITH t AS (SELECT knowledge_id, relative_path, row_number() OVER (ORDER BY relative_path, knowledge_id) AS n FROM v_file WHERE language = 'en' ORDER BY n LIMIT 60) SELECT knowledge_id, relative_path, n FROM t WHERE n <= 20")
def trimmed_results(spark, d):
    rows = v.v_file(spark, d).where("language = 'en'").select("knowledge_id", "relative_path").orderBy("relative_path", "knowledge_id").limit(60)
    return search.trim(rows, ["relative_path", "knowledge_id"], F.lit(1500), 32_000)


@query("unique_keys", "SELECT 'v_file' AS name, count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT knowledge_id, relative_path FROM v_file)) AS n_keys FROM v_file UNION ALL SELECT 'v_job', count(*), count(DISTINCT knowledge_id) FROM v_job")
def unique_keys(spark, d):
    return graph.key_counts({"v_file": (v.v_file(spark, d), ["knowledge_id", "relative_path"]), "v_job": (v.v_job(spark, d), ["knowledge_id"])})


@query("first_seen", "SELECT slug, knowledge_id, relative_path FROM v_concept_edge QUALIFY row_number() OVER (PARTITION BY slug ORDER BY relative_path, knowledge_id) = 1")
def first_seen(spark, d):
    return graph.first_seen(v.v_concept_edge(spark, d), ["slug"], ["relative_path", "knowledge_id"]).select("slug", "knowledge_id", "relative_path")


@query("tool_calls", "SELECT doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'metadata' WHEN 1 THEN 'content' WHEN 2 THEN 'bulk' ELSE 'other' END AS op, CASE WHEN doc_id % 4 = 3 THEN 'unknown op' WHEN doc_id % 4 = 0 AND doc_id % 60 > 10 THEN 'too many paths' WHEN doc_id % 4 = 2 AND doc_id % 60 > 50 THEN 'too many paths' WHEN doc_id % 4 = 1 AND doc_id * 100 NOT BETWEEN 1000 AND 50000 THEN 'tokens out of range' END AS problem FROM v_file")
def tool_calls(spark, d):
    i = F.col("doc_id")
    rows = v.v_file(spark, d).select("doc_id", _pick(i % 4, "metadata", "content", "bulk", "other").alias("op"), (i % 60).alias("n_paths"), (i * 100).alias("tokens"))
    return retrieve.call_problems(rows).select("doc_id", "op", "problem")


assert V.COMMITS_DEFAULT <= V.COMMITS_MAX
