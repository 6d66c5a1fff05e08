"""The domain tables over the driver's base tables, as DataFrames and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def base(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def v_file(spark, d) -> DataFrame:
    t, i = F.col("text"), F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, (".ts", ".py", ".go", ".md", ".test.ts", ".lock"))), (i % 6 + 1).cast("int"))
    path = F.concat(F.lit("src/"), "lang", F.lit("/mod"), (i % 7).cast("string"), F.lit("/doc_"), i.cast("string"), ext)
    return base(spark, d, "documents").select(
        F.col("source").alias("knowledge_id"), "doc_id", path.alias("relative_path"), F.col("lang").alias("language"), F.sha2(t, 256).alias("sha"),
        F.octet_length(t).cast("long").alias("size_bytes"), F.split_part(t, F.lit("\n"), F.lit(1)).alias("purpose"),
        F.substring(t, 1, 600).alias("summary"), F.substring(t, 601, 200).alias("business_context"), t.alias("content"),
    )


def v_edge(spark, d) -> DataFrame:
    f = v_file(spark, d)

    def tokens(kind, text, pattern):
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
        return f.select(F.lit(kind).alias("edge_type"), "knowledge_id", "relative_path", F.explode(found).alias("dst"))

    inner = f.select(F.lit("HAS_IMPORT_INTERNAL").alias("edge_type"), "knowledge_id", "relative_path", F.concat(F.lit("./mod"), ((F.col("doc_id") + 1) % 7).cast("string")).alias("dst"))
    host = base(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("dst"))
    outer = f.join(host, "doc_id").select(F.lit("HAS_IMPORT_EXTERNAL").alias("edge_type"), "knowledge_id", "relative_path", "dst")
    parts = [tokens("HAS_KEYWORD", F.lower("purpose"), "([a-z]{5,})"), tokens("HAS_CLASS", F.col("summary"), "([A-Z][a-z]{6,})"), tokens("HAS_FUNCTION", F.col("summary"), "([a-z]{9,})"), inner, outer]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def v_edges(spark, d) -> DataFrame:
    """The rows of v_edge by one scan of the texts, for queries over all kinds; one kind alone is read faster from v_edge, of which only its part is left."""
    f = v_file(spark, d)
    found = lambda text, pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    inner = F.array(F.concat(F.lit("./mod"), ((F.col("doc_id") + 1) % 7).cast("string")))
    kinds = {"HAS_KEYWORD": found(F.lower("purpose"), "([a-z]{5,})"), "HAS_CLASS": found(F.col("summary"), "([A-Z][a-z]{6,})"), "HAS_FUNCTION": found(F.col("summary"), "([a-z]{9,})"), "HAS_IMPORT_INTERNAL": inner}
    pairs = F.concat(*[_of_kind(kind, x) for kind, x in kinds.items()])
    rows = f.select("knowledge_id", "relative_path", F.inline(pairs)).select("edge_type", "knowledge_id", "relative_path", "dst")
    host = base(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("dst"))
    return rows.unionByName(f.select("doc_id", "knowledge_id", "relative_path").join(host, "doc_id").select(F.lit("HAS_IMPORT_EXTERNAL").alias("edge_type"), "knowledge_id", "relative_path", "dst"))


def _of_kind(kind: str, names):
    return F.transform(names, lambda v: F.struct(F.lit(kind).alias("edge_type"), v.alias("dst")))


def v_concept_edge(spark, d) -> DataFrame:
    f = v_file(spark, d).select("doc_id", "knowledge_id", "relative_path").join(base(spark, d, "labels"), "doc_id")
    row = lambda edge, name, kind: f.select(F.lit(edge).alias("edge_type"), "knowledge_id", "relative_path", F.concat(F.lit(f"{name}-"), F.col(name).cast("string")).alias("slug"), F.lit(kind).alias("kind"))
    return row("PLAYS_ROLE", "quality", "role").unionByName(row("BELONGS_TO_DOMAIN", "toxic", "domain"))


def v_knowledge(spark, d) -> DataFrame:
    top = base(spark, d, "documents").groupBy(F.col("source").alias("knowledge_id")).agg(F.max("doc_id").alias("updated_seq"))
    name = F.concat(F.lit("org/"), "knowledge_id")
    return top.select("knowledge_id", F.lit("github").alias("source_kind"), F.concat(F.lit("https://github.com/"), name, F.lit(".git")).alias("source_url"), F.lit("main").alias("branch"), name.alias("repo_name"), F.when(F.col("updated_seq") % 5 == 0, "QUEUED").otherwise("PROCESSED").alias("state"), "updated_seq")


def v_commit(spark, d) -> DataFrame:
    whole = F.floor("o_totalprice").cast("long")
    cost = F.concat(F.floor(F.col("o_totalprice") / 1000000).cast("long").cast("string"), F.lit("."), F.lpad((whole % 1000000).cast("string"), 6, "0"))
    return base(spark, d, "orders").select(F.col("o_custkey").alias("knowledge_key"), F.col("o_orderkey").cast("string").alias("commit_hash"), whole.cast("string").alias("input_tokens"), (F.col("o_orderkey") % 1000).cast("string").alias("output_tokens"), cost.alias("cost_usd"), F.col("o_orderdate").alias("committed_at"))


def v_job(spark, d) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("github_index", "github_pull", "local_ingest", "CUSTOM_CONTEXT_PROCESSING"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    p = F.substring("o_orderpriority", 1, 1)
    priority = F.when(p.isin("1", "2"), 2).when(p == "3", 1).otherwise(0)
    return base(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("knowledge_id"), kinds.alias("type"), priority.alias("priority"), (F.col("o_orderkey") % 5).cast("int").alias("attempts"), F.col("o_orderdate").alias("created_at"))


def v_activity(spark, d) -> DataFrame:
    return base(spark, d, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("identity_id"), F.col("event_type").alias("tool_name"), F.col("ts").alias("created_at"), F.length("props").cast("long").alias("input_tokens"), F.floor("value").cast("long").alias("output_tokens"))


def v_snapshot_prev(spark, d) -> DataFrame:
    return v_file(spark, d).where("doc_id % 10 <> 0").select("knowledge_id", "relative_path", "sha")


def v_snapshot_next(spark, d) -> DataFrame:
    sha = F.when(F.col("doc_id") % 4 == 0, F.concat("sha", F.lit("x"))).otherwise(F.col("sha"))
    return v_file(spark, d).where("doc_id % 9 <> 0").select("knowledge_id", "relative_path", sha.alias("sha"))


def v_snapshot_moved(spark, d) -> DataFrame:
    """The next snapshot with some files moved and some changed."""
    path = F.when(F.col("doc_id") % 8 == 3, F.concat(F.lit("moved/"), "relative_path")).otherwise(F.col("relative_path"))
    sha = F.when(F.col("doc_id") % 5 == 0, F.concat("sha", F.lit("x"))).otherwise(F.col("sha"))
    return v_file(spark, d).where("doc_id % 9 <> 0").select("knowledge_id", path.alias("relative_path"), sha.alias("sha"))


_TEXT = {
    "v_file": """SELECT source AS knowledge_id, doc_id, concat('src/',lang,'/mod',cast(doc_id%7 AS varchar),'/doc_',cast(doc_id AS varchar), CASE CAST(doc_id%6 AS INT) WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.md' WHEN 4 THEN '.test.ts' ELSE '.lock' END) AS relative_path, lang AS language, sha256(text) AS sha, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, split_part(text, chr(10), 1) AS purpose, substring(text,1,600) AS summary, substring(text,601,200) AS business_context, text AS content FROM documents""",
    "v_edge": """SELECT DISTINCT 'HAS_KEYWORD' AS edge_type, knowledge_id, relative_path, t AS dst FROM (SELECT *, unnest(regexp_extract_all(lower(purpose),'([a-z]{5,})',1)) AS t FROM v_file)
  UNION ALL SELECT DISTINCT 'HAS_CLASS', knowledge_id, relative_path, t FROM (SELECT *, unnest(regexp_extract_all(summary,'([A-Z][a-z]{6,})',1)) AS t FROM v_file)
  UNION ALL SELECT DISTINCT 'HAS_FUNCTION', knowledge_id, relative_path, t FROM (SELECT *, unnest(regexp_extract_all(summary,'([a-z]{9,})',1)) AS t FROM v_file)
  UNION ALL SELECT 'HAS_IMPORT_INTERNAL', knowledge_id, relative_path, concat('./mod',cast((doc_id+1)%7 AS varchar)) FROM v_file
  UNION ALL SELECT 'HAS_IMPORT_EXTERNAL', f.knowledge_id, f.relative_path, regexp_extract(p.url,'^https?://([^/]+)',1) FROM v_file f JOIN pages p ON p.page_id=f.doc_id""",
    "v_concept_edge": """SELECT 'PLAYS_ROLE' AS edge_type, f.knowledge_id, f.relative_path, concat('quality-',cast(l.quality AS varchar)) AS slug, 'role' AS kind FROM labels l JOIN v_file f ON f.doc_id=l.doc_id
  UNION ALL SELECT 'BELONGS_TO_DOMAIN', f.knowledge_id, f.relative_path, concat('toxic-',cast(l.toxic AS varchar)), 'domain' FROM labels l JOIN v_file f ON f.doc_id=l.doc_id""",
    "v_knowledge": """SELECT source AS knowledge_id, 'github' AS source_kind, concat('https://github.com/org/',source,'.git') AS source_url, 'main' AS branch, concat('org/',source) AS repo_name, CASE WHEN max(doc_id)%5=0 THEN 'QUEUED' ELSE 'PROCESSED' END AS state, max(doc_id) AS updated_seq FROM documents GROUP BY source""",
    "v_commit": """SELECT o_custkey AS knowledge_key, cast(o_orderkey AS varchar) AS commit_hash, cast(CAST(floor(o_totalprice) AS BIGINT) AS varchar) AS input_tokens, cast(o_orderkey%1000 AS varchar) AS output_tokens, concat(cast(CAST(floor(o_totalprice/1000000) AS BIGINT) AS varchar),'.',lpad(cast(CAST(floor(o_totalprice) AS BIGINT)%1000000 AS varchar),6,'0')) AS cost_usd, o_orderdate AS committed_at FROM orders""",
    "v_job": """SELECT o_orderkey AS id, concat('k',cast(o_custkey AS varchar)) AS knowledge_id, CASE CAST(o_orderkey%4 AS INT) WHEN 0 THEN 'github_index' WHEN 1 THEN 'github_pull' WHEN 2 THEN 'local_ingest' ELSE 'CUSTOM_CONTEXT_PROCESSING' END AS type, CASE substring(o_orderpriority,1,1) WHEN '1' THEN 2 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END AS priority, CAST(o_orderkey%5 AS INT) AS attempts, o_orderdate AS created_at FROM orders""",
    "v_activity": """SELECT event_id, concat('u',cast(user_id AS varchar)) AS identity_id, event_type AS tool_name, ts AS created_at, CAST(length(props) AS BIGINT) AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens FROM events""",
    "v_snapshot_prev": """SELECT knowledge_id, relative_path, sha FROM v_file WHERE doc_id%10<>0""",
    "v_snapshot_moved": """SELECT knowledge_id, CASE WHEN doc_id%8=3 THEN concat('moved/',relative_path) ELSE relative_path END AS relative_path, CASE WHEN doc_id%5=0 THEN concat(sha,'x') ELSE sha END AS sha FROM v_file WHERE doc_id%9<>0""",
    "v_snapshot_next": """SELECT knowledge_id, relative_path, CASE WHEN doc_id%4=0 THEN concat(sha,'x') ELSE sha END AS sha FROM v_file WHERE doc_id%9<>0""",
}


def with_views(sql: str) -> str:
    """sql with the views it names as common table expressions; sql may begin with its own list of them."""
    used = {v for v in _TEXT if v in sql}
    while more := {w for v in used for w in _TEXT if w in _TEXT[v]} - used:
        used |= more
    if not used:
        return sql
    ctes = ",\n".join(f"{v} AS ({t})" for v, t in _TEXT.items() if v in used)
    if sql.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{sql.lstrip()[15:]}"
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql.lstrip()[5:]}"
    return f"WITH {ctes}\n{sql}"
