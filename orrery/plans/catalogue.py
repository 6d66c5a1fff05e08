"""The registered queries of the engine, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from ..operators import graph, retrieve, scan, search, stats
from ..operators.search import Scope
from ..streaming import usage
from . import views as v
from .registry import QUERIES, SQL, query

QUERY = "attion eriner"


# --- search ---------------------------------------------------------------------------------

_TEXT_COLUMNS = {"purpose": ("purpose", "summary"), "businessContext": ("business_context",), "paths": ("relative_path",)}
_SNAKE = {"businessContext": "business_context", "importsInternal": "imports_internal", "importsExternal": "imports_external"}


def _channel_sql(name: str, terms: list[str], where: str = "") -> str:
    if name in search.TEXTS:
        has = [" OR ".join(f"contains(lower(COALESCE({c}, '')), '{t}')" for c in search.TEXTS[name]) for t in terms]
        score = " + ".join(f"CASE WHEN {h} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for h in has)
        rows = f"SELECT knowledge_id, relative_path, ({score}) / {float(len(terms))}::DOUBLE AS score FROM v_file WHERE TRUE {where}"
    else:
        kind, flat = search.ENTITY[name]
        has = [f"contains(lower(dst), '{t}')" for t in terms]
        score = "1.0::DOUBLE" if flat else "(" + " + ".join(f"CASE WHEN {h} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for h in has) + f") / {float(len(terms))}::DOUBLE"
        rows = f"SELECT knowledge_id, relative_path, max({score}) AS score FROM v_edge WHERE edge_type = '{kind}' AND ({' OR '.join(has)}) {where} GROUP BY 1, 2"
    return f"SELECT '{name}' AS channel, knowledge_id, relative_path, score FROM ({rows}) WHERE score > 0 ORDER BY score DESC, relative_path, knowledge_id LIMIT {V.CHANNEL_CAP}"


def _fused_sql(terms: list[str], where: str = "") -> str:
    hits = " UNION ALL ".join(f"SELECT * FROM ({_channel_sql(c, terms, where)})" for c in V.CHANNEL_WEIGHTS)
    weight = "CASE channel " + " ".join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, w in V.CHANNEL_WEIGHTS.items()) + " END"
    return f"""hits AS ({hits}), parts AS (SELECT *, score / max(score) OVER (PARTITION BY channel) * {weight} AS part FROM hits),
fused AS (SELECT knowledge_id, relative_path, round(sum(part), 6) AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM parts GROUP BY 1, 2)"""


def _add_channel(name: str) -> None:
    term = {"importsInternal": "./mod", "importsExternal": "e", "paths": "mod1 .py"}.get(name, QUERY)

    @query(f"channel_{_SNAKE.get(name, name)}", f"SELECT * FROM ({_channel_sql(name, search.terms_of(term))})")
    def run(spark, d):
        return search.channel(name, v.v_file(spark, d), v.v_edge(spark, d), term)


for _name in V.CHANNEL_WEIGHTS:
    _add_channel(_name)
_TERMS = search.terms_of(QUERY)
_EXCLUDED = " AND NOT (" + " OR ".join([f"ends_with(lower(relative_path), '{s}')" for c in ("tests", "config") for s in V.EXCLUSIONS[c][0]] + [f"contains(lower(relative_path), '{s}')" for c in ("tests", "config") for s in V.EXCLUSIONS[c][1]]) + ")"


def _fused(spark, d, scope=Scope()):
    return search.fused_search(v.v_file(spark, d), v.v_edges(spark, d), QUERY, scope)


@query("smart_search_fused", f"WITH {_fused_sql(_TERMS)} SELECT f.*, COALESCE(k.repo_name, '') AS repo_name FROM fused f LEFT JOIN v_knowledge k USING (knowledge_id)")
def smart_search_fused(spark, d):
    return search.with_repo_names(_fused(spark, d), v.v_knowledge(spark, d)).select("knowledge_id", "relative_path", "score", "channels", "repo_name")


@query("smart_search_scoped", f"""WITH {_fused_sql(_TERMS, "AND knowledge_id IN ('src1','src2','src3') AND starts_with(relative_path, 'src/en')")} SELECT * FROM fused""")
def smart_search_scoped(spark, d):
    return _fused(spark, d, Scope(knowledge_ids=("src1", "src2", "src3"), prefix="src/en"))


@query("smart_search_excluded", f"WITH {_fused_sql(_TERMS, _EXCLUDED)} SELECT * FROM fused")
def smart_search_excluded(spark, d):
    return _fused(spark, d, Scope(exclude=("tests", "config")))


@query("smart_search_page2", f"WITH {_fused_sql(_TERMS)} SELECT * FROM fused ORDER BY score DESC, relative_path, knowledge_id LIMIT 10 OFFSET 10")
def smart_search_page2(spark, d):
    return search.page(_fused(spark, d), 2, 10)


_FOLDER = "concat_ws('/', split_part(relative_path, '/', 1), split_part(relative_path, '/', 2))"


@query("folder_clusters", f"WITH {_fused_sql(_TERMS)} SELECT knowledge_id, {_FOLDER} AS folder, count(*) AS file_count, arg_min(relative_path, (-score, relative_path)) AS top_file FROM fused GROUP BY 1, 2 HAVING count(*) >= 2")
def folder_clusters(spark, d):
    return search.folder_clusters(_fused(spark, d))


@query("concept_clusters", f"""WITH {_fused_sql(_TERMS)}, r AS (SELECT DISTINCT kind, slug, relative_path FROM fused JOIN v_concept_edge USING (knowledge_id, relative_path) WHERE kind IN ('role', 'pattern', 'domain'))
SELECT kind, slug, count(*) AS file_count, array_to_string(list_slice(list_sort(list(relative_path)), 1, 5), ',') AS sample_files FROM r GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY file_count DESC, kind, slug LIMIT 20""")
def concept_clusters(spark, d):
    return search.concept_clusters(_fused(spark, d), v.v_concept_edge(spark, d))


def _add_lookup(mode: str, term: str) -> None:
    kinds = ", ".join(f"'{e}'" for e in search.MODES[mode])

    @query(f"keyword_lookup_{mode}", f"""WITH r AS (SELECT * FROM v_edge WHERE edge_type IN ({kinds}) AND contains(lower(dst), '{term}')), n AS (SELECT DISTINCT dst FROM r ORDER BY dst LIMIT 20),
u AS (SELECT DISTINCT r.dst, r.knowledge_id, r.relative_path, k.repo_name FROM r JOIN n USING (dst) JOIN v_knowledge k ON k.knowledge_id = r.knowledge_id)
SELECT dst AS name, knowledge_id, relative_path, repo_name, row_number() OVER (PARTITION BY dst ORDER BY knowledge_id, relative_path)::INT AS nth FROM u QUALIFY nth <= 20""")
    def run(spark, d):
        return search.keyword_lookup(v.v_edge(spark, d), v.v_knowledge(spark, d), term, mode)


for _mode, _term in (("keyword", "tion"), ("class", "th"), ("function", "tion"), ("module", "mod")):
    _add_lookup(_mode, _term)


@query("list_knowledge", "SELECT k.knowledge_id, repo_name, branch, state, updated_seq, COALESCE(n, 0) AS file_count FROM v_knowledge k LEFT JOIN (SELECT knowledge_id, count(*) AS n FROM v_file GROUP BY 1) USING (knowledge_id)")
def list_knowledge(spark, d):
    return search.list_knowledge(v.v_knowledge(spark, d), v.v_file(spark, d))


_NAMES = {"HAS_KEYWORD": "keywords", "HAS_CLASS": "classes", "HAS_FUNCTION": "functions", "HAS_IMPORT_INTERNAL": "imports_internal", "HAS_IMPORT_EXTERNAL": "imports_external"}


@query("file_metadata", "SELECT f.knowledge_id, f.relative_path, any_value(f.language) AS language, any_value(f.purpose) AS purpose, " + ", ".join(f"COALESCE(string_agg(DISTINCT dst, ',' ORDER BY dst) FILTER (edge_type = '{e}'), '') AS {n}" for e, n in _NAMES.items()) + " FROM v_file f LEFT JOIN v_edge e USING (knowledge_id, relative_path) GROUP BY 1, 2")
def file_metadata(spark, d):
    files = v.v_file(spark, d)
    return search.file_metadata(files, v.v_edges(spark, d), files.select("knowledge_id", "relative_path"))


@query("file_not_found", "SELECT concat('src/x/', split_part(relative_path, '/', 4)) AS relative_path FROM v_file WHERE doc_id % 3 = 0")
def file_not_found(spark, d):
    files = v.v_file(spark, d)
    asked = files.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("src/x/"), S.basename(F.col("relative_path")))).otherwise(F.col("relative_path")).alias("relative_path"))
    return asked.join(files.select("relative_path"), "relative_path", "left_anti").select("relative_path")


@query("repo_names", "SELECT knowledge_id, repo_name FROM v_knowledge WHERE knowledge_id IN ('src1', 'src2', 'none')")
def repo_names(spark, d):
    return v.v_knowledge(spark, d).where(F.col("knowledge_id").isin("src1", "src2", "none")).select("knowledge_id", "repo_name")


# --- scan and classification ------------------------------------------------------------------

_ADMIT = "CASE WHEN ends_with(relative_path, '.lock') OR regexp_matches(split_part(relative_path, '/', 4), '^.*\\.test\\.ts$') THEN 'reject-static' ELSE 'accept' END"


@query("scan_admission", f"SELECT {_ADMIT} AS decision, count(*) AS n FROM v_file GROUP BY 1")
def scan_admission(spark, d):
    decision = scan.admission(F.col("relative_path"), globs=("*.test.ts",)).alias("decision")
    return v.v_file(spark, d).groupBy(decision).agg(F.count("*").alias("n"))


@query("glob_filter", r"SELECT knowledge_id, relative_path FROM v_file WHERE regexp_matches(relative_path, '^src/[^/]*/mod[0-3]/.*\.py$')")
def glob_filter(spark, d):
    globs = [S.glob_regex(f"src/*/mod{i}/**.py") for i in range(4)]
    return v.v_file(spark, d).where(F.col("relative_path").rlike("|".join(globs))).select("knowledge_id", "relative_path")


_TOKENS = "CAST(ceil(length(content) / 4.0) AS BIGINT)"
_KIND = f"CASE WHEN size_bytes > 52428800 OR (CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END) > 2000 THEN 'oversized' WHEN {_TOKENS} > 1000 THEN 'big' ELSE 'small' END"


@query("scan_manifest_summary", f"""WITH r AS (SELECT {_KIND.replace('> 1000', '> 15000')} AS kind, {_TOKENS} AS tokens FROM v_file)
SELECT count(*) AS total_files, count(*) FILTER (kind = 'small') AS small_count, count(*) FILTER (kind = 'big') AS big_count, count(*) FILTER (kind = 'oversized') AS oversized_count, COALESCE(sum(tokens), 0)::BIGINT AS total_tokens, COALESCE(sum(greatest(1, ceil(tokens / 6000.0))) FILTER (kind = 'big'), 0)::BIGINT AS estimated_big_chunks FROM r""")
def scan_manifest_summary(spark, d):
    return scan.manifest_summary(v.v_file(spark, d))


@query("scan_kinds", f"SELECT knowledge_id, {_KIND} AS kind, count(*) AS n FROM v_file GROUP BY 1, 2")
def scan_kinds(spark, d):
    return v.v_file(spark, d).groupBy("knowledge_id", scan.kind(F.col("content"), context=1000).alias("kind")).agg(F.count("*").alias("n"))


@query("binary_sniff", "SELECT contains(content, chr(0)) AS is_binary, count(*) AS n FROM v_file GROUP BY 1")
def binary_sniff(spark, d):
    return v.v_file(spark, d).groupBy(scan.is_binary(F.col("content")).alias("is_binary")).agg(F.count("*").alias("n"))


@query("content_dedupe", "SELECT concat('file:', sha) AS decision_key, count(*) AS n_files, min(relative_path) AS first_path FROM v_file GROUP BY sha")
def content_dedupe(spark, d):
    return scan.content_decisions(v.v_file(spark, d))


@query("ignore_overlay", f"SELECT knowledge_id, unnest(list_distinct(list_filter(list_concat([{', '.join(repr(x) for x in V.IGNORED_EXTENSIONS)}], ['.min.js', concat('.', knowledge_id)]), lambda x: NOT (updated_seq % 2 = 0 AND x IN ('.lock', '.png'))))) AS extension FROM v_knowledge")
def ignore_overlay(spark, d):
    even = F.col("updated_seq") % 2 == 0
    rules = scan.overlaid(V.IGNORED_EXTENSIONS, F.array(F.lit(".min.js"), F.concat(F.lit("."), "knowledge_id")), F.when(even, F.array(F.lit(".lock"), F.lit(".png"))))
    return v.v_knowledge(spark, d).select("knowledge_id", F.explode(rules).alias("extension"))


# --- graph ------------------------------------------------------------------------------------


@query("graph_edges_keyword", "SELECT * FROM v_edge WHERE edge_type = 'HAS_KEYWORD'")
def graph_edges_keyword(spark, d):
    return v.v_edge(spark, d).where("edge_type = 'HAS_KEYWORD'")


@query("graph_edge_counts", "SELECT edge_type, count(*) AS n_edges, count(DISTINCT dst) AS n_entities FROM v_edge GROUP BY 1")
def graph_edge_counts(spark, d):
    return graph.edge_counts(v.v_edges(spark, d))


@query("folder_tree", """WITH p AS (SELECT knowledge_id, string_split(relative_path, '/') AS s FROM v_file),
a AS (SELECT DISTINCT knowledge_id, array_to_string(list_slice(s, 1, i), '/') AS folder_path FROM (SELECT *, unnest(range(0, len(s))) AS i FROM p)),
c AS (SELECT knowledge_id, array_to_string(list_slice(s, 1, len(s) - 1), '/') AS folder_path, count(*) AS n FROM p GROUP BY 1, 2)
SELECT knowledge_id, folder_path, (CASE WHEN folder_path = '' THEN 0 ELSE len(string_split(folder_path, '/')) END)::INT AS level,
  CASE WHEN contains(folder_path, '/') THEN regexp_replace(folder_path, '/[^/]*$', '') END AS parent_path, COALESCE(n, 0) AS direct_files FROM a LEFT JOIN c USING (knowledge_id, folder_path)""")
def folder_tree(spark, d):
    return graph.folder_tree(v.v_file(spark, d))


@query("orphan_files", "SELECT knowledge_id, relative_path FROM v_file WHERE knowledge_id NOT IN (SELECT knowledge_id FROM v_knowledge WHERE state <> 'QUEUED')")
def orphan_files(spark, d):
    return graph.orphan_files(v.v_file(spark, d), v.v_knowledge(spark, d).where("state <> 'QUEUED'"))


@query("orphan_entities", "SELECT DISTINCT edge_type, dst FROM v_edge EXCEPT SELECT DISTINCT edge_type, dst FROM v_edge WHERE knowledge_id <> 'src0'")
def orphan_entities(spark, d):
    edges = v.v_edge(spark, d)
    return graph.orphan_entities(edges, graph.cascade_delete({"edge": edges}, "src0")["edge"])


_MIRROR = "SELECT DISTINCT trim(CASE WHEN edge_type = 'HAS_KEYWORD' THEN lower(dst) ELSE dst END) AS keyword, edge_type AS type, knowledge_id, relative_path FROM v_edge WHERE trim(dst) <> ''"


@query("keyword_mirror", f"SELECT *, 1 AS frequency FROM ({_MIRROR})")
def keyword_mirror(spark, d):
    return graph.keyword_mirror(v.v_edge(spark, d))


@query("keyword_counters", f"SELECT keyword, type, count(*) AS total_frequency, count(DISTINCT (knowledge_id, relative_path)) AS file_count FROM ({_MIRROR}) GROUP BY 1, 2")
def keyword_counters(spark, d):
    return graph.keyword_counters(graph.keyword_mirror(v.v_edge(spark, d)))


@query("upsert_merge", """WITH u AS (SELECT o_custkey AS k, 'c' || (o_orderkey % 3) AS kind, 'n' || o_orderkey AS name, o_orderkey AS seq FROM orders)
SELECT k, arg_min(kind, seq) AS kind, arg_max(name, seq) AS name, max(seq) AS seq FROM u GROUP BY k""")
def upsert_merge(spark, d):
    rows = v.base(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string")).alias("kind"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("at"))
    return graph.merge(rows.where("seq % 2 = 0"), rows.where("seq % 2 <> 0"), ["k"], "at", first=("kind",)).select("k", "kind", "name", "seq")


@query("concept_upsert", """WITH c AS (SELECT slug, kind || '-' || (hash % 2) AS kind, relative_path AS name, relative_path AS seq FROM (SELECT *, length(relative_path) AS hash FROM v_concept_edge))
SELECT slug, arg_min(kind, seq) AS kind, arg_max(name, seq) AS name FROM c GROUP BY slug""")
def concept_upsert(spark, d):
    rows = v.v_concept_edge(spark, d).select("slug", F.concat("kind", F.lit("-"), (F.length("relative_path") % 2).cast("string")).alias("kind"), F.col("relative_path").alias("name"), F.col("relative_path").alias("at"))
    return graph.merge(rows, rows.limit(0), ["slug"], "at", first=("kind",)).select("slug", "kind", "name")


@query("guidepost_targets", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 'file' WHEN doc_id % 3 = 0 AND doc_id % 2 <> 0 AND doc_id % 5 <> 0 THEN 'concept' ELSE 'contract' END AS target FROM documents
WHERE (doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT = 1""")
def guidepost_targets(spark, d):
    i = F.col("doc_id")
    rows = v.base(spark, d, "documents").select(i, F.when(i % 2 == 0, i).alias("file_id"), F.when(i % 3 == 0, i).alias("concept_id"), F.when(i % 5 == 0, i).alias("contract_id"))
    return graph.guidepost_targets(rows).select("doc_id", "target")


@query("delta_store", "SELECT knowledge_id, relative_path, CASE WHEN doc_id % 4 = 0 THEN concat(sha, 'x') ELSE sha END AS sha FROM v_file WHERE doc_id % 5 <> 0 OR doc_id % 4 = 0")
def delta_store(spark, d):
    f = v.v_file(spark, d)
    delta = f.where("doc_id % 4 = 0").select("knowledge_id", "relative_path", F.concat("sha", F.lit("x")).alias("sha"))
    return graph.replace_by_key(f.where("doc_id % 5 <> 0").select("knowledge_id", "relative_path", "sha"), delta, ["knowledge_id", "relative_path"])


@query("version_snapshot", "SELECT knowledge_id, relative_path, 'c1' AS commit_hash, sha FROM v_file WHERE doc_id % 2 = 0")
def version_snapshot(spark, d):
    f = v.v_file(spark, d).select("knowledge_id", "relative_path", "sha", "doc_id")
    done = graph.snapshot(f.where("doc_id % 2 <> 0"), "c1")
    return graph.snapshot(f, "c1", done).select("knowledge_id", "relative_path", "commit_hash", "sha")


# --- retrieval ----------------------------------------------------------------------------------

_LINES = "ln AS (SELECT knowledge_id, relative_path, unnest(range(1, len(s) + 1))::INT AS line_no, unnest(s) AS line FROM (SELECT knowledge_id, relative_path, regexp_split_to_array(content, '\\r?\\n') AS s FROM v_file))"


@query("read_range", f"""WITH {_LINES}, r AS (SELECT *, sum(length(line) + 1) OVER w AS used, row_number() OVER w AS nth FROM ln WHERE line_no BETWEEN 2 AND 9 WINDOW w AS (PARTITION BY knowledge_id, relative_path ORDER BY line_no)),
k AS (SELECT *, length(max(line_no) OVER (PARTITION BY knowledge_id, relative_path)::VARCHAR)::INT AS width FROM r WHERE used <= 1200 OR nth = 1)
SELECT knowledge_id, relative_path, line_no, lpad(line_no::VARCHAR, width, ' ') || ': ' || line AS numbered FROM k""")
def read_range(spark, d):
    return retrieve.read_range(v.v_file(spark, d), 2, 9, 300)


@query("search_in_file", f"""WITH {_LINES}, a AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY knowledge_id, relative_path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM ln)
SELECT * FROM a WHERE contains(lower(line), 'license')""")
def search_in_file(spark, d):
    return retrieve.search_lines(v.v_file(spark, d), "license", 2)


@query("bulk_search", f"WITH {_LINES} SELECT knowledge_id, relative_path, count(*) FILTER (contains(lower(line), 'license')) AS matches FROM ln GROUP BY 1, 2")
def bulk_search(spark, d):
    return retrieve.bulk_search(v.v_file(spark, d), "license")


_FOLD = """WITH RECURSIVE {views} o AS ({rows}),
w AS (SELECT k, i, cost, cost::BIGINT AS used, 1 AS g FROM o WHERE i = 1
  UNION ALL SELECT o.k, o.i, o.cost, CASE WHEN w.used > 0 AND w.used + o.cost > {budget} THEN o.cost ELSE w.used + o.cost END, CASE WHEN w.used > 0 AND w.used + o.cost > {budget} THEN w.g + 1 ELSE w.g END FROM w JOIN o ON o.k = w.k AND o.i = w.i + 1)"""


def _fold(rows: str, budget: int, tail: str) -> str:
    text = v.with_views(rows.replace("{", "{{").replace("}", "}}")) if "v_file" in rows else None
    ctes = text[len("WITH ") : text.index("\nSELECT")] + "," if text else ""
    return _FOLD.format(views=ctes, rows=rows, budget=budget) + tail


QUERIES["page_pack"] = lambda spark, d: retrieve.pack(v.v_file(spark, d).select("knowledge_id", "doc_id", F.char_length("content").cast("long").alias("cost")), ["knowledge_id"], "doc_id", "cost", V.PAGE_CHARS)
SQL["page_pack"] = _fold("\nSELECT knowledge_id AS k, doc_id, row_number() OVER (PARTITION BY knowledge_id ORDER BY doc_id) AS i, length(content) AS cost FROM v_file", V.PAGE_CHARS, " SELECT w.k AS knowledge_id, o.doc_id, w.cost, w.g AS page FROM w JOIN o ON o.k = w.k AND o.i = w.i")
QUERIES["chunk_lines"] = lambda spark, d: retrieve.chunks(v.v_file(spark, d).select("knowledge_id", "relative_path", "content"), 200)
SQL["chunk_lines"] = _fold("\nSELECT knowledge_id || '|' || relative_path AS k, unnest(range(1, len(s) + 1)) AS i, ceil((length(unnest(s)) + 1) / 4.0)::BIGINT AS cost FROM (SELECT knowledge_id, relative_path, string_split(content, chr(10)) AS s FROM v_file)", 200, " SELECT split_part(k, '|', 1) AS knowledge_id, split_part(k, '|', 2) AS relative_path, g AS chunk, min(i)::INT AS start_line, max(i)::INT AS end_line, sum(cost)::BIGINT AS tokens FROM w GROUP BY 1, 2, 3")

# --- statistics and usage -------------------------------------------------------------------------


@query("stats_commits", "SELECT knowledge_key, commit_hash, input_tokens::DOUBLE AS input_tokens, output_tokens::DOUBLE AS output_tokens, cost_usd::DOUBLE AS cost_usd FROM v_commit")
def stats_commits(spark, d):
    return stats.commit_stats(v.v_commit(spark, d))


@query("stats_rollup", "SELECT knowledge_key, count(*) AS n_commits, round(sum(input_tokens::DOUBLE), 6) AS input_tokens, round(sum(output_tokens::DOUBLE), 6) AS output_tokens, round(sum(cost_usd::DOUBLE), 6) AS cost_usd FROM v_commit GROUP BY ROLLUP (knowledge_key)")
def stats_rollup(spark, d):
    return stats.stats_rollup(v.v_commit(spark, d))


@query("usage_global", "SELECT count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(input_tokens + output_tokens)::BIGINT AS total_tokens FROM v_activity")
def usage_global(spark, d):
    return stats.global_usage(v.v_activity(spark, d))


@query("usage_monthly", "SELECT identity_id, year(created_at)::INT AS year, month(created_at)::INT AS month, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM v_activity GROUP BY 1, 2, 3")
def usage_monthly(spark, d):
    return stats.monthly_usage(v.v_activity(spark, d))


@query("activity_snippets", "SELECT event_id, substring(props, 1, 500) AS response FROM events")
def activity_snippets(spark, d):
    return v.base(spark, d, "events").select("event_id", F.substring("props", 1, 500).alias("response"))


@query("usage_hourly_window", "SELECT date_trunc('hour', created_at) AS hour_start, tool_name, count(*) AS calls, sum(output_tokens)::BIGINT AS output_tokens FROM v_activity GROUP BY 1, 2")
def usage_hourly_window(spark, d):
    return usage.hourly(v.v_activity(spark, d)).withColumn("hour_start", F.col("hour_start").cast("timestamp_ntz"))


@query("usage_session_window", """WITH g AS (SELECT *, CASE WHEN created_at < lag(created_at) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM v_activity WINDOW w AS (PARTITION BY identity_id ORDER BY created_at)),
s AS (SELECT *, sum(new) OVER (PARTITION BY identity_id ORDER BY created_at) AS n FROM g) SELECT identity_id, min(created_at) AS session_start, count(*) AS calls FROM s GROUP BY identity_id, n""")
def usage_session_window(spark, d):
    return usage.sessions(v.v_activity(spark, d)).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("token_usage_fresh", "SELECT sum(o_orderkey)::BIGINT AS total, sum(o_custkey)::BIGINT AS cached, greatest(0, sum(o_orderkey) - sum(o_custkey))::BIGINT AS fresh FROM orders")
def token_usage_fresh(spark, d):
    return stats.fresh_usage(v.base(spark, d, "orders").select(F.col("o_orderkey").alias("total"), F.col("o_custkey").alias("cached")))


@query("folder_rollup", "SELECT knowledge_id, regexp_replace(relative_path, '/[^/]*$', '') AS folder_path, count(*) AS file_count, sum(size_bytes)::BIGINT AS size_bytes, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM v_file GROUP BY 1, 2")
def folder_rollup(spark, d):
    return stats.folder_rollup(v.v_file(spark, d))


@query("folder_batches", """WITH r AS (SELECT knowledge_id, regexp_replace(relative_path, '/[^/]*$', '') AS folder_path, count(*) AS file_count FROM v_file GROUP BY 1, 2)
SELECT knowledge_id, folder_path, file_count, ((row_number() OVER (PARTITION BY knowledge_id ORDER BY folder_path) - 1) // 4)::INT AS batch FROM r WHERE file_count <= 3 UNION ALL SELECT knowledge_id, folder_path, file_count, NULL FROM r WHERE file_count > 3""")
def folder_batches(spark, d):
    return stats.folder_batches(stats.folder_rollup(v.v_file(spark, d)), 3, 4)


# --- versions and diffs -----------------------------------------------------------------------------

_DIFF = """diff AS (SELECT COALESCE(p.knowledge_id, n.knowledge_id) AS knowledge_id, COALESCE(p.relative_path, n.relative_path) AS relative_path,
 CASE WHEN p.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'deleted' WHEN p.sha <> n.sha THEN 'modified' ELSE 'unchanged' END AS status, p.sha AS old_sha, n.sha AS new_sha
 FROM v_snapshot_prev p FULL JOIN v_snapshot_next n ON p.knowledge_id = n.knowledge_id AND p.relative_path = n.relative_path)"""


def _diff(spark, d):
    return stats.snapshot_diff(v.v_snapshot_prev(spark, d), v.v_snapshot_next(spark, d))


@query("snapshot_diff", f"WITH {_DIFF} SELECT * FROM diff")
def snapshot_diff(spark, d):
    return _diff(spark, d)


@query("apply_diff", "SELECT * FROM v_snapshot_next")
def apply_diff(spark, d):
    return stats.apply_diff(v.v_snapshot_prev(spark, d), _diff(spark, d))


@query("affected_folders", f"WITH {_DIFF}, a AS (SELECT DISTINCT knowledge_id, regexp_replace(relative_path, '/[^/]*$', '') AS folder_path FROM diff WHERE status <> 'unchanged') SELECT *, length(folder_path)::INT AS length FROM a")
def affected_folders(spark, d):
    return stats.affected_folders(_diff(spark, d))


@query("name_status", """SELECT CASE CAST(doc_id % 5 AS INT) WHEN 1 THEN 'R' WHEN 3 THEN 'D' WHEN 4 THEN 'M' ELSE 'A' END AS status, CASE WHEN doc_id % 5 IN (1, 2) THEN concat('to/', relative_path) ELSE relative_path END AS path, CASE WHEN doc_id % 5 = 1 THEN relative_path END AS old_path FROM v_file WHERE doc_id % 11 <> 0""")
def name_status(spark, d):
    i, path, tab = F.col("doc_id"), F.col("relative_path"), F.lit("\t")
    two = lambda code: F.concat(F.lit(code), tab, path, tab, F.lit("to/"), path)
    line = F.when(i % 11 == 0, F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("X\t"), path))).when(i % 5 == 0, F.concat(F.lit("A\t"), path)).when(i % 5 == 1, two("R087")).when(i % 5 == 2, two("C100")).when(i % 5 == 3, F.concat(F.lit("D\t"), path)).otherwise(F.concat(F.lit("M\t"), path))
    return stats.parse_name_status(v.v_file(spark, d).select(line.alias("line")))


@query("commit_history", "SELECT knowledge_key, count(*) AS n_commits, arg_max(commit_hash, (committed_at, commit_hash)) AS head, string_agg(commit_hash, ',' ORDER BY committed_at, commit_hash) AS history FROM v_commit GROUP BY 1")
def commit_history(spark, d):
    return stats.commit_history(v.v_commit(spark, d))


# --- jobs and state -------------------------------------------------------------------------------------


@query("job_dequeue", "SELECT type, row_number() OVER (PARTITION BY type ORDER BY priority DESC, created_at, id)::INT AS position, id, knowledge_id, priority FROM v_job QUALIFY position <= 10")
def job_dequeue(spark, d):
    return stats.dequeue(v.v_job(spark, d))


@query("job_dedupe", "SELECT type, knowledge_id, arg_min(id, (created_at, id)) AS id FROM v_job GROUP BY 1, 2")
def job_dedupe(spark, d):
    return stats.live_jobs(v.v_job(spark, d))


@query("job_dead_letter", "SELECT type, count(*) AS dead, max(attempts) AS most_attempts FROM v_job WHERE attempts >= 3 GROUP BY 1")
def job_dead_letter(spark, d):
    return stats.dead_letters(v.v_job(spark, d))


@query("state_latest", "SELECT 'k' || o_custkey AS knowledge_id, arg_max(o_orderstatus, o_orderkey) AS state, max(o_orderkey) AS seq FROM orders GROUP BY o_custkey")
def state_latest(spark, d):
    rows = v.base(spark, d, "orders").select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("knowledge_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderkey").alias("seq"))
    return usage.latest_state(rows)


# --- scalars ------------------------------------------------------------------------------------------------


@query("path_functions", """SELECT doc_id, sha256(replace(relative_path, chr(92), '/')) AS meta_id, replace(relative_path, '/', '__SL__') AS encoded, CASE split_part(relative_path, '.', -1) WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'md' THEN 'markdown' ELSE 'unknown' END AS language,
concat_ws('/', 'src', split_part(relative_path, '/', 2)) AS top_two, split_part(relative_path, '/', 4) AS name, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END::BIGINT AS n_lines, ceil(length(content) / 4.0)::BIGINT AS tokens FROM v_file""")
def path_functions(spark, d):
    p = F.col("relative_path")
    return v.v_file(spark, d).select("doc_id", S.meta_id(p).alias("meta_id"), S.encode_meta_path(p).alias("encoded"), S.language_from_path(p).alias("language"), S.top_two_segments(p).alias("top_two"), S.basename(p).alias("name"), S.count_lines(F.col("content")).alias("n_lines"), S.token_len(F.col("content")).alias("tokens"))


@query("slugify", r"""SELECT p_partkey, regexp_replace(substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' -- ' || p_brand), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 80), '-$', '') AS slug FROM part""")
def slugify(spark, d):
    return v.base(spark, d, "part").select("p_partkey", S.slugify(F.concat("p_name", F.lit(" -- "), "p_brand")).alias("slug"))


@query("repo_name_from_url", "SELECT knowledge_id, repo_name AS name FROM v_knowledge")
def repo_name_from_url(spark, d):
    return v.v_knowledge(spark, d).select("knowledge_id", S.repo_name_from_url(F.col("source_url")).alias("name"))


@query("fixed_facts", """SELECT doc_id, sha256(sha) AS meta_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(relative_path) + 1), lambda i: ord(substr(relative_path, i, 1))::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS fnv,
CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false END AS yes, CASE WHEN doc_id % 4 <> 0 THEN concat('{"a":', CAST(doc_id AS VARCHAR), '}') END AS json, CASE WHEN doc_id % 2 = 0 THEN doc_id + 0.5::DOUBLE ELSE 0.0::DOUBLE END AS number, round(5 + least(1.0, (doc_id % 9) / 6.0) * 65, 6)::DOUBLE AS percent,
concat(replace(relative_path, '/', '__'), '_') AS slug, lower(split_part(relative_path, '.', -1)) AS ext, relative_path AS decoded FROM v_file""")
def fixed_facts(spark, d):
    """Scalar functions for which the reference has fixed values, over columns of files."""
    i, text, path = F.col("doc_id"), F.col("doc_id").cast("string"), F.col("relative_path")
    answer = F.when(i % 3 == 0, F.concat(F.lit(" yes, "), path)).when(i % 3 == 1, F.concat(F.lit("No: "), path)).otherwise(path)
    raw = F.when(i % 4 == 0, F.concat(F.lit("{"), text)).when(i % 4 == 1, F.concat(F.lit('```json\n{"a":'), text, F.lit("}\n```"))).otherwise(F.concat(F.lit('so: {"a":'), text, F.lit("} it is")))
    number = F.when(i % 2 == 0, F.concat(text, F.lit(".5 USD"))).otherwise(F.concat(F.lit("$"), text))
    return v.v_file(spark, d).select(
        "doc_id", S.meta_id(F.col("sha")).alias("meta_id"), S.fnv1a(path).alias("fnv"), S.yes_no(answer).alias("yes"), S.lenient_json(raw).alias("json"), S.parse_number(number).alias("number"), F.round(S.phase_percent(F.lit("file_analysis"), i % 9, F.lit(6)), 6).alias("percent"),
        S.file_slug(F.concat(F.lit("/"), path, F.lit("!"))).alias("slug"), F.regexp_replace(S.normalize_ext(F.element_at(F.split(path, r"\."), -1)), "^[.]", "").alias("ext"), S.decode_meta_path(S.encode_meta_path(path)).alias("decoded"),
    )


from . import deep, flows  # noqa: E402, F401  register their queries
