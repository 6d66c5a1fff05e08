"""Queries of ancestry, scored text, the store and its loads, admission in two passes and greedy groups, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import admission, ancestry, chains, pull, search, store, textindex
from ..operators.shared import shared_folder
from ..sources import bulk
from . import views as v
from .registry import query


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# --- histories with merges ----------------------------------------------------------------------

#: Two lanes a customer, merged by every fifth order and the one after it, across.
_HISTORY = """h0 AS (SELECT knowledge_key, commit_hash, lag(commit_hash) OVER w AS before, lag(commit_hash, 2) OVER w AS first, row_number() OVER w AS i, count(*) OVER (PARTITION BY knowledge_key) AS n FROM v_commit WINDOW w AS (PARTITION BY knowledge_key ORDER BY committed_at, commit_hash)),
h AS (SELECT commit_hash, first AS parent_hash FROM h0 UNION ALL SELECT commit_hash, before FROM h0 WHERE i % 5 IN (0, 1) AND before IS NOT NULL)"""
_UP = "up(start, commit_hash, depth) AS (SELECT commit_hash, commit_hash, 0 FROM h0 UNION SELECT up.start, h.parent_hash, up.depth + 1 FROM up JOIN h ON h.commit_hash = up.commit_hash WHERE h.parent_hash IS NOT NULL)"


def _history(spark, d):
    w = Window.partitionBy("knowledge_key").orderBy("committed_at", "commit_hash")
    rows = v.v_commit(spark, d).select("knowledge_key", "commit_hash", F.lag("commit_hash").over(w).alias("before"), F.lag("commit_hash", 2).over(w).alias("first"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("knowledge_key")).alias("n"))
    edges = rows.select("commit_hash", F.col("first").alias("parent_hash")).unionByName(rows.where("i % 5 IN (0, 1) AND before IS NOT NULL").select("commit_hash", F.col("before").alias("parent_hash")))
    return rows, ancestry.history(edges)


@query("history_ancestors", f"WITH RECURSIVE {_HISTORY}, {_UP} SELECT start, commit_hash, min(depth)::BIGINT AS depth FROM up GROUP BY 1, 2")
def history_ancestors(spark, d):
    rows, h = _history(spark, d)
    return h.ancestors(rows)


@query("history_generations", f"WITH RECURSIVE {_HISTORY}, {_UP} SELECT start AS commit_hash, max(depth)::BIGINT AS generation FROM up GROUP BY 1")
def history_generations(spark, d):
    return _history(spark, d)[1].generations()


@query("history_merge_bases", f"""WITH RECURSIVE {_HISTORY}, {_UP}, p AS (SELECT a.commit_hash AS a, b.commit_hash AS b FROM h0 a JOIN h0 b ON a.knowledge_key = b.knowledge_key AND a.i = a.n AND b.i = b.n - 1),
c AS (SELECT DISTINCT p.a, p.b, x.commit_hash FROM p JOIN up x ON x.start = p.a JOIN up y ON y.start = p.b AND y.commit_hash = x.commit_hash)
SELECT a, b, commit_hash AS base FROM c WHERE NOT EXISTS (SELECT 1 FROM c o JOIN h ON h.commit_hash = o.commit_hash WHERE o.a = c.a AND o.b = c.b AND h.parent_hash = c.commit_hash)""")
def history_merge_bases(spark, d):
    rows, h = _history(spark, d)
    side = lambda k, x: rows.where(F.col("i") == F.col("n") - k).select("knowledge_key", F.col("commit_hash").alias(x))
    return h.merge_bases(side(0, "a").join(side(1, "b"), "knowledge_key"))


@query("history_reachable", f"WITH RECURSIVE {_HISTORY}, {_UP}, p AS (SELECT a.commit_hash, b.commit_hash AS head FROM h0 a JOIN h0 b USING (knowledge_key) WHERE b.i = b.n) SELECT p.commit_hash, p.head, EXISTS (SELECT 1 FROM up WHERE up.start = p.head AND up.commit_hash = p.commit_hash) AS reachable FROM p")
def history_reachable(spark, d):
    rows, h = _history(spark, d)
    heads = rows.where("i = n").select("knowledge_key", F.col("commit_hash").alias("head"))
    return h.reachable(rows.join(heads, "knowledge_key").select("commit_hash", "head"))


# --- scored full text ---------------------------------------------------------------------------

_TERMS = ("the", "ing", "zebra", "o")


def _scored_sql(channel: str, text: str, terms: tuple, files: str = "v_file") -> str:
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""WITH d AS (SELECT knowledge_id, relative_path, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {files}),
t AS (SELECT knowledge_id, relative_path, len(w) AS length, unnest(w) AS word FROM d),
s AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
f AS (SELECT knowledge_id, relative_path, length, word, count(*) AS tf FROM t GROUP BY ALL),
g AS (SELECT word, count(*) AS df FROM f GROUP BY word),
p AS (SELECT q.term, knowledge_id, relative_path, max(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) * ln(1 + (n - df + 0.5) / (df + 0.5))) AS part
      FROM f JOIN g USING (word) JOIN (VALUES {values}) q(term) ON contains(word, q.term), s GROUP BY ALL)
SELECT '{channel}' AS channel, knowledge_id, relative_path, round(sum(part), 6) AS score FROM p GROUP BY ALL ORDER BY score DESC, relative_path, knowledge_id LIMIT 100"""


def _stored(spark, index: textindex.TextIndex) -> textindex.TextIndex:
    at = _folder(spark)
    index.save(at)
    return textindex.load(spark, at)


@query("text_search_purpose", _scored_sql("purpose", "concat_ws(' ', purpose, summary)", _TERMS))
def text_search_purpose(spark, d):
    return textindex.search(_stored(spark, textindex.build(v.v_file(spark, d))), "purpose", " ".join(_TERMS))


@query("text_search_context", _scored_sql("businessContext", "business_context", ("tion", "e")))
def text_search_context(spark, d):
    return textindex.search(_stored(spark, textindex.build(v.v_file(spark, d))), "businessContext", "tion e")


@query("text_search_replaced", _scored_sql("purpose", "concat_ws(' ', purpose, summary)", _TERMS, "(SELECT * REPLACE (CASE WHEN doc_id % 4 = 0 THEN business_context ELSE purpose END AS purpose) FROM v_file WHERE doc_id % 5 <> 1)"))
def text_search_replaced(spark, d):
    f = v.v_file(spark, d)
    index = textindex.build(f)
    new = f.where("doc_id % 4 = 0 AND doc_id % 5 <> 1").withColumn("purpose", F.col("business_context"))
    return textindex.search(_stored(spark, textindex.replace(index, new, f.where("doc_id % 5 = 1"))), "purpose", " ".join(_TERMS))


# --- the store ----------------------------------------------------------------------------------

_ANALYSED = """(SELECT * EXCLUDE (doc_id, purpose, summary, language), CASE WHEN doc_id % 4 = 0 THEN 'local' ELSE concat('org', CAST(doc_id % 2 AS VARCHAR)) END AS org_id,
  regexp_extract_all(lower(CASE WHEN doc_id % 5 = 0 THEN summary ELSE purpose END), '([a-z]{5,})', 1) AS keywords, regexp_extract_all(summary, '([A-Z][a-z]{6,})', 1) AS classes, regexp_extract_all(summary, '([a-z]{9,})', 1) AS functions,
  [concat(' ', language, ' '), '', NULL] AS system_capabilities, [knowledge_id] AS business_entities, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'in' WHEN 1 THEN ' ' END AS data_flow_direction
  FROM (SELECT f.* REPLACE (CASE WHEN f.doc_id % 8 = 3 THEN concat('moved/', f.relative_path) ELSE f.relative_path END AS relative_path) FROM v_file f WHERE doc_id % 9 <> 0))"""
_VALUES = f"""a AS {_ANALYSED},
m AS (SELECT DISTINCT type, trim(value) AS value, org_id, knowledge_id, relative_path FROM (
  SELECT 'HAS_KEYWORD' AS type, unnest(keywords) AS value, org_id, knowledge_id, relative_path FROM a UNION ALL SELECT 'HAS_CLASS', unnest(classes), org_id, knowledge_id, relative_path FROM a
  UNION ALL SELECT 'HAS_FUNCTION', unnest(functions), org_id, knowledge_id, relative_path FROM a UNION ALL SELECT 'HAS_SYSTEM_CAPABILITY', unnest(system_capabilities), org_id, knowledge_id, relative_path FROM a
  UNION ALL SELECT 'HAS_BUSINESS_ENTITY', unnest(business_entities), org_id, knowledge_id, relative_path FROM a UNION ALL SELECT 'HAS_DATA_FLOW_DIRECTION', data_flow_direction, org_id, knowledge_id, relative_path FROM a) WHERE trim(value) <> '')"""


def _analysed(spark, d, moved: bool):
    """Analysed files: before a pull, or after it with some files moved, changed, gone and new."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    f = v.v_file(spark, d).where("doc_id % 9 <> 0" if moved else "doc_id % 10 <> 0")
    path, changed = F.col("relative_path"), i % 5 == 0 if moved else F.lit(False)
    if moved:
        path = F.when(i % 8 == 3, F.concat(F.lit("moved/"), path)).otherwise(path)
    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return f.select(
        "knowledge_id", path.alias("relative_path"), F.when(changed, F.concat("sha", F.lit("x"))).otherwise(F.col("sha")).alias("sha"), F.when(i % 4 != 0, F.concat(F.lit("org"), (i % 2).cast("string"))).alias("org_id"),
        found(F.lower(F.when(changed, F.col("summary")).otherwise(F.col("purpose"))), "([a-z]{5,})").alias("keywords"), found(F.col("summary"), "([A-Z][a-z]{6,})").alias("classes"), found(F.col("summary"), "([a-z]{9,})").alias("functions"),
        F.array(F.concat(F.lit(" "), "language", F.lit(" ")), F.lit(""), none).alias("system_capabilities"), F.array("knowledge_id").alias("business_entities"), F.when(i % 3 == 0, "in").when(i % 3 == 1, " ").alias("data_flow_direction"),
    )


def _pulled(spark, d):
    old, new = _analysed(spark, d, False), _analysed(spark, d, True)
    return store.pull(store.build(old), pull.diff(old, new), new)[0]


@query("store_pull_counters", f"WITH {_VALUES} SELECT value AS keyword, type, org_id, count(*)::BIGINT AS total_frequency, count(*)::BIGINT AS file_count FROM m GROUP BY ALL")
def store_pull_counters(spark, d):
    return _pulled(spark, d).counter


@query("store_pull_mirror", f"WITH {_VALUES} SELECT value AS keyword, type, org_id, knowledge_id, relative_path, 1::BIGINT AS frequency FROM m")
def store_pull_mirror(spark, d):
    return _pulled(spark, d).mirror


@query("store_pull_entities", f"WITH {_VALUES} SELECT type AS edge_type, value AS dst, count(*)::BIGINT AS n_files FROM m WHERE type IN ('HAS_KEYWORD', 'HAS_CLASS', 'HAS_FUNCTION') GROUP BY ALL")
def store_pull_entities(spark, d):
    return _pulled(spark, d).entity


@query("store_pull_folders", f"""WITH a AS {_ANALYSED}, p AS (SELECT knowledge_id, string_split(relative_path, '/') AS s FROM a),
u AS (SELECT knowledge_id, len(s) AS n, unnest(range(len(s))) AS i, s FROM p)
SELECT knowledge_id, array_to_string(s[1:i], '/') AS folder_path, any_value(i)::INT AS level, any_value(CASE WHEN i > 1 THEN array_to_string(s[1:i - 1], '/') END) AS parent_path, '' AS summary, count(*) FILTER (i = n - 1)::BIGINT AS direct_files, count(*)::BIGINT AS all_files
FROM u GROUP BY 1, 2""")
def store_pull_folders(spark, d):
    return _pulled(spark, d).folder


@query("store_pull_swept", f"""WITH {_VALUES}, b AS (SELECT DISTINCT * FROM (SELECT 'HAS_KEYWORD' AS edge_type, unnest(regexp_extract_all(lower(purpose), '([a-z]{{5,}})', 1)) AS dst FROM v_file WHERE doc_id % 10 <> 0
UNION ALL SELECT 'HAS_CLASS', unnest(regexp_extract_all(summary, '([A-Z][a-z]{{6,}})', 1)) FROM v_file WHERE doc_id % 10 <> 0 UNION ALL SELECT 'HAS_FUNCTION', unnest(regexp_extract_all(summary, '([a-z]{{9,}})', 1)) FROM v_file WHERE doc_id % 10 <> 0))
SELECT edge_type, dst FROM b WHERE (edge_type, dst) NOT IN (SELECT (type, value) FROM m)""")
def store_pull_swept(spark, d):
    old, new = _analysed(spark, d, False), _analysed(spark, d, True)
    before = store.build(old)
    return store.orphans(before, store.pull(before, pull.diff(old, new), new)[0])


# --- bulk loads ---------------------------------------------------------------------------------


@query("bulk_file_edges", "WITH e AS (SELECT knowledge_id, relative_path, edge_type, count(*) AS n FROM v_edge GROUP BY ALL) SELECT f.knowledge_id, f.relative_path, f.language, COALESCE(sum(n), 0)::BIGINT AS n_edges, count(edge_type)::BIGINT AS n_kinds FROM v_file f LEFT JOIN e USING (knowledge_id, relative_path) GROUP BY ALL")
def bulk_file_edges(spark, d):
    """Files and their edges from bucketed tables: grouped and joined without an exchange."""
    root = _folder(spark)
    bulk.load_tables(spark, root, {"file": v.v_file(spark, d).select(*search.ID, "language", "sha"), "edge": v.v_edges(spark, d)}, int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = bulk.open_tables(spark, root)
    n = t["edge"].groupBy(*search.ID).agg(F.count("*").alias("n_edges"), F.countDistinct("edge_type").alias("n_kinds"))
    out = t["file"].join(n.hint("merge"), search.ID, "left")
    return out.select(*search.ID, "language", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("n_kinds", F.lit(0)).alias("n_kinds"))


# --- admission ----------------------------------------------------------------------------------

_OPEN = "(SELECT concat('src/', language, '/doc_', CAST(doc_id AS VARCHAR), CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN '.dat' WHEN 1 THEN '' WHEN 2 THEN '.ts' ELSE '.lock' END) AS relative_path, sha, content FROM v_file)"


def _open(spark, d):
    i = F.col("doc_id")
    end = F.when(i % 4 == 0, ".dat").when(i % 4 == 1, "").when(i % 4 == 2, ".ts").otherwise(".lock")
    return v.v_file(spark, d).select(F.concat(F.lit("src/"), "language", F.lit("/doc_"), i.cast("string"), end).alias("relative_path"), "sha", "content")


def by_length(rows: list[dict]) -> list[bool | None]:
    """A verdict for tests: none for one content in five, else whether its length is even."""
    n = [len(r["content"]) for r in rows]
    return [None if x % 5 == 0 else x % 2 == 0 for x in n]


@query("admission_two_passes", f"""SELECT relative_path, sha, CASE WHEN relative_path LIKE '%.lock' THEN 'reject-static' WHEN relative_path LIKE '%.ts' THEN 'accept' WHEN least(length(content), 4000) % 5 <> 0 AND least(length(content), 4000) % 2 = 0 THEN 'accept-llm' ELSE 'reject-llm' END AS decision FROM {_OPEN}""")
def admission_two_passes(spark, d):
    return admission.two_passes(_open(spark, d), by_length, f"{_folder(spark)}").drop("content")


@query("admission_outcomes", f"""WITH d AS (SELECT CASE WHEN relative_path LIKE '%.lock' THEN 'reject-static' WHEN relative_path LIKE '%.ts' THEN 'accept' WHEN least(length(content), 4000) % 5 <> 0 AND least(length(content), 4000) % 2 = 0 THEN 'accept-llm' ELSE 'reject-llm' END AS outcome FROM {_OPEN})
SELECT o.outcome, count(d.outcome)::BIGINT AS n FROM (VALUES ('accept'), ('accept-llm'), ('reject-static'), ('reject-llm'), ('oversized'), ('binary')) o(outcome) LEFT JOIN d USING (outcome) GROUP BY 1""")
def admission_outcomes(spark, d):
    return admission.outcomes(admission.two_passes(_open(spark, d), by_length))


# --- greedy groups ------------------------------------------------------------------------------

_GREEDY = """WITH RECURSIVE r AS (SELECT {key} AS k, {name} AS name, {cost} AS c, row_number() OVER (PARTITION BY {key} ORDER BY {name}) AS pos FROM {rows}),
g(k, name, c, pos, grp, total) AS (SELECT k, name, c, pos, 1, c FROM r WHERE pos = 1 UNION ALL
SELECT r.k, r.name, r.c, r.pos, CASE WHEN g.total + r.c > {budget} THEN g.grp + 1 ELSE g.grp END, CASE WHEN g.total + r.c > {budget} THEN r.c ELSE g.total + r.c END FROM g JOIN r ON r.k = g.k AND r.pos = g.pos + 1)"""


@query("pack_entries", _GREEDY.format(key="knowledge_id", name="relative_path", cost="length(summary)", rows="v_file", budget=3000) + " SELECT k AS knowledge_id, name AS relative_path, grp::BIGINT AS page FROM g")
def pack_entries(spark, d):
    out = chains.greedy(v.v_file(spark, d).select(*search.ID, F.char_length("summary").alias("c")), ["knowledge_id"], ["relative_path"], F.col("c"), 3000)
    return out.select(*search.ID, F.col("group").alias("page"))


@query("batch_folders", "WITH RECURSIVE f AS (SELECT knowledge_id, regexp_replace(relative_path, '/[^/]*$', '') AS folder, sum(ceil(length(content) / 4.0))::BIGINT AS tokens FROM v_file GROUP BY ALL), " + _GREEDY.format(key="knowledge_id", name="folder", cost="tokens", rows="f", budget=6000).removeprefix("WITH RECURSIVE ") + " SELECT k AS knowledge_id, grp::BIGINT AS batch, count(*)::BIGINT AS n_folders, sum(c)::BIGINT AS tokens FROM g GROUP BY ALL")
def batch_folders(spark, d):
    from ..functions import scalars as S

    folders = v.v_file(spark, d).groupBy("knowledge_id", S.direct_folder(F.col("relative_path")).alias("folder")).agg(F.sum(S.token_len(F.col("content"))).alias("tokens"))
    out = chains.greedy(folders, ["knowledge_id"], ["folder"], F.col("tokens"), 6000)
    return out.groupBy("knowledge_id", F.col("group").alias("batch")).agg(F.count("*").alias("n_folders"), F.sum("tokens").alias("tokens"))


_PROGRESS = "SELECT concat('r', CAST(user_id % 5 AS VARCHAR)) AS run_id, event_id * 40 AS at_ms, event_id AS done, 777::BIGINT AS total FROM events"


@query("progress_writes", f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY at_ms, done) AS pos FROM ({_PROGRESS})),
w(run_id, pos, last, stored) AS (SELECT run_id, pos, at_ms, true FROM p WHERE pos = 1 UNION ALL
SELECT p.run_id, p.pos, CASE WHEN p.at_ms - w.last > 250 OR p.done >= p.total THEN p.at_ms ELSE w.last END, p.at_ms - w.last > 250 OR p.done >= p.total FROM w JOIN p ON p.run_id = w.run_id AND p.pos = w.pos + 1)
SELECT run_id, at_ms, done, total FROM p JOIN w USING (run_id, pos) WHERE stored""")
def progress_writes(spark, d):
    rows = v.base(spark, d, "events").select(F.concat(F.lit("r"), F.coalesce((F.col("user_id") % 5).cast("string"), F.lit(""))).alias("run_id"), (F.col("event_id") * 40).alias("at_ms"), F.col("event_id").alias("done"), F.lit(777).cast("long").alias("total"))
    return chains.throttled(rows)


# --- the whole answer ---------------------------------------------------------------------------

_ANSWER = "attion eriner"


def _answer_sql(page: int, size: int) -> str:
    from .catalogue import _fused_sql

    return f"""WITH {_fused_sql(search.terms_of(_ANSWER))}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, relative_path, knowledge_id) AS rank, count(*) OVER () AS total FROM fused),
u AS (SELECT string_agg(DISTINCT channel, ',' ORDER BY channel) AS used FROM hits),
p AS (SELECT r.*, COALESCE(k.repo_name, '') AS repo_name, array_to_string(list_filter(string_split(relative_path, '/'), lambda s: s <> '')[1:2], '/') AS folder, used FROM u, r LEFT JOIN v_knowledge k USING (knowledge_id) WHERE rank BETWEEN {(page - 1) * size + 1} AND {page * size}),
c AS (SELECT DISTINCT rank, p.relative_path, kind, slug, total, used FROM p JOIN v_concept_edge e ON e.knowledge_id = p.knowledge_id AND e.relative_path = p.relative_path WHERE kind IN ('role', 'pattern', 'domain')),
k AS (SELECT kind, slug, count(DISTINCT rank) AS n, array_to_string(list_sort(list(DISTINCT relative_path))[1:5], ',') AS paths, any_value(total) AS total, any_value(used) AS used FROM c GROUP BY 1, 2 HAVING count(DISTINCT rank) >= 2 ORDER BY n DESC, kind, slug LIMIT 20)
SELECT 'hit' AS section, rank::INT AS pos, knowledge_id, relative_path, score, channels, repo_name AS name, NULL::VARCHAR AS kind, NULL::BIGINT AS n, total::BIGINT AS total_matches, used AS channels_used FROM p
UNION ALL SELECT 'repo', row_number() OVER (ORDER BY min(rank)), NULL, NULL, NULL, NULL, repo_name, NULL, count(*), any_value(total), any_value(used) FROM p WHERE repo_name <> '' GROUP BY repo_name
UNION ALL SELECT 'folder', row_number() OVER (ORDER BY count(*) DESC, folder, knowledge_id), knowledge_id, arg_min(relative_path, rank), NULL, NULL, folder, NULL, count(*), any_value(total), any_value(used) FROM p GROUP BY knowledge_id, folder HAVING count(*) >= 2
UNION ALL SELECT 'concept', row_number() OVER (ORDER BY n DESC, kind, slug), NULL, paths, NULL, NULL, slug, kind, n, total, used FROM k"""


def _register_answer(name: str, page: int, size: int) -> None:
    @query(name, _answer_sql(page, size))
    def run(spark, d):
        from ..operators import answer

        return answer.answer(v.v_file(spark, d), v.v_edges(spark, d), v.v_knowledge(spark, d), _ANSWER, page=page, size=size, concepts=v.v_concept_edge(spark, d))


_register_answer("search_answer", 1, 30)
_register_answer("search_answer_page2", 2, 25)


# --- artifacts ----------------------------------------------------------------------------------


def _folder_docs(spark, d):
    """Folder summaries as an analysis leaves them: some malformed, some with fields of other types."""
    i, keys = F.col("doc_id"), F.regexp_extract_all("purpose", F.lit("([a-z]{5,})"), F.lit(1))
    whole = F.to_json(F.struct(F.col("relative_path").alias("folderPath"), F.col("purpose"), F.lit("").alias("summary"), keys.alias("keywords"), F.lit("text").alias("classes"), F.array(F.lit("f"), F.lit("")).alias("functions")))
    odd = F.to_json(F.struct(F.col("relative_path").alias("folderPath"), i.alias("purpose"), F.array(F.lit(1), F.lit(2)).alias("keywords")))
    doc = F.when(i % 7 == 0, F.concat(F.lit('{"folderPath": "'), "relative_path")).when(i % 7 == 1, "[1, 2]").when(i % 7 == 2, odd).otherwise(whole)
    return v.v_file(spark, d).select("knowledge_id", doc.alias("doc"))


def _written(spark, rows):
    from ..sources import artifacts

    at = _folder(spark)
    artifacts.write_documents(rows, at, ["knowledge_id"])
    return artifacts.read_documents(spark, at)


@query("artifact_folders", """SELECT knowledge_id, relative_path AS folder_path, CASE WHEN doc_id % 7 = 2 THEN '' ELSE purpose END AS purpose, CASE WHEN doc_id % 7 = 2 THEN '' ELSE array_to_string(regexp_extract_all(purpose, '([a-z]{5,})', 1), ',') END AS keywords, '' AS classes, CASE WHEN doc_id % 7 = 2 THEN '' ELSE 'f' END AS functions FROM v_file WHERE doc_id % 7 NOT IN (0, 1)""")
def artifact_folders(spark, d):
    from ..sources import artifacts

    out = artifacts.folder_summaries(_written(spark, _folder_docs(spark, d)))
    return out.select("knowledge_id", "folder_path", "purpose", *[F.array_join(c, ",").alias(c) for c in ("keywords", "classes", "functions")])


@query("artifact_health", "SELECT count(*) FILTER (doc_id % 7 NOT IN (0, 1)) AS n_read, count(*) FILTER (doc_id % 7 IN (0, 1)) AS n_malformed FROM v_file")
def artifact_health(spark, d):
    from ..sources import artifacts

    return artifacts.health(_written(spark, _folder_docs(spark, d)))


@query("artifact_enrichment", """WITH f AS (SELECT knowledge_id, unnest(regexp_extract_all(purpose, '([a-z]{5,})', 1)) AS keyword FROM v_file),
c AS (SELECT concat('o', CAST(updated_seq % 3 AS VARCHAR)) AS org_id, keyword, count(*) AS n FROM f JOIN v_knowledge USING (knowledge_id) GROUP BY ALL),
t AS (SELECT org_id, string_agg(concat(keyword, '=', CAST(n AS VARCHAR)), ',' ORDER BY n DESC, keyword) AS top FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY n DESC, keyword) <= 50) GROUP BY 1)
SELECT knowledge_id, CASE WHEN updated_seq % 4 = 3 THEN '' ELSE repo_name END AS repo_architecture, CASE WHEN updated_seq % 4 = 3 THEN '' ELSE concat('s', branch) END AS subsystems, COALESCE(top, '') AS top_keywords, 0 AS n_effects FROM v_knowledge LEFT JOIN t ON t.org_id = concat('o', CAST(updated_seq % 3 AS VARCHAR))""")
def artifact_enrichment(spark, d):
    """Envelopes and bare records of repository summaries, and registries of an organisation, written and merged."""
    from ..sources import artifacts

    k = v.v_knowledge(spark, d).withColumn("org_id", F.concat(F.lit("o"), (F.col("updated_seq") % 3).cast("string")))
    system = F.array(F.struct(F.concat(F.lit("s"), "branch").alias("name"), F.lit(1).alias("responsibility")), F.struct(F.lit("").alias("name"), F.lit(2).alias("responsibility")))
    record = F.struct(F.col("repo_name").alias("architecture"), system.alias("majorSubsystems"))
    q = F.col("updated_seq") % 4
    doc = F.when(q == 0, F.to_json(F.struct(record.alias("repoSummary")))).when(q == 3, "nonsense").otherwise(F.to_json(record))
    summaries = artifacts.repo_summaries(_written(spark, k.select("knowledge_id", doc.alias("doc"))))
    words = v.v_file(spark, d).select("knowledge_id", F.explode(F.regexp_extract_all("purpose", F.lit("([a-z]{5,})"), F.lit(1))).alias("keyword"))
    counts = words.join(k.select("knowledge_id", "org_id"), "knowledge_id").groupBy("org_id", "keyword").agg(F.count("*").alias("n"))
    doc = F.to_json(F.map_concat(F.map_from_entries(F.collect_list(F.struct("keyword", F.col("n").cast("string")))), F.create_map(F.lit("not counted"), F.lit("many"))))
    lines = counts.groupBy("org_id").agg(F.regexp_replace(doc, r'":"(\d+)"', '":$1').alias("doc")).select("org_id", F.lit("keywords").alias("registry"), "doc")
    at = _folder(spark)
    artifacts.write_documents(lines, at, ["org_id", "registry"])
    registries = artifacts.registry_counts(artifacts.read_documents(spark, at), ["org_id", "registry"])
    out = artifacts.enrichment(k.select("knowledge_id", "org_id"), summaries, registries)
    top = F.array_join(F.transform("top_keywords", lambda x: F.concat_ws("=", x["keyword"], x["count"].cast("long").cast("string"))), ",")
    return out.select("knowledge_id", "repo_architecture", F.array_join(F.transform("major_subsystems", lambda x: x["name"]), ",").alias("subsystems"), top.alias("top_keywords"), F.size("side_effects").alias("n_effects"))


# --- retrieved answers --------------------------------------------------------------------------


@query("content_range", """WITH f AS (SELECT knowledge_id, relative_path, regexp_split_to_array(content, '\\r?\\n') AS s FROM v_file),
l AS (SELECT knowledge_id, relative_path, len(s) AS total, i, s[i] AS line, length(CAST(i AS VARCHAR)) + 3 + length(s[i]) AS cost FROM (SELECT *, unnest(range(2, greatest(2, least(len(s), 40)) + 1)) AS i FROM f) WHERE i <= len(s)),
u AS (SELECT *, sum(cost) OVER (PARTITION BY knowledge_id, relative_path ORDER BY i) AS used FROM l),
k AS (SELECT *, min(CASE WHEN used > 800 AND i > 2 THEN i END) OVER (PARTITION BY knowledge_id, relative_path) AS stop FROM u),
t AS (SELECT knowledge_id, relative_path, max(i) AS last, length(CAST(max(i) AS VARCHAR)) AS width FROM k WHERE i < COALESCE(stop, 1000000) GROUP BY 1, 2),
c AS (SELECT k.knowledge_id, k.relative_path, string_agg(lpad(CAST(i AS VARCHAR), CAST(width AS INT), ' ') || ' | ' || line, chr(10) ORDER BY i) AS content FROM k JOIN t USING (knowledge_id, relative_path) WHERE i <= last GROUP BY 1, 2)
SELECT f.knowledge_id, f.relative_path, len(s)::INT AS total_lines, 2 AS from_line, COALESCE(last, 1)::INT AS to_line, COALESCE(last, 1) < greatest(2, least(len(s), 40)) AS truncated, COALESCE(last, 1) < len(s) AS has_more, CASE WHEN COALESCE(last, 1) < len(s) THEN COALESCE(last, 1) + 1 END::INT AS next_from_line, COALESCE(content, '') AS content
FROM f LEFT JOIN t USING (knowledge_id, relative_path) LEFT JOIN c USING (knowledge_id, relative_path)""")
def content_range(spark, d):
    from ..operators import retrieve

    return retrieve.content_range(v.v_file(spark, d), 2, 40, 200)


_ASKED = "(SELECT knowledge_id, CASE WHEN doc_id % 6 = 0 THEN concat('gone/', relative_path) ELSE relative_path END AS relative_path, doc_id AS ord FROM v_file WHERE doc_id % 2 = 0)"


def _asked(spark, d):
    path = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("gone/"), "relative_path")).otherwise(F.col("relative_path"))
    return v.v_file(spark, d).where("doc_id % 2 = 0").select("knowledge_id", path.alias("relative_path"), F.col("doc_id").alias("ord"))


@query("bulk_answer", f"""WITH m AS (SELECT knowledge_id, relative_path, len(list_filter(regexp_split_to_array(content, '\\r?\\n'), lambda x: contains(lower(x), 'tion')))::INT AS n FROM v_file),
r AS (SELECT a.*, n, CASE WHEN n IS NULL THEN 'errored' WHEN n = 0 THEN 'no_match' ELSE 'matched' END AS section FROM {_ASKED} a LEFT JOIN m USING (knowledge_id, relative_path))
SELECT knowledge_id, relative_path, section, row_number() OVER (PARTITION BY knowledge_id, section ORDER BY CASE WHEN section = 'matched' THEN -n ELSE 0 END, ord)::INT AS pos, COALESCE(n, 0)::INT AS match_count, CASE WHEN section = 'matched' THEN n END AS n_contexts FROM r""")
def bulk_answer(spark, d):
    from ..operators import retrieve

    out = retrieve.bulk_answer(v.v_file(spark, d), _asked(spark, d), "tion", 2)
    return out.select(*search.ID, "section", "pos", "match_count", F.when(F.col("matches").isNotNull(), F.size(F.filter("matches", lambda m: m["context"].contains(m["text"])))).alias("n_contexts"))


@query("metadata_answer", f"""WITH e AS (SELECT knowledge_id, relative_path, string_agg(DISTINCT dst, ',' ORDER BY dst) FILTER (edge_type = 'HAS_KEYWORD') AS keywords, count(DISTINCT dst) FILTER (edge_type = 'HAS_FUNCTION') AS n_functions FROM v_edge GROUP BY 1, 2)
SELECT ord, a.knowledge_id, a.relative_path, f.sha IS NOT NULL AS found, language, size_bytes, summary, CASE WHEN f.sha IS NOT NULL THEN COALESCE(keywords, '') END AS keywords, CASE WHEN f.sha IS NOT NULL THEN COALESCE(n_functions, 0) END::INT AS n_functions
FROM {_ASKED} a LEFT JOIN v_file f USING (knowledge_id, relative_path) LEFT JOIN e USING (knowledge_id, relative_path)""")
def metadata_answer(spark, d):
    out = search.metadata_answer(v.v_file(spark, d), v.v_edges(spark, d), _asked(spark, d))
    return out.select("ord", *search.ID, "found", "language", "size_bytes", "summary", F.array_join("keywords", ",").alias("keywords"), F.size("functions").alias("n_functions"))


@query("lookup_answer", """WITH n AS (SELECT DISTINCT dst FROM v_edge WHERE edge_type = 'HAS_KEYWORD' AND contains(lower(dst), 'er') ORDER BY dst LIMIT 20),
r AS (SELECT DISTINCT e.dst, e.knowledge_id, e.relative_path FROM v_edge e JOIN n USING (dst) WHERE edge_type = 'HAS_KEYWORD'),
k AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY knowledge_id, relative_path) AS nth FROM r)
SELECT k.dst AS name, k.knowledge_id, k.relative_path, repo_name, nth::INT AS nth, f.purpose, f.summary FROM k JOIN v_knowledge USING (knowledge_id) JOIN v_file f ON f.knowledge_id = k.knowledge_id AND f.relative_path = k.relative_path WHERE nth <= 20""")
def lookup_answer(spark, d):
    f = v.v_file(spark, d)
    found = search.keyword_lookup(v.v_edge(spark, d), v.v_knowledge(spark, d), "er")
    return search.lookup_answer(found, f)


# --- plugged analysis, statistics, archives -------------------------------------------------------


def count_words(row: dict) -> str | None:
    """An analysis for tests: none of every fifth length, else how many blanks a content has."""
    n = len(row["content"])
    return None if n % 5 == 0 else str(row["content"].count(" "))


@query("plugged_analysis", "SELECT knowledge_id, relative_path, CASE WHEN length(content) % 5 <> 0 THEN CAST(length(content) - length(replace(content, ' ', '')) AS VARCHAR) END AS answer, length(content) % 5 <> 0 AS cached FROM v_file")
def plugged_analysis(spark, d):
    """Two runs over one log: the second finds what the first was answered."""
    from ..operators import plugged

    log, rows = _folder(spark), v.v_file(spark, d).select(*search.ID, F.col("sha").alias("cache_key"), "content")
    plugged.answered(rows, count_words, log).count()
    return plugged.answered(rows, count_words, log).select(*search.ID, "answer", "cached")


def merge_counts(records: list[str]) -> str:
    """A roll-up for tests: sums of numbers and the least name."""
    parts = [r.split("|") for r in records]
    return f"{sum(int(p[0]) for p in parts)}|{min(p[1] for p in parts)}"


@query("rolled_folders", "SELECT knowledge_id, regexp_replace(relative_path, '/[^/]*$', '') AS folder_path, count(*) AS n, concat(CAST(sum(length(content)) AS VARCHAR), '|', min(relative_path)) AS record FROM v_file GROUP BY 1, 2")
def rolled_folders(spark, d):
    from ..functions import scalars as S
    from ..operators import plugged

    rows = v.v_file(spark, d).select("knowledge_id", S.direct_folder(F.col("relative_path")).alias("folder_path"), "relative_path", F.concat_ws("|", F.char_length("content").cast("string"), "relative_path").alias("record"))
    return plugged.rolled_up(rows, ["knowledge_id", "folder_path"], "relative_path", "record", merge_counts, 4)


@query("stats_repos", """WITH e AS (SELECT knowledge_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE size_bytes END AS input_tokens, 2.5 AS output_tokens FROM v_file WHERE doc_id % 7 <> 0),
s AS (SELECT knowledge_id, count(*) AS n_commits, sum(input_tokens)::DOUBLE AS input_tokens, sum(output_tokens)::DOUBLE AS output_tokens FROM e GROUP BY 1),
r AS (SELECT k.knowledge_id, repo_name, 'GITHUB' AS type, 1 AS n_repos, (SELECT count(*) FROM v_file f WHERE f.knowledge_id = k.knowledge_id) AS file_count, COALESCE(n_commits, 0) AS n_commits, COALESCE(input_tokens, 0) AS input_tokens, COALESCE(output_tokens, 0) AS output_tokens, 0.0::DOUBLE AS cost_usd FROM v_knowledge k LEFT JOIN s USING (knowledge_id))
SELECT * FROM r UNION ALL SELECT NULL, NULL, NULL, count(*), sum(file_count)::BIGINT, sum(n_commits)::BIGINT, sum(input_tokens), sum(output_tokens), 0.0::DOUBLE FROM r""")
def stats_repos(spark, d):
    """Commit entries out of each source's JSON: some have a hash that is no text, some amounts that are none."""
    from ..operators import stats

    i, f = F.col("doc_id"), v.v_file(spark, d)
    entry = F.when(i % 7 == 0, F.to_json(F.struct(i.alias("hash")))).when(i % 5 == 0, F.to_json(F.struct(F.col("sha").alias("hash"), F.col("size_bytes").alias("inputTokens"), F.lit("2.5x").alias("outputTokens")))).otherwise(F.to_json(F.struct(F.col("sha").alias("hash"), F.col("size_bytes").cast("string").alias("inputTokens"), F.lit("2.5").alias("outputTokens"), F.lit("-").alias("costUsd"))))
    source = f.groupBy("knowledge_id").agg(F.concat(F.lit('{"commitHashes":['), F.array_join(F.collect_list(entry), ","), F.lit(',null,"text"]}')).alias("source"))
    return stats.repo_stats(v.v_knowledge(spark, d), stats.commit_entries(source), f)


@query("archive_push_remove", "SELECT knowledge_id, relative_path, CASE WHEN doc_id % 3 = 1 THEN 'new' ELSE sha END AS sha, 'c1' AS commit_hash FROM v_file WHERE doc_id % 3 <> 0 UNION ALL SELECT knowledge_id, relative_path, sha, 'c0' FROM v_file")
def archive_push_remove(spark, d):
    f = v.v_file(spark, d)
    rows = f.select(*search.ID, "sha")
    archive = rows.withColumn("commit_hash", F.lit("c0")).unionByName(rows.withColumn("commit_hash", F.lit("c1")))
    pushed = pull.push_archive(archive, "c1", f.where("doc_id % 3 = 1").select(*search.ID, F.lit("new").alias("sha")))
    return pull.remove_from_archive(pushed, "c1", f.where("doc_id % 3 = 0").select(*search.ID))


# --- edges of enrichment --------------------------------------------------------------------------

_CONTRACTS = "(SELECT DISTINCT 'o' AS org_id, knowledge_id, concat('api-', CAST(doc_id % 3 AS VARCHAR)) AS slug FROM v_file)"
_NAMED = """(SELECT 'o' AS org_id, knowledge_id, CASE WHEN doc_id % 11 = 0 THEN 'gone' ELSE relative_path END AS relative_path, concat('api-', CAST((doc_id + t) % 4 AS VARCHAR)) AS slug, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'DEFINES' WHEN 1 THEN 'CONSUMES' ELSE 'USES' END AS edge, concat('run', CAST(t AS VARCHAR)) AS run, doc_id + t AS seq FROM v_file, (VALUES (0), (4), (9)) v(t))"""


def _scoped(spark, d, slugs: int):
    return v.v_file(spark, d).select(F.lit("o").alias("org_id"), "knowledge_id", F.concat(F.lit("api-"), (F.col("doc_id") % slugs).cast("string")).alias("slug")).distinct()


@query("contract_edges", f"""SELECT n.org_id, n.knowledge_id, n.relative_path, n.slug, n.edge, arg_max(run, (seq, run)) AS run, min(seq) AS created_at, CASE WHEN count(*) > 1 THEN max(seq) END AS updated_at
FROM {_NAMED} n JOIN v_file f ON f.knowledge_id = n.knowledge_id AND f.relative_path = n.relative_path JOIN {_CONTRACTS} c ON c.org_id = n.org_id AND c.knowledge_id = n.knowledge_id AND c.slug = n.slug WHERE edge <> 'USES' GROUP BY 1, 2, 3, 4, 5""")
def contract_edges(spark, d):
    """Edges named in three runs, the first of which is what is there already."""
    from ..operators import enrich

    i, f = F.col("doc_id"), v.v_file(spark, d)

    def named(t):
        edge = F.when(i % 3 == 0, "DEFINES").when(i % 3 == 1, "CONSUMES").otherwise("USES")
        return f.select(F.lit("o").alias("org_id"), "knowledge_id", F.when(i % 11 == 0, "gone").otherwise(F.col("relative_path")).alias("relative_path"), F.concat(F.lit("api-"), ((i + t) % 4).cast("string")).alias("slug"), edge.alias("edge"), F.lit(f"run{t}").alias("run"), (i + t).alias("at"))

    contracts = _scoped(spark, d, 3)
    old = enrich.contract_edges(f, contracts, named(0))
    return enrich.contract_edges(f, contracts, named(4).unionByName(named(9)), old)


_ABOUT = """(SELECT 'o' AS org_id, knowledge_id, concat('api-', CAST(doc_id % 4 AS VARCHAR)) AS slug, CASE WHEN doc_id % 5 IN (0, 1) THEN relative_path END AS file_path, CASE WHEN doc_id % 5 IN (1, 2) THEN concat('api-', CAST(doc_id % 3 AS VARCHAR)) END AS concept_slug, CASE WHEN doc_id % 5 = 3 THEN 'api-0' END AS contract_slug, doc_id AS seq FROM v_file)"""


def _about(spark, d):
    from ..operators import enrich

    i, f = F.col("doc_id"), v.v_file(spark, d)
    slug = lambda n: F.concat(F.lit("api-"), (i % n).cast("string"))
    asked = f.select(F.lit("o").alias("org_id"), "knowledge_id", slug(4).alias("slug"), F.when((i % 5).isin(0, 1), F.col("relative_path")).alias("file_path"), F.when((i % 5).isin(1, 2), slug(3)).alias("concept_slug"), F.when(i % 5 == 3, "api-0").alias("contract_slug"), F.lit("run").alias("run"), i.alias("at"))
    ends = {"file": f, "concept": _scoped(spark, d, 2), "contract": _scoped(spark, d, 3)}
    return enrich.guidepost_edges(_scoped(spark, d, 3), ends, asked)


@query("guidepost_edges", f"""WITH a AS (SELECT *, CASE WHEN file_path IS NOT NULL THEN 'file' WHEN concept_slug IS NOT NULL THEN 'concept' ELSE 'contract' END AS kind, COALESCE(file_path, concept_slug, contract_slug) AS target FROM {_ABOUT} WHERE doc_id_n = 1),
s AS (SELECT DISTINCT knowledge_id, CAST(doc_id % 2 AS VARCHAR) AS two, CAST(doc_id % 3 AS VARCHAR) AS three FROM v_file)
SELECT org_id, a.knowledge_id, slug, kind, target, 'run' AS run, min(seq) AS created_at, CASE WHEN count(*) > 1 THEN max(seq) END AS updated_at FROM a
WHERE EXISTS (SELECT 1 FROM s WHERE s.knowledge_id = a.knowledge_id AND a.slug = concat('api-', three))
  AND (kind = 'file' OR EXISTS (SELECT 1 FROM s WHERE s.knowledge_id = a.knowledge_id AND a.target = concat('api-', CASE WHEN kind = 'concept' THEN two ELSE three END)))
GROUP BY 1, 2, 3, 4, 5""".replace("WHERE doc_id_n = 1", "WHERE (file_path IS NOT NULL)::INT + (concept_slug IS NOT NULL)::INT + (contract_slug IS NOT NULL)::INT = 1"))
def guidepost_edges(spark, d):
    return _about(spark, d)[0]


@query("guidepost_refused", f"SELECT knowledge_id, slug, seq, ((file_path IS NOT NULL)::INT + (concept_slug IS NOT NULL)::INT + (contract_slug IS NOT NULL)::INT) AS n_targets FROM {_ABOUT} WHERE (file_path IS NOT NULL)::INT + (concept_slug IS NOT NULL)::INT + (contract_slug IS NOT NULL)::INT <> 1")
def guidepost_refused(spark, d):
    return _about(spark, d)[1].select("knowledge_id", "slug", F.col("at").alias("seq"), "n_targets")
