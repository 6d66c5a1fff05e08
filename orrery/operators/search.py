"""Ranked search: eight channels, weighted fusion, clusters, lookup."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V

ID = ["knowledge_id", "relative_path"]
#: Channels over entities: the edge type, and whether a match scores 1 whatever it matches.
ENTITY = {"keywords": ("HAS_KEYWORD", False), "classes": ("HAS_CLASS", False), "functions": ("HAS_FUNCTION", False), "importsInternal": ("HAS_IMPORT_INTERNAL", True), "importsExternal": ("HAS_IMPORT_EXTERNAL", True)}
TEXTS = {"purpose": ("purpose", "summary"), "businessContext": ("business_context",), "paths": ("relative_path",)}
#: Lookup modes: the edge types of each.
MODES = {"keyword": ("HAS_KEYWORD",), "class": ("HAS_CLASS",), "function": ("HAS_FUNCTION",), "module": ("HAS_IMPORT_INTERNAL", "HAS_IMPORT_EXTERNAL")}


@dataclass(frozen=True)
class Scope:
    """Conditions on files; what is empty is no condition.  Exclusions ignore case."""

    knowledge_id: str | None = None
    knowledge_ids: tuple[str, ...] = ()
    prefix: str | None = None
    exclude: tuple[str, ...] = field(default=())

    def on(self, df: DataFrame) -> DataFrame:
        if self.knowledge_id:
            df = df.where(F.col("knowledge_id") == self.knowledge_id)
        if self.knowledge_ids:
            df = df.where(F.col("knowledge_id").isin(*self.knowledge_ids))
        if self.prefix:
            df = df.where(F.col("relative_path").startswith(self.prefix))
        path = F.lower("relative_path")
        bad = [path.endswith(s) for c in self.exclude for s in V.EXCLUSIONS[c][0]] + [path.contains(s) for c in self.exclude for s in V.EXCLUSIONS[c][1]]
        return df.where(~reduce(or_, bad)) if bad else df


def terms_of(query: str) -> list[str]:
    """Lower-case words of a query; all of it where there is none."""
    return query.strip().lower().split() or [query]


def _has(columns: tuple[str, ...], term: str) -> Column:
    return reduce(or_, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(term) for c in columns])


def match_share(columns: tuple[str, ...], terms: list[str]) -> Column:
    """The share of terms that some column contains."""
    return sum((F.when(_has(columns, t), 1.0).otherwise(0.0) for t in terms), F.lit(0.0)) / float(len(terms))


def matches(files: DataFrame, edges: DataFrame, query: str, scope: Scope, channels: tuple) -> DataFrame:
    """channel, knowledge_id, relative_path, score of every match: one scan of the files for all text channels, one of the edges for all others."""
    terms, out = terms_of(query), []
    texts, entities = [c for c in channels if c in TEXTS], [c for c in channels if c in ENTITY]
    if texts:
        columns = sorted({x for c in texts for x in TEXTS[c]} - set(ID))
        scores = F.array(*[F.struct(F.lit(c).alias("channel"), match_share(TEXTS[c], terms).alias("score")) for c in texts])
        out.append(scope.on(files.select(*ID, *columns)).select(*ID, F.inline(scores)).where("score > 0"))
    if entities:
        names = F.create_map(*[F.lit(x) for c in entities for x in (ENTITY[c][0], c)])
        flat = [ENTITY[c][0] for c in entities if ENTITY[c][1]]
        hits = scope.on(edges.where(F.col("edge_type").isin(*[ENTITY[c][0] for c in entities])).where(reduce(or_, [_has(("dst",), t) for t in terms])))
        score = F.when(F.col("edge_type").isin(*flat), 1.0).otherwise(match_share(("dst",), terms)) if flat else match_share(("dst",), terms)
        out.append(hits.groupBy(*ID, F.element_at(names, F.col("edge_type")).alias("channel")).agg(F.max(score).alias("score")))
    return reduce(DataFrame.unionByName, out).select("channel", *ID, "score")


def best_of_channels(hits: DataFrame, cap: int = V.CHANNEL_CAP) -> DataFrame:
    """Each channel's best `cap` files; tasks pass on no more than that of a channel."""
    order = Window.partitionBy("channel").orderBy(F.desc("score"), "relative_path", "knowledge_id")
    return hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap).drop("nth")


def channel(name: str, files: DataFrame, edges: DataFrame, query: str, scope: Scope = Scope(), cap: int = V.CHANNEL_CAP) -> DataFrame:
    """channel, knowledge_id, relative_path, score: the channel's best `cap` files."""
    return matches(files, edges, query, scope, (name,)).orderBy(F.desc("score"), "relative_path", "knowledge_id").limit(cap)


def fuse(hits: DataFrame, weights: dict = V.CHANNEL_WEIGHTS) -> DataFrame:
    """knowledge_id, relative_path, score, channels: scores over the channel's best, weighted and added up."""
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    share = F.col("score") / F.max("score").over(Window.partitionBy("channel")) * F.element_at(weight, F.col("channel"))
    rows = hits.withColumn("part", share)
    return rows.groupBy(*ID).agg(F.round(F.sum("part"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))


def fused_search(files: DataFrame, edges: DataFrame, query: str, scope: Scope = Scope(), channels: tuple = tuple(V.CHANNEL_WEIGHTS)) -> DataFrame:
    return fuse(best_of_channels(matches(files, edges, query, scope, channels)))


def with_repo_names(results: DataFrame, knowledge: DataFrame) -> DataFrame:
    names = knowledge.select("knowledge_id", "repo_name")
    return results.join(names, "knowledge_id", "left").withColumn("repo_name", F.coalesce("repo_name", F.lit("")))


def page(results: DataFrame, number: int = 1, size: int = V.PAGE_SIZE) -> DataFrame:
    size = min(max(size, V.PAGE_MIN), V.PAGE_MAX)
    return results.orderBy(F.desc("score"), "relative_path", "knowledge_id").offset((number - 1) * size).limit(size)


def folder_clusters(results: DataFrame) -> DataFrame:
    """Folders (two segments) with two and more results: how many, and the best file."""
    w = Window.partitionBy("knowledge_id", "folder").orderBy(F.desc("score"), "relative_path")
    rows = results.withColumn("folder", S.top_two_segments(F.col("relative_path"))).withColumn("nth", F.row_number().over(w))
    return rows.groupBy("knowledge_id", "folder").agg(F.count("*").alias("file_count"), F.max(F.when(F.col("nth") == 1, F.col("relative_path"))).alias("top_file")).where("file_count >= 2")


def concept_clusters(results: DataFrame, concept_edges: DataFrame, most: int = 20, sample: int = 5) -> DataFrame:
    """Concepts of two and more results: their files counted, the first few named."""
    rows = results.select(*ID).join(concept_edges.where(F.col("kind").isin("role", "pattern", "domain")), ID).select("kind", "slug", "relative_path").distinct()
    out = rows.groupBy("kind", "slug").agg(F.count("*").alias("file_count"), F.array_join(F.slice(F.array_sort(F.collect_list("relative_path")), 1, sample), ",").alias("sample_files"))
    return out.where("file_count >= 2").orderBy(F.desc("file_count"), "kind", "slug").limit(most)


def keyword_lookup(edges: DataFrame, knowledge: DataFrame, term: str, mode: str = "keyword", k: int = 20, per: int = 20, scope: Scope = Scope()) -> DataFrame:
    """Files of the first k entities that contain the term, at most `per` of each: entities are chosen before the scope applies."""
    rows = edges.where(F.col("edge_type").isin(*MODES[mode])).where(F.lower("dst").contains(term.lower()))
    names = rows.select("dst").distinct().orderBy("dst").limit(k)
    rows = scope.on(rows.join(F.broadcast(names), "dst")).select("dst", *ID).distinct().join(knowledge.select("knowledge_id", "repo_name"), "knowledge_id")
    nth = F.row_number().over(Window.partitionBy("dst").orderBy("knowledge_id", "relative_path"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= per).select(F.col("dst").alias("name"), *ID, "repo_name", "nth")


def list_knowledge(knowledge: DataFrame, files: DataFrame) -> DataFrame:
    counts = files.groupBy("knowledge_id").agg(F.count("*").alias("n"))
    return knowledge.join(counts, "knowledge_id", "left").select("knowledge_id", "repo_name", "branch", "state", "updated_seq", F.coalesce("n", F.lit(0)).alias("file_count"))


def file_metadata(files: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Files of paths(relative_path, and knowledge_id where given) with their sorted entities: edges are collected first, so nothing fans out."""
    key = [c for c in ID if c in paths.columns]
    paths = paths.select(*key).distinct()
    wanted = files.select(*ID, "language", "purpose").join(paths, key, "left_semi")
    kinds = {"HAS_KEYWORD": "keywords", "HAS_CLASS": "classes", "HAS_FUNCTION": "functions", "HAS_IMPORT_INTERNAL": "imports_internal", "HAS_IMPORT_EXTERNAL": "imports_external"}
    text = lambda e: F.array_join(F.array_sort(F.collect_set(F.when(F.col("edge_type") == e, F.col("dst")))), ",").alias(kinds[e])
    found = edges.join(paths, key, "left_semi").groupBy(*ID).agg(*map(text, kinds))
    out = wanted.join(found, ID, "left")
    return out.select(*ID, "language", "purpose", *[F.coalesce(c, F.lit("")).alias(c) for c in kinds.values()])


def metadata_answer(files: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Per row of asked(knowledge_id, relative_path, ord), in that order by ord: found, all columns of files, and the sorted entities as arrays.

    What isn't there has found false and nulls.  asked is joined first, so only its files and edges are grouped.
    """
    kinds = {"keywords": "HAS_KEYWORD", "classes": "HAS_CLASS", "functions": "HAS_FUNCTION", "imports_internal": "HAS_IMPORT_INTERNAL", "imports_external": "HAS_IMPORT_EXTERNAL"}
    keys = asked.select(*ID).distinct()
    found = edges.join(keys, ID, "left_semi").groupBy(*ID).agg(*[F.array_sort(F.collect_set(F.when(F.col("edge_type") == e, F.col("dst")))).alias(c) for c, e in kinds.items()])
    rows = files.drop(*kinds).join(keys, ID, "left_semi").withColumn("found", F.lit(True)).join(found, ID, "left")
    out = asked.select("ord", *ID).join(rows, ID, "left")
    none = F.array().cast("array<string>")
    rest = [c for c in files.columns if c not in (*ID, *kinds, "found", "ord")]
    return out.select("ord", *ID, F.coalesce("found", F.lit(False)).alias("found"), *rest, *[F.when(F.col("found"), F.coalesce(c, none)).alias(c) for c in kinds])


def lookup_answer(found: DataFrame, files: DataFrame) -> DataFrame:
    """Looked-up files with their purpose and summary, "" where a file has none."""
    texts = files.select(*ID, F.coalesce("purpose", F.lit("")).alias("purpose"), F.coalesce("summary", F.lit("")).alias("summary"))
    return found.join(texts, ID, "left").na.fill("", ["purpose", "summary"])


def list_projection(knowledge: DataFrame, counts: DataFrame) -> DataFrame:
    """What a list shows: state, one text for the source, the stored number of files or else the counted one."""
    source = F.concat(F.col("source_kind"), F.lit(":"), F.col("source_url"), F.lit("@"), F.col("branch"))
    return knowledge.join(counts, "knowledge_id", "left").select("knowledge_id", "state", source.alias("source"), F.coalesce("total_files", "file_count").alias("total_files"))


def suggest(names: DataFrame, asked: DataFrame, found: int = V.BRANCHES_FOUND, shown: int = V.BRANCHES_SHOWN) -> DataFrame:
    """For each asked text the first names that contain it, or the first of all where none does.

    asked is broadcast and compared with every name: it holds what users typed, a few rows.
    """
    first = names.orderBy("name").limit(shown)
    hit = asked.join(names, F.lower("name").contains(F.lower("asked")))
    hit = hit.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy("name"))).where(F.col("n") <= found).drop("n")
    rest = asked.join(hit.select("asked").distinct(), "asked", "left_anti").crossJoin(F.broadcast(first))
    return hit.select("asked", "name").unionByName(rest.select("asked", "name"))


def with_purpose(found: DataFrame, files: DataFrame) -> DataFrame:
    return found.join(files.select(*ID, "purpose"), ID, "left")


def capped(found: DataFrame, most: int) -> DataFrame:
    """The first rows by name, knowledge base and path."""
    return found.orderBy("name", *ID).limit(most)


def group_entries(knowledge: DataFrame) -> DataFrame:
    """Knowledge bases by address, else by path, else by id."""
    return knowledge.groupBy(F.coalesce("source_url", "source_path", "knowledge_id").alias("entry")).agg(F.count("*").alias("n"))


def clamped_page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """The rows of a page, the last one if there are not so many, with its number and how many pages there are.

    The count is one row; the page itself is a limit over sorted rows.
    """
    total = rows.count()
    pages = max(1, -(-total // size))
    at = min(max(1, number), pages)
    return rows.orderBy(*order).offset((at - 1) * size).limit(size).withColumn("page", F.lit(at)).withColumn("pages", F.lit(pages))


def commit_limit(asked: Column) -> Column:
    return F.when(asked.isNull(), V.COMMITS_DEFAULT).otherwise(F.least(F.greatest(asked, F.lit(1)), F.lit(V.COMMITS_MAX)))


def trim(rows: DataFrame, order: list[str], chars: Column, most: int = V.RESPONSE_CHARS) -> DataFrame:
    """A result page, each row of so many characters, cut to 0.7 of its rows until it fits or has LEAST_RESULTS.

    rows is a page: it is bounded by the largest page, so its sizes come in one row.
    """
    nth = F.row_number().over(Window.orderBy(*order))
    sizes = rows.withColumn("n", nth).withColumn("chars", chars)
    lengths = [r["chars"] for r in sizes.orderBy("n").select("chars").limit(V.PAGE_MAX).collect()]
    keep = len(lengths)
    while keep > V.LEAST_RESULTS and sum(lengths[:keep]) > most:
        keep = int(keep * V.TRIM)
    return sizes.where(F.col("n") <= keep).drop("chars")
