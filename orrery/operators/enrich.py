"""Enrichment of files: concepts, contracts, guideposts, test targets; and the business context of repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V

KEY = ["knowledge_id", "relative_path"]
ITEM = "struct<slug:string,kind:string,name:string,note:string,edge:string>"


def _length(c: str, most: int) -> Column:
    return F.coalesce(F.char_length(c).between(1, most), F.lit(False))


def problems(items: DataFrame) -> DataFrame:
    """items(…, family, slug, kind, name, note, edge) with the first rule that each breaks, null where none."""
    kinds = {"concept": V.CONCEPT_KINDS, "contract": V.CONTRACT_KINDS, "guidepost": V.GUIDEPOST_KINDS}
    known = F.lit(False)
    for family, names in kinds.items():
        known = known | ((F.col("family") == family) & F.col("kind").isin(*names))
    edge = F.col("family") == "guidepost"
    for family, names in V.EDGE_KINDS.items():
        edge = edge | ((F.col("family") == family) & F.col("edge").isin(*names))
    note = F.when(F.col("family") == "concept", _length("note", V.RATIONALE_CHARS)).when(F.col("family") == "guidepost", _length("note", V.NOTE_CHARS)).otherwise(True)
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    rule = F.when(no(X.is_slug(F.col("slug"))), "slug").when(no(known), "kind").when(no(_length("name", V.NAME_CHARS)), "name").when(no(note), "note").when(no(edge), "edge")
    return items.withColumn("problem", rule)


def over_limits(items: DataFrame) -> DataFrame:
    """Files with more concepts, contracts or guideposts than may be."""
    most = F.when(F.col("family") == "concept", V.MOST_CONCEPTS).when(F.col("family") == "contract", V.MOST_CONTRACTS).otherwise(V.MOST_GUIDEPOSTS)
    return items.groupBy(*KEY, "family").agg(F.count("*").alias("n")).where(F.col("n") > most)


def fan_out(enrichments: DataFrame) -> DataFrame:
    """One row for each item of enrichments(knowledge_id, relative_path, concepts, contracts, guideposts), arrays of ITEM."""
    rows = None
    for family in ("concept", "contract", "guidepost"):
        part = enrichments.select(*KEY, F.lit(family).alias("family"), F.inline(f"{family}s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def attach(files: DataFrame, entities: DataFrame, edges: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Edges (knowledge_id, relative_path, slug, edge, at) whose ends both exist, with when each was made and last seen."""
    rows = edges.join(files.select(*KEY), KEY, "left_semi").join(entities.select("slug"), "slug", "left_semi")
    if old is not None:
        rows = rows.select(*KEY, "slug", "edge", "at").unionByName(old.select(*KEY, "slug", "edge", "at"))
    return rows.groupBy(*KEY, "slug", "edge").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


SCOPE = ["org_id", "knowledge_id"]


def _merged_edges(rows: DataFrame, keys: list[str], old: DataFrame | None) -> DataFrame:
    """Edges by key with the run that named each last, when it was made, and when it was last named again: null if it wasn't."""
    known = rows.select(*keys, "run", F.col("at").alias("created_at"), F.lit(None).cast(rows.schema["at"].dataType).alias("updated_at"))
    if old is not None:
        known = known.unionByName(old.select(*known.columns))
    seen = F.coalesce("updated_at", "created_at")
    again = F.when((F.count("*") > 1) | F.max("updated_at").isNotNull(), F.max(seen))
    return known.groupBy(*keys).agg(F.max_by("run", F.struct(seen.alias("s"), "run")).alias("run"), F.min("created_at").alias("created_at"), again.alias("updated_at"))


def contract_edges(files: DataFrame, contracts: DataFrame, edges: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """DEFINES and CONSUMES edges of edges(org_id, knowledge_id, relative_path, slug, edge, run, at) between files and contracts(org_id, knowledge_id, slug) of one knowledge base that are both there; other kinds are left out."""
    rows = edges.where(F.col("edge").isin(*V.EDGE_KINDS["contract"])).join(files.select(*KEY), KEY, "left_semi")
    rows = rows.join(contracts.select(*SCOPE, "slug"), [*SCOPE, "slug"], "left_semi")
    return _merged_edges(rows, [*SCOPE, "relative_path", "slug", "edge"], old)


#: What a guidepost can be about: the column that names it.
TARGETS = {"file": "file_path", "concept": "concept_slug", "contract": "contract_slug"}


def guidepost_edges(guideposts: DataFrame, ends: dict[str, DataFrame], asked: DataFrame, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """ABOUT edges of asked(org_id, knowledge_id, slug, file_path, concept_slug, contract_slug, run, at), and the rows refused.

    A row must name exactly one target; others are refused, with how many they name.  An
    edge needs its guidepost and, in the same knowledge base, its target: ends by kind
    (file: by relative_path, in any organisation; concept and contract: by slug).
    """
    n = sum((F.col(c).isNotNull().cast("int") for c in TARGETS.values()), F.lit(0))
    rows = asked.withColumn("n_targets", n)
    kind = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(k)) for k, c in TARGETS.items()])
    good = rows.where("n_targets = 1").withColumn("kind", kind).withColumn("target", F.coalesce(*TARGETS.values()))
    good = good.join(guideposts.select(*SCOPE, "slug"), [*SCOPE, "slug"], "left_semi")
    parts = []
    for k, end in ends.items():
        name = "relative_path" if k == "file" else "slug"
        on = ["knowledge_id"] if k == "file" else SCOPE
        parts.append(good.where(F.col("kind") == k).join(end.select(*on, F.col(name).alias("target")), [*on, "target"], "left_semi").select(*SCOPE, "slug", "kind", "target", "run", "at"))
    return _merged_edges(reduce(DataFrame.unionByName, parts), [*SCOPE, "slug", "kind", "target"], old), rows.where("n_targets <> 1")


def upsert(old: DataFrame, new: DataFrame, first: tuple[str, ...], last: tuple[str, ...]) -> DataFrame:
    """Entities by slug: columns in `first` keep their earliest value, those in `last` take the latest, in order of `at`.

    Of rows at one time the least values in order of the columns come first.
    """
    both = old.unionByName(new)
    order = F.struct("at", *first, *last)
    return both.groupBy("slug").agg(*[F.min_by(c, order).alias(c) for c in first], *[F.max_by(c, order).alias(c) for c in last], F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def tests(files: DataFrame, targets: DataFrame) -> DataFrame:
    """TESTS edges of targets(knowledge_id, relative_path, target_path) between files that are there; blank targets are none."""
    rows = targets.where(F.coalesce(F.trim("target_path"), F.lit("")) != "").distinct()
    ends = files.select("knowledge_id", F.col("relative_path").alias("target_path"))
    return rows.join(files.select(*KEY), KEY, "left_semi").join(ends, ["knowledge_id", "target_path"], "left_semi").select(*KEY, "target_path")


def merge_fields(parts: list[DataFrame], key: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Partial records laid over one another: of each field the last part's that has it, else its default."""
    out = None
    for i, p in enumerate(parts):
        own = p.select(*key, *[F.col(c).alias(f"__{i}_{c}") for c in defaults if c in p.columns])
        out = own if out is None else out.join(own, key, "full_outer")
    pick = lambda c: F.coalesce(*[F.col(f"__{i}_{c}") for i, p in reversed(list(enumerate(parts))) if c in p.columns], defaults[c]).alias(c)
    return out.select(*key, *map(pick, defaults))


def context_versions(rows: DataFrame) -> DataFrame:
    """Business context versions of rows(knowledge_id, commit_hash, title, features, risks): a name each, arrays as one text."""
    texts = [X.join_nonblank(F.col(c)).alias(c) for c in ("features", "risks")]
    return rows.select("knowledge_id", "commit_hash", F.concat_ws("@", "knowledge_id", "commit_hash").alias("version_id"), F.trim("title").alias("title"), *texts)


def context_keywords(rows: DataFrame) -> DataFrame:
    """(version_id, keyword) of the words of features and risks, each once."""
    words = F.explode(F.array_union(X.nonempty(F.transform("features", lambda x: F.trim(x))), X.nonempty(F.transform("risks", lambda x: F.trim(x))))).alias("keyword")
    return rows.select(F.concat_ws("@", "knowledge_id", "commit_hash").alias("version_id"), words).distinct()
