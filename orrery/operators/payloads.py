"""Job payloads: JSON of any shape, narrowed to the typed fields of its kind of job, or to what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.artifacts import text, texts


def _field(doc: Column, name: str) -> Column:
    """A field that is a string and not empty, null else."""
    return F.nullif(text(doc, f"$.{name}"), F.lit(""))


def _overrides(doc: Column) -> Column:
    """Of each category of ignore patterns what is added and removed: lists of non-empty strings, null where there is none."""
    some = lambda path: F.when(F.size(texts(doc, path)) > 0, texts(doc, path))

    def patch(category):
        add, remove = some(f"$.ignoreOverrides.{category}.add"), some(f"$.ignoreOverrides.{category}.remove")
        return F.when(add.isNotNull() | remove.isNotNull(), F.struct(add.alias("add"), remove.alias("remove")))

    parts = {c: patch(c) for c in V.PATTERN_CATEGORIES}
    return F.when(F.coalesce(*[F.when(p.isNotNull(), True) for p in parts.values()], F.lit(False)), F.struct(*[p.alias(c) for c, p in parts.items()]))


def narrow(jobs: DataFrame) -> DataFrame:
    """Per row of jobs(id, knowledge_id, type, payload: JSON text): problem (null if there is none), coherent, and the fields that its kind of job has.

    A payload must be an object with a knowledgeId, and a repoUrl or, of local jobs, a
    rootDir: strings that aren't empty.  Other fields of another type count as missing;
    fields that a kind doesn't have, or of a payload with a problem, are null.  coherent:
    the payload names the job's own knowledge base.
    """
    doc = F.try_parse_json("payload")
    rows = jobs.withColumn("doc", F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc))
    d, local = F.col("doc"), F.col("type") == "local_ingest"
    place = F.when(local, _field(d, "rootDir")).otherwise(_field(d, "repoUrl"))
    known = F.col("type").isin("github_index", "local_ingest")
    problem = F.when(~F.coalesce(known, F.lit(False)), "unknown type").when(d.isNull(), "not an object").when(_field(d, "knowledgeId").isNull(), "missing knowledgeId")
    problem = problem.when(place.isNull(), F.when(local, "missing rootDir").otherwise("missing repoUrl"))
    rows = rows.withColumn("problem", problem)
    good, github = F.col("problem").isNull(), F.col("problem").isNull() & ~local
    both = {"org_id": "orgId", "llm_api_key": "llmApiKey", "llm_provider": "llmProvider", "llm_model": "llmModel", "llm_key_id": "llmKeyId"}
    own = {"repo_url": "repoUrl", "branch": "branch", "commit_hash": "commitHash", "git_token": "gitToken"}
    return rows.select(
        "id", "type", "problem", F.when(good, _field(d, "knowledgeId")).alias("knowledge_id"), F.when(good, F.coalesce(_field(d, "knowledgeId") == F.col("knowledge_id"), F.lit(False))).alias("coherent"),
        *[F.when(github, _field(d, name)).alias(c) for c, name in own.items()], F.when(good & local, _field(d, "rootDir")).alias("root_dir"), *[F.when(good, _field(d, name)).alias(c) for c, name in both.items()], F.when(github, _overrides(d)).alias("ignore_overrides"),
    )
