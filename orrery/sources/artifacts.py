"""JSON artifacts: sinks, and readers that take what has the right type and pass over the rest.

Documents are read as VARIANT, so a field of another type is as good as none and never
fails a document; documents that are no JSON objects are counted, not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOP = 50
#: Registries of counted names, and the field of each.
REGISTRIES = {
    "keywords": "top_keywords",
    "business-entities": "top_business_entities",
    "ontology-concepts": "top_ontology_concepts",
    "system-capabilities": "top_system_capabilities",
    "integration-surface": "integration_surface",
    "contracts-provided": "contracts_provided",
    "contracts-consumed": "contracts_consumed",
    "side-effects": "side_effects",
    "config-dependencies": "config_dependencies",
}


def write_documents(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Each row of rows(doc: a struct, or a column of JSON text) as one line; `by` columns become folders, and those that are written again are replaced."""
    doc = F.col("doc") if dict(rows.dtypes)["doc"] == "string" else F.to_json("doc")
    out = rows.select(*(by or []), doc.alias("value")).where("value IS NOT NULL").write.mode("overwrite")
    (out.partitionBy(*by).option("partitionOverwriteMode", "dynamic") if by else out).text(path)


def read_documents(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """(doc variant, and the folders' columns) of JSON lines, or of files of one document each; doc is null for what is no JSON object."""
    rows = spark.read.option("wholetext", whole_files).option("recursiveFileLookup", "false").text(path)
    parsed = F.try_parse_json("value")
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return rows.where(F.trim("value") != "").withColumn("doc", F.when(is_object, parsed)).drop("value")


def health(docs: DataFrame) -> DataFrame:
    """(n_read, n_malformed) of read_documents."""
    return docs.agg(F.count("doc").alias("n_read"), F.count_if(F.col("doc").isNull()).alias("n_malformed"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text(doc: Column, path: str) -> Column:
    """A field that is a string, "" else: numbers and objects are none."""
    value = F.try_variant_get(doc, path, "variant")
    return F.coalesce(F.when(_kind(value) == "STRING", F.try_variant_get(doc, path, "string")), F.lit(""))


def items(doc: Column, path: str) -> Column:
    """The elements of a field that is an array; none of any other."""
    return F.coalesce(F.try_variant_get(doc, path, "array<variant>"), F.array().cast("array<variant>"))


def texts(doc: Column, path: str, blanks: bool = False) -> Column:
    """The strings of an array, in order; "" too where blanks are wanted."""
    found = F.transform(F.filter(items(doc, path), lambda x: _kind(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return found if blanks else F.filter(found, lambda x: x != "")


LISTS = {"keywords": "keywords", "classes": "classes", "functions": "functions", "importsInternal": "imports_internal", "importsExternal": "imports_external"}


def folder_summaries(docs: DataFrame) -> DataFrame:
    """A row per document that is an object: folder_path, purpose, summary, lists, dependency_graph, generated_at; and the columns beside doc."""
    d = F.col("doc")
    names = {"folderPath": "folder_path", "purpose": "purpose", "summary": "summary", "dependencyGraph": "dependency_graph", "generatedAt": "generated_at"}
    rest = [c for c in docs.columns if c != "doc"]
    return docs.where("doc IS NOT NULL").select(*rest, *[text(d, f"$.{k}").alias(c) for k, c in names.items()], *[texts(d, f"$.{k}").alias(c) for k, c in LISTS.items()])


def repo_summaries(docs: DataFrame) -> DataFrame:
    """A row per document: its repoSummary if it has one, else the document itself, typed; subsystems are those with a name."""
    inner = F.try_variant_get("doc", "$.repoSummary", "variant")
    d = F.when(inner.isNotNull() & (_kind(inner) != "VOID"), inner).otherwise(F.col("doc"))
    systems = F.filter(items(F.col("d"), "$.majorSubsystems"), lambda x: _kind(x).startswith("OBJECT"))
    systems = F.filter(F.transform(systems, lambda x: F.struct(text(x, "$.name").alias("name"), text(x, "$.responsibility").alias("responsibility"))), lambda x: x["name"] != "")
    rows = docs.where("doc IS NOT NULL").withColumn("d", d)
    rest = [c for c in docs.columns if c != "doc"]
    return rows.select(*rest, text(F.col("d"), "$.architecture").alias("repo_architecture"), text(F.col("d"), "$.dataFlow").alias("repo_data_flow"), texts(F.col("d"), "$.keyPatterns", blanks=True).alias("repo_key_patterns"), systems.alias("major_subsystems"))


def registry_counts(docs: DataFrame, keys: list[str], top: int = TOP) -> DataFrame:
    """(keys, entries array<struct<keyword, count>>): the `top` counted names of registries, an object of numbers each; other values are passed over."""
    rows = docs.where("doc IS NOT NULL").select(*keys, F.explode(F.try_variant_get("doc", "$", "map<string,variant>")).alias("keyword", "v"))
    number = _kind(F.col("v")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    rows = rows.where(number).select(*keys, "keyword", F.try_variant_get("v", "$", "double").alias("count"))
    rows = rows.groupBy(*keys, "keyword").agg(F.max("count").alias("count"))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "keyword"))
    kept = rows.withColumn("nth", nth).where(F.col("nth") <= top)
    entries = F.transform(F.array_sort(F.collect_list(F.struct("nth", "keyword", "count"))), lambda x: F.struct(x["keyword"].alias("keyword"), x["count"].alias("count")))
    return kept.groupBy(*keys).agg(entries.alias("entries"))  # `top` entries at most


def enrichment(knowledge: DataFrame, summaries: DataFrame, registries: DataFrame) -> DataFrame:
    """Per row of knowledge(knowledge_id, org_id): its repository summary and the nine registries of its organisation; what is missing is empty.

    summaries: as from `repo_summaries`, with knowledge_id; of several of one base the
    greatest counts.  registries: as from `registry_counts`, with org_id and registry.
    """
    fields = ["repo_architecture", "repo_data_flow", "repo_key_patterns", "major_subsystems"]
    one = summaries.groupBy("knowledge_id").agg(F.max(F.struct(*fields)).alias("s"))
    wide = registries.groupBy("org_id").pivot("registry", list(REGISTRIES)).agg(F.first("entries"))
    none = F.array().cast("array<struct<keyword:string,count:double>>")
    out = knowledge.join(one, "knowledge_id", "left").join(wide, "org_id", "left")
    empty = {"repo_architecture": F.lit(""), "repo_data_flow": F.lit(""), "repo_key_patterns": F.array().cast("array<string>"), "major_subsystems": F.array().cast("array<struct<name:string,responsibility:string>>")}
    return out.select("knowledge_id", "org_id", *[F.coalesce(F.col(f"s.{c}"), empty[c]).alias(c) for c in fields], *[F.coalesce(F.col(f"`{r}`"), none).alias(c) for r, c in REGISTRIES.items()])


# --- skills -----------------------------------------------------------------------------------


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, "^[\"']|[\"']\\z", "")


def front_matter_text(content: Column, field: str = "description") -> Column:
    """A field of a text's front matter, between `---` at its begin and the next line that begins so; "" where there is none.

    A value of `>` or `|` goes on over the indented lines that follow, joined by blanks; a
    fold over the lines keeps whether it does.  Of repeated fields the last value stands,
    folded lines being added to it.
    """
    body = F.regexp_extract(content, r"\A---((?s:.*?))\n---", 1)
    lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, "\r\\z", ""))
    start = F.struct(F.lit("").alias("value"), F.lit(False).alias("folding"))

    def step(acc, line):
        word = F.trim(line)
        goes_on = acc["folding"] & line.rlike(r"^\s") & (word != "")
        longer = F.when(acc["value"] == "", word).otherwise(F.concat(acc["value"], F.lit(" "), word))
        has = line.rlike(f"^{field}:")
        value = F.trim(F.regexp_extract(line, f"^{field}:\\s*(.*)\\z", 1))
        folds = value.isin(">", "|")
        fresh = F.struct(F.when(folds, acc["value"]).otherwise(_unquoted(value)).alias("value"), folds.alias("folding"))
        rest = F.struct(acc["value"].alias("value"), F.lit(False).alias("folding"))
        return F.when(goes_on, F.struct(longer.alias("value"), F.lit(True).alias("folding"))).when(has, fresh).otherwise(rest)

    return F.coalesce(F.aggregate(lines, start, step, lambda acc: acc["value"]), F.lit(""))


def skills(files: DataFrame, manifest: str = "SKILL.md", home: str = "~/.claude/skills") -> DataFrame:
    """(name, description, install_path, files) of the folders directly below the root that hold a manifest.

    files(relative_path, size_bytes, content).  A folder's files are its own `.md` ones, the
    manifest first, then by name.
    """
    parts = F.split("relative_path", "/")
    rows = files.where((F.size(parts) == 2) & F.col("relative_path").endswith(".md")).select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("filename"), F.col("size_bytes").alias("bytes"), "content")
    own = F.col("filename") == manifest
    entry = F.struct((~own).alias("later"), "filename", "bytes")
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["filename"].alias("filename"), x["bytes"].alias("bytes")))
    out = rows.groupBy("name").agg(F.max(F.when(own, F.coalesce("content", F.lit("")))).alias("text"), listed.alias("files")).where("text IS NOT NULL")
    return out.select("name", front_matter_text(F.col("text")).alias("description"), F.concat(F.lit(f"{home}/"), "name").alias("install_path"), "files")
