"""File sources and sinks: repository trees, JSON artifacts, commit partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scan as A

ANALYSIS = T.StructType([T.StructField(n, t) for n, t in (("relativePath", T.StringType()), ("language", T.StringType()), ("sha256", T.StringType()), ("sizeBytes", T.LongType()), ("tokenCount", T.LongType()), ("isBigFile", T.BooleanType()), ("totalChunks", T.LongType()), ("analysedAt", T.StringType()))])


def safe_path(path) -> F.Column:
    """Whether a relative path stays below its root: not empty, not absolute, no `..` segment."""
    return (path != "") & ~path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")


def scan_repository(spark: SparkSession, root: str, **rules) -> DataFrame:
    """relative_path, size_bytes, content, outcome of every file below root: rejected, binary, oversized, big or small."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    folder = F.regexp_replace(F.lit(root if ":" in root else f"file:{root}"), "^([a-z]+):/+|/+$", "$1:/")
    path = F.expr("substring(p, length(f) + 2)")
    rows = rows.select(F.regexp_replace("path", "^([a-z]+):/+", "$1:/").alias("p"), folder.alias("f"), F.col("length").alias("size_bytes"), "content").select(path.alias("relative_path"), "size_bytes", "content")
    text = F.decode("content", "utf-8")
    outcome = F.when(A.admission(F.col("relative_path"), **rules) == "reject-static", "rejected").when(A.is_binary(F.col("content")), "binary").otherwise(A.kind(text))
    return rows.withColumn("outcome", outcome)


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    """Analysis artifacts below path: malformed ones are skipped, the last one of a path stands."""
    rows = spark.read.schema(ANALYSIS).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    rows = rows.where(F.col("relativePath").isNotNull())
    return rows.groupBy("relativePath").agg(*[F.max_by(c, "analysedAt").alias(c) for c in rows.columns if c != "relativePath"])


def registry_top(spark: SparkSession, text: DataFrame, n: int = 50) -> DataFrame:
    """keyword, count of a JSON object in column `value`: numbers only, the n largest."""
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("keyword", "v")).select("keyword", F.col("v").try_cast("double").alias("count"))
    return rows.where(F.col("count").isNotNull()).orderBy(F.desc("count"), "keyword").limit(n)


def write_commit(files: DataFrame, path: str) -> None:
    """Files to partitions by knowledge_id and commit_hash; a partition that is written again is replaced."""
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("knowledge_id", "commit_hash").parquet(path)
