"""Admission in two passes: what rules leave open is decided once for each distinct content, by a function that is passed in.

Verdicts are kept by content in a log that is only appended to; the last one of a content
stands, and the files that it was asked for add up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from .scan import admission
from .shared import cut

VERDICT = "sha string, ignore boolean, source string, repository_name string, files array<string>, at timestamp"


def read_verdicts(spark: SparkSession, path: str | None) -> DataFrame:
    """One row a content: its last verdict, and all files that were named; malformed rows are left out, a log that isn't there has none."""
    rows = spark.createDataFrame([], VERDICT)
    if path is not None:
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
            rows = spark.read.schema(VERDICT).option("mode", "DROPMALFORMED").json(path)
    return merged(rows)


def merged(rows: DataFrame) -> DataFrame:
    rows = rows.where("sha IS NOT NULL AND ignore IS NOT NULL")
    order = F.struct("at", "source", "repository_name", "ignore")
    files = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("files", F.array().cast("array<string>"))))))
    return rows.groupBy("sha").agg(*[F.max_by(c, order).alias(c) for c in ("ignore", "source", "repository_name")], files.alias("files"), F.max("at").alias("at"))


def undecided(files: DataFrame, verdicts: DataFrame | None = None, chars: int = V.VERDICT_CHARS, **rules) -> DataFrame:
    """(sha, relative_path, ext, content) of each distinct content that neither rules nor verdicts decide: its first file, and its first characters."""
    rows = files.where(admission(F.col("relative_path"), **rules).isNull())
    if verdicts is not None:
        rows = rows.join(verdicts.select("sha"), "sha", "left_anti")
    # The copies of a content meet as one row of each task.
    one = rows.groupBy("sha").agg(F.min_by(F.struct("relative_path", F.substring("content", 1, chars).alias("content")), "relative_path").alias("x"))
    return one.select("sha", "x.relative_path", S.extension(F.col("x.relative_path")).alias("ext"), "x.content")


def ask(asked: DataFrame, decide: Callable[[list[dict]], list[bool | None]]) -> DataFrame:
    """asked(as from `undecided`) with `accept`: what decide gives for lots of (relative_path, ext, content); null where it gives none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                said = decide(batch.select(["relative_path", "ext", "content"]).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("sha")), batch.column(batch.schema.names.index("relative_path")), pa.array(said, pa.bool_())], ["sha", "relative_path", "accept"])

    return asked.mapInArrow(run, "sha string, relative_path string, accept boolean")


def two_passes(files: DataFrame, decide: Callable, path: str | None = None, repository: str | None = None, gate: bool = True, **rules) -> DataFrame:
    """files(relative_path, sha, content, and what else) with `decision`: reject-static, accept, accept-llm or reject-llm.

    Pass one applies the rules and the verdicts of the log at `path`.  The open contents are
    decided once each; verdicts are appended to the log, where none was given the content is
    rejected for this run only.  Pass two applies them to all files.  Null contents and null
    keys that rules leave open are rejected without being asked.
    """
    spark = files.sparkSession
    known = read_verdicts(spark, path)
    new = None
    if gate:
        said = cut(ask(undecided(files.where("content IS NOT NULL AND sha IS NOT NULL"), known, **rules), decide))
        new = said.where("accept IS NOT NULL").select("sha", (~F.col("accept")).alias("ignore"), F.lit("llm").alias("source"), F.lit(repository).alias("repository_name"), F.array("relative_path").alias("files"), F.current_timestamp().alias("at"))
        if path is not None and not new.isEmpty():
            new.write.mode("append").json(path)
        known = known.select("sha", "ignore").unionByName(new.select("sha", "ignore"))
    rows = files.join(known.select("sha", F.col("ignore").alias("__ignore")), "sha", "left")
    decision = F.coalesce(admission(F.col("relative_path"), gate=gate, verdict=F.col("__ignore"), **rules), F.lit("reject-llm"))
    return rows.withColumn("decision", decision).select(*[c for c in files.columns if c != "decision"], "decision")


def outcomes(decided: DataFrame) -> DataFrame:
    """(outcome, n) of all six outcomes of a scan; decided: rows with `outcome` or `decision`."""
    column = "outcome" if "outcome" in decided.columns else "decision"
    names = decided.sparkSession.createDataFrame([(x,) for x in V.OUTCOMES], "outcome string")
    count = decided.groupBy(F.col(column).alias("outcome")).agg(F.count("*").alias("n"))
    return names.join(count, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def last_verdicts(verdicts: DataFrame) -> DataFrame:
    """The verdict that each repository had last."""
    w = Window.partitionBy("repository_name").orderBy(F.desc("at"), F.desc("sha"))
    return verdicts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
