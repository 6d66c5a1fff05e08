"""Ancestry on commit graphs: reachability, depths, generations and merge bases, whatever their depth and merges.

Tables of ancestors by powers of two are joined with themselves: level k has the pairs of a
commit and what stands at the end of some path of exactly 2**k parents, each once.  A
history of n commits has at most log2(n) levels, and as sets take the place of paths,
merges don't multiply.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

EDGE = "commit_hash string, ancestor string"


class History:
    """A commit graph that answers questions of ancestry; see `history`."""

    def __init__(self, levels: list[DataFrame], commits: DataFrame):
        self.levels, self.commits = levels, commits

    def ancestors(self, starts: DataFrame) -> DataFrame:
        """(start, commit_hash, depth) of all that starts(commit_hash) reach, themselves with depth 0; depth: fewest parents on the way.

        A start that the history doesn't know reaches itself only; null starts reach nothing.
        """
        at = F.col("commit_hash")
        found = starts.where(at.isNotNull()).select(at.alias("start"), at, F.lit(0).cast("long").alias("depth")).distinct()
        for k, level in enumerate(self.levels):
            # Each row stays and adds what is 2**k parents on: one join and one aggregate a level.
            step = found.join(level, "commit_hash", "left")
            both = F.array(F.struct(at.alias("c"), F.col("depth").alias("d")), F.struct(F.col("ancestor").alias("c"), (F.col("depth") + (1 << k)).alias("d")))
            found = step.select("start", F.inline(both)).where("c IS NOT NULL").groupBy("start", F.col("c").alias("commit_hash")).agg(F.min("d").alias("depth"))
        return found

    def generations(self) -> DataFrame:
        """(commit_hash, generation): the most parents on a way to a commit without any; an ancestor's is always less."""
        out = self.commits.select("commit_hash", F.lit(0).cast("long").alias("generation"))
        for k, level in enumerate(self.levels):
            far = level.join(out.withColumnRenamed("commit_hash", "ancestor"), "ancestor").select("commit_hash", (F.col("generation") + (1 << k)).alias("generation"))
            out = cut(out.unionByName(far).groupBy("commit_hash").agg(F.max("generation").alias("generation")))
        return out

    def reachable(self, pairs: DataFrame) -> DataFrame:
        """pairs(commit_hash, head) and reachable: whether head is the commit or has it among its ancestors; false where one is null."""
        up = self.ancestors(pairs.select(F.col("head").alias("commit_hash"))).select(F.col("start").alias("head"), "commit_hash", F.lit(True).alias("reachable"))
        return pairs.join(up, ["head", "commit_hash"], "left").select(*pairs.columns, F.coalesce("reachable", F.lit(False)).alias("reachable"))

    def merge_bases(self, pairs: DataFrame) -> DataFrame:
        """(a, b, base) of pairs(a, b): every common ancestor from which no other common one descends; several after criss-cross merges, none without a common one.

        Whatever a common ancestor reaches is common too, so those to leave out have a child among them.
        """
        pairs = pairs.select("a", "b").distinct()
        up = cut(self.ancestors(pairs.select(F.col("a").alias("commit_hash")).unionByName(pairs.select(F.col("b").alias("commit_hash")))))
        side = lambda x: up.select(F.col("start").alias(x), "commit_hash")
        common = cut(pairs.join(side("a"), "a").join(side("b"), ["b", "commit_hash"]).select("a", "b", "commit_hash"))
        if not self.levels:
            return common.withColumnRenamed("commit_hash", "base")
        older = common.join(self.levels[0], "commit_hash").select("a", "b", F.col("ancestor").alias("commit_hash"))
        return common.join(older, ["a", "b", "commit_hash"], "left_anti").withColumnRenamed("commit_hash", "base")

    def merge_base(self, pairs: DataFrame) -> DataFrame:
        """One base of each pair that has any: of the highest generation, then the last hash."""
        best = self.merge_bases(pairs).join(self.generations().withColumnRenamed("commit_hash", "base"), "base", "left")
        return best.groupBy("a", "b").agg(F.max_by("base", F.struct("generation", "base")).alias("base"))

    def save(self, path: str) -> None:
        """Writes the tables, a partition a level, for `load`."""
        rows = [x.select(F.lit(k).alias("power"), "commit_hash", "ancestor") for k, x in enumerate(self.levels)]
        rows.append(self.commits.select(F.lit(-1).alias("power"), "commit_hash", F.lit(None).cast("string").alias("ancestor")))
        reduce(DataFrame.unionByName, rows).repartition("power", "commit_hash").write.partitionBy("power").mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> History:
    rows = spark.read.parquet(path)
    powers = sorted(r[0] for r in rows.select("power").distinct().collect())  # a row a level
    return History([rows.where(F.col("power") == k).select("commit_hash", "ancestor") for k in powers if k >= 0], rows.where("power = -1").select("commit_hash"))


def history(edges: DataFrame) -> History:
    """The history of edges(commit_hash, parent_hash): a row for each parent, a null parent for none.

    Repeated rows count once, rows with a null commit_hash are left out; a parent without
    rows of its own is a commit without parents.  A graph with a cycle raises ValueError.
    """
    rows = cut(edges.where(F.col("commit_hash").isNotNull()).select("commit_hash", F.col("parent_hash").alias("ancestor")).distinct())
    commits = cut(rows.select("commit_hash").unionByName(rows.where("ancestor IS NOT NULL").select(F.col("ancestor").alias("commit_hash"))).distinct())
    n, level, levels = commits.count(), rows.where("ancestor IS NOT NULL"), []
    while level.count():
        if 1 << len(levels) >= n:
            raise ValueError(f"a path of {1 << len(levels)} parents over {n} commits: the history has a cycle")
        levels.append(level)
        on = level.select(F.col("commit_hash").alias("ancestor"), F.col("ancestor").alias("far"))
        level = cut(level.join(on, "ancestor").select("commit_hash", F.col("far").alias("ancestor")).distinct())
    return History(levels, commits)
