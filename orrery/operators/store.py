"""The knowledge store of analysed files: built whole, or kept up by what a pull changes.

A pull takes the rows of the files that it touches as negative, the analysed ones as
positive, and adds up: edges and mirror rows that stay don't show, counters and entities
change by sums, and what comes to 0 is swept.  Nothing else of the tables is recomputed.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from . import pull as P
from .shared import cut

FILE, FOLDER = ["knowledge_id", "relative_path"], ["knowledge_id", "folder_path"]
ENTITY, KEYWORD = ["edge_type", "dst"], ["keyword", "type", "org_id"]
#: Columns of lists in an analysed file, and the channel of each.
CHANNELS = V.MIRROR_CHANNELS
#: Channels that are edges to entities too.
EDGES = ("HAS_KEYWORD", "HAS_CLASS", "HAS_FUNCTION", "HAS_IMPORT_INTERNAL", "HAS_IMPORT_EXTERNAL")
DEFAULT_ORG = "local"


@dataclass(frozen=True)
class Store:
    """file; folder with its counts; edge and entity; mirror and counter."""

    file: DataFrame
    folder: DataFrame
    edge: DataFrame
    entity: DataFrame
    mirror: DataFrame
    counter: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def channel_values(files: DataFrame) -> DataFrame:
    """(knowledge_id, relative_path, org_id, type, value) of all channels: keywords in lower case, values trimmed, blank ones left out, each once a file."""
    lists = {c: F.col(c) for c in CHANNELS if c in files.columns}
    if "keywords" in lists:
        lists["keywords"] = F.transform("keywords", F.lower)
    if "data_flow_direction" in lists:
        lists["data_flow_direction"] = F.array("data_flow_direction")
    row = F.array(*[F.struct(F.lit(CHANNELS[c]).alias("type"), F.transform(x, lambda v: F.btrim(v, F.lit(V.BLANKS))).alias("values")) for c, x in lists.items()])
    org = F.coalesce("org_id", F.lit(DEFAULT_ORG)).alias("org_id") if "org_id" in files.columns else F.lit(DEFAULT_ORG).alias("org_id")
    rows = files.select(*FILE, org, F.inline(row)).select(*FILE, "org_id", "type", F.explode(F.array_distinct("values")).alias("value"))
    return rows.where("value <> ''").distinct()


def edges_of(values: DataFrame) -> DataFrame:
    return values.where(F.col("type").isin(*EDGES)).select(F.col("type").alias("edge_type"), F.col("value").alias("dst"), *FILE)


def mirror_of(values: DataFrame) -> DataFrame:
    return values.select(F.col("value").alias("keyword"), "type", "org_id", *FILE, F.lit(1).cast("long").alias("frequency"))


def folders_of(files: DataFrame, sign=None) -> DataFrame:
    """(knowledge_id, folder_path, direct_files, all_files) of the files' folders and all above them, the root too; sign: a column of 1 and -1."""
    n = F.lit(1).cast("long") if sign is None else sign
    parts = F.split("relative_path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.concat_ws("/", F.slice(parts, 1, i)).alias("folder_path"), F.when(i == F.size(parts) - 1, n).otherwise(0).alias("direct")))
    rows = files.select("knowledge_id", n.alias("n"), F.inline(up))
    return rows.groupBy(*FOLDER).agg(F.sum("direct").alias("direct_files"), F.sum("n").alias("all_files"))


def _with_summaries(folders: DataFrame, summaries: DataFrame | None) -> DataFrame:
    """Folders with level, parent and summary, an empty one where none was made."""
    p = F.col("folder_path")
    out = folders.withColumn("summary", F.lit(None).cast("string")) if summaries is None else folders.join(summaries.select(*FOLDER, "summary"), FOLDER, "left")
    return out.select(*FOLDER, S.folder_level(p).cast("int").alias("level"), S.parent_folder(p).alias("parent_path"), F.coalesce("summary", F.lit("")).alias("summary"), "direct_files", "all_files")


def entities_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*ENTITY).agg(F.count("*").alias("n_files"))


def counters_of(mirror: DataFrame) -> DataFrame:
    return mirror.groupBy(*KEYWORD).agg(F.sum("frequency").alias("total_frequency"), F.count("*").alias("file_count"))


def build(files: DataFrame, summaries: DataFrame | None = None) -> Store:
    """The store of analysed files (one row a key), with summaries(knowledge_id, folder_path, summary; one row a key) where there are any.

    files: knowledge_id, relative_path, and of org_id and the channels' columns those there
    are; null lists and null values count as none, a null org_id as `local`.
    """
    values = channel_values(files)
    edge, mirror = edges_of(values), mirror_of(values)
    return Store(files, _with_summaries(folders_of(files), summaries), edge, entities_of(edge), mirror, counters_of(mirror))


def _signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that only one of two sets has: 1 for new ones, -1 for old ones."""
    both = old.withColumn("sign", F.lit(-1).cast("long")).unionByName(new.withColumn("sign", F.lit(1).cast("long")))
    return both.groupBy(*old.columns).agg(F.sum("sign").alias("sign")).where("sign <> 0")


def _exchanged(rows: DataFrame, signed: DataFrame, keys: list[str]) -> DataFrame:
    """rows without the negative ones of a difference, and with its positive ones."""
    kept = rows.join(signed.where("sign < 0").select(*keys), keys, "left_anti")
    return kept.unionByName(signed.where("sign > 0").select(*rows.columns))


def _summed(rows: DataFrame, delta: DataFrame, keys: list[str], sums: list[str], least: str) -> DataFrame:
    """rows with the sums of delta added; keys at 0 or less in `least` go.  Only the delta's keys are added up."""
    touched = rows.join(delta.select(*keys), keys, "left_semi").select(*keys, *sums).unionByName(delta.select(*keys, *sums))
    new = touched.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).where(F.col(least) > 0)
    return rows.join(delta.select(*keys), keys, "left_anti").select(*keys, *sums).unionByName(new)


def pull(store: Store, changes: DataFrame, analysed: DataFrame, summaries: DataFrame | None = None) -> tuple[Store, DataFrame]:
    """The store after changes(as from `pull.diff`), and (name, n) of what changed.

    Deleted and renamed-from files go.  Added, modified and renamed-to files take their row
    in analysed; without one they are skipped, so a modified file keeps its old row.
    Folders that the changes name get the summary of summaries, all others keep theirs;
    folders, entities and counters that no file has any more are swept.  The result equals
    `build` over the resulting files, but for summaries of folders that no change names.
    """
    gone = P.deleted_paths(changes).select(*FILE)
    new = cut(analysed.join(P.changed_paths(changes), FILE, "left_semi").dropDuplicates(FILE).select(*store.file.columns))
    touched = cut(gone.unionByName(new.select(*FILE)).distinct())
    file = store.file.join(touched, FILE, "left_anti").unionByName(new)
    values = channel_values(new)
    semi = lambda rows: rows.join(touched, FILE, "left_semi")
    edges = cut(_signed(semi(store.edge), edges_of(values).select(*store.edge.columns)))
    mirrors = cut(_signed(semi(store.mirror), mirror_of(values).select(*store.mirror.columns)))
    by_entity = edges.groupBy(*ENTITY).agg(F.sum("sign").alias("n_files")).where("n_files <> 0")
    by_keyword = mirrors.groupBy(*KEYWORD).agg(F.sum(F.col("frequency") * F.col("sign")).alias("total_frequency"), F.sum("sign").alias("file_count"))
    files = _signed(semi(store.file).select(*FILE), new.select(*FILE))
    by_folder = folders_of(files, F.col("sign")).where("direct_files <> 0 OR all_files <> 0")
    sizes = _summed(store.folder, by_folder, FOLDER, ["direct_files", "all_files"], "all_files")
    named = P.affected_folders(changes)
    old = store.folder.select(*FOLDER, "summary").join(named, FOLDER, "left_anti")
    told = old if summaries is None else old.unionByName(summaries.select(*FOLDER, "summary").join(named, FOLDER, "left_semi"))
    folder = _with_summaries(sizes, told)
    after = Store(
        file, folder, _exchanged(store.edge, edges, store.edge.columns), _summed(store.entity, by_entity, ENTITY, ["n_files"], "n_files"),
        _exchanged(store.mirror, mirrors, store.mirror.columns), _summed(store.counter, by_keyword, KEYWORD, ["total_frequency", "file_count"], "file_count"),
    )
    named_counts = {"files_upserted": new.agg(F.count("*")), "files_deleted": gone.agg(F.count("*")), "edges_added": edges.agg(F.count_if(F.col("sign") > 0)), "edges_removed": edges.agg(F.count_if(F.col("sign") < 0))}
    counts = reduce(DataFrame.unionByName, [rows.toDF("n").select(F.lit(name).alias("name"), "n") for name, rows in named_counts.items()])
    return after, counts


def orphans(before: Store, after: Store) -> DataFrame:
    """Entities that a pull swept."""
    return before.entity.select(*ENTITY).join(after.entity.select(*ENTITY), ENTITY, "left_anti")
