"""A corpus from documents to a training mix: five stages, each one of the library's operators.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one
the mix itself.  `run` chains them without tables in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import langid, lines, mixing, neardup, phrases
from orrery.llm.common import cut, marked, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is `und` (null texts, texts without letters) go; all others stay as they are.

    Repeated rows and null ids are judged row by row; without documents that teach, all go.
    """
    profiles = langid.fit_profiles(docs.select("doc_id", "text", "lang"))
    return langid.predict(docs.select(*COLUMNS), profiles, keep_text=True).where("lang_pred <> 'und'").select(*COLUMNS)


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines, and n_chars follows; every row stays, a null text as one empty line.

    Rows of one id are one document, so a line is not repeated by them; an empty table gives one.
    """
    out = lines.keep_bitmaps(docs.select(*COLUMNS))
    text = lines.kept_text(F.col("text"))
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least doc_id stays, with all rows of that id; rows with a null id all stay."""
    docs = docs.select(*COLUMNS)
    gone = cut(neardup.classes(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("__id")))
    # Only rows that may go are shuffled, with their texts.
    rows = marked(docs, "doc_id", gone)
    doubted = rows.where("__maybe")
    stay = doubted.join(gone.hint("shuffle_hash"), doubted["doc_id"] == gone["__id"], "left_anti")
    return rows.where("NOT __maybe").unionByName(stay).select(*COLUMNS)


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any passage of a benchmark item go, row by row; null texts have none and stay, as all do without items."""
    found = phrases.find_phrases(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep_text=True)
    return found.where("n_hit = 0").select(*COLUMNS)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which it takes words, and how many, repeats counted; null texts have none and are not in it."""
    return mixing.mix(docs.select("doc_id", "source", "text")).where("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]
#: Language ID and near-dedup have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
