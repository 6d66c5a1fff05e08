"""Scored full text: a stored inverted index with term statistics, and ranked search over it.

Tables: `postings` (a word of a file's text, how often, the text's length), sorted by word
so that a search reads the row groups of its words only; `words` with their number of
files and the most that a word can add to a score; `grams`, the n-gram postings that find
the words that contain a term; `totals` by channel.  A search never reads a text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .search import ID, TEXTS, Scope, terms_of
from .shared import cut

#: Saturation and length weight of the score; characters of a gram.
K1, B, GRAM = 1.2, 0.75, 3
WORD = r"[\p{L}\p{N}_]+"
CHANNELS = ("purpose", "businessContext")
#: Words of the postings of a task that writes them, about.
ROWS = 5_000_000


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame
    words: DataFrame
    grams: DataFrame
    totals: DataFrame

    def save(self, path: str) -> None:
        """Writes the tables; postings by ranges of word and file, so a frequent word is in many files and a rare one in one."""
        parts = max(1, -(-(self.totals.agg(F.sum("length")).first()[0] or 0) // ROWS))
        order = ["channel", "word", *ID]
        for name in ("postings", "words", "grams", "totals"):
            rows = getattr(self, name)
            if name == "postings":
                rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            elif name == "grams":
                rows = rows.sort("channel", "gram", "word")
            rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "words", "grams", "totals")])


def saturation(tf, length, mean) -> F.Column:
    """How much an occurrence count is worth in a text of that length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def rarity(n, df) -> F.Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def build(files: DataFrame, channels: tuple = CHANNELS) -> TextIndex:
    """The index of files(knowledge_id, relative_path, and the channels' columns).

    Words are runs of letters, digits and `_`, in lower case; a channel's columns are one
    text, joined by a blank.  A null text has no words and counts as a text of length 0;
    rows with a null key are left out, repeated keys count as texts of their own.
    """
    text = F.array(*[F.struct(F.lit(c).alias("channel"), F.concat_ws(" ", *TEXTS[c]).alias("text")) for c in channels])
    rows = files.where(F.col("knowledge_id").isNotNull() & F.col("relative_path").isNotNull()).select(*ID, F.inline(text))
    rows = rows.select("channel", *ID, F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("all"))
    totals = rows.groupBy("channel").agg(F.count("*").alias("n"), F.sum(F.size("all")).cast("long").alias("length"))
    # Read for postings, words and grams: texts are taken apart once.
    tf = cut(rows.select("channel", *ID, F.size("all").cast("long").alias("length"), F.explode("all").alias("word")).groupBy("channel", *ID, "length", "word").agg(F.count("*").alias("tf")))
    best = saturation(F.col("tf"), F.col("length"), F.col("total") / F.col("n"))
    words = tf.join(totals.select("channel", "n", F.col("length").alias("total")), "channel").groupBy("channel", "word", "n").agg(F.count("*").alias("df"), F.max(best).alias("best"))
    words = cut(words.select("channel", "word", "df", (F.col("best") * rarity(F.col("n"), F.col("df"))).alias("most")))
    gram = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("word") - k + 1)), lambda i: F.substring("word", i, k))))))
    return TextIndex(tf, words, words.select("channel", gram.alias("gram"), "word"), totals)


def grams_of(term: str) -> list[str]:
    """The grams by which words that contain a term are found: itself if it is short."""
    return sorted({term[i : i + GRAM] for i in range(max(1, len(term) - GRAM + 1))})


def words_with(index: TextIndex, channel: str, terms: list[str]) -> DataFrame:
    """(term, word, df, most) of the indexed words that contain a term: those that have all its grams, looked at once more."""
    asked = {t: grams_of(t) for t in terms}
    found = index.grams.where((F.col("channel") == channel) & F.col("gram").isin(sorted({g for gs in asked.values() for g in gs})))
    held = found.groupBy("word").agg(F.collect_set("gram").alias("held"))  # as many as the query has grams
    has = [F.when(F.size(F.array_intersect("held", F.array(*map(F.lit, gs)))) == len(gs), F.when(F.col("word").contains(t), F.lit(t))) for t, gs in asked.items()]
    out = held.select("word", F.explode(F.array_compact(F.array(*has))).alias("term"))
    return out.join(index.words.where(F.col("channel") == channel).select("word", "df", "most"), "word")


def _scores(index: TextIndex, channel: str, words: DataFrame, scope: Scope) -> DataFrame:
    """(term, file, part): what each term adds to a file's score, that of its best word there."""
    total = index.totals.where(F.col("channel") == channel).select("channel", "n", (F.col("length") / F.col("n")).alias("mean"))
    rows = scope.on(index.postings.where(F.col("channel") == channel)).join(words, "word").join(F.broadcast(total), "channel")  # one row
    part = saturation(F.col("tf"), F.col("length"), F.col("mean")) * rarity(F.col("n"), F.col("df"))
    return rows.groupBy("term", *ID).agg(F.max(part).alias("part"))


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*ID).agg(F.sum("part").alias("score"))


def search(index: TextIndex, channel: str, query: str, scope: Scope = Scope(), cap: int = V.CHANNEL_CAP) -> DataFrame:
    """channel, knowledge_id, relative_path, score: the best `cap` files of `*term*` for each word of the query.

    A file's score sums, over the terms, the BM25 score of its best word that contains the
    term.  Files of the most promising term give a score that the last result must reach;
    terms that together cannot reach it are only looked up in files that have another term.
    A term is matched against words, so one that holds a blank or punctuation finds nothing.
    """
    terms = sorted(set(terms_of(query)))
    words = words_with(index, channel, terms)
    most = {r.term: r.most for r in words.groupBy("term").agg(F.max("most").alias("most")).collect()}  # a row a term
    order = sorted(most, key=lambda t: (-most[t], t))
    out = _scores(index, channel, words, scope)
    if len(order) > 1:
        first = _summed(_scores(index, channel, words.where(F.col("term") == order[0]), scope)).orderBy(F.desc("score")).limit(cap)
        seen = first.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        # The longest tail of terms that cannot reach the least of `cap` results by themselves.
        rest = len(order)
        while seen.n == cap and rest > 1 and sum(most[t] for t in order[rest - 1 :]) + 1e-6 < seen.least:
            rest -= 1
        if rest < len(order):
            strong = _scores(index, channel, words.where(F.col("term").isin(order[:rest])), scope)
            weak = _scores(index, channel, words.where(F.col("term").isin(order[rest:])), scope)
            out = strong.unionByName(weak.join(strong.select(*ID).distinct(), ID, "left_semi"))
    out = _summed(out).select(F.lit(channel).alias("channel"), *ID, F.round("score", 6).alias("score"))
    return out.orderBy(F.desc("score"), "relative_path", "knowledge_id").limit(cap)


def replace(index: TextIndex, files: DataFrame, gone: DataFrame, channels: tuple = CHANNELS) -> TextIndex:
    """The index after files(as for `build`) came or changed and the keys gone(knowledge_id, relative_path) went: their postings are exchanged, statistics follow.

    Texts without any word stay counted as long as their key isn't named again.
    """
    keys = files.select(*ID).unionByName(gone.select(*ID)).distinct()
    new = build(files, channels)
    kept = index.postings.join(keys, ID, "left_anti")
    lost = index.postings.join(keys, ID, "left_semi").groupBy("channel", *ID).agg(F.max("length").alias("length")).groupBy("channel").agg((-F.count("*")).alias("n"), (-F.sum("length")).alias("length"))
    totals = reduce(DataFrame.unionByName, (index.totals, new.totals, lost)).groupBy("channel").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    postings = kept.unionByName(new.postings)
    best = saturation(F.col("tf"), F.col("length"), F.col("total") / F.col("n"))
    words = postings.join(totals.select("channel", "n", F.col("length").alias("total")), "channel").groupBy("channel", "word", "n").agg(F.count("*").alias("df"), F.max(best).alias("best"))
    words = words.select("channel", "word", "df", (F.col("best") * rarity(F.col("n"), F.col("df"))).alias("most"))
    # Grams of words that are gone find nothing, as they have no statistics.
    return TextIndex(postings, words, index.grams.unionByName(new.grams).distinct(), totals)


def ranked(hits: DataFrame) -> DataFrame:
    """hits with `rank` in its channel."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("score"), "relative_path", "knowledge_id")))
