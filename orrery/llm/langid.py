"""Language ID (operator 10): rank-order profiles and out-of-place distance.

A profile is a language's most frequent n-grams (of 1 to 3 lower-cased letters, with a blank
for whatever lies between words) in order.  A text's own most frequent n-grams, in order,
are compared with each profile: the sum of rank differences, K for an n-gram that the
profile does not hold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bare, share, shared_value, table
from .tokens import blocks, text_bytes

K = 400
#: Training texts per language, about: those of the smallest hashes.
SAMPLE_DOCS = 600
#: Bytes of text taken apart at once; a longer text is a block by itself.
AT_ONCE = 1 << 18
BLANK = 32


def held_out(doc_id, modulus: int, remainder: int) -> F.Column:
    """Whether crc32(doc_id as text) leaves the remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _characters(data: np.ndarray, offsets: np.ndarray):
    """Code points of lower-cased UTF-8 texts, whatever is no letter a blank, and where each text starts."""
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    if not len(code):
        return code, at
    used = np.flatnonzero(np.bincount(code))
    letter = np.zeros(used[-1] + 1, bool)
    letter[used] = [chr(c).isalpha() for c in used.tolist()]
    return np.where(letter[code], code, BLANK), at


def _grams(code: np.ndarray) -> np.ndarray:
    """The n-grams of 1 to 3 characters, 21 bits each: no blank inside, a letter at least, runs of blanks as one."""
    code = code[np.concatenate([[True], (code[1:] != BLANK) | (code[:-1] != BLANK)])] if len(code) else code
    blank = code == BLANK
    pair = code[:-1] | code[1:] << 21
    inside = ~blank[1:-1]
    return np.concatenate([code[~blank], pair, (pair[:-1] | code[2:] << 42)[inside]])


def lowered(column):
    import pyarrow.compute as pc

    return text_bytes(pc.utf8_lower(column))


def _count(batches):
    import pyarrow as pa

    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, offsets = lowered(batch.column(1))
        held: dict[str, list] = {}
        for a, b in blocks(offsets, AT_ONCE):
            code, at = _characters(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for i in range(b - a):
                held.setdefault(langs[a + i], []).append(_grams(code[at[i] : at[i + 1]]))
        for lang, parts in held.items():
            grams, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])


def fit_profiles(rows: DataFrame, k: int = K, sample_docs: int = SAMPLE_DOCS) -> dict[str, list[int]]:
    """language -> its k most frequent n-grams, from rows (doc_id, text, lang).

    Learns from sample_docs texts of each language, about, chosen by a hash of id and text,
    and counts all their n-grams on the executors; null texts and languages teach nothing,
    null ids do.  What comes to the driver is k numbers for each language, however many
    texts there are.  Ties go to the lesser n-gram.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("__n"))
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(counts), "lang").where(chance * F.col("__n") < sample_docs).select("lang", "text")
    grams = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():  # k rows a language
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Ranker:
    """Out-of-place distances of texts to profiles, kept as the places of each n-gram in the profiles that hold it."""

    def __init__(self, profiles: dict[str, list[int]], k: int):
        self.k, self.langs = k, list(profiles)
        gram = np.array([g for p in profiles.values() for g in p], np.int64)
        lang = np.repeat(np.arange(len(profiles)), [len(p) for p in profiles.values()]).astype(np.int32)
        rank = np.concatenate([np.arange(len(p)) for p in profiles.values()] or [np.zeros(0, np.int64)]).astype(np.int32)
        order = np.argsort(gram, kind="stable")
        self.gram, self.lang, self.rank = gram[order], lang[order], rank[order]

    def score(self, code: np.ndarray):
        """(index of the nearest language, score) of a text."""
        grams, counts = np.unique(_grams(code), return_counts=True)
        top = grams[np.argsort(-counts, kind="stable")[: self.k]]  # in order of the n-gram where counts are equal
        if not len(top) or not self.langs:
            return 0, 0.0
        first, last = np.searchsorted(self.gram, top), np.searchsorted(self.gram, top, "right")
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = self.k - np.abs(self.rank[at] - np.repeat(np.arange(len(top)), n))
        near = np.bincount(self.lang[at], near, minlength=len(self.langs))
        best = int(near.argmax())
        return best, float(near[best]) / (self.k * len(top))


def _predictor(shared, keep_text: bool):
    def run(batches):
        import pyarrow as pa

        ranker = shared_value(shared)
        for batch in batches:
            names = batch.schema.names
            data, offsets = lowered(batch.column(names.index("text")))
            langs, scores = [], []
            for a, b in blocks(offsets, AT_ONCE):
                code, at = _characters(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for i in range(b - a):
                    best, score = ranker.score(code[at[i] : at[i + 1]])
                    langs.append(ranker.langs[best] if ranker.langs else None)
                    scores.append(score)
            rest = [k for k in names if k != "text" or keep_text]
            yield pa.RecordBatch.from_arrays([batch.column(names.index(k)) for k in rest] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*rest, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: dict[str, list[int]], k: int = K, keep_text: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text, and what else it has): its columns (text: if kept), lang_pred, score.

    The whole text is ranked.  A text that is null or has no letter is `und` with score 0,
    as is every text where nothing was learned.  Ties go to the first language by name.
    Score: 1 less the distance's share of its maximum.  Repeated and null ids: row by row.
    Columns of docs named lang_pred or score are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "__letter")]
    shared = share(docs.sparkSession, Ranker(profiles, k))
    letter = F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False))
    kinds = dict(docs.dtypes)
    kept = [c for c in names if c != "text" or keep_text]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", __letter boolean, lang_pred string, score double"
    out = docs.select(*[docs[c] for c in names], letter.alias("__letter")).mapInArrow(_predictor(shared, keep_text), schema)
    known = F.col("__letter") & F.col("lang_pred").isNotNull()
    return out.select(*kept, F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(known, F.col("score")).otherwise(0.0).alias("score"))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = bare(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    profiles = fit_profiles(docs.where(~held_out(docs["doc_id"], 3, 1)))
    out = predict(docs.select("doc_id", "text", held_out(docs["doc_id"], 3, 1).alias("held_out")), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score")
