"""Toxicity (operator 4): subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of its known subwords: its character n-grams and
itself, hashed to buckets.  A text is the average of its words that have any, and of one
end mark; a softmax over two classes follows.  Vectors and softmax are trained together,
by gradient steps over the whole sample in numpy.  Known are the buckets that one class
of the sample's texts has more often than chance explains; others would only tell the
sample's texts apart.  As everything before the softmax is linear, scoring needs one
number for each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, cut, table
from .langid import held_out
from .tokens import LOWER, blocks, powers, prefix_hash, scramble, text_bytes, words

BUCKETS, SIZES, WIDTH = 1 << 18, (3, 5, 7), 4
#: Labelled texts that are learned from, about, of each class: those of the smallest hashes.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 1500
#: Bytes of the sample's texts at most; a text that goes beyond is left out, the next smaller ones stay.
SAMPLE_BYTES = 32 << 20
STEPS, RATE, TOP_RATE, MOMENTUM = 300, 30.0, 0.1, 0.8
#: Bytes of sample texts that are taken apart at once.
FIT_BYTES = 256 << 10
#: Known buckets: shares of texts that have them differ by so many standard errors between the classes.
CHANCE = 8.0


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(word index, bucket) of the subwords of words data[start:end]: n-grams of <word>, and all of it."""
    n = end - start + 2
    at = np.cumsum(n) - n
    marked = np.full(int(n.sum()), ord("<"), np.uint8)
    marked[at + n - 1] = ord(">")
    inner = np.arange(int((end - start).sum())) - np.repeat(np.cumsum(end - start) - (end - start), end - start)
    marked[np.repeat(at + 1, end - start) + inner] = data[np.repeat(start, end - start) + inner]
    h, inverse = prefix_hash(marked), powers(len(marked))[1]
    word = np.repeat(np.arange(len(n)), n)
    left = np.repeat(at + n, n) - np.arange(len(marked))
    ids, owners = [scramble((h[at + n] - h[at]) * inverse[at])], [np.arange(len(n))]
    for size in SIZES:
        i = np.flatnonzero(left >= size)
        ids.append(scramble((h[i + size] - h[i]) * inverse[i] + np.uint64(size)))
        owners.append(word[i])
    return np.concatenate(owners), (np.concatenate(ids) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _sums(order_at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Row sums of values whose groups start at order_at (n groups, none empty)."""
    return np.add.reduceat(values, order_at, axis=0) if n else values[:0]


class Sparse:
    """Products with a sparse matrix (row, column, weight), each direction sorted once."""

    def __init__(self, row, col, weight, shape):
        self.shape, self.sides = shape, []
        for key, other in ((row, col), (col, row)):
            order = np.argsort(key, kind="stable")
            groups, at = np.unique(key[order], return_index=True)
            self.sides.append((other[order].astype(np.int32), weight[order].astype(np.float32)[:, None], groups, at))

    def times(self, x: np.ndarray, flip: bool = False) -> np.ndarray:
        other, weight, groups, at = self.sides[flip]
        out = np.zeros((self.shape[flip], x.shape[1]), np.float32)
        if len(groups):
            out[groups] = _sums(at, x[other] * weight, len(groups))
        return out


def _cells(raw: list[bytes], known: np.ndarray | None = None):
    """(row, bucket, share) over texts: share is what the bucket has in the text's average.

    Without known (a mask of buckets), each (row, bucket) that occurs, and shares of 0.
    """
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    start, end, row, h = words(data, offsets)
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, np.zeros(0, np.float32)
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    word, bucket = subwords(data, start[first], end[first])
    if known is not None:
        use = known[bucket]
        word, bucket = word[use], bucket[use]
    n_known = np.bincount(word, minlength=len(first))
    cell, n = np.unique(row * len(first) + of, return_counts=True)  # distinct words of each text
    d, w = cell // len(first), cell % len(first)
    if known is not None:
        d, w, n = d[n_known[w] > 0], w[n_known[w] > 0], n[n_known[w] > 0]
    total = np.bincount(d, n, len(raw)) + 1
    order = np.argsort(word, kind="stable")
    bucket, at = bucket[order], np.cumsum(n_known) - n_known
    size = n_known[w]
    place = np.repeat(at[w] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    key = np.repeat(d, size) * BUCKETS + bucket[place]
    if known is None:
        key = np.unique(key)
        return key // BUCKETS, key % BUCKETS, np.zeros(len(key), np.float32)
    key, of = np.unique(key, return_inverse=True)
    value = np.bincount(of, np.repeat(n / size / total[d], size), len(key))
    return key // BUCKETS, key % BUCKETS, value.astype(np.float32)


def _lots(raw: list[bytes]):
    return blocks(np.concatenate([[0], np.cumsum([len(r) for r in raw])]), FIT_BYTES)


def known_buckets(raw: list[bytes], y: np.ndarray) -> np.ndarray:
    """Mask of the buckets that texts of one class have more often than chance explains."""
    n = np.bincount(y, minlength=2).astype(float)
    have = np.zeros((2, BUCKETS))
    for a, b in _lots(raw):
        d, f, _ = _cells(raw[a:b])
        for label in (0, 1):
            have[label] += np.bincount(f[y[a:b][d] == label], minlength=BUCKETS)
    share, all_of = have / n[:, None], have.sum(0) / n.sum()
    error = np.sqrt(np.maximum(all_of * (1 - all_of), 1e-12) * (1 / n).sum())
    # In small samples no difference is that many errors wide: a third of the widest there can be is enough.
    return np.abs(share[1] - share[0]) > error * min(CHANCE, np.sqrt(1 / (1 / n).sum()) / 3)


def fit(texts: list, labels: list, prior: float | None = None, seed: int = 1) -> tuple[np.ndarray, float, float]:
    """(number per bucket, number of the end mark, bias): what makes up the log-odds of a text.

    Unknown buckets have 0.  prior: the share of label 1 among all labelled rows, if the
    sample's differs.  Needs both classes, else the bias alone says the class.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, np.float32), 0.0, 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    raw = [(t or "").encode() for t in texts]
    known = known_buckets(raw, y)
    used = np.append(np.flatnonzero(known), BUCKETS)  # the last one is the end mark
    column = np.cumsum(known) - 1
    parts = []
    for a, b in _lots(raw):
        d, f, value = _cells(raw[a:b], known)
        end = 1 - np.bincount(d, value, b - a)
        parts.append((np.concatenate([d, np.arange(b - a)]) + a, np.append(column[f], np.full(b - a, len(used) - 1)), np.append(value, end)))
    d, f, value = map(np.concatenate, zip(*parts, strict=True))
    bags = Sparse(d, f, value, (len(y), len(used)))
    rng = np.random.default_rng(seed)
    emb, top, bias = np.zeros((len(used), WIDTH), np.float32), rng.normal(0, 1, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    moved = [np.zeros_like(emb), np.zeros_like(top), np.zeros_like(bias)]
    for _ in range(STEPS):
        doc = bags.times(emb)
        z = doc @ top + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = p
        g[np.arange(len(y)), y] -= 1
        g /= len(y)
        for m, grad in zip(moved, (bags.times(g @ top.T, True), doc.T @ g, g.sum(0)), strict=True):
            m *= MOMENTUM
            m += grad
        emb, top, bias = emb - RATE * moved[0], top - TOP_RATE * moved[1], bias - TOP_RATE * moved[2]
    odds_of = emb @ (top[:, 1] - top[:, 0])
    table = np.zeros(BUCKETS + 1, np.float32)
    table[used] = odds_of
    odds = float(bias[1] - bias[0])
    if prior:
        odds += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return table[:BUCKETS], float(table[BUCKETS]), odds


def log_odds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, end_mark: float, bias: float) -> np.ndarray:
    """Of each row of a block of texts; texts without known subwords have the end mark and the bias."""
    data = LOWER[data]
    start, end, row, h = words(data, offsets)
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    word, bucket = subwords(data, start[first], end[first]) if len(first) else (start, start)
    number = table[bucket]
    n_known = np.bincount(word[number != 0], minlength=len(first))
    score = np.bincount(word, number, len(first)) / np.maximum(n_known, 1)
    n = len(offsets) - 1
    total = np.bincount(row, score[of], n) + end_mark
    return total / (np.bincount(row, n_known[of] > 0, n) + 1) + bias


def _scorer(shared):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            names = batch.schema.names
            data, offsets = text_bytes(batch.column(names.index("text")))
            odds = [log_odds(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], *model) for a, b in blocks(offsets)]
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(odds) if odds else np.zeros(0), -700, 700)))
            rest = [k for k in names if k != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(names.index(k)) for k in rest] + [pa.array(score, pa.float64())], [*rest, "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN, n_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float, float]:
    """A model from docs(doc_id, text) and labels(doc_id, toxic): n_toxic and n_clean texts, about, of n_bytes together at most.

    A doc_id with several labels is toxic if any says so; null labels and ids teach nothing.
    A doc_id with several rows teaches by its least text, once; null texts are empty.
    """
    marks = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = dict(marks.groupBy("toxic").count().collect())
    if not sizes:
        return fit([], [])
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxic")), F.lit(1 << 30)) / float(1 << 30)
    most = F.when(F.col("toxic") == 1, F.lit(n_toxic / sizes.get(1, 1))).otherwise(F.lit(n_clean / sizes.get(0, 1)))
    sample = marks.where(chance < most)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = cut(texts)
    sizes_of = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").collect()
    chosen, held = [], 0
    for r in sizes_of:  # a row for each sample text
        if held + r["size"] <= n_bytes:
            chosen.append((r["doc_id"],))
            held += r["size"]
    chosen = docs.sparkSession.createDataFrame(chosen, f"doc_id {dict(docs.dtypes)['doc_id']}")
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy("doc_id").collect()
    prior = sizes.get(1, 0) / sum(sizes.values())
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], prior if 0 < prior < 1 else None)


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """Per row of docs(doc_id, text, and what else it has): its columns but text, and score (0 to 1).

    Whole texts are scored.  Null or empty texts, and texts without words, get what the
    bias alone says.  Repeated and null ids: row by row.  No rows give no rows.
    """
    names = [c for c in docs.columns if c not in ("text", "score")]
    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in names) + "score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*[docs[c] for c in names], docs["text"]).mapInArrow(_scorer(shared), schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = bare(table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = bare(table(spark, sf_dir, "labels"), "doc_id", "toxic")
    model = train(docs, labels.where(~held_out(labels["doc_id"], 4, 2)))
    out = score(docs.select("doc_id", "text", held_out(docs["doc_id"], 4, 2).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
