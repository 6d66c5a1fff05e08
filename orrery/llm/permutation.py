"""Approximate nearest neighbours (operator 3): a permutation index.

A vector is represented by its nearest pivots in order and posted in the inverted file of
each of them, with its place.  Files are dealt out by vectors: a shard holds the files of
some thousand vectors, and is built once and stored.  A query reads the files of its own
pivots only, adds up footrule distances over their postings, and the candidates of least
distance are reranked by exact cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bare, cut, table

#: Pivots: the vectors of smallest hash, a bounded sample; places kept of each vector; share of a shard's rows reranked, and the least.
#: A query reads the files of PLACES of PIVOTS pivots: a tenth of all postings.
PIVOTS, PLACES, RERANKED, LEAST_RERANKED = 1024, 96, 0.1, 200
#: Rows of an index shard and of a query block, at most.
SHARD, QUERIES = 8192, 512
TOP = 5


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding array<double>) whose vectors are not null or zero and hold finite numbers only."""
    v = vectors.select(vectors["vec_id"], vectors["embedding"].cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which change no cosine, so that squares of tiny or huge components stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def choose_pivots(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """n usable vectors of the commonest length, those of smallest hash: (pivot, component), of length 1."""
    size = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not size:
        return np.zeros((0, 0))
    rows = vectors.where(F.size("embedding") == size[0][0]).orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(n).collect()
    p = scaled(np.array([r["embedding"] for r in rows]))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def places(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each row of x (of length 1), nearest first, ties to the smaller pivot."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k].astype(np.int16)


def _batches(batches, limit: int):
    """(ids, vectors) of up to `limit` rows, scaled."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        for a in range(0, len(ids), limit):
            yield ids[a : a + limit], scaled(x[a : a + limit])


def _packer(batches):
    import pyarrow as pa

    for ids, x in _batches(batches, QUERIES):
        yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in (ids, x)], ["q_ids", "qs"])


class Shard:
    """Inverted files of up to SHARD vectors.

    The postings lie file by file: those of pivot p from starts[p] to starts[p + 1], each the
    row of a vector and its weight, k less its place.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray, rows: np.ndarray, weights: np.ndarray, k: int):
        self.ids, self.x, self.starts, self.rows, self.weights, self.k = ids, x, starts, rows, weights, k
        self.norm = np.sqrt((x * x).sum(1))

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int) -> Shard:
        order = places(x / np.sqrt((x * x).sum(1))[:, None], pivots, k)
        k = order.shape[1]
        pivot = order.ravel()
        by_file = np.argsort(pivot, kind="stable")
        starts = np.searchsorted(pivot[by_file], np.arange(len(pivots) + 1)).astype(np.int64)
        return cls(ids, x, starts, (by_file // k).astype(np.uint16), (k - by_file % k).astype(np.uint16), k)

    def parts(self) -> list[bytes]:
        return [a.tobytes() for a in (self.ids, self.x, self.starts, self.rows, self.weights)]

    @classmethod
    def of(cls, ids: bytes, x: bytes, starts: bytes, rows: bytes, weights: bytes, d: int, k: int) -> Shard:
        get = np.frombuffer
        return cls(get(ids, np.int64), get(x, np.float64).reshape(-1, d), get(starts, np.int64), get(rows, np.uint16), get(weights, np.uint16), k)

    def closeness(self, q_places: np.ndarray) -> tuple[np.ndarray, int]:
        """Of each vector the sum of the lesser weights over a query's pivots, and the postings read.

        A pivot that only one side has counts as if at place k.  As |a - b| = a + b - 2 min(a, b), and
        all vectors' weights have one sum, the least footrule distance is the largest such sum.
        """
        spans = [slice(a, b) for a, b in zip(self.starts[q_places], self.starts[q_places + 1], strict=True)]
        sizes = [s.stop - s.start for s in spans]
        rows, weights = np.concatenate([self.rows[s] for s in spans]), np.concatenate([self.weights[s] for s in spans])
        least = np.minimum(weights, np.repeat(self.k - np.arange(len(q_places)), sizes))
        return np.bincount(rows, least, len(self.ids)), len(rows)

    def nearest(self, q: np.ndarray, qid: int, q_places: np.ndarray, reranked: float, top: int):
        """(ids, scores) of the `top` nearest rows by cosine among the share `reranked` of least footrule distance."""
        reranked = max(LEAST_RERANKED, int(reranked * len(self.ids)))
        close, _ = self.closeness(q_places)
        close[self.ids == qid] = 0
        if reranked < len(close):
            at = len(close) - reranked
            near = np.flatnonzero(close >= np.partition(close, at)[at])  # with all ties
        else:
            near = np.arange(len(close))
        near = near[self.ids[near] != qid]
        # Sums row by row, so that equal vectors have equal scores.
        cosine = (self.x[near] * q).sum(1) / (self.norm[near] * np.sqrt((q * q).sum()))
        best = np.lexsort((self.ids[near], -cosine))[:top]
        return self.ids[near][best], cosine[best]


FILES = "ids binary, x binary, starts binary, rows binary, weights binary"


def _poster(shared):
    def run(batches):
        import pyarrow as pa

        pivots, k = shared.value
        for ids, x in _batches(batches, SHARD):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary()) for part in Shard.build(ids, x, pivots, k).parts()], ["ids", "x", "starts", "rows", "weights"])

    return run


def _searcher(shared, reranked: float, top: int):
    def run(batches):
        import pyarrow as pa

        pivots, k = shared.value
        d = pivots.shape[1]
        seen, shard = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                *files, q_ids, qs = [batch.column(i)[row].as_py() for i in range(7)]
                if seen != files[0]:
                    seen, shard = files[0], Shard.of(*files, d, k)
                q, q_id = np.frombuffer(qs, np.float64).reshape(-1, d), np.frombuffer(q_ids, np.int64)
                order = places(q / np.sqrt((q * q).sum(1))[:, None], pivots, k)
                out = [shard.nearest(q[i], q_id[i], order[i], reranked, top) for i in range(len(q))]
                n = [len(o[0]) for o in out]
                cols = [np.repeat(q_id, n), np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


@dataclass(frozen=True)
class Index:
    """The stored files, a row a shard, and the pivots with the number of places, for all executors."""

    shards: DataFrame
    shared: object
    length: int


def index(vectors: DataFrame, pivots: int = PIVOTS, k: int = PLACES) -> Index | None:
    """The permutation index of vectors(vec_id long, embedding array of numbers); none if no row is usable.

    Rows with null ids, and vectors that are null, empty, zero, hold null or non-finite
    components, or differ in length from most, are not indexed; all others are, repeated ids
    each time.  Pivots are a bounded sample.
    """
    good = usable(vectors).where("vec_id IS NOT NULL")
    chosen = choose_pivots(good, pivots)
    if not len(chosen):
        return None
    shared = vectors.sparkSession.sparkContext.broadcast((chosen, min(k, len(chosen))))
    return Index(cut(good.where(F.size("embedding") == chosen.shape[1]).select("vec_id", "embedding").mapInArrow(_poster(shared), FILES)), shared, chosen.shape[1])


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, pivots: int = PIVOTS, k: int = PLACES, reranked: float = RERANKED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's `top` nearest rows found, ties to the smaller vec_id.

    vectors and queries: (vec_id long, embedding array of numbers); see `index` for those that
    take no part.  A query's own vec_id is no candidate; a repeated vec_id in vectors is a
    candidate each time, in queries it is asked once.  Fewer candidates than `top`: all of
    them; no queries: no rows.
    """
    return ask(index(vectors, pivots, k), queries, top, reranked)


def ask(found: Index | None, queries: DataFrame, top: int = TOP, reranked: float = RERANKED) -> DataFrame:
    """`search` over an index that is there."""
    if found is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = usable(queries).where("vec_id IS NOT NULL").dropDuplicates(["vec_id"])
    blocks = asked.where(F.size("embedding") == found.length).select("vec_id", "embedding").coalesce(max(1, asked.rdd.getNumPartitions() // 8)).mapInArrow(_packer, "q_ids binary, qs binary")
    # Each block of the stated query set meets each shard: a few packed rows on both sides.
    rows = found.shards.crossJoin(blocks).mapInArrow(_searcher(found.shared, reranked, top), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3_permutation_index(spark, sf_dir: str) -> DataFrame:
    vectors = bare(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors, vectors.where(vectors["vec_id"] % 50 == 0))
