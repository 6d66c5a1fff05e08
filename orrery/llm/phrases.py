"""Benchmark decontamination (operator 7): a distributed positional inverted index.

The index is dealt out by document: each block of training documents stores the postings
(sorted word positions) of every term that test items use.  A phrase is looked up from its
locally rarest term: its postings, minus the term's offset, are candidate starts, which
the other terms' offset-adjusted postings then thin out, rarer terms first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, bare, cut, share, shared_value, table
from .tokens import LOWER, blocks, text_bytes, words

WINDOW = 10
#: Bytes of test items in one broadcast; more items go in further broadcasts, one in memory at a time.
ITEM_BYTES = 16 << 20
#: Candidate starts tried at once.
AT_ONCE = 1 << 20
#: Words within which, and how many of an item's rarest words, the query asks for.
NEAR, RAREST = 20, 4
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lots(counts: np.ndarray):
    """(first, last) ranges of entries whose counts add up to AT_ONCE at most, or of one entry."""
    ends, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
        yield a, b
        a = b


class Phrases:
    """The distinct windows of test items, as term numbers, with the items that hold each."""

    def __init__(self, rows: list[tuple], window: int = WINDOW, rarest: list[tuple] = ()):
        """rows: (item_id as string or None, text or None); rarest: (item_id, its rarest words, rarest first)."""
        kept: dict[tuple, set] = {}
        for item, text in rows:
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            hashes = words(data, np.array([0, len(data)]))[3].tolist()
            for i in range(max(1, len(hashes) - window + 1) if hashes else 0):
                kept.setdefault(tuple(hashes[i : i + window]), set()).add(item)
        self.items = sorted({x for s in kept.values() for x in s if x is not None})
        number = {x: i for i, x in enumerate(self.items)}
        few = [np.frombuffer("\n".join(w).encode(), np.uint8) for _, w in rarest]
        few = [words(data, np.array([0, len(data)]))[3] for data in few]
        self.vocabulary = np.unique(np.concatenate([np.array([h for w in kept for h in w], np.uint64), *few]))
        self.near_items = [x for x, _ in rarest]
        self.rarest = np.full((len(few), max(map(len, few), default=1)), -1, np.int64)
        for i, h in enumerate(few):
            self.rarest[i, : len(h)] = np.searchsorted(self.vocabulary, h)
        self.length = np.array([len(w) for w in kept], np.int64)
        self.terms = np.full((len(kept), window), -1, np.int64)
        for i, w in enumerate(kept):
            self.terms[i, : len(w)] = np.searchsorted(self.vocabulary, np.array(w, np.uint64))
        owners = [sorted(number[x] for x in s if x is not None) for s in kept.values()]
        self.owner_at = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
        self.owners = np.array([x for o in owners for x in o], np.int64)


class Shard:
    """Postings of a block of documents for a vocabulary."""

    def __init__(self, hashes: np.ndarray, row: np.ndarray, n_rows: int, vocabulary: np.ndarray):
        at = np.searchsorted(vocabulary, hashes)
        at[at == len(vocabulary)] = 0
        self.term = np.where(vocabulary[at] == hashes, at, -1) if len(vocabulary) else np.full(len(hashes), -1)
        self.row, self.last = row, np.searchsorted(row, np.arange(n_rows), "right")  # past each row's last word
        self.first = np.searchsorted(row, np.arange(n_rows), "left")
        known = np.flatnonzero(self.term >= 0)
        self.postings = known[np.argsort(self.term[known], kind="stable")]
        self.count = np.bincount(self.term[known], minlength=len(vocabulary))
        self.at = np.concatenate([[0], np.cumsum(self.count)])

    def phrases(self, p: Phrases):
        """(window, first word) of every occurrence of p's windows."""
        if not len(p.terms) or not len(self.postings):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        used = p.terms >= 0
        counts = np.where(used, self.count[p.terms], np.iinfo(np.int64).max)
        order = np.argsort(counts, axis=1, kind="stable")
        least = np.take_along_axis(counts, order[:, :1], 1)[:, 0]
        live = np.flatnonzero(least > 0)
        out_w, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in lots(least[live]):
            ids = live[a:b]
            n = least[ids]
            w = np.repeat(ids, n)
            place = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            offset = order[w, 0]
            word = self.postings[self.at[p.terms[w, offset]] + place]
            row, start = self.row[word], word - offset
            ok = (start >= self.first[row]) & (start + p.length[w] <= self.last[row])
            w, start = w[ok], start[ok]
            for k in range(1, p.terms.shape[1]):
                if not len(w):
                    break
                offset = order[w, k]
                want = p.terms[w, offset]
                ok = (want < 0) | (self.term[np.minimum(start + offset, len(self.term) - 1)] == want)
                w, start = w[ok], start[ok]
            out_w.append(w)
            out_s.append(start)
        return np.concatenate(out_w), np.concatenate(out_s)

    def near(self, p: Phrases, span: int):
        """(row, item) where an item's rarest words lie within span words of an occurrence of its rarest one."""
        out = [np.zeros((2, 0), np.int64)]
        if not len(p.rarest) or not len(self.postings):
            return out[0]
        n_words = len(self.term)
        key = self.term[self.postings] * n_words + self.postings  # ascending
        counts = self.count[p.rarest[:, 0]]
        live = np.flatnonzero(counts)
        for a, b in lots(counts[live]):
            ids = live[a:b]
            n = counts[ids]
            item = np.repeat(ids, n)
            word = self.postings[np.repeat(self.at[p.rarest[ids, 0]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            for k in range(1, p.rarest.shape[1]):
                term = p.rarest[item, k]
                i = np.searchsorted(key, term * n_words + word)
                ok = term < 0
                for at in (i - 1, np.minimum(i, len(key) - 1)):  # the word's nearest neighbours among the term's postings
                    there = self.postings[at]
                    ok |= (at >= 0) & (self.term[there] == term) & (abs(there - word) <= span) & (self.row[there] == self.row[word])
                item, word = item[ok], word[ok]
            out.append(np.unique(np.stack([self.row[word], item]), axis=1))
        return np.unique(np.concatenate(out, axis=1), axis=1)


def rarest_words(items: DataFrame, n: int) -> DataFrame:
    """item_id, terms: the n words of an item that the fewest items hold, ties to the smaller word; rarest first."""
    low = F.translate("text", UPPER_CASE, LOWER_CASE)
    found = items.where("item_id IS NOT NULL").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)))).alias("word"))
    held = cut(found.distinct())
    counted = attach(held, held.groupBy("word").agg(F.count("*").alias("n")), ["word"], "n", held.count())
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("n", "word"))).where(F.col("place") <= n)
    return ranked.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("terms"))


def _matcher(parts, span, keep_text):
    def run(batches):
        import pyarrow as pa

        own_part = shared_value(parts[0]) if len(parts) == 1 else None
        for batch in batches:
            names = batch.schema.names
            data, offsets = text_bytes(batch.column(names.index("text")))
            cols = {k: [] for k in ("n_words", "n_hit", "items", "spans", "near_items")}
            for a, b in blocks(offsets, 1 << 18):
                own = offsets[a : b + 1] - offsets[a]
                _, _, row, hashes = words(LOWER[data[offsets[a] : offsets[b]]], own)
                hit = np.zeros(len(hashes) + 1, np.int64)
                items: list[set] = [set() for _ in range(b - a)]
                close: list[set] = [set() for _ in range(b - a)]
                for part in parts:
                    p = shared_value(part) if len(parts) > 1 else own_part
                    shard = Shard(hashes, row, b - a, p.vocabulary)
                    w, start = shard.phrases(p)
                    np.add.at(hit, start, 1)
                    np.add.at(hit, start + p.length[w], -1)
                    n = p.owner_at[w + 1] - p.owner_at[w]
                    owner = p.owners[np.repeat(p.owner_at[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    pairs = np.unique(np.stack([np.repeat(row[start], n), owner]), axis=1) if len(owner) else np.zeros((2, 0), np.int64)
                    for r, i in pairs.T.tolist():
                        items[r].add(p.items[i])
                    if span:
                        for r, i in shard.near(p, span).T.tolist():
                            close[r].add(p.near_items[i])
                    if len(parts) > 1:
                        del part._value  # the next part's turn: a worker reads it from its disk again later
                covered = np.cumsum(hit)[:-1] > 0
                cols["n_words"] += np.bincount(row, minlength=b - a).tolist()
                cols["n_hit"] += np.bincount(row[covered], minlength=b - a).tolist()
                cols["items"] += [sorted(x) for x in items]
                cols["near_items"] += [sorted(x) for x in close]
                spans: list[list] = [[] for _ in range(b - a)]
                edge = np.flatnonzero(covered & (np.concatenate([[True], ~covered[:-1]]) | np.concatenate([[True], row[1:] != row[:-1]]))) if len(covered) else []
                stop = np.flatnonzero(covered & (np.concatenate([~covered[1:], [True]]) | np.concatenate([row[1:] != row[:-1], [True]]))) if len(covered) else []
                first = np.searchsorted(row, np.arange(b - a))
                for s, e in zip(edge, stop):
                    r = int(row[s])
                    spans[r].append({"start": int(s - first[r]), "end": int(e + 1 - first[r])})
                cols["spans"] += spans
            strings, span_type = pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            types = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": strings, "spans": span_type, "near_items": strings}
            rest = [k for k in names if k != "text" or keep_text]
            yield pa.RecordBatch.from_arrays([batch.column(names.index(k)) for k in rest] + [pa.array(cols[k], t) for k, t in types.items()], rest + list(types))

    return run


def find_phrases(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int = 0, rarest: int = RAREST, keep_text: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text, ...): its columns (text: if kept), n_words, n_hit, items, spans, near_items.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters.  An
    item's windows are its runs of `window` words, or all of it if shorter.  n_hit: words
    inside any occurrence of any window; spans: their maximal runs, in words; items: sorted
    item_ids, as strings, with a window in the text.  near_items, with near > 0: items whose
    `rarest` rarest words (those that the fewest items hold, ties to the smaller word; all, if
    there are fewer) lie within `near` words of an occurrence of the rarest, in any order.
    Null or empty texts have no words and items without words no windows; an item with a
    null id hits words but is not listed; repeated ids are one item.  Documents with null or
    repeated ids are matched each by itself.  Columns of docs that have the names of results are replaced.
    """
    spark = docs.sparkSession
    items = items.select(items["item_id"].cast("string").alias("item_id"), items["text"])
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // ITEM_BYTES) or 1
    few = cut(rarest_words(items, rarest)) if near else None
    parts = []
    for k in range(n):  # each part is bounded by ITEM_BYTES, about; the driver holds one at a time
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        rare = few.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect() if near else []
        parts.append(share(spark, Phrases([(r[0], r[1]) for r in rows], window, [(r[0], r[1]) for r in rare])))
    results = ("n_words", "n_hit", "items", "spans", "near_items")
    names, kinds = [c for c in docs.columns if c not in results], dict(docs.dtypes)
    own = ", ".join(f"`{c}` {kinds[c]}" for c in names if c != "text" or keep_text)
    out = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, near_items array<string>"
    return docs.select(*[docs[c] for c in names]).mapInArrow(_matcher(parts, near, keep_text), f"{own}, {out}")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = bare(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = find_phrases(docs, bare(table(spark, sf_dir, "benchmark"), "item_id", "text"), near=NEAR)
    sha = lambda items: F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)
    counts = [F.size("items").cast("long").alias("n_items"), sha("items").alias("items_sha256"), F.size("near_items").cast("long").alias("n_near"), sha("near_items").alias("near_sha256")]
    return found.select("doc_id", "n_words", "n_hit", *counts, (F.col("n_hit") > 0).alias("contaminated"))


OP7_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS g, len(list_slice(w, s, s + 9)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT rid, n, s, list_slice(w, s, s + n - 1) AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
m AS (SELECT g.rid, g.n, g.s, win.item_id FROM g JOIN win ON g.n = win.n AND g.g = win.g),
h AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM m WHERE item_id IS NOT NULL) GROUP BY rid),
iw AS (SELECT DISTINCT item_id::VARCHAR AS x, unnest(w) AS word FROM i WHERE item_id IS NOT NULL),
rw AS (SELECT x, word, row_number() OVER (PARTITION BY x ORDER BY n, word) AS k FROM iw JOIN (SELECT word, count(*) AS n FROM iw GROUP BY word) USING (word)),
rare AS (SELECT * FROM rw WHERE k <= 4),
o AS (SELECT rid, x, k, p FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) JOIN rare USING (word)),
c AS (SELECT a.rid, a.x, a.p, count(DISTINCT o.k) AS found FROM o a JOIN o ON a.rid = o.rid AND a.x = o.x AND o.p BETWEEN a.p - 20 AND a.p + 20 WHERE a.k = 1 GROUP BY a.rid, a.x, a.p),
nr AS (SELECT DISTINCT rid, x FROM c JOIN (SELECT x, count(*) AS wanted FROM rare GROUP BY x) USING (x) WHERE found = wanted),
u AS (SELECT rid, count(*)::BIGINT AS n_near, string_agg(x, ',' ORDER BY x) AS ids FROM nr GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, COALESCE(h.n_hit, 0)::BIGINT AS n_hit, COALESCE(t.n_items, 0)::BIGINT AS n_items,
       sha256(COALESCE(t.ids, '')) AS items_sha256,
       COALESCE(u.n_near, 0)::BIGINT AS n_near, sha256(COALESCE(u.ids, '')) AS near_sha256, COALESCE(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN t ON d.rid = t.rid LEFT JOIN u ON d.rid = u.rid
"""
