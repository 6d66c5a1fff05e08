"""MinHash near-dedup (operator 2): ProbMinHash signatures, banding, verification.

The shingles of a text are its runs of five words, with the number of times it has each as
weight.  Each is a Poisson process of arrivals, its rate the weight; every arrival falls on
a random register, which keeps the earliest one.  A shingle stops once its next arrival is
later than all registers: later ones can't matter.  The share of registers on which two
texts agree estimates their probability Jaccard similarity.  Where no shingle repeats that
is the Jaccard similarity of their sets; a text in which some do has a second sketch, with
all weights 1, so that copies are found whose only change is how often a passage occurs.
Bands of registers give candidates, and the two similarities, computed exactly from the
shingles, decide: the greater counts.  Texts with the same words are one node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bare, cut, sifted, table
from .tokens import LOWER, blocks, scramble, text_bytes, words

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 4: texts of similarity 0.8 share none with probability (1 - 0.8**4)**32 = 5e-8.
BANDS, PER_BAND = 32, 4
REGISTERS = BANDS * PER_BAND
#: Buckets of up to so many texts are compared pair by pair, larger ones block by block.
SMALL = 16
#: Texts, and bytes of their shingles, in a block, about.
BLOCK_TEXTS, BLOCK_BYTES = 256, 1 << 20
#: Bytes of text sketched at once; a longer text is a block by itself.
AT_ONCE = 1 << 18
#: A shingle (48 bits); and, in texts where some repeat, how often the text has it.
ONCE = np.dtype([("s", "<u4"), ("s2", "<u2")])
GRAM = np.dtype([("s", "<u4"), ("s2", "<u2"), ("w", "<u4")])
#: Rows of links in a task.
LINKS_A_TASK = 10_000
#: Steps from bucket to bucket in which texts find their home.
STEPS = 3
#: For sums of shares that round off.
SLACK = 1e-9


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, k: int = SHINGLE):
    """(row, shingle) of every run of k words; all words of a row that has fewer, but some, are one."""
    n = np.bincount(row, minlength=n_rows)
    first = np.cumsum(n) - n
    h = np.zeros(len(hashes), np.uint64)
    length = np.minimum(n, k)[row]
    for i in range(k):
        use = np.flatnonzero(i < length)
        use = use[use + i < len(hashes)]
        h[use] = scramble(h[use] * np.uint64(31) + hashes[np.minimum(use + i, len(hashes) - 1)] + np.uint64(i))
    start = np.arange(len(hashes)) - first[row] <= np.maximum(n - k, 0)[row]
    return row[start], h[start]


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_rows: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (row, register): the shingle whose arrival there is first, 0 in rows without shingles."""
    time = np.full((n_rows, m), np.inf)
    holder = np.zeros((n_rows, m), np.uint64)
    now, live, turn = np.zeros(len(row)), np.arange(len(row)), 0
    while len(live):
        turn += 1
        seed = scramble(shingle[live] + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        unit = ((seed >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        now[live] -= np.log(unit) / weight[live]
        live = live[now[live] < time.max(1)[row[live]]]
        if not len(live):
            break
        register = (scramble(shingle[live] ^ np.uint64(turn * 0x51ED270B)) % np.uint64(m)).astype(np.int64)
        # Of arrivals at one register the earliest comes last, and so stays.
        order = np.argsort(-now[live], kind="stable")
        r, g, e = row[live][order], register[order], live[order]
        better = now[e] < time[r, g]
        r, g, e = r[better], g[better], e[better]
        time[r, g] = now[e]
        holder[r, g] = shingle[e]
    return holder


def _weighted(row: np.ndarray, shingle: np.ndarray):
    """Distinct (row, shingle) in order, and how often each occurs."""
    order = np.lexsort((shingle, row))
    r, s = row[order], shingle[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return r[at], s[at], np.diff(np.append(at, len(r)))


def _digests(row: np.ndarray, hashes: np.ndarray, n_rows: int) -> list:
    """For each row a digest of its words in order, None without words."""
    import hashlib

    at = np.searchsorted(row, np.arange(n_rows + 1))
    return [hashlib.md5(hashes[x:y].tobytes()).digest() if x < y else None for x, y in zip(at[:-1], at[1:], strict=True)]


def _bands(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """(row, band): a hash of each band's registers, and of which band it is."""
    sig = signatures(row, shingle, weight, n_rows).reshape(n_rows, BANDS, PER_BAND)
    key = np.zeros((n_rows, BANDS), np.uint64)
    for i in range(PER_BAND):
        key = scramble(key * np.uint64(31) + sig[:, :, i])
    return scramble(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sketch(batches):
    """(doc_id, text) to (doc_id, same, bands): `same` tells texts with the same words, bands are hashes, BANDS of a sketch."""
    import pyarrow as pa

    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        same: list = []
        bands: list = []
        for a, b in blocks(offsets, AT_ONCE):
            _, _, row, h = words(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])
            names = _digests(row, h, b - a)
            r, s, w = _weighted(*shingles(h, row, b - a))
            keys = _bands(r, s, w.astype(np.float64), b - a).tolist()
            twice = np.unique(r[w > 1])
            if len(twice):
                use = np.isin(r, twice)
                plain = _bands(np.searchsorted(twice, r[use]), s[use], np.ones(use.sum()), len(twice)).tolist()
                for i, k in zip(twice.tolist(), plain, strict=True):
                    keys[i] = sorted({*keys[i], *k})
            same += names
            bands += [k if names[i] else None for i, k in enumerate(keys)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "same", "bands"])


def _sets(batches):
    """(node, same, text) to (node, grams, outline): the text's shingles with their numbers; only where its words are those of `same`."""
    import pyarrow as pa

    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        nodes, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: dict[str, list] = {"node": [], "grams": [], "outline": []}
        for a, b in blocks(offsets, AT_ONCE):
            _, _, row, h = words(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])
            names = _digests(row, h, b - a)
            r, s = shingles(h, row, b - a)
            r, s, w = _weighted(r, s & np.uint64((1 << 48) - 1))
            at = np.searchsorted(r, np.arange(b - a + 1))
            for i in range(b - a):
                if names[i] == wanted[a + i]:
                    out["node"].append(nodes[a + i])
                    own, n = s[at[i] : at[i + 1]], w[at[i] : at[i + 1]]
                    out["grams"].append(_pack(own, n))
                    out["outline"].append(_outline(own, n))
        columns = [pa.array(out["node"], pa.int64()), pa.array(out["grams"], pa.binary()), pa.array(out["outline"], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, list(out))


def _pack(shingle: np.ndarray, n: np.ndarray) -> bytes:
    """A byte that tells whether some shingle repeats, then the records."""
    repeats = len(n) and n.max() > 1
    out = np.zeros(len(shingle), GRAM if repeats else ONCE)
    out["s"], out["s2"] = shingle & np.uint64(0xFFFFFFFF), shingle >> np.uint64(32)
    if repeats:
        out["w"] = n
    return (b"\1" if repeats else b"\0") + out.tobytes()


def _unpack(data: bytes):
    """Sorted shingles and their shares of the text."""
    x = np.frombuffer(data, GRAM if data[0] else ONCE, offset=1)
    w = x["w"].astype(np.float64) if data[0] else np.ones(len(x))
    return x["s"].astype(np.uint64) | x["s2"].astype(np.uint64) << np.uint64(32), w / w.sum() if len(w) else w


def _outline(shingle: np.ndarray, n: np.ndarray) -> bytes:
    """Numbers of distinct shingles and of all, then a bit set for each shingle, of 2 to 4 times as many bits as shingles."""
    size = max(64, 1 << int(2 * len(shingle) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[shingle & np.uint64(size - 1)] = True
    return np.array([len(shingle), n.sum()], "<i8").tobytes() + np.packbits(bits, bitorder="little").tobytes()


def ceiling(x: bytes, y: bytes) -> float:
    """What the similarity of two texts can't exceed, from their outlines.

    A bit that only one text has is at least one shingle that only this one has: these bound
    what both hold, and the shares that they take, the sum of the lesser shares, which the
    probability Jaccard similarity does not exceed.  Bits of the longer outline are folded.
    """
    (n, n_all), (k, k_all) = (np.frombuffer(t, "<i8", 2).tolist() for t in (x, y))
    p, q = (np.frombuffer(t, np.uint8, offset=16) for t in (x, y))
    size = min(len(p), len(q))
    p, q = (np.bitwise_or.reduce(t.reshape(-1, size)) for t in (p, q))
    of_x, of_y = int(np.bitwise_count(p & ~q).sum()), int(np.bitwise_count(q & ~p).sum())
    common = min(n - of_x, k - of_y)
    jaccard = common / max(1, n + k - common)
    if n == n_all and k == k_all:
        return jaccard  # no shingle repeats in either text, so the sets say all
    return max(jaccard, 1 - max(of_x / max(1, n_all), of_y / max(1, k_all)))


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two distributions, from their shares x and y of what both hold.

    The sum, over what both hold, of 1 / sum(max(x' / x, y' / y)), the inner sum over all
    that either holds: in order of x / y those from here on give x' / x, the others y' / y.
    """
    if not len(x):
        return 0.0
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    from_here = np.cumsum(x[::-1])[::-1] + (1 - x.sum())
    before = np.cumsum(y) - y + (1 - y.sum())
    return float((1 / (from_here / x + before / y)).sum())


def similarity_of(s: np.ndarray, x: np.ndarray, t: np.ndarray, y: np.ndarray) -> float:
    """The greater of two texts' Jaccard and probability Jaccard similarity, from their shingles s, t and shares x, y."""
    _, at, own = np.intersect1d(s, t, assume_unique=True, return_indices=True)
    return max(len(at) / max(1, len(s) + len(t) - len(at)), probability_jaccard(x[at], y[own]))


def _similar(batches):
    """(a, b, grams_a, grams_b) to (a, b, similarity)."""
    import pyarrow as pa

    for batch in batches:
        out, kept = [], None
        left, right = batch.column(2), batch.column(3)
        for i in range(len(left)):
            y = right[i].as_py()
            if kept is None or kept[0] != y:
                kept = (y, *_unpack(y))
            out.append(similarity_of(*_unpack(left[i].as_py()), *kept[1:]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])


def _likely(similarity: float):
    """(a, b, outline_a, outline_b) to (a, b) of the pairs that may reach the similarity."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [ceiling(x, y) >= similarity - SLACK for x, y in zip(left, right, strict=True)]
            yield batch.select([0, 1]).filter(keep)

    return run


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, part) of nodes(node): part is the least node that links (a, b) lead to.

    Each round a node takes the least part among itself, its neighbours and its part's part.
    Tasks that write shuffle files get LINKS_A_TASK rows, about, so that few links make few files.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    tasks = -(-both.count() // LINKS_A_TASK) or 1
    both = both.coalesce(tasks)
    part = cut(both.select(F.col("a").alias("node")).distinct().coalesce(tasks).withColumn("part", F.col("node")))
    while True:
        near = both.join(part, both["b"] == part["node"]).select("a", "part").coalesce(tasks).groupBy("a").agg(F.min("part").alias("near"))
        step = part.join(near, part["node"] == near["a"]).select("node", "part", F.least("part", "near").alias("low")).coalesce(tasks)
        # The part's own new part: parts are few, and each node asks for one.
        up = step.groupBy("part").agg(F.min("low").alias("up")).withColumnRenamed("part", "p")
        new = step.join(up, step["part"] == up["p"]).select("node", F.least("low", "up").alias("part"), (F.least("low", "up") != F.col("part")).alias("moved"))
        new = cut(new.coalesce(tasks))
        part = new.select("node", "part")
        if not new.where("moved").limit(1).count():
            break
    rest = nodes.join(part, "node", "left")
    return rest.select("node", F.coalesce("part", "node").alias("part"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough; outlines, a tenth of the sets or less, go to all pairs, and the sets to those that are left."""

    def beside(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
        left, right = (sets.select(F.col("node").alias(x), F.col(what).alias(f"{what}_{x}")) for x in "ab")
        return pairs.join(left, "a").join(right, "b").select("a", "b", f"{what}_a", f"{what}_b")

    likely = cut(beside(pairs, sets, "outline").mapInArrow(_likely(similarity), "a long, b long"))
    rows = beside(likely, sifted(sets, "node", likely.select(F.explode(F.array("a", "b")).alias("node"))), "grams")
    return rows.mapInArrow(_similar, "a long, b long, similarity double").where(F.col("similarity") >= similarity - SLACK).select("a", "b")


def _shares(batches):
    """(node, grams) to a row for each shingle: (node, s, share, part_of_set)."""
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            s, w = _unpack(batch.column(1)[i].as_py())
            columns = [np.full(len(s), batch.column(0)[i].as_py()), s.view(np.int64), w, np.full(len(s), 1 / max(1, len(s)))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "s", "share", "part_of_set"])


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all ranges first:last, one after the other."""
    size = last - first
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _block_links(left: list, right: list, similarity: float):
    """Links (a, b), a > b, between texts (node, part, grams) of two blocks that join their parts: those that all links would join, by one link less than parts.

    The sum of the lesser shares bounds the probability Jaccard similarity from above, so only pairs that reach it are computed.
    """
    sets = [_unpack(m["grams"]) for m in right]
    nodes, parts = (np.array([m[k] for m in right], np.int64) for k in ("node", "part"))
    s, w = (np.concatenate([x[k] for x in sets]) for k in (0, 1))
    sizes = np.array([len(x[0]) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    even = np.array([len(x[1]) and x[1].min() == x[1].max() for x in sets], bool)
    order = np.argsort(s, kind="stable")
    s, w, owner = s[order], w[order], owner[order]
    # Parts as numbers, and by number what they are joined to so far.
    known = np.unique(np.concatenate([parts, [m["part"] for m in left]]))
    parts, joined = np.searchsorted(known, parts), np.arange(len(known))
    for m in left:
        own, share = _unpack(m["grams"])
        part = int(np.searchsorted(known, m["part"]))
        first, last = np.searchsorted(s, own), np.searchsorted(s, own, "right")
        at = _ranges(first, last)
        reach = np.bincount(owner[at], np.minimum(w[at], np.repeat(share, last - first)), minlength=len(sets))
        common = np.bincount(owner[at], minlength=len(sets))
        jaccard = common / np.maximum(1, len(own) + sizes - common)
        if len(share) and share.min() == share.max():
            reach[even] = 0  # no shingle repeats in either text, so the sets say all
        for i in np.flatnonzero((np.maximum(reach, jaccard) >= similarity - SLACK) & (joined[parts] != joined[part])):
            if joined[parts[i]] == joined[part]:
                continue
            if jaccard[i] >= similarity - SLACK or similarity_of(own, share, *sets[i]) >= similarity - SLACK:
                joined[joined == joined[parts[i]]] = joined[part]
                yield max(m["node"], int(nodes[i])), min(m["node"], int(nodes[i]))


def _meet(similarity: float):
    """(left, right), two blocks, to the links between them."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                links = list(_block_links(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), similarity))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _rest(shared: DataFrame, parts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links that join the parts of a large bucket's texts as all links would: of each two blocks as many as they have parts, at most.

    A text over 1 - similarity of whose shingles, and of whose weight, no other text of such
    buckets has can't have any, and goes first.  The others are dealt into blocks, each text into one: texts that
    buckets lead to from one another share a home, and a home is dealt by a hash.  Two
    blocks meet once if they have a bucket in common.
    """
    of = shared.where(F.col("size") > SMALL).join(parts, "node")
    split = of.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    open_ = cut(of.join(split, "key").select("key", "size", "node", "part"))
    home = open_.groupBy("node").agg(F.max_by("key", F.struct("size", "key")).alias("home"))
    for _ in range(STEPS):
        met = open_.select("key", "node").join(home, "node").groupBy("key").agg(F.min("home").alias("home"))
        home = cut(open_.select("key", "node").join(met, "key").groupBy("node").agg(F.min("home").alias("home")))
    some = sifted(sets.select("node", "grams"), "node", home.select("node"))
    who = cut(open_.select("node", "part").distinct().join(home, "node").join(some, "node"))
    held_by = who.select("node", "grams").mapInArrow(_shares, "node long, s long, share double, part_of_set double").groupBy("s")
    alone = held_by.agg(*[F.max(c).alias(c) for c in ("node", "share", "part_of_set")], F.count("*").alias("n")).where("n = 1").groupBy("node")
    alone = alone.agg(F.least(F.sum("share"), F.sum("part_of_set")).alias("own")).where(F.col("own") > 1 - similarity + SLACK).select("node")
    who = cut(who.join(alone, "node", "left_anti"))
    homes = who.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum(F.octet_length("grams")) / BLOCK_BYTES)).cast("long").alias("lots"))
    who = cut(who.join(homes, "home").withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("lots")))).select("node", "part", "grams", "block"))
    held = cut(who.groupBy("block").agg(F.collect_list(F.struct("node", "part", "grams")).alias("m"), F.min("part").alias("low"), F.max("part").alias("high")))
    keys = open_.select("key", "node").join(who.select("node", "block"), "node").select("key", "block").distinct()
    ends = held.select("block", "low", "high")
    two = keys.join(keys.withColumnRenamed("block", "other"), "key").where("block <= other").select("block", "other").distinct()
    two = two.join(ends, "block").join(ends.toDF("other", "low2", "high2"), "other").where("NOT (low = high AND low2 = high2 AND low = low2)")
    left, right = held.select("block", F.col("m").alias("left")), held.select(F.col("block").alias("other"), F.col("m").alias("right"))
    met = two.select("block", "other").join(left, "block").join(right, "other").select("left", "right")
    return met.mapInArrow(_meet(similarity), "a long, b long")


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (node, part) after links (a, b) between nodes of different parts."""
    low, high = (parts.select(F.col("node").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab")
    between = links.join(low, "a").join(high, "b").where("part_a <> part_b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct()
    became = components(parts.select(F.col("part").alias("node")).distinct(), between).select(F.col("node").alias("part"), F.col("part").alias("became"))
    return cut(parts.join(became, "part").select("node", F.col("became").alias("part")))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, same_id, class_id: one row per distinct doc_id of docs(doc_id, text).

    same_id: the least doc_id whose text has the same words in the same order; class_id: the
    least doc_id that is reached over links.  Links join texts whose five-word shingles (all
    words, of shorter texts) have a probability Jaccard similarity, with their counts as
    weights, or a Jaccard similarity, as sets, of `similarity` or more.  Candidates are texts with a band in common.  In each bucket
    every text is compared with the bucket's leader, the text in the largest buckets, as a
    common original is; then all pairs of a bucket that are still in different parts are
    compared, whatever its size.  Texts without words (null, empty) have classes of their
    own; null ids are left out; of rows with one doc_id the least text in order of `same`
    stands.  Other columns are ignored.
    """
    docs = docs.where(docs["doc_id"].isNotNull()).select("doc_id", "text")
    sketch = cut(docs.mapInArrow(_sketch, "doc_id long, same binary, bands array<long>"))
    one = cut(sketch.groupBy("doc_id").agg(F.min("same").alias("same")))
    by_text = cut(one.where(F.col("same").isNotNull()).groupBy("same").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    # The bands of each distinct text, from its least document; equal rows of that are one.
    nodes = sketch.join(by_text.select("same", F.col("node").alias("doc_id")), ["same", "doc_id"]).dropDuplicates(["same", "doc_id"])
    nodes = cut(nodes.select("same", F.col("doc_id").alias("node"), "bands"))
    posted = nodes.select("node", F.explode("bands").alias("key"))
    total = nodes.agg(F.sum(F.size("bands"))).first()[0] or 0
    sizes = cut(posted.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1))
    shared = cut(attach(sifted(posted, "key", sizes.select("key")), sizes, ["key"], "size", total))
    fame = shared.groupBy("node").agg(F.sum("size").alias("fame"))
    wanted = cut(fame.join(nodes.select("node", "same"), "node"))
    leaders = shared.join(wanted.select("node", "fame"), "node").groupBy("key").agg(F.min_by("node", F.struct(-F.col("fame"), F.col("node"))).alias("leader"), F.count("*").alias("n"))
    texts = sifted(docs, "doc_id", wanted.select("node"))
    texts = texts.join(wanted.select("node", "same").hint("shuffle_hash"), texts["doc_id"] == F.col("node")).select("node", "same", "text")
    sets = cut(texts.mapInArrow(_sets, "node long, grams binary, outline binary").dropDuplicates(["node"]))
    of_pair = [F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")]
    pairs = attach(shared, cut(leaders), ["key"], "n", total).where("node <> leader").select(*of_pair).distinct()
    parts = cut(components(wanted.select("node"), _verified(pairs, sets, similarity)))
    few = shared.where(F.col("size") <= SMALL).join(parts, "node").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "part"))).alias("m"))
    mates = few.select(F.explode("m").alias("x"), "m").select("x", F.explode(F.filter("m", lambda y: (y["node"] < F.col("x")["node"]) & (y["part"] != F.col("x")["part"]))).alias("y"))
    links = _verified(mates.select(F.col("x")["node"].alias("a"), F.col("y")["node"].alias("b")).distinct(), sets, similarity)
    parts = _joined(parts, cut(links.unionByName(_rest(shared, parts, sets, similarity))))
    by_text = cut(by_text.join(parts, "node", "left").select("same", "n", "node", F.coalesce("part", "node").alias("part")))
    with_text = attach(one.where(F.col("same").isNotNull()).select("doc_id", "same"), by_text, ["same"], "n", total // BANDS + 1)
    with_text = with_text.select("doc_id", F.col("node").alias("same_id"), F.col("part").alias("class_id"))
    bare_ids = one.where(F.col("same").isNull()).select("doc_id", F.col("doc_id").alias("same_id"), F.col("doc_id").alias("class_id"))
    return with_text.unionByName(bare_ids)


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(bare(table(spark, sf_dir, "documents"), "doc_id", "text"))
