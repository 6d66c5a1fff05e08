"""Phrase collocation mining (operator 12): phrases of two and three words that hold together, per language.

Texts become blocks of codes into a dictionary of the block's own, so they are taken apart
once.  Summed over blocks, the dictionaries give the frequent words, numbered densely; a
block gets the numbers of its own words back by a join, and all other words break its
pieces.  Numbers of two or three neighbouring words are packed into keys of 16 bytes, sorted
by radix and run-length counted within the block, dealt out by ranges of the key, and sorted
and summed there.  Scores are joins of what is frequent.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bare, cut, table

LEAST, TOP, INSIDE = 10, 2000, 50
#: Words of a block; bytes of a text that are split at once; keys of a range, about; blocks from which ranges are
#: drawn, and of whose sorted keys each SAMPLED_KEY-th; parts in which a language's first rows are found.
BLOCK, CHUNK, RANGE, SAMPLED_BLOCKS, SAMPLED_KEY, PARTS = 1_500_000, 1 << 20, 2_000_000, 64, 1024, 64
#: A word's number has 42 bits, so three of them fit into two words of 64 bits.
BITS = 42
#: Bytes A-Z in lower case, those that end a piece as a full stop, tabs as blanks.
TO_WORDS = bytes(46 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def radix_order(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The order of 128-bit keys: a stable counting sort by 16 bits at a time, from the last ones."""
    order = np.arange(len(hi))
    for word in (lo, hi):
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(hi: np.ndarray, lo: np.ndarray, n: np.ndarray):
    """Distinct keys in order, and the sums of n."""
    order = radix_order(hi, lo)
    hi, lo, n = hi[order], lo[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, np.int64)
    return hi[first], lo[first], np.add.reduceat(n, first) if len(first) else n


def packed(*columns: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, as planes of sorted or small numbers compress well."""
    import pyarrow as pa

    planes = b"".join(np.ascontiguousarray(c.reshape(-1, 1).view(np.uint8).T).tobytes() for c in columns)
    return pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpacked(data: bytes, n: int, *kinds) -> list[np.ndarray]:
    import pyarrow as pa

    size = [np.dtype(k).itemsize for k in kinds]
    planes, out, at = np.frombuffer(pa.Codec("zstd").decompress(data, n * sum(size), asbytes=True), np.uint8), [], 0
    for kind, s in zip(kinds, size, strict=True):
        out.append(np.ascontiguousarray(planes[at : at + n * s].reshape(s, n).T).view(kind).ravel())
        at += n * s
    return out


class Block:
    """Codes of texts, 0 where a piece ends, and the words that they stand for."""

    def __init__(self):
        self.lang_of, self.words, self.codes, self.size, self.skip, self.by_lang = [], [], [np.zeros(1, np.int32)], 0, 0, {}

    def number(self, lang: str) -> dict:
        if lang not in self.by_lang:
            block, nth = self, len(self.by_lang)

            class Numbers(dict):
                def __missing__(self, word):
                    block.lang_of.append(nth)
                    block.words.append(word)
                    self[word] = len(block.words)
                    return len(block.words)

            self.by_lang[lang] = Numbers({b".": 0})
        return self.by_lang[lang]

    def add(self, lang: str, words: list[bytes]) -> None:
        self.codes.append(np.fromiter(map(self.number(lang).__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def end_text(self) -> None:
        self.codes.append(np.zeros(1, np.int32))

    def row(self) -> dict:
        codes = np.concatenate(self.codes)
        n = np.bincount(codes[1 + self.skip :], minlength=len(self.words) + 1)[1:]
        # No word has a line end, so one text holds them all; arrays of texts would take several times the room.
        return {"langs": list(self.by_lang), "lang_of": self.lang_of, "words": b"\n".join(self.words), "counts": n, "codes": packed(codes), "n_codes": len(codes), "skip": 1 + self.skip}

    def next(self, lang: str) -> Block:
        """A block that goes on in the middle of a piece: it has its last two words once more, not to be counted again."""
        last = np.concatenate(self.codes[-3:])[-2:]
        last = last[int(np.flatnonzero(last == 0)[-1]) + 1 :] if (last == 0).any() else last
        new = Block()
        new.add(lang, [self.words[i - 1] for i in last])
        new.skip = len(last)
        return new


SHAPE = "langs array<string>, lang_of array<int>, words binary, counts array<int>, codes binary, n_codes long, skip int"


def _blocks(batches):
    import pyarrow as pa

    kinds = pa.schema([("langs", pa.list_(pa.string())), ("lang_of", pa.list_(pa.int32())), ("words", pa.binary()), ("counts", pa.list_(pa.int32())), ("codes", pa.binary()), ("n_codes", pa.int64()), ("skip", pa.int32())])
    block = Block()
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            lang, data, at = lang.as_py(), text.as_buffer().to_pybytes().translate(TO_WORDS).replace(b".", b" . "), 0
            while at < len(data):
                end = data.find(b" ", at + CHUNK)
                end = len(data) if end < 0 else end
                block.add(lang, data[at:end].split())
                at = end
                if block.size >= BLOCK:
                    yield pa.RecordBatch.from_pylist([block.row()], kinds)
                    block = block.next(lang)
            block.end_text()
    if block.size > block.skip:
        yield pa.RecordBatch.from_pylist([block.row()], kinds)


def _keys(codes, skip, pos, number):
    """Sorted distinct keys (as two words) of a block's phrases, and how often each occurs."""
    known = np.zeros(int(codes.max(initial=0)) + 1, np.uint64)
    known[pos + 1] = number
    ids = known[codes]
    a, b, c = ids[:-1], ids[1:], np.append(ids[2:], np.uint64(0))
    two = (a > 0) & (b > 0)
    three = two & (c > 0)
    two[: skip - 1] = three[: max(0, skip - 2)] = False
    first, second = np.concatenate([a[two], a[three]]), np.concatenate([b[two], b[three]])
    third = np.concatenate([np.zeros(int(two.sum()), np.uint64), c[three]])
    low = np.uint64(2 * BITS - 64)  # bits of the second number in the second word
    hi = first << np.uint64(64 - BITS) | second >> low
    lo = (second & np.uint64((1 << (2 * BITS - 64)) - 1)) << np.uint64(BITS) | third
    return run_lengths(hi, lo, np.ones(len(hi), np.int64))


def _of_blocks(batches):
    for batch in batches:
        at = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            (codes,) = unpacked(at["codes"][i].as_py(), at["n_codes"][i].as_py(), np.int32)
            entry = at["numbers"][i].values
            yield _keys(codes, at["skip"][i].as_py(), entry.field("pos").to_numpy(), entry.field("id").to_numpy())


def _sample(batches):
    import pyarrow as pa

    for hi, lo, _ in _of_blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x[::SAMPLED_KEY].view(np.int64)) for x in (hi, lo)], ["hi", "lo"])


def _deal(bounds: list[tuple[int, int]]):
    """Each block's keys as a row a range: those from a bound up to the next."""

    def run(batches):
        import pyarrow as pa

        for hi, lo, n in _of_blocks(batches):
            cuts = [0]
            for h, low in bounds:
                a, b = np.searchsorted(hi, np.uint64(h)), np.searchsorted(hi, np.uint64(h), "right")
                cuts.append(int(a + np.searchsorted(lo[a:b], np.uint64(low))))
            cuts.append(len(hi))
            own = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            step = lambda x: np.diff(x, prepend=np.uint64(0))
            data = [packed(step(hi[a:b]), lo[a:b], n[a:b].astype(np.uint32)) for _, a, b in own]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in own], pa.int32()), pa.array([b - a for _, a, b in own], pa.int64()), pa.array(data, pa.binary())], ["range", "n_keys", "keys"])

    return run


def _sum(least: int):
    """The keys of a range that occur at least so often, as numbers; memory: the range's distinct keys and one more lot."""

    def run(rows):
        import pyarrow as pa

        have, lot, size = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)], [], 0
        for n, data in zip(rows["n_keys"], rows["keys"], strict=True):
            hi, lo, count = unpacked(data.as_py(), n.as_py(), np.uint64, np.uint64, np.uint32)
            lot.append((np.cumsum(hi, dtype=np.uint64), lo, count.astype(np.int64)))
            size += len(lo)
            if size >= RANGE:
                have, lot, size = run_lengths(*(np.concatenate(x) for x in zip(have, *lot, strict=True))), [], 0
        hi, lo, n = run_lengths(*(np.concatenate(x) for x in zip(have, *lot, strict=True)))
        hi, lo, n = (x[n >= least] for x in (hi, lo, n))
        low = 2 * BITS - 64
        ids = hi >> np.uint64(64 - BITS), (hi & np.uint64((1 << (64 - BITS)) - 1)) << np.uint64(low) | lo >> np.uint64(BITS), lo & np.uint64((1 << BITS) - 1)
        return pa.table({k: pa.array(x.astype(np.int64)) for k, x in zip(("id1", "id2", "id3", "a"), (*ids, n), strict=True)})

    return run


def numbered(words: DataFrame) -> DataFrame:
    """words with a column id: 1, 2, ... without gaps.  words is used twice: pass one that stays as it is, with `row` a monotonically_increasing_id."""
    part = F.shiftright("row", 33)
    sizes = words.groupBy(part.alias("part")).agg(F.count("*").alias("size"))  # a row a partition
    sizes = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return words.join(sizes, part == sizes["part"]).withColumn("id", F.col("before") + F.col("row").bitwiseAND((1 << 33) - 1) + 1).drop("part", "before", "row")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs(lang string, text): words (id, lang, word, f) and phrases (id1, id2, id3 or 0, a) that occur `least` times or more, and (lang, n) of all words.

    Occurrences are contiguous within pieces, overlaps included.
    """
    spark = docs.sparkSession
    blocks = cut(docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), docs["text"]).mapInArrow(_blocks, SHAPE).withColumn("block", F.monotonically_increasing_id()))
    words = F.split(F.col("words").cast("string"), "\n", -1).alias("word")
    pairs = blocks.select("block", "langs", F.posexplode(F.arrays_zip(words, "lang_of", "counts")).alias("pos", "x")).select("block", "pos", F.get("langs", F.col("x.lang_of")).alias("lang"), "x.word", F.col("x.counts").alias("n"))
    totals = cut(pairs.groupBy("lang").agg(F.sum("n").alias("n")))
    words = pairs.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = cut(numbered(cut(words.withColumn("row", F.monotonically_increasing_id()))).select("id", "lang", "word", "f"))
    # One entry for each word of a block, so a word has a row a block at most.
    numbers = pairs.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("pos", "id")).alias("numbers"))
    coded = blocks.select("block", "codes", "n_codes", "skip").join(numbers, "block")
    # Bounds of the ranges, from a bounded number of blocks.
    n = 2 * (totals.agg(F.sum("n")).first()[0] or 0)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE))
    some = [r[0] for r in blocks.select("block").orderBy(F.xxhash64("block")).limit(SAMPLED_BLOCKS).collect()]
    seen = sorted((r.hi % (1 << 64), r.lo % (1 << 64)) for r in coded.where(F.col("block").isin(some)).mapInArrow(_sample, "hi long, lo long").collect())
    bounds = sorted({seen[len(seen) * k // ranges] for k in range(1, ranges)}) if seen else []
    dealt = coded.mapInArrow(_deal(bounds), "range int, n_keys long, keys binary")
    phrases = cut(dealt.groupBy("range").applyInArrow(_sum(least), "id1 long, id2 long, id3 long, a long"))
    return words, phrases, totals


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two or three words that occur `least` times or more and are none's part.

    docs(lang, text): A-Z count as a-z; `.,;:!?` and line ends end a piece, blanks and tabs
    a word.  n: words of the language; l, r: occurrences of the phrase's parts where it
    holds least, the first such cut; score: floor(10**6 a a / (l r)), exactly.  A phrase is
    a part of a longer one that holds it and occurs `inside` percent as often or more.
    Null lang: `und`.  Null and empty texts have no words, repeated rows count each time,
    no rows give no phrases; other columns of docs are ignored.
    """
    words, found, totals = phrase_counts(bare(docs, "lang", "text"), least)
    one, two = [words.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else [])) for k in (1, 2)]
    pairs = cut(found.where("id3 = 0").drop("id3").join(one, "id1").join(two, "id2"))
    triples = found.where("id3 > 0")
    left = pairs.select("id1", "id2", "lang", "w1", "w2", "f1", F.col("a").alias("f12"))
    right = pairs.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
    triples = cut(triples.join(left, ["id1", "id2"]).join(right, ["id2", "id3"]))
    longer = triples.select("id1", "id2", F.col("a").alias("longer")).unionByName(triples.select(F.col("id2").alias("id1"), F.col("id3").alias("id2"), F.col("a").alias("longer")))
    pairs = pairs.join(longer.groupBy("id1", "id2").agg(F.max("longer").alias("longer")), ["id1", "id2"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    both = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.array(F.struct(F.col("f1").alias("l"), F.col("f2").alias("r"))).alias("cuts"))
    both = both.unionByName(triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.array(F.struct(F.col("f1").alias("l"), F.col("f23").alias("r")), F.struct(F.col("f12").alias("l"), F.col("f3").alias("r"))).alias("cuts")))
    wide = lambda x: f"CAST({x} AS DECIMAL(15,0))"  # noqa: E731  up to 10**15, so all products are below 10**38
    score = F.expr(f"transform(cuts, (c, i) -> struct((1000000BD * {wide('a')} * {wide('a')}) div ({wide('c.l')} * {wide('c.r')}) AS score, i AS k, c.l AS l, c.r AS r))")
    best = both.withColumn("best", F.array_min(score))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score").join(totals, "lang")


def first_of_langs(found: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first `top` rows, ranked by score, then a (both descending), then phrase; found in parts first, as one language may hold most rows."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return out.where(F.col("rank") <= top).drop("part")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return first_of_langs(collocations(table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT COALESCE(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
o AS (SELECT lang, p, unnest(w) AS x, unnest(range(len(w))) AS i FROM p),
s AS (SELECT lang, x, lead(x, 1) OVER q AS y, lead(x, 2) OVER q AS z FROM o WINDOW q AS (PARTITION BY p ORDER BY i)),
t AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
f1 AS (SELECT lang, x, count(*) AS a FROM s GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS a FROM s WHERE y IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, x, y, z, count(*) AS a FROM s WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c2 AS (SELECT f2.lang, f2.x, f2.y, f2.a, l.a AS l, r.a AS r FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 r ON r.lang = f2.lang AND r.x = f2.y WHERE f2.a >= 10),
c3 AS (
  SELECT f3.*, v.k, v.l, v.r FROM f3 JOIN f1 a ON a.lang = f3.lang AND a.x = f3.x JOIN f2 bc ON bc.lang = f3.lang AND bc.x = f3.y AND bc.y = f3.z
  JOIN f2 ab ON ab.lang = f3.lang AND ab.x = f3.x AND ab.y = f3.y JOIN f1 c ON c.lang = f3.lang AND c.x = f3.z,
  LATERAL (SELECT * FROM (VALUES (1, a.a, bc.a), (2, ab.a, c.a)) v(k, l, r)) v),
longer AS (SELECT lang, x, y, max(a) AS a FROM (SELECT lang, x, y, a FROM f3 UNION ALL SELECT lang, y, z, a FROM f3) GROUP BY ALL),
c AS (
  SELECT c2.lang, c2.x || ' ' || c2.y AS phrase, c2.a, 1 AS k, c2.l, c2.r FROM c2 LEFT JOIN longer g ON g.lang = c2.lang AND g.x = c2.x AND g.y = c2.y WHERE COALESCE(100 * g.a < 50 * c2.a, true)
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, a, k, l, r FROM c3),
b AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM c),
m AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM k JOIN t USING (lang) WHERE rank <= 2000
"""
