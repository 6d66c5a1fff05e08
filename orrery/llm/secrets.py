"""Secret scans (operator 8), in DataFrame operations only.

Pattern kinds (assign, access, hex) and a fourth kind, entropy: a window slides over each
candidate string, its sum of c*log2(c) over character counts c changes by what enters and
leaves, and windows over the threshold of the string's character class merge to spans.
Windows that overlap an allowed word count for nothing.

All folds append to short arrays only: candidates are scanned in pieces of PIECE windows,
and positions are sums over blocks of matches, so time is linear in the text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, table

# The pattern kinds in order, each with its group to measure and the least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # of AKIA[A-Z0-9]+, those of 20 and more: such runs can't overlap shorter ones
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Entropy: window, candidate strings, and by character class (the first that fits) the threshold in bits.
#: About 19 of 20 windows of random characters of a class reach its threshold, few of words do; see the tests.
WINDOW, CANDIDATE = 20, r"[A-Za-z0-9+/_=-]{20,}"
CLASSES = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    "one case": (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 3.5),
    "mixed": (r"^[0-9A-Za-z]+$", 3.75),
    "base64": (r"", 3.75),
}
#: Candidates that are no secrets: without digits (words) or without letters (numbers), UUIDs.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
)
#: Words that mark a placeholder or a run of the alphabet, in either case: windows that overlap one are left out.
WORDS = ("example", "sample", "placeholder", "dummy", "changeme", "xxxxx", "abcdefgh", "0123456789")
#: Stands for an allowed word's characters; no candidate has it.
MASK = "."
PIECE, BLOCK = 256, 256


def _let(value, body) -> F.Column:
    """body(value), value computed once: a lambda's body would compute an expression anew wherever it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _append(acc, item):
    return F.concat(acc["out"], F.array(item))


def _running(values) -> F.Column:
    """Of a bound array<long> the sums before each value: over blocks, then within each."""
    none = F.array().cast("array<bigint>")
    sums = lambda x, start: F.aggregate(x, F.struct(start.alias("at"), none.alias("out")), lambda acc, v: F.struct((acc["at"] + v).alias("at"), _append(acc, acc["at"]).alias("out")), lambda acc: acc["out"])
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / BLOCK), F.lit(0)).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))
    zero = F.lit(0).cast("long")

    def within(parts):
        starts = sums(F.transform(parts, lambda x: F.aggregate(x, zero, lambda a, v: a + v)), zero)
        return _let(starts, lambda at: F.flatten(F.transform(parts, lambda x, k: sums(x, F.get(at, k)))))

    return _let(blocks, within)


def _located(text, pattern: str) -> F.Column:
    """array<struct<start, end, s>> of a pattern's leftmost matches, code points, end exclusive.

    A match starts where the matches and the gaps before it end.
    """
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("s"))
    length = lambda x: F.coalesce(F.char_length(x), F.lit(0)).cast("long")

    def placed(z):
        def one(x, at):
            start = at + length(x["gap"])
            return F.struct(start.cast("int").alias("start"), (start + length(x["s"])).cast("int").alias("end"), x["s"].alias("s"))

        before = _let(F.transform(z, lambda x: length(x["gap"]) + length(x["s"])), _running)
        # The last gap has no match behind it.
        return _let(before, lambda at: F.transform(F.slice(z, 1, F.size(z) - 1), lambda x, i: one(x, F.get(at, i))))

    return F.when(text.rlike(pattern), _let(zipped, placed)).otherwise(none)


def masked(s, words: tuple = WORDS) -> F.Column:
    """A candidate with the characters of allowed words masked."""
    for word in words:
        s = F.regexp_replace(s, f"(?i){word}", MASK * len(word))
    return s


SPANS = "array<struct<a:int,b:int>>"


def _merged(spans) -> F.Column:
    """Sorted spans, those that touch or overlap as one: the last one stays open until another begins behind it."""
    none = F.array().cast(SPANS)
    zero = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), none.alias("out"))
    closed = lambda acc: F.when(acc["a"] < 0, acc["out"]).otherwise(_append(acc, F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))

    def add(acc, x):
        grows = (acc["a"] >= 0) & (x["a"] <= acc["b"])
        return F.when(grows, F.struct(acc["a"].alias("a"), x["b"].alias("b"), acc["out"].alias("out"))).otherwise(F.struct(x["a"].alias("a"), x["b"].alias("b"), closed(acc).alias("out")))

    return F.aggregate(spans, zero, add, closed)


def _of_piece(chars, first, most, window: int) -> F.Column:
    """Hot windows of a piece, merged: chars is its bound array of characters, first the position of its first one."""
    terms = [c * math.log2(c) if c else 0.0 for c in range(window + 1)]
    gains = F.array(*[F.lit(b - a) for a, b in zip(terms, terms[1:], strict=False)])  # of one more of n
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("mask"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.array().cast(SPANS).alias("out"))
    closed = lambda acc: F.when(acc["a"] < 0, acc["out"]).otherwise(_append(acc, F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))

    def step(acc, i):  # i: from 1
        now, gone = F.get(chars, i - 1), F.get(chars, i - 1 - window)
        # What stays while the window slides: the characters that both windows have.
        stay = F.slice(chars, F.greatest(i - window + 1, F.lit(1)), F.least(i - 1, F.lit(window - 1)))
        count = lambda c: F.size(F.filter(stay, lambda x: x == c))
        total = acc["sum"] + F.get(gains, count(now)) - F.when(i > window, F.get(gains, count(gone))).otherwise(F.lit(0.0))
        mask = F.when(now == MASK, i).otherwise(acc["mask"])

        def moved(t):
            hot = (i >= window) & (t["mask"] <= i - window) & (t["sum"] <= most)
            a, b = first + i - window, first + i
            grows = (acc["a"] >= 0) & (a <= acc["b"])
            keep = F.struct(t["sum"].alias("sum"), t["mask"].alias("mask"), acc["a"].alias("a"), acc["b"].alias("b"), acc["out"].alias("out"))
            grown = F.struct(t["sum"].alias("sum"), t["mask"].alias("mask"), acc["a"].alias("a"), b.alias("b"), acc["out"].alias("out"))
            fresh = F.struct(t["sum"].alias("sum"), t["mask"].alias("mask"), a.alias("a"), b.alias("b"), closed(acc).alias("out"))
            return F.when(~hot, keep).when(grows, grown).otherwise(fresh)

        return _let(F.struct(total.alias("sum"), mask.alias("mask")), moved)

    return F.aggregate(F.sequence(F.lit(1), F.size(chars)), zero, step, closed)


def _hot_spans(s, window: int, classes: dict) -> F.Column:
    """array<struct<a, b>>: merged spans of the windows of s whose entropy reaches the threshold of its class."""
    least = F.lit(None).cast("double")
    for pattern, bits in reversed(list(classes.values())):
        least = F.when(s.rlike(pattern), F.lit(bits)).otherwise(least)
    most = (F.lit(math.log2(window)) - least) * window + 1e-9  # of the sum of c*log2(c)

    def pieces(x):
        # As bytes, of which a part is taken without a walk from the start; candidates are ASCII.
        starts = F.sequence(F.lit(0), F.char_length(s) - window, F.lit(PIECE))
        chars = lambda at: F.split(F.substring(x["data"], at + 1, F.lit(PIECE + window - 1)).cast("string"), "")
        return F.flatten(F.transform(starts, lambda at: _let(chars(at), lambda c: _of_piece(c, at, x["most"], window))))

    return _let(_let(F.struct(masked(s).cast("binary").alias("data"), most.alias("most")), pieces), _merged)


def scan(docs: DataFrame, window: int = WINDOW, classes: dict = CLASSES, allow: tuple = ALLOW) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, found array<struct<start, rank, kind, end>>, sorted.

    rank orders kinds at one start: assign, access, hex, entropy.  Null text: empty, nothing
    found.  Rows with null or repeated ids are scanned each by itself; no rows give no rows;
    other columns are ignored.  Time per text is linear in its length and matches.
    """
    t = F.coalesce(docs["text"], F.lit(""))
    assign = F.filter(_located(t, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["s"], ASSIGN, 2)) >= ASSIGN_LEAST)

    def entropy(m):
        allowed = F.lit(False)
        for pattern in allow:
            allowed = allowed | m["s"].rlike(pattern)
        spans = F.when(allowed, F.array().cast("array<struct<a:int,b:int>>")).otherwise(_hot_spans(m["s"], window, classes))
        return F.transform(spans, lambda x: F.struct((m["start"] + x["a"]).alias("start"), (m["start"] + x["b"]).alias("end")))

    rows = docs.select(docs["doc_id"], assign.alias("assign"), _located(t, ACCESS).alias("access"), _located(t, HEX).alias("hex"), _located(t, CANDIDATE).alias("long"))
    hot = F.flatten(F.transform("long", entropy))
    named = lambda a, rank, kind: F.transform(a, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    every = F.concat(named(F.col("assign"), 0, "assign"), named(F.col("access"), 1, "access"), named(F.col("hex"), 2, "hex"), named(hot, 3, "entropy"))
    return rows.select("doc_id", F.array_sort(every).alias("found"))


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(bare(table(spark, sf_dir, "documents"), "doc_id", "text"))
    text = lambda a: F.array_join(F.transform(a, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("found", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(text(F.filter("found", lambda m: m["rank"] < 3)).cast("binary"), 256)
    return found.select("doc_id", n("assign"), n("access"), n("hex"), base.alias("base_sha256"), text(F.col("found")).alias("spans"))
