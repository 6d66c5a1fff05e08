"""Byte-level BPE (operator 11): texts to token ids and ids back to bytes, by the tiktoken library.

The vocabulary is a local file of ranks; it is of a fixed size, so it is broadcast as a
tiktoken encoding, which a Python worker builds once.  Long texts are encoded piece by
piece, cut only where every match of the pattern ends, so that the ids are the whole text's.
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, table

#: Characters of a long text that are encoded at once, about.
PIECE = 1 << 16
#: What the pattern's \s takes (Unicode's White_Space), as a regex class body.
SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: No match holds white space behind anything else, so one ends here whatever follows.
BOUNDARY = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


def pieces(text: str, size: int = PIECE):
    """(part, whole) in order: parts to be encoded by themselves; whole: the part is one match, not to be taken apart.

    A part has about `size` characters, but for stretches without white space, which stay
    together.  A run of over `size` white space characters is one match up to its last
    character, which goes with what follows (`\\s+(?!\\S)`), or all of it at the text's end;
    the regex engine would run out of stack on it.
    """
    if len(text) <= size:
        yield text, False
        return
    begin, run = 0, re.compile(f"[{SPACE}]{{{size + 1},}}")
    for m in run.finditer(text):
        end = m.end() - (m.end() < len(text))
        yield from _cut(text, begin, m.start(), size)
        yield text[m.start() : end], True
        begin = end
    yield from _cut(text, begin, len(text), size)


def _cut(text: str, begin: int, end: int, size: int):
    while end - begin > size and (m := BOUNDARY.search(text, begin + size, end)) and m.start() < end:
        yield text[begin : m.start()], False
        begin = m.start()
    if begin < end:
        yield text[begin:end], False


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A file of ranks (base64 of a token's bytes, space, rank, a line each): on the driver's disk, or any URI that Spark reads."""
    if "://" in path:
        lines = [r[0].encode() for r in spark.read.text(path).collect()]
    else:
        with open(path, "rb") as f:
            lines = f.readlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Coder:
    """An encoding and, for matches that must not be taken apart, one of the same ranks whose pattern takes all."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.ranks = ranks
        self.by_match = tiktoken.Encoding("by_match", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.as_one = None

    def encode(self, text: str, size: int = PIECE) -> list[int]:
        import tiktoken

        if len(text) <= size:
            return self.by_match.encode_ordinary(text)
        ids: list[int] = []
        for part, whole in pieces(text, size):
            if whole and self.as_one is None:
                self.as_one = tiktoken.Encoding("as_one", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
            ids += (self.as_one if whole else self.by_match).encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes | None:
        try:
            return self.by_match.decode_bytes(ids)
        except (KeyError, OverflowError, TypeError):
            return None


def coder(spark: SparkSession, path: str, pattern: str):
    """The vocabulary for all executors: a broadcast of fixed size, from which a worker makes its Coder once."""
    return spark.sparkContext.broadcast((read_ranks(spark, path), pattern, {}))


def _coder(shared) -> Coder:
    ranks, pattern, made = shared.value  # a worker keeps this value from task to task
    if not made:
        made["coder"] = Coder(ranks, pattern)
    return made["coder"]


def _adds(rows: DataFrame, source: str, name: str, kind: str, work, keep: bool) -> DataFrame:
    """rows with a column `name`, made from `source` by work(its Arrow array); source goes unless kept."""
    names = [c for c in rows.columns if c not in (name, "__in") and (keep or c != source)]
    kinds = dict(rows.dtypes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], work(batch.column(0))], [*batch.schema.names[1:], name])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{name}` {kind}"])
    return rows.select(rows[source].alias("__in"), *[rows[c] for c in names]).mapInArrow(run, schema)


def encode(docs: DataFrame, shared, keep_text: bool = False) -> DataFrame:
    """Per row of docs(text, and what else it has): its columns (text: if kept) and ids array<int>, those of the whole text.

    Each match of the pattern is encoded separately; strings of special tokens are ordinary
    text.  Null and empty texts have no ids.  Bytes that are not UTF-8 count as U+FFFD.
    Rows are taken one by one, so repeated and null ids are rows as any other, and no rows
    give none.  A column of docs named ids is replaced.  shared: see `coder`.
    """

    def work(column):
        import numpy as np
        import pyarrow as pa

        own = _coder(shared)  # a text's ids are packed at once, as Python's integers take eight times the room
        ids = [np.array(own.encode(x.as_buffer().to_pybytes().decode("utf-8", "replace")) if x.is_valid else [], np.int32) for x in column]
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), np.concatenate([np.zeros(0, np.int32), *ids]))

    return _adds(docs, "text", "ids", "array<int>", work, keep_text)


def decode(rows: DataFrame, shared) -> DataFrame:
    """Per row of rows(ids, and what else it has): its columns and decoded binary, the bytes of its ids.

    Raw bytes, as a token may be a part of a character.  Null ids, and ids of which one is
    null or not in the vocabulary: null.  A column of rows named decoded is replaced.
    """

    def work(column):
        import pyarrow as pa

        own = _coder(shared)
        return pa.array([own.decode(x.as_py()) if x.is_valid else None for x in column], pa.binary())

    return _adds(rows, "ids", "decoded", "binary", work, True)


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shared = coder(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = decode(encode(bare(table(spark, sf_dir, "documents"), "doc_id", "text"), shared), shared)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
