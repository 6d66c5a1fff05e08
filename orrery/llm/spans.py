"""Suffix-array dedup (operator 9): bytes in 50-byte strings that a smaller doc_id has too.

1. Anchors.  Every 50-byte string has a least-hashed 16-byte gram, its anchor; strings that
   are equal have equal anchors.  Neighbouring strings with one anchor form a context.
2. Anchors meet by hash, packed to a few rows per batch, equal contexts of a batch as one.
   Equal contexts of an anchor are copies: all but the least document's go.  If an anchor
   has different contexts, those of the least documents are contested.
3. Contested contexts only, each distinct one once, and of them the stretches between
   strings that have an equal by hash, get suffix arrays by linear grouping (gsaca.py);
   equal 50-byte strings are neighbours there, compared byte by byte.  Contexts of an anchor
   with very many are taken apart first, by the 42 bytes that their strings have in common.
4. What each document loses comes back to it as names of contexts with masks, and its bytes go.

All is one plan, in which the texts and the marks are shuffled once and read twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, table
from .gsaca import suffix_array
from .tokens import blocks, powers, prefix_hash, scramble, text_bytes

SPAN, GRAM = 50, 16
#: Bytes of text for each hash bucket of anchors, about.
BUCKET_BYTES = 16 << 20
#: Bytes of contexts in one suffix array, and the distinct contexts of one anchor beyond which they are taken apart.
ARRAY_BYTES, CONTEXTS = 128 << 10, 1000
#: String starts in each piece of a context that is taken apart.
PIECE = 9
BLOCK = 1 << 18
#: An anchor and its context in 48 bits each, as packed in rows; marks name both in 62 bits and add what happens.
PAIR = np.dtype([("k", "<u4"), ("k2", "<u2"), ("c", "<u4"), ("c2", "<u2")])
ALL, ASK, APART = 1, 2, 3
LOW48 = np.uint64((1 << 48) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(row, first, last, key, context, at) of each run of span-byte strings with one anchor, at `at`; first, last: string starts."""
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    h = scramble(x[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ scramble(x[8:] + np.uint64(1)))
    bits = np.uint64(int(len(h)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, least = span - gram + 1, v
    reach = 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: reach - width], least[width - reach :])
    at = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    valid = np.arange(len(at)) + span <= offsets[row + 1]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    last = np.flatnonzero(ends)
    hash_at, inverse = prefix_hash(data), powers(len(data))[1]
    context = (hash_at[last + span] - hash_at[first]) * inverse[first] + ((at[first] - first) * 64 + last - first).astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)
    return row[first], first, last, h[at[first]] & LOW48, scramble(context) & LOW48, at[first]


def _binaries(data: np.ndarray, at: np.ndarray):
    """Arrow binaries of the records of data (a structured array) between the places in at."""
    import pyarrow as pa

    offsets = (at * data.dtype.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _unpacked(x: np.ndarray):
    wide = lambda a, b: x[a].astype(np.uint64) | x[b].astype(np.uint64) << np.uint64(32)
    return wide("k", "k2"), wide("c", "c2")


def _name(key: np.ndarray, context: np.ndarray) -> np.ndarray:
    """62 bits for an anchor with its context, above two bits that stay free."""
    return scramble(scramble(key) + context * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(3)


def _post(n_buckets: int):
    """(doc_id, text) to rows (bucket, docs, counts, pairs, gone), at most one per bucket and batch.

    pairs: the bucket's anchors with their contexts, each once, by the least document of the
    batch that has it; docs, counts: those documents and how many of the anchors each has.
    gone: the names of contexts that an equal one in the batch already marks, of the
    documents and counts in a row of their own.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, keys, contexts = [], [], []
            for a, b in blocks(offsets, BLOCK):
                row, _, _, key, context, _ = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows.append((row + a).astype(np.int32))
                keys.append(key)
                contexts.append(context)
            if not rows:
                continue
            row, key, context = np.concatenate(rows), np.concatenate(keys), np.concatenate(contexts)
            del rows, keys, contexts
            name = _name(key, context)
            if not len(name):
                continue
            order = np.argsort(name)
            doc, sorted_name = ids[row[order]], name[order]
            group = np.concatenate([[0], np.cumsum(sorted_name[1:] != sorted_name[:-1])])
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            earliest = doc == np.minimum.reduceat(doc, first)[group]
            later, kept, group = order[~earliest], order[earliest], group[earliest]  # later: copies within the batch
            kept = kept[np.concatenate([[True], group[1:] != group[:-1]])]
            del order, doc, sorted_name, first, earliest, group
            bucket = (key[kept] >> np.uint64(16)) * np.uint64(n_buckets) >> np.uint64(32)
            by = np.lexsort((row[kept], bucket))
            kept, bucket = kept[by], bucket[by].astype(np.int64)
            pairs = np.zeros(len(kept), PAIR)
            for part, whole in (("k", key), ("c", context)):
                pairs[part], pairs[f"{part}2"] = whole[kept] & np.uint64(0xFFFFFFFF), whole[kept] >> np.uint64(32)
            out = _runs(bucket, ids[row[kept]], pairs)
            yield _rows(*out[:3], pairs=out[3])
            if len(later):
                later = later[np.argsort(row[later], kind="stable")]
                some = np.full(len(later), int(name[later[0]] % np.uint64(n_buckets)), np.int64)
                out = _runs(some, ids[row[later]], name[later] | np.uint64(ALL))
                yield _rows(*out[:3], gone=out[3])

    return run


def _runs(bucket: np.ndarray, doc: np.ndarray, records: np.ndarray):
    """Buckets, and for each binaries of its documents, of their counts, and of their records; all in order."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(doc))).astype("<i4")
    used = np.unique(bucket)
    ends = np.append(np.searchsorted(bucket, used), len(bucket))
    doc_ends = np.searchsorted(at, ends)
    return used, _binaries(doc[at], doc_ends), _binaries(counts, doc_ends), _binaries(records, ends)


def _rows(bucket, docs, counts, pairs=None, gone=None):
    import pyarrow as pa

    none = pa.nulls(len(bucket), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), docs, counts, none if pairs is None else pairs, none if gone is None else gone], ["bucket", "docs", "counts", "pairs", "gone"])


def _meet(n_parts: int):
    """All anchors of some buckets to (part, docs, marks), one row for each part of the documents: contexts that go, and contested ones."""

    def run(batches):
        doc, marks = _met(batches)
        part = (scramble(doc.view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        doc, marks, part = doc[by], marks[by], part[by]
        used = np.unique(part)
        yield _marks_rows(used, doc, marks, np.append(np.searchsorted(part, used), len(part)))

    return run


def _marks_rows(part, doc, marks, ends):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), _binaries(doc, ends), _binaries(marks, ends)], ["part", "docs", "marks"])


def _by_document(batches):
    """(part, docs, marks), some parts whole, to (doc_id, marks): a row for each document."""
    import pyarrow as pa

    docs, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for batch in batches:
        docs += [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        marks += [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
    doc, mark = np.concatenate(docs), np.concatenate(marks)
    by = np.argsort(doc, kind="stable")
    doc, mark = doc[by], mark[by]
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(doc[at], pa.int64()), _binaries(mark, np.append(at, len(doc)))], ["doc_id", "marks"])


def _met(batches):
    """Documents and their marks."""
    doc, pairs, gone_doc, gone = [], [], [], []
    for batch in batches:
        for d, n, p, g in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            d = np.repeat(np.frombuffer(d, np.int64), np.frombuffer(n, "<i4"))
            if p is None:
                gone_doc.append(d)
                gone.append(np.frombuffer(g, np.uint64))
            else:
                doc.append(d)
                pairs.append(np.frombuffer(p, PAIR))
    if doc:
        doc, pairs = np.concatenate(doc), np.concatenate(pairs)
        key, context = _unpacked(pairs)
        del pairs
        order = np.lexsort((context, key))
        key, context, doc = key[order], context[order], doc[order]
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new = new_key | np.concatenate([[True], context[1:] != context[:-1]])
        first = np.flatnonzero(new_key)
        n = np.diff(np.append(first, len(key)))
        several = np.repeat(np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first), n)
        contexts = np.repeat(np.add.reduceat(new, first), n)
        same = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(doc, same), np.diff(np.append(same, len(key))))
        what = np.where(doc > least, ALL, np.where(contexts > CONTEXTS, APART, np.where(contexts > 1, ASK, 0))) * several
        use = np.flatnonzero(what)
        gone_doc.append(doc[use])
        gone.append(_name(key[use], context[use]) | what[use].astype(np.uint64))
    return np.concatenate([np.zeros(0, np.int64), *gone_doc]), np.concatenate([np.zeros(0, np.uint64), *gone])


def _of_row(row: np.ndarray, name: np.ndarray) -> np.ndarray:
    """A number for each (row, name)."""
    return scramble(name ^ scramble(row.astype(np.uint64) + np.uint64(1)))


def _marked(blobs: list) -> tuple:
    """(numbers, what) of all marks; blobs: per row a binary or None."""
    parts = [np.frombuffer(x or b"", np.uint64) for x in blobs]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    marks = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return _of_row(row, marks & ~np.uint64(3)), (marks & np.uint64(3)).astype(np.int64)


def _pieces(first: int, last: int, at: int):
    """(number, first, last, start and end of their common bytes) of the runs of strings that a context is taken apart into."""
    for k, low in enumerate(range(0, SPAN - GRAM + 1, PIECE)):  # bytes of a string before the anchor
        x, y = max(first, at - low - PIECE + 1), min(last, at - low)
        if x <= y:
            yield k, x, y, at - low, at - low - PIECE + 1 + SPAN


def _contested(batches):
    """(doc_id, text, marks) to (g, name, at, s, d): each contested context of a document once, or its pieces, with its bytes.

    g: the group that shares a suffix array; at: the first string of s, counted from the context's first.
    """
    import pyarrow as pa

    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        ids, blobs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for a, b in blocks(offsets, BLOCK):
            if not any(blobs[a:b]):
                continue
            number, what = _marked(blobs[a:b])
            asked = {w: number[what == w] for w in (ASK, APART)}
            if not any(map(len, asked.values())):
                continue
            own = data[offsets[a] : offsets[b]]
            row, first, last, key, context, at = anchors(own, offsets[a : b + 1] - offsets[a])
            name = _name(key, context)
            mine = _of_row(row, name)
            once = {}
            for w, numbers in asked.items():
                use = np.flatnonzero(np.isin(mine, numbers)) if len(numbers) else np.zeros(0, np.int64)
                once[w] = use[np.unique(mine[use], return_index=True)[1]]
            raw = own.tobytes()
            use = once[ASK]
            ends = zip(first[use].tolist(), (last[use] + SPAN).tolist(), strict=True)
            rows = list(zip(key[use].tolist(), name[use].tolist(), [0] * len(use), [raw[x:y] for x, y in ends], [ids[a + r] for r in row[use].tolist()], strict=True))
            for i in once[APART].tolist():
                for k, x, y, low, high in _pieces(int(first[i]), int(last[i]), int(at[i])):
                    group = int(prefix_hash(np.frombuffer(raw[low:high], np.uint8))[-1])
                    rows.append(((group & (1 << 60) - 1) << 2 | k, int(name[i]), x - int(first[i]), raw[x : y + SPAN], ids[a + row[i]]))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            cols[1] = np.array(cols[1], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["g", "name", "at", "s", "d"])


def least_holders(strings: list[bytes], docs: np.ndarray, span: int = SPAN) -> list[np.ndarray]:
    """For each string the least of docs (one per string) that has the span-byte string starting at each place."""
    text = b"\xff".join(strings) + b"\xff"  # no UTF-8 text has that byte
    data = np.frombuffer(text, np.uint8)
    n = np.array([len(s) for s in strings])
    start = np.cumsum(n + 1) - (n + 1)
    owner = np.repeat(np.arange(len(n)), n + 1)
    valid = np.arange(len(data)) - start[owner] <= n[owner] - span
    order = np.array(suffix_array(text), np.int64)
    order = order[valid[order]]
    held = np.full(len(data), np.iinfo(np.int64).max)
    if len(order):
        seen = np.lib.stride_tricks.sliding_window_view(data, span)[order]
        new = np.concatenate([[True], (seen[1:] != seen[:-1]).any(1)])
        least = np.minimum.reduceat(docs[owner[order]], np.flatnonzero(new))
        held[order] = np.repeat(least, np.diff(np.append(np.flatnonzero(new), len(order))))
    return [held[s : s + max(0, k - span + 1)] for s, k in zip(start, n, strict=True)]


def _shared_places(strings: list[bytes], span: int = SPAN) -> list[tuple[int, int] | None]:
    """For each string the first and last place whose span-byte string, by its hash, has an equal among them all; None without one."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    n = np.array([len(s) for s in strings])
    start, n_places = np.cumsum(n) - n, np.maximum(n - span + 1, 0)
    owner = np.repeat(np.arange(len(n)), n_places)
    at = np.arange(len(owner)) - (np.cumsum(n_places) - n_places)[owner]
    i = start[owner] + at
    h, inverse = prefix_hash(data), powers(len(data))[1]
    name = scramble((h[i + span] - h[i]) * inverse[i])
    order = np.argsort(name)
    equal = name[order][1:] == name[order][:-1]
    shared = np.zeros(len(name), bool)
    shared[order[1:][equal]] = shared[order[:-1][equal]] = True
    at, owner = at[shared], owner[shared]
    first = np.searchsorted(owner, np.arange(len(n) + 1))
    return [(int(at[x]), int(at[y - 1])) if x < y else None for x, y in zip(first[:-1], first[1:], strict=True)]


def _arrays(batches):
    """(g, name, at, s, d), a group's contexts together, to (d, lost): what each context loses, packed.

    Places without an equal elsewhere are their own document's and stay out of the suffix
    arrays.  Contexts from which nothing goes are left out.  lost: the name, the first
    string's place and the number of strings (8, 4 and 4 bytes), then a byte for each string.
    """
    import pyarrow as pa

    def done(rows):
        lost: list = [None] * len(rows)
        todo: list = []
        size = 0

        def decide():
            least: dict[bytes, int] = {}  # equal stretches are one
            for i, x, y in todo:
                s, d = rows[i][3][x : y + SPAN], rows[i][4]
                least[s] = min(d, least.get(s, d))
            found = dict(zip(least, least_holders(list(least), np.array(list(least.values()), np.int64)), strict=True))
            for i, x, y in todo:
                h = found[rows[i][3][x : y + SPAN]]
                if (h < rows[i][4]).any():
                    mask = np.zeros(len(rows[i][3]) - SPAN + 1, np.uint8)
                    mask[x : x + len(h)] = h < rows[i][4]
                    lost[i] = rows[i][1].to_bytes(8, "little", signed=True) + rows[i][2].to_bytes(4, "little") + len(mask).to_bytes(4, "little") + mask.tobytes()

        for i, (r, place) in enumerate(zip(rows, _shared_places([r[3] for r in rows]), strict=True)):
            if place:
                if size >= ARRAY_BYTES and rows[todo[-1][0]][0] != r[0]:
                    decide()
                    todo, size = [], 0
                todo.append((i, *place))
                size += place[1] - place[0] + SPAN
        if todo:
            decide()
        use = [i for i, x in enumerate(lost) if x]
        return pa.RecordBatch.from_arrays([pa.array([rows[i][4] for i in use], pa.int64()), pa.array([lost[i] for i in use], pa.binary())], ["d", "lost"])

    rows: list = []
    size = 0
    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if size >= BLOCK and r[0] != rows[-1][0]:
                yield done(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[3])
    if rows:
        yield done(rows)


def _losses(blobs: list):
    """(row, name, first place, mask) of all packed losses."""
    for row, parts in enumerate(blobs):
        for x in parts or ():
            yield row, int.from_bytes(x[:8], "little"), int.from_bytes(x[8:12], "little"), np.frombuffer(x, np.uint8, offset=16)


def _remove(batches):
    """(doc_id, text, marks, masks) to the row of the result, and the bytes kept."""
    import hashlib

    import pyarrow as pa

    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        blobs, masks = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for a, b in blocks(offsets, BLOCK):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            gone = np.zeros(len(own) + 1, np.int64)
            touched = [bool(blobs[i] or masks[i]) for i in range(a, b)]
            if any(touched):
                row, first, last, key, context, _ = anchors(own, at)
                mine = _of_row(row, _name(key, context))
                number, what = _marked(blobs[a:b])
                use = np.isin(mine, number[what == ALL])
                np.add.at(gone, first[use], 1)
                np.add.at(gone, last[use] + SPAN, -1)
                losses = list(_losses(masks[a:b]))
                if losses:
                    names = _of_row(np.array([r for r, _, _, _ in losses]), np.array([x for _, x, _, _ in losses], np.uint64))
                    by = np.argsort(mine, kind="stable")
                    low, high = np.searchsorted(mine[by], names), np.searchsorted(mine[by], names, "right")
                    for (_, _, place, mask), x, y in zip(losses, low, high, strict=True):
                        starts = (first[by[x:y], None] + place + np.flatnonzero(mask)).ravel()
                        np.add.at(gone, starts, 1)
                        np.add.at(gone, starts + SPAN, -1)
            covered = np.cumsum(gone)[:-1] > 0
            for i in range(b - a):
                here, raw = covered[at[i] : at[i + 1]], own[at[i] : at[i + 1]]
                n = int(here.sum()) if touched[i] else 0
                kept = (raw[~here] if n else raw).tobytes()
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(n)
                out["n_spans"].append(int(here[0]) + int((here[1:] & ~here[:-1]).sum()) if n else 0)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(out.values(), types, strict=True)], ["doc_id", *out])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id long, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    A byte goes if a SPAN-byte string over it also starts in a document of smaller doc_id.
    Rows of one doc_id are one document with several texts: they take nothing from each
    other.  Rows with a null id neither lose nor take.  Null or empty texts have 0 bytes,
    texts under SPAN bytes stay.  Other columns are ignored.
    """
    docs = docs.select(docs["doc_id"], docs["text"])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BUCKET_BYTES))
    posted = docs.where(F.col("doc_id").isNotNull()).mapInArrow(_post(n), "bucket int, docs binary, counts binary, pairs binary, gone binary")
    marks = posted.repartition(n, "bucket").mapInArrow(_meet(n), "part int, docs binary, marks binary")
    marks = marks.repartition(n, "part").mapInArrow(_by_document, "doc_id long, marks binary").withColumnRenamed("doc_id", "__id")
    rows = docs.join(marks.hint("shuffle_hash"), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "marks")
    held = rows.mapInArrow(_contested, "g long, name long, at int, s binary, d long")
    lost = held.repartition("g").sortWithinPartitions("g", "name").mapInArrow(_arrays, "d long, lost binary")
    masks = lost.groupBy(F.col("d").alias("__d")).agg(F.collect_list("lost").alias("masks"))
    rows = rows.join(masks.hint("shuffle_hash"), F.col("doc_id") == F.col("__d"), "left").select("doc_id", "text", "marks", "masks")
    return rows.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(bare(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
