"""Merkle manifest of a dataset (operator 13): a hash tree for each group of rows, and one over the groups' roots.

Rows are sorted by ranges of (group, key), so a partition holds consecutive leaves.  Its
first group's number of leaves in earlier partitions says where they stand in the tree;
every other group begins in the partition.  Each partition builds the subtrees that it
holds whole; of those only the ragged boundary nodes, whose sibling stands elsewhere, are
shuffled by their coordinate, and the upper levels are finished from them, some levels a
round.  A row's proof is its path in the partition and the path of its boundary node.

Nodes are 32 bytes.  A step of a proof is L (sibling to the left), R (to the right) or N
(none: an odd last node) and the sibling's digest.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, cut, share, shared_value, table

#: Rows of a partition, about, in large tables; levels that a round finishes above the partitions' own.
ROWS, FIRST, LEVELS = 50_000, 4, 8


def tagged(value) -> F.Column:
    """A field of a leaf: `-` if null, else its UTF-8 byte count, `:` and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values) -> F.Column:
    """The digest of a row of such fields."""
    return F.unhex(F.sha2(F.concat(*[tagged(v) for v in values]).cast("binary"), 256))


def _hex(digest) -> F.Column:
    return F.lower(F.hex(digest))


def fold(leaf, proof) -> F.Column:
    """The root, as lower-case hex, that a leaf (binary) and its proof lead to."""

    def up(own, step):
        other, side = _hex(F.substring(step, 2, 32)), F.substring(step, 1, 1).cast("string")
        pair = F.when(side == "L", F.concat(other, own)).when(side == "R", F.concat(own, other)).otherwise(own)
        return F.sha2(pair.cast("binary"), 256)

    return F.aggregate(proof, _hex(leaf), up)


def proof_digest(proof) -> F.Column:
    """The digest of a proof's siblings as hex text, from the leaf upwards."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: _hex(F.substring(s, 2, 32))), "").cast("binary"), 256)


def parent(*children: bytes) -> bytes:
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def at_level(leaves: int, level: int) -> int:
    """Nodes of a level of a tree of so many leaves."""
    return -(-leaves >> level)


def subtrees(begin: int, digests: list[bytes], leaves: int) -> list[tuple[int, list[bytes]]]:
    """By level (first node, digests) of the nodes all of whose leaves are among those from `begin` on."""
    levels = [(begin, digests)]
    for k in range(height(leaves)):
        first, own = levels[-1]
        odd = first & 1
        above = [parent(own[i], own[i + 1]) for i in range(odd, len(own) - 1, 2)]
        if (len(own) - odd) & 1 and first + len(own) == at_level(leaves, k):
            above.append(parent(own[-1]))
        if not above:
            break
        levels.append(((first + 1) >> 1, above))
    return levels


def ragged(levels: list[tuple[int, list[bytes]]]) -> list[tuple[int, int, bytes]]:
    """(level, node, digest) of the nodes of `subtrees` whose parent isn't there: two of a level at most."""
    out = []
    for k, (first, own) in enumerate(levels):
        above, n_above = (levels[k + 1][0], len(levels[k + 1][1])) if k + 1 < len(levels) else (0, 0)
        out += [(k, i, own[i - first]) for i in sorted({first, first + len(own) - 1}) if not above <= i >> 1 < above + n_above]
    return out


def step(i: int, level: int, leaves: int, node) -> bytes:
    """The step from node i of a level to its parent; node(j): a digest of that level."""
    if i & 1:
        return b"L" + node(i - 1)
    return b"R" + node(i + 1) if i + 1 < at_level(leaves, level) else b"N"


class Places:
    """Where each partition's groups stand: of its first group the leaves before it, of its first and last group all leaves."""

    def __init__(self, ends: list):
        total: dict[str, int] = {}
        self.by_part: dict[int, tuple] = {}
        for e in sorted(ends, key=lambda e: e.part):
            before = total.get(e.first.g, 0)
            for g, n in {(e.first.g, e.first.n), (e.last.g, e.last.n)}:
                total[g] = total.get(g, 0) + n
            self.by_part[e.part] = (e.first.g, before, e.last.g)
        self.by_part = {p: (f, before, total[f], last, total[last]) for p, (f, before, last) in self.by_part.items()}
        self.largest = max(total.values(), default=0)

    def of(self, part: int, g: str, n: int) -> tuple[int, int]:
        """(first leaf, leaves of the whole group) of a group with n leaves in a partition."""
        first, before, n_first, last, n_last = self.by_part[part]
        return (before, n_first) if g == first else (0, n_last) if g == last else (0, n)


def _groups(batches):
    """(group, partition, its part of a sorted partition as record batches) one by one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    now, parts = None, []
    for batch in batches:
        g = batch.column(batch.schema.names.index("g"))
        while batch.num_rows:
            own = g[0].as_py()
            n = pc.sum(pc.equal(g, own)).as_py()  # sorted: the first n
            if parts and own != now:
                yield now, pa.Table.from_batches(parts)
                parts = []
            now = own
            parts.append(batch.slice(0, n))
            batch, g = batch.slice(n), g.slice(n)
    if parts:
        yield now, pa.Table.from_batches(parts)


def _trees(batches, shared):
    places = shared_value(shared)
    for g, rows in _groups(batches):
        begin, leaves = places.of(rows["part"][0].as_py(), g, rows.num_rows)
        yield g, rows, begin, leaves, subtrees(begin, rows["leaf"].to_pylist(), leaves)


def _boundary(shared):
    def run(batches):
        import pyarrow as pa

        for g, _, _, leaves, levels in _trees(batches, shared):
            level, node, digest = zip(*ragged(levels), strict=True)
            n = len(level)
            yield pa.RecordBatch.from_arrays([pa.array([g] * n), pa.array(level, pa.int32()), pa.array(node, pa.int64()), pa.array(digest, pa.binary()), pa.array([leaves] * n, pa.int64())], ["g", "level", "node", "digest", "leaves"])

    return run


def _paths(shared):
    def run(batches):
        import pyarrow as pa

        for _, rows, begin, leaves, levels in _trees(batches, shared):
            level, node, proofs = [], [], []
            for i in range(begin, begin + rows.num_rows):
                k, proof = 0, []
                while k + 1 < len(levels) and 0 <= (i >> 1) - levels[k + 1][0] < len(levels[k + 1][1]):
                    first, own = levels[k]
                    proof.append(step(i, k, leaves, lambda j: own[j - first]))  # noqa: B023
                    k, i = k + 1, i >> 1
                level.append(k)
                node.append(i)
                proofs.append(proof)
            out = rows.drop(["part"]).append_column("level", pa.array(level, pa.int32())).append_column("node", pa.array(node, pa.int64())).append_column("local", pa.array(proofs, pa.list_(pa.binary())))
            yield from out.combine_chunks().to_batches()

    return run


def _finish(to: int):
    """The nodes of one block, up to its top at level `to` or the tree's root."""

    def run(key, rows):
        import pyarrow as pa

        leaves, top = rows["leaves"][0].as_py(), min(to, height(rows["leaves"][0].as_py()))
        have = {(k, i): d for k, i, d in zip(rows["level"].to_pylist(), rows["node"].to_pylist(), rows["digest"].to_pylist(), strict=True)}
        given = list(have)
        for k in range(top):
            for i in sorted(i for level, i in have if level == k):
                if (k + 1, i >> 1) not in have:
                    pair = [i & ~1, i | 1] if i | 1 < at_level(leaves, k) else [i]
                    have[k + 1, i >> 1] = parent(*(have[k, j] for j in pair))
        proofs, tops = [], []
        for k, i in given:
            proof = []
            for level in range(k, top):
                proof.append(step(i, level, leaves, lambda j: have[level, j]))  # noqa: B023
                i >>= 1
            proofs.append(proof)
            tops.append((i, have[top, i]))
        n = len(given)
        out = {"g": rows["g"], "level": rows["level"], "node": rows["node"], "leaves": rows["leaves"], "above": pa.array(proofs, pa.list_(pa.binary())), "up_level": pa.array([top] * n, pa.int32()), "up_node": pa.array([i for i, _ in tops], pa.int64()), "up": pa.array([d for _, d in tops], pa.binary())}
        return pa.table(out)

    return run


def _upper(nodes: DataFrame, first: int, most: int) -> DataFrame:
    """(g, level, node, above, root) of boundary nodes: their path to the group's root, and it.

    A round finishes blocks of aligned leaves, FIRST levels above the partitions' own and then
    LEVELS more each; a block gathers the boundary nodes of some partitions, or 2**LEVELS tops.
    """
    shape = "g string, level int, node long, leaves long, above array<binary>, up_level int, up_node long, up binary"
    to, rounds = first + FIRST, []
    while True:
        tall = F.when(F.col("leaves") == 1, 0).otherwise(F.length(F.bin(F.col("leaves") - 1)))
        open_ = F.col("level") < F.least(F.lit(to), tall)
        met = nodes.where(open_).withColumn("block", F.expr(f"shiftright(node, {to} - level)")).groupBy("g", "block").applyInArrow(_finish(to), shape)
        done = nodes.where(~open_).select("g", "level", "node", "leaves", F.array().cast("array<binary>").alias("above"), F.col("level").alias("up_level"), F.col("node").alias("up_node"), F.col("digest").alias("up"))
        rounds.append(cut(met.unionByName(done)))
        if to >= most:
            break
        nodes = rounds[-1].select("g", F.col("up_level").alias("level"), F.col("up_node").alias("node"), F.col("up").alias("digest"), "leaves").distinct()
        to += LEVELS
    out = rounds[-1].select("g", "level", "node", "above", F.col("up").alias("root"))
    for lower in rounds[-2::-1]:
        higher = out.select("g", F.col("level").alias("up_level"), F.col("node").alias("up_node"), F.col("above").alias("higher"), "root")
        out = lower.join(higher, ["g", "up_level", "up_node"]).select("g", "level", "node", F.concat("above", "higher").alias("above"), "root")
    return out


def trees(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of leaves(g string, key, leaf binary, what else): their paths in partitions, and those of boundary nodes.

    First: its columns, level, node, local array<binary>.  Second: g, level, node, above
    array<binary>, root.  g and leaf must not be null; leaves of a group stand by key (null
    first), then leaf; equal ones may change places.  leaves is used more than once: pass a
    cut one.
    """
    spark, total = leaves.sparkSession, leaves.count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS))
    # The last column only splits ranges of rows alike in all others.
    rows = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, "g", "key", "leaf", "tie").sortWithinPartitions("g", "key", "leaf")
    rows = cut(rows.drop("tie").withColumn("part", F.spark_partition_id()))
    counts = rows.groupBy("part", "g").agg(F.count("*").alias("n")).select("part", F.struct("g", "n").alias("x"))
    places = Places(counts.groupBy("part").agg(F.min("x").alias("first"), F.max("x").alias("last")).collect())  # a row a partition
    shared = share(spark, places)
    nodes = rows.mapInArrow(_boundary(shared), "g string, level int, node long, digest binary, leaves long")
    shape = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "part") + ", level int, node long, local array<binary>"
    per_part = -(-total // max(1, len(places.by_part)))
    return rows.mapInArrow(_paths(shared), shape), _upper(nodes, height(max(1, per_part)), height(max(1, places.largest)))


def manifest(leaves: DataFrame) -> DataFrame:
    """Per row of leaves(group string, key, leaf binary, what else): its columns, subroot and root (hex), proof array<binary>.

    Groups (null first, then by UTF-8 bytes) have a tree each, of leaves by key (null
    first); their roots are the leaves of the tree that gives root.  A run is two nodes; an
    odd last node is hashed alone.  Rows alike in group and key stand by leaf; rows alike in
    all are leaves of their own.  No rows give none.  Columns of leaves with the names of
    results are replaced.
    """
    own = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    extra = [c for c in own if c not in ("group", "key", "leaf")]
    g = F.when(leaves["group"].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), leaves["group"]))
    rows = cut(leaves.select(g.alias("g"), leaves["key"], leaves["leaf"], F.struct(F.lit(0).alias("_"), *[leaves[c] for c in extra]).alias("rest")))
    low, nodes = trees(rows)
    nodes = cut(nodes)
    # The groups' roots are leaves again.
    tops = cut(nodes.groupBy("g").agg(F.first("root").alias("leaf")).select(F.lit("").alias("g"), F.col("g").alias("key"), "leaf"))
    high, last = trees(tops)
    high = high.join(last, ["g", "level", "node"]).select(F.col("key").alias("g"), F.concat("local", "above").alias("top"), F.col("root").alias("whole"))
    nodes = nodes.join(high, "g").select("g", "level", "node", F.concat("above", "top").alias("above"), "root", "whole")
    out = low.join(nodes, ["g", "level", "node"])
    kept = {"group": F.when(F.col("g") != "0", F.expr("substring(g, 2)")), "key": F.col("key"), "leaf": F.col("leaf")} | {c: F.col("rest")[c] for c in extra}
    return out.select(*[kept[c].alias(c) for c in own], _hex(F.col("root")).alias("subroot"), _hex(F.col("whole")).alias("root"), F.concat("local", "above").alias("proof"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = bare(table(spark, sf_dir, "documents"), "doc_id", "source", "lang", "n_chars", "text")
    first, last = [docs[c] for c in ("doc_id", "source", "lang")], docs["text"]
    struck = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    changed = F.when(struck & docs["n_chars"].isNotNull(), leaf_of(*first, docs["n_chars"].cast("decimal(20,0)") + 1, last))
    leaves = docs.select(docs["lang"].alias("group"), docs["doc_id"].alias("key"), leaf_of(*first, docs["n_chars"], last).alias("leaf"), changed.alias("changed"))
    out = manifest(leaves).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return out.select(F.col("key").alias("doc_id"), _hex(F.col("leaf")).alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP13_SQL = r"""
WITH RECURSIVE
f AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, n_chars, text,
         COALESCE(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || COALESCE(strlen(source) || ':' || source, '-') || COALESCE(strlen(lang) || ':' || lang, '-') AS head,
         COALESCE(strlen(text) || ':' || text, '-') AS tail,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
               lambda i: list_transform(range(0, 8), lambda j: (ord(substr(doc_id::VARCHAR, i, 1)) >> j) & 1)))),
             lambda c, b: CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS crc
  FROM documents),
l AS (
  SELECT *, sha256(head || COALESCE(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN crc % 7 = 0 THEN sha256(head || strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) || tail) END AS changed FROM f),
p AS (
  SELECT rid, doc_id, leaf, COALESCE(changed, leaf) AS given, COALESCE('1' || lang, '0') AS g,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
low(g, lev, pos, n, d) AS (
  SELECT g, 0, pos, n, leaf FROM p
  UNION ALL
  SELECT g, lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY g, lev, pos // 2, n),
r AS (SELECT g, d AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(lev, pos, n, d) AS (
  SELECT 0, pos, n, subroot FROM r
  UNION ALL
  SELECT lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lev, pos // 2, n),
levels AS (
  SELECT g, lev, 0 AS part FROM low WHERE n > 1 GROUP BY g, lev
  UNION ALL SELECT r.g, h.lev, 1 FROM r, (SELECT DISTINCT lev FROM high WHERE n > 1) h),
steps AS (
  SELECT p.rid, row_number() OVER (PARTITION BY p.rid ORDER BY v.part, v.lev) AS k,
         (CASE WHEN v.part = 0 THEN p.pos ELSE r.pos END >> v.lev) % 2 AS side, COALESCE(a.d, b.d) AS sibling
  FROM p JOIN r ON r.g = p.g JOIN levels v ON v.g = p.g
  LEFT JOIN low a ON v.part = 0 AND a.g = p.g AND a.lev = v.lev AND a.pos = xor(p.pos >> v.lev, 1)
  LEFT JOIN high b ON v.part = 1 AND b.lev = v.lev AND b.pos = xor(r.pos >> v.lev, 1)),
folded(rid, k, acc) AS (
  SELECT rid, 0::BIGINT, given FROM p
  UNION ALL
  SELECT o.rid, o.k + 1, sha256(CASE WHEN sibling IS NULL THEN acc WHEN side = 1 THEN sibling || acc ELSE acc || sibling END)
  FROM folded o JOIN steps s ON s.rid = o.rid AND s.k = o.k + 1)
SELECT p.doc_id, p.leaf, r.subroot, h.d AS root, COALESCE(q.proof, sha256('')) AS proof_sha256, z.acc AS folded_root, z.acc = h.d AS verified
FROM p JOIN r ON r.g = p.g, (SELECT d FROM high WHERE n = 1) h,
     (SELECT rid, arg_max(acc, k) AS acc FROM folded GROUP BY rid) z
     LEFT JOIN (SELECT rid, sha256(COALESCE(string_agg(sibling, '' ORDER BY k), '')) AS proof FROM steps GROUP BY rid) q ON q.rid = z.rid
WHERE z.rid = p.rid
"""
