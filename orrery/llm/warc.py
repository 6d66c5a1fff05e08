"""WARC (operator 6): archives as a table of record chunks.

A record's bytes are rows (record_id, chunk_no, data): the header block with the first CHUNK
bytes of payload, then further pieces of CHUNK bytes, the last row with the closing lines.
Rows in the order of record and chunk are the archive, byte for byte.  Each row carries
the digest of the payload so far, so readers and writers hold one chunk at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bare, cut, dir_of, table

CHUNK, LEAST = 1 << 20, 100
#: Copies of one row that one task writes at a time.
COPIES = 1024
DATE = "1970-01-01T00:00:00Z"
START, END = b"WARC/1.1\r\nWARC-Record-ID: ", b"\r\n\r\n"
ROW = "record_id string, page_id long, chunk_no int, n_chunks int, payload_bytes long, digest string, data binary"


def named(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with the name of their record: the page_id and a hash of url and html.

    Rows that are equal in all three have one name.
    """
    # A hash passes nulls over, so which of the two are null goes into it.
    fp = F.hex(F.xxhash64(F.lit(7), pages["url"].isNull(), pages["html"].isNull(), pages["url"], pages["html"]))
    name = F.concat(F.lit("urn:x-page:"), F.coalesce(pages["page_id"].cast("string"), F.lit("none")), F.lit(":"), F.lower(fp))
    return pages.select(name.alias("name"), pages["page_id"], pages["url"], pages["html"])


def _digests(batches):
    """Of rows (name, page_id, html): name, page_id, payload_bytes, digest; payloads are read where they lie."""
    import hashlib

    import pyarrow as pa

    for batch in batches:
        html = batch.column(2)
        payloads = [html[i].as_buffer() or b"" for i in range(len(html))]
        columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in payloads], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in payloads], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["name", "page_id", "payload_bytes", "digest"])


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per name: page_id, payload_bytes, digest, copies (rows of that name), refers_to and its record's name, or nulls."""
    seen = named(pages).select("name", "page_id", "html").mapInArrow(_digests, "name string, page_id long, payload_bytes long, digest string")
    seen = cut(seen.groupBy("name").agg(F.first("page_id").alias("page_id"), F.first("payload_bytes").alias("payload_bytes"), F.first("digest").alias("digest"), F.count("*").alias("copies")))
    large = seen.where(F.col("payload_bytes") >= least).select("name", "page_id", "digest")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "name")))
    groups = large.groupBy("digest").agg(F.count("*").alias("n"), first.alias("to"))
    repeated = cut(groups.where((F.col("n") > 1) & F.col("to").isNotNull()))
    revisits = attach(large, repeated, ["digest"], "n", seen.count())
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("to.page_id"))
    revisits = revisits.where(later).select("name", F.col("to.page_id").alias("refers_to"), F.col("to.name").alias("refers_name"))
    return seen.join(revisits, "name", "left")


def _cutter(chunk: int):
    """Rows (name, page_id, first, last, html, fields, payload_bytes, revisit) as the chunk rows of their copies first to last."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        def pieces(name, page, copy, payload, fields, size, revisit):
            record = f"<{name}>" if copy == 1 else f"<{name}:{copy}>"
            body = b"" if revisit else payload
            n, sha = max(1, -(-len(body) // chunk)), hashlib.sha256()
            for k in range(n):
                piece = memoryview(body)[k * chunk : (k + 1) * chunk]
                sha.update(piece)
                head = START + record.encode() + b"\r\n" + fields if k == 0 else b""
                yield record, page, k + 1, n, size, None if revisit else sha.hexdigest(), b"".join((head, piece, END if k == n - 1 else b""))

        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary())
        names = [x.split(" ")[0] for x in ROW.split(", ")]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)

        for batch in batches:
            html = batch.column(batch.schema.names.index("html"))
            name, page, first, last, fields, size, revisit = (
                batch.column(batch.schema.names.index(c)).to_pylist() for c in ("name", "page_id", "first", "last", "fields", "payload_bytes", "revisit")
            )
            held, rows = 0, []
            for i in range(len(html)):
                payload = html[i].as_buffer() or b""
                for copy in range(first[i], last[i] + 1):
                    for row in pieces(name[i], page[i], copy, payload, fields[i].encode(), size[i], revisit[i]):
                        rows.append(row)
                        held += len(row[-1])
                        if held >= chunk:
                            yield packed(rows)
                            held, rows = 0, []
            if rows:
                yield packed(rows)

    return run


def write_archive(pages: DataFrame, path: str, chunk: int = CHUNK, least: int = LEAST, date: str = DATE) -> None:
    """Writes pages(page_id, url, html) as WARC/1.1 records to a Parquet table of chunk rows at path.

    Of records with equal payloads of `least` bytes and more, that with the smallest page_id
    is a response, the others are revisits, which have no payload and name that record in
    WARC-Refers-To (of several rows of its page_id, that of the smallest name).  Rows of one
    page_id with one payload are alike: all response or all revisit.  Rows that are equal in
    all columns are a record each, numbered from 2 on at the end of their ids.  A null page_id
    is never referred to; line breaks in urls are percent-coded; a null url leaves its header
    out; a null html is an empty payload; no pages make an empty table.  Other columns of pages stay out.

    A payload is cut in one pass as slices of its column, a chunk in memory besides it.
    """
    plan = cut(plan_records(pages, least))
    repeats = not plan.where("copies > 1").isEmpty()
    left = named(pages).select("name", "url", "html")
    if repeats:  # copies go before the shuffle, so that no task gets more than one a map task
        left = left.dropDuplicates(["name"])
    rows = left.join(plan.hint("shuffle_hash"), "name")
    if repeats:
        many = rows.where("copies > 1").withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), "copies", F.lit(COPIES).cast("long")))).repartition("name", "first")
        rows = rows.where("copies = 1").withColumn("first", F.lit(1).cast("long")).unionByName(many)
    else:
        rows = rows.withColumn("first", F.lit(1).cast("long"))
    revisit = F.col("refers_to").isNotNull()
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    fields = F.concat(
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_name"), F.lit(">"))),
        line("X-Page-ID", F.col("page_id")), line("X-Payload-Length", F.col("payload_bytes")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))), F.lit("\r\n"),
    )
    last = F.least(F.col("copies"), F.col("first") + COPIES - 1)
    html = F.when(~revisit, F.col("html"))  # a revisit's payload needn't go to Python
    rows.select("name", "page_id", "first", last.alias("last"), html.alias("html"), fields.alias("fields"), "payload_bytes", revisit.alias("revisit")).mapInArrow(_cutter(chunk), ROW).write.parquet(path)


class _Reader:
    """One record at a time: header fields, then payload bytes, never more than a chunk."""

    def begin(self, block: bytes) -> None:
        import hashlib

        head, rest = block.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        self.fields = dict(x.split(": ", 1) for x in lines[1:])
        self.left, self.sha = int(self.fields["Content-Length"]), hashlib.sha256()
        self.add(rest)

    def add(self, data: bytes) -> None:
        payload = memoryview(data)[: self.left]
        self.sha.update(payload)
        self.left -= len(payload)

    def row(self) -> tuple:
        f = self.fields
        digest = self.sha.hexdigest()
        named = f["WARC-Payload-Digest"].removeprefix("sha256:")
        if self.left or (f["WARC-Type"] == "response" and digest != named):
            raise ValueError(f"{f['WARC-Record-ID']}: payload incomplete or unlike its digest")
        page, to = f.get("X-Page-ID"), f.get("WARC-Refers-To")
        return page and int(page), int(f["X-Payload-Length"]), named, f["WARC-Type"], to and int(to.split(":")[2])


def _read(batches):
    import pyarrow as pa

    reader = _Reader()
    for batch in batches:
        names = batch.schema.names
        no, n = batch.column(names.index("chunk_no")).to_pylist(), batch.column(names.index("n_chunks")).to_pylist()
        data = batch.column(names.index("data"))
        out = []
        for i in range(len(no)):
            piece = data[i].as_buffer().to_pybytes()
            if no[i] == 1:
                reader.begin(piece)
            else:
                reader.add(piece)
            if no[i] == n[i]:
                out.append(reader.row())
        types = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(types)], [k for k, _ in types])


def read_archive(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of an archive table.

    Header blocks are parsed and payloads digested again as they stream by; a payload that is
    cut or unlike its digest raises an error.  A record of one row is read where it lies; the
    rows of longer ones are first brought together, in chunk order.
    """
    rows = spark.read.schema(ROW).parquet(path)
    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    long = rows.where(F.col("n_chunks") > 1).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    both = [x.select("chunk_no", "n_chunks", "data").mapInArrow(_read, shape) for x in (rows.where(F.col("n_chunks") == 1), long)]
    return both[0].unionByName(both[1])


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = dir_of(spark)
    write_archive(bare(table(spark, sf_dir, "pages"), "page_id", "url", "html"), path)
    return read_archive(spark, path)


OP6_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(COALESCE(html, '')))::BIGINT AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
