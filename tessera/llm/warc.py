"""Operator 8: write pages as WARC archives, resolve repeated payloads to revisits, and read the archives back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter
from pyspark.sql.types import StructType

from tessera.llm.common import NULL_ID, doc_key, id_of, new_path, table, written
from tessera.sources.sink import Attempt, FileWriter, opened, publish

#: A record ends with this.
END = b"\r\n\r\n"
#: Fixed values of the WARC 1.1 format.
VERSION, IDENTICAL = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A writer begins a new archive after so many packed bytes; one record is never cut.
ARCHIVE_BYTES = 64 << 20
#: Of gzip, in its members.
LEVEL = 5
FIELDS = "page long, record_type string, payload_bytes long, payload_digest string, payload_hex string, refers_to long"
#: Records that a reader hands on at a time, and bytes that it unpacks at a time.
RECORDS, UNPACKED = 1000, 1 << 20


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def head(kind: Column, page: Column, url: Column, n_bytes: Column, digest: Column | None = None, refers_to: Column | None = None) -> Column:
    """The header lines of a record with a block of ``n_bytes``.  A revisit has an empty block and points to the response."""
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))),
        _line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        _line("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]+", " ")),
        F.coalesce(_line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), F.lit("")) if digest is not None else F.lit(""),
        F.coalesce(F.concat(_line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">"))), _line("WARC-Profile", F.lit(IDENTICAL))), F.lit("")) if refers_to is not None else F.lit(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", n_bytes.cast("string")),
        F.lit("\r\n"),
    )


class ArchiveWriter(FileWriter, DataSourceArrowWriter):
    """Rows (head, block or null) as archives ``part-<task>-<number>.warc.gz`` with a gzip member for each record."""

    def __init__(self, path: str, staged: str, most: int, packed: bool) -> None:
        super().__init__(path, staged)
        self.most, self.packed = most, packed

    def write(self, batches: Iterator[pa.RecordBatch]) -> Attempt:
        store, root = opened(f"{self.path}/{self.staged}")
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        folder = f"{task}-{uuid.uuid4().hex}"
        files, size, out = 0, 0, None
        codec = pa.Codec("zstd")
        try:
            for b in batches:
                for first, block in zip(b.column("head"), b.column("block"), strict=True):
                    if out is None:
                        store.create_dir(f"{root}/{folder}", recursive=True)
                        out, size = store.open_output_stream(f"{root}/{folder}/part-{task:05d}-{files:05d}.warc.gz", compression=None), 0
                        files += 1
                    body = block.as_buffer() or b""
                    if self.packed and len(body):
                        body = codec.decompress(body[8:], int.from_bytes(body[:8], "little"))
                    member = gzip.compress(b"".join((first.as_buffer(), body, END)), LEVEL, mtime=0)
                    out.write(member)
                    size += len(member)
                    if size >= self.most:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Attempt(folder, files)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc_archives"

    def schema(self) -> str:
        return "head string, block binary"

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], self.options["staged"], int(self.options["most"]), self.options["packed"] == "true")


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, packed: bool = False) -> int:
    """Write rows (head, block; ``packed`` as in ``_packed_pages``) as archives below ``path``; a failed job leaves none.

    Returns how many archives were made.
    """
    spark = records.sparkSession
    spark.dataSource.register(ArchiveSource)
    staged = f"_staged-{uuid.uuid4().hex}"
    sink = records.select("head", "block").write.format("warc_archives").option("path", path).option("staged", staged)
    sink.option("most", archive_bytes).option("packed", str(packed).lower()).mode("append").save()
    return publish(spark, path, staged)


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names in lower case) and the block of each record of an archive, one record at a time."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {first[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8").partition(":")
            head[k.lower()] = v.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"record {head.get('warc-record-id')} ends before its content")
        yield head, block
        stream.read(len(END))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``; digest and size are those of the block, or of the header in a revisit.

    Archives are read as streams, of one gzip member or of many, so a task holds one unpacked record at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = re.compile(r"<urn:page:(-?\d+)>")
        number = lambda x: int(page.fullmatch(x)[1]) if x else None
        types = [("page", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload_hex", pa.string()), ("refers_to", pa.int64())]
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [n for n, _ in types])

        for b in batches:
            for where in b.column("path").to_pylist():
                store, at = opened(where)
                with store.open_input_stream(at, compression=None, buffer_size=UNPACKED) as packed, gzip.GzipFile(fileobj=packed) as raw:
                    for head, block in parse(io.BufferedReader(raw, UNPACKED)):
                        revisit = head["warc-type"] == "revisit"
                        digest = head["warc-payload-digest"][5:] if revisit else base64.b32encode(hashlib.sha1(block).digest()).decode()
                        if not revisit and head.get("warc-payload-digest", "sha1:" + digest) != "sha1:" + digest:
                            raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
                        rows.append((number(head["warc-record-id"]), head["warc-type"], None if revisit else len(block), digest,
                                     base64.b32decode(digest).hex(), number(head.get("warc-refers-to"))))
                        if len(rows) >= RECORDS:
                            yield out()
        if rows:
            yield out()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")
    return files.mapInArrow(read, FIELDS)


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page, payload_bytes, payload_digest, record_type, refers_to.

    Of the records with equal payloads of at least ``least_bytes``, that with the largest page stays a response.
    Digests are pre-aggregated before they are shuffled, so that a payload of a third of all pages meets as one row
    for each task; its headers return by a join on the digest that Spark may split.
    """
    keys = headers.select("page", "payload_bytes", "payload_digest", "payload_hex")
    owners = keys.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page").alias("owner"))
    joined = keys.join(owners, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("owner").isNotNull() & (F.col("owner") != F.col("page"))
    return joined.select(
        "page", "payload_bytes", "payload_digest", "payload_hex",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("owner")).alias("refers_to"),
    )


def _payloads(pages: DataFrame) -> DataFrame:
    """page, url, n (bytes of the payload), hex (its SHA-1), block (the payload)."""
    block = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(
        doc_key("page_id").alias("page"), F.col("url").cast("string").alias("url"), F.octet_length(block).cast("long").alias("n"),
        F.sha1(block).alias("hex"), block.alias("block"),
    )


def _packed_pages(payloads: DataFrame) -> DataFrame:
    """The same with blocks compressed for the way through shuffles, after eight bytes that hold their length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                blobs = []
                for x in part.column("block"):
                    raw = x.as_buffer()
                    blobs.append(len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True))
                kept = ["page", "url", "n", "hex"]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(blobs, pa.binary())], [*kept, "block"])

    return payloads.mapInArrow(pack, "page long, url string, n long, hex string, block binary")


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``path``/raw (a response for each page) and ``path``/deduplicated, and read the latter back.

    Null html: an empty payload, which takes part as any other.  Null page_id: archived under the smallest long and
    returned as null.  Rows with equal page_id: all are archived; where their payloads are equal too, all of them
    are the response, as a record cannot refer to itself.  Pages of any length are one record; an archive is closed
    when it holds ``archive_bytes``.  Empty table: no archives.  Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = _payloads(pages)
    write_archives(rows.select(head(F.lit("response"), F.col("page"), F.col("url"), F.col("n")).alias("head"), "block"), f"{path}/raw", archive_bytes)
    # The headers are a small table, so that the archives are parsed once.
    decided = resolve(written(read_archives(spark, f"{path}/raw"), "warc-headers", 4), least_bytes)
    known = decided.dropDuplicates(["page", "payload_hex"]).select(F.col("page").alias("of"), "payload_digest", "payload_hex", "record_type", "refers_to")
    # Fresh headers meet their payloads again, by page and digest.
    full = _packed_pages(rows).join(known, (F.col("page") == F.col("of")) & (F.col("hex") == F.col("payload_hex")))
    own = F.col("record_type") == "response"
    fresh = head(F.col("record_type"), F.col("page"), F.col("url"), F.when(own, F.col("n")).otherwise(0), F.col("payload_digest"), F.col("refers_to"))
    write_archives(full.select(fresh.alias("head"), F.when(own, F.col("block")).alias("block")), f"{path}/deduplicated", archive_bytes, packed=True)
    return read_back(spark, f"{path}/deduplicated")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Each archived page; a revisit takes the size of the response that it refers to.  The archives are parsed once."""
    records = written(read_archives(spark, path), "warc-records", 4)
    sizes = records.where("record_type = 'response'").groupBy(F.col("page").alias("owner"), F.col("payload_digest").alias("of")).agg(F.max("payload_bytes").alias("size"))
    joined = records.join(sizes, (F.col("refers_to") == F.col("owner")) & (F.col("payload_digest") == F.col("of")), "left")
    return joined.select(
        id_of("page").alias("page_id"), F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type",
        F.when(F.col("refers_to") != NULL_ID, F.col("refers_to")).alias("refers_to"),
    )


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page; cases as in ``archive_pages``."""
    return archive_pages(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def _bits(hex_digit: str) -> str:
    return f"(CASE {hex_digit} " + " ".join(f"WHEN '{x:x}' THEN '{x:04b}'" for x in range(16)) + " END)"


#: SHA-1 in base32: 40 hex digits as 160 bits, cut into 32 groups of five.
OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex FROM p),
b AS (SELECT page_id, n, array_to_string(list_transform(range(1, 41), lambda i: {_bits('substr(hex, i, 1)')}), '') AS bits FROM h),
d AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
    + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS digest FROM b),
o AS (SELECT digest, max(page_id) AS owner FROM d GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM d JOIN o USING (digest)
"""
