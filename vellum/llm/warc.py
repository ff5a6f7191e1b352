"""WARC archives written and read as a chunked record table.

A payload is never held as one record: it travels as rows of (record id, chunk
number, bytes), at most ``CHUNK`` bytes each, and each chunk row carries the
SHA-256 of its record's bytes so far, so that the last chunk's is the payload's.
On disk a long payload becomes a segmented record (``WARC-Segment-Number`` and
``continuation`` records, as the format defines), one segment per chunk. Spark's
text source writes and reads the files line by line, so any store that Spark
reaches will do, and a file is streamed by one task.

Of records with equal payloads of at least ``LEAST`` bytes, that with the
smallest id is the response and the others are revisits without a payload.

Defined cases: a null payload counts as empty; smaller payloads are always
responses; rows that repeat id and payload are each written (the first ones
refer to none, as nothing but their own id comes first); an empty table gives
no archive rows; other columns of the input are not read; null ids are written
as an empty record id and read back as null.

Archives from elsewhere keep their record ids as they stand. An archive that ends
within a record, a header block without a length and a segmented record without
its last segment raise an error. So does an uncompressed archive that Spark deals
out in several blocks: a block may begin within a payload, so compress it, or raise
``spark.sql.files.maxPartitionBytes`` above its size. Spark hands over a payload
line by line, so a foreign one without line ends is one line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 256 * 1024
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
# Fixed value: the format's profile of a revisit whose payload has the same digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN, END = "<urn:record:", ">"


def resolved(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """record_id, url, payload (binary), payload_bytes, payload_digest, refers_to.

    The smallest id per digest is summed up before the shuffle; the join back
    is on the digest, where Spark may split a digest that many records share.
    """
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    records = pages.select(
        F.col(id_col).alias("record_id"),
        url.alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns(
        {"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload"), 256)}
    )
    first = (
        records.filter(F.col("payload_bytes") >= LEAST)
        .groupBy("payload_digest")
        .agg(F.min("record_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    found = records.join(first, "payload_digest", "left")
    other = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("record_id"))
    return found.withColumn("refers_to", F.when(other, F.col("first_id"))).drop("first_id")


def chunks(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk rows of each record, in order; a record without bytes has one empty chunk."""
    sent = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(F.lit(0))
    last = F.greatest(F.ceil(sent / F.lit(size)) - 1, F.lit(0))
    numbered = records.withColumn("last_chunk", last.cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("last_chunk")))
    )
    part = F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), F.col("chunk") * size + 1, F.lit(size)))
    return numbered.withColumn("bytes", F.coalesce(part, F.lit(b""))).drop("payload")


def _name(record_id: Column, chunk: Column) -> Column:
    """A record's URN; its segments after the first are numbered."""
    tail = F.when(chunk > 0, F.concat(F.lit(":"), chunk.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit(URN), F.coalesce(record_id.cast("string"), F.lit("")), tail, F.lit(END))


def lines(parts: DataFrame) -> DataFrame:
    """One text row per chunk: a whole WARC record but for the last line end."""
    record, chunk = F.col("record_id"), F.col("chunk")
    kind = (
        F.when(chunk > 0, F.lit("continuation"))
        .when(F.col("refers_to").isNotNull(), F.lit("revisit"))
        .otherwise(F.lit("response"))
    )
    segmented = F.col("last_chunk") > 0
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), _name(record, chunk)),
        F.lit(f"WARC-Date: {DATE}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " "))),
        F.when(chunk == 0, F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"))),
        F.when(chunk == 0, F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string"))),
        F.when(F.col("refers_to").isNotNull(), F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: "), _name(F.col("refers_to"), F.lit(0)))),
        F.when(segmented, F.concat(F.lit("WARC-Segment-Number: "), (chunk + 1).cast("string"))),
        F.when(segmented & (chunk > 0), F.concat(F.lit("WARC-Segment-Origin-ID: "), _name(record, F.lit(0)))),
        F.when(
            segmented & (chunk == F.col("last_chunk")),
            F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("payload_bytes").cast("string")),
        ),
        F.lit("Content-Type: application/octet-stream"),
        F.concat(F.lit("Content-Length: "), F.length("bytes").cast("string")),
    ]
    text = F.concat(F.concat_ws("\r\n", *head).cast("binary"), F.lit(b"\r\n\r\n"), F.col("bytes"), F.lit(b"\r\n"))
    return parts.select(text.cast("string").alias("value"))


def write(pages: DataFrame, path: str, size: int = CHUNK, **names: str) -> None:
    """Write ``pages`` as gzip-compressed WARC files under ``path``."""
    out = lines(chunks(resolved(pages, **names), size))
    out.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


CHUNK_SCHEMA = "record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, segment int, total long, chunk int, bytes binary, bytes_so_far long, digest_so_far string, ends boolean"


def read(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """The chunk rows of the archives under ``path``, with headers and running digests.

    Each file is one stream: lines are gathered up to ``size`` bytes and passed
    on, so a task holds a chunk and the running hash of its record. A record's
    segments follow each other in the file, and the hash runs on over them.
    """
    raw = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("value").cast("binary").alias("line"),
            F.col("_metadata.file_path").alias("file"),
            (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("split"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, file, out = None, None, []
        for batch in batches:
            for line, name, split in zip(*(batch.column(c).to_pylist() for c in ("line", "file", "split"))):
                if name != file:
                    if split:
                        raise ValueError(f"{name}: an uncompressed archive was dealt out in blocks; compress it or read it as one")
                    if parser:
                        parser.finish(file)
                    parser, file = Records(size), name
                out += parser.feed(line + b"\n")
                if len(out) >= 64:
                    yield _batch(out)
                    out = []
        if parser:
            parser.finish(file)
        if out:
            yield _batch(out)

    return raw.mapInArrow(run, CHUNK_SCHEMA)


_FIELDS = [
    ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("segment", pa.int32()), ("total", pa.int64()),
    ("chunk", pa.int32()), ("bytes", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("ends", pa.bool_()),
]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], schema=pa.schema(_FIELDS))


class Records:
    """Chunk rows from the lines of one archive."""

    def __init__(self, size: int):
        self.size, self.head, self.left, self.row, self.parts, self.held = size, {}, None, None, [], 0
        self.hash, self.chunk, self.hashed = hashlib.sha256(), 0, 0
        self.owed = self.more = False  # a line end after the payload; segments of the record

    def finish(self, file: str) -> None:
        """Fail if the archive ends within a record."""
        if self.left is not None or self.head or self.owed or self.more:
            raise ValueError(f"{file}: the archive ends within a record")

    def feed(self, line: bytes) -> Iterator[tuple]:
        if self.left is None:
            text = line.rstrip(b"\r\n").decode("utf-8", "replace")
            if text:
                name, _, value = text.partition(":")
                self.head[name.lower()] = value.strip()
            elif "content-length" in self.head:
                yield from self._begin()
            elif self.head:
                raise ValueError(f"a record without Content-Length: {self.head}")
            else:
                self.owed = False
            return
        take = line[: self.left]
        self.left -= len(take)
        at = 0
        while at < len(take):
            n = min(self.size - self.held, len(take) - at)
            self.parts.append(take[at : at + n])
            self.held, at = self.held + n, at + n
            if self.held == self.size and self.left + len(take) - at > 0:
                yield self._pass(False)
        if self.left == 0:
            yield self._pass(True)

    def _begin(self) -> Iterator[tuple]:
        h, self.head = self.head, {}
        name = lambda x: x.removeprefix(URN).removesuffix(END) if x and x.startswith(URN) else x
        segment = int(h.get("warc-segment-number", 1))
        n, total = h.get("warc-payload-length"), int(h.get("warc-segment-total-length", 0)) or None
        if (segment > 1) != self.more:
            raise ValueError(f"segments that do not follow each other at {h.get('warc-record-id')}")
        if segment == 1:
            self.hash, self.chunk, self.hashed = hashlib.sha256(), 0, 0
            self.first = (
                name(h.get("warc-record-id")), h.get("warc-type"), h.get("warc-target-uri"), name(h.get("warc-refers-to")),
                (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None, int(n) if n else None,
            )
        self.row = (*self.first, segment, total)
        self.many = "warc-segment-number" in h
        self.left = int(h["content-length"])
        if self.left == 0:
            yield self._pass(True)

    def _pass(self, done: bool) -> tuple:
        data = b"".join(self.parts)
        self.parts, self.held = [], 0
        self.hash.update(data)
        self.hashed += len(data)
        ends = done and (not self.many or self.row[7] == self.hashed)
        row = (*self.row, self.chunk, data, self.hashed, self.hash.hexdigest(), ends)
        self.chunk += 1
        if done:
            self.left, self.owed, self.more = None, True, not ends
        return row


def records(chunk_rows: DataFrame) -> DataFrame:
    """One row per record: its last chunk, whose running length and digest are the whole payload's.

    A revisit has no payload, so its length and digest are those that its headers state.
    """
    revisit = F.col("record_type") == "revisit"
    return chunk_rows.filter("ends").select(
        "record_id",
        "record_type",
        "refers_to",
        F.when(revisit, F.col("payload_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        (revisit | F.col("payload_digest").isNull() | F.col("payload_digest").eqNullSafe(F.col("digest_so_far"))).alias("intact"),
    )
