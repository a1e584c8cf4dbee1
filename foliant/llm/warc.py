"""WARC archives compressed record by record with a Zstandard dictionary of their own."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import cut, new_folder, sized

#: Magic number of the skippable frame that holds an archive's dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame, all of it ASCII: what Spark's text writer puts after each row of a file.
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
_DATE = "2024-01-01T00:00:00Z"


def _record(kind: str, row: dict) -> bytes:
    """One WARC record: named fields, an empty line, the block, two empty lines."""
    payload = row["payload"] if kind == "response" else b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"] + payload
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{row['record_id']}>", "WARC-Date": _DATE, "X-Page-ID": row["page_id"], "WARC-Target-URI": re.sub(r"[\r\n]+", " ", row["url"] or ""),
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}", "X-Payload-Length": row["payload_bytes"],
        **({"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{row['refers_id']}>", "X-Refers-To-Page": row["refers_to"]} if kind == "revisit" else {}),
        "Content-Type": "application/http;msgtype=response", "Content-Length": len(block),
    }
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def _archive(records: list[bytes], dictionary_bytes: int) -> bytes:
    """A whole archive: the dictionary in a leading skippable frame, then one frame for each record."""
    import zstandard

    samples, held = [], 0
    for record in records[:: max(1, len(records) // 2000)]:
        samples.append(record[: 64 << 10])
        held += len(samples[-1])
        if held > 100 * dictionary_bytes:
            break
    try:
        trained = zstandard.train_dictionary(min(dictionary_bytes, max(1024, held // 8)), samples)
    except zstandard.ZstdError:  # too few or too short records for a dictionary
        trained = None
    own = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True) if trained else zstandard.ZstdCompressor(level=3, write_checksum=True)
    body = trained.as_bytes() if trained else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body + b"".join(map(own.compress, records))


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive: fields in lower case, and ``payload`` as bytes."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    body, at = data[8 : 8 + size], 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) if body else zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
        if magic >> 4 == 0x184D2A5:  # another skippable frame
            at += 8 + size
            continue
        frame = reader.decompressobj()
        parts = []
        while not frame.eof and at < len(data):
            parts.append(frame.decompress(data[at : at + (1 << 16)]))
            at += 1 << 16
        at = min(at, len(data)) - len(frame.unused_data)
        record = b"".join(parts)
        head, _, rest = record.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError("no WARC record")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        block = rest[: int(fields["content-length"])]
        yield fields | {"payload": block.partition(b"\r\n\r\n")[2]}


def _uuid(*parts: Column) -> Column:
    """A UUID of the hash of some text, of the version that leaves its making open."""
    h = F.sha2(F.concat_ws(":", *parts).cast("binary"), 256)
    pieces = (h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("8"), h.substr(14, 3)), F.concat(F.lit("a"), h.substr(18, 3)), h.substr(21, 12))
    return F.concat_ws("-", *pieces)


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_id) for every row.

    Of the pages whose payloads are equal and at least ``least`` bytes long, the one with the least page_id is the
    response and the others revisit it. Only digests and ids are grouped; the digests that repeat are counted and
    broadcast while they are few, so payloads stay where they are and a payload that many pages share is dealt out
    like any other; beyond, the join is a shuffle whose hot digests adaptive execution splits.

    A record's id is a UUID of its digest and its row, so repeated and null page_ids have distinct ones; the response
    that others revisit, and of repeated rows the first, has that of the digest alone, which they refer to.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    least_row = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first")
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(least_row, F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    joined = rows.join(sized(cut(first), 200_000), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    own = F.when(F.col("row") == F.col("first.row"), _uuid(F.col("payload_digest"))).otherwise(_uuid(F.col("payload_digest"), F.col("row").cast("string")))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"), own.alias("record_id"), F.when(revisit, _uuid(F.col("payload_digest"))).alias("refers_id"),
    )


def write_archives(pages: DataFrame, least: int = 100, archive_bytes: int = 16 << 20, dictionary_bytes: int = 64 << 10) -> DataFrame:
    """(archive, records, bytes, data): archives of about ``archive_bytes`` of records, each complete in ``data``.

    Each archive has its own dictionary, trained on its own records, in a leading skippable frame, and every
    record is a frame of its own, so records can be read singly. write_files() makes files of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, records, held = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            data = _archive(records, dictionary_bytes)
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05}-{number:05}.warc.zst"]), pa.array([len(records)]), pa.array([len(data)]), pa.array([data], pa.binary())], names=["archive", "records", "bytes", "data"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                records.append(_record(row["record_type"], row))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield close()
                    number, records, held = number + 1, [], 0
        if records:
            yield close()

    return plan_records(pages, least).mapInArrow(run, "archive string, records long, bytes long, data binary")


def write_files(archives: DataFrame, folder: str) -> None:
    """One file for each archive (data), in the format of .warc.zst: zstd tools and WARC readers take it as it is.

    Spark's text writer puts a row's bytes into a file of its own and a line end after it, which here is an empty
    skippable frame. Files have the writer's names and come or go with its commit, on any store that Spark writes to.
    """
    archives.select(F.col("data").cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).option("lineSep", EMPTY_FRAME).text(folder)


_READ = "archive string, record_id string, page_id long, url string, warc_date string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_id string"


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record of archives (archive, data); a revisit has no payload but its length and digest."""

    def number(text: str | None) -> int | None:
        return int(text) if text and re.fullmatch(r"-?[0-9]+", text) else None

    def bare(urn: str | None) -> str | None:
        return urn and urn.removeprefix("<urn:uuid:").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _READ.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for archive, data in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for r in parse_archive(data.as_py()):
                    digest, length = r["warc-payload-digest"].removeprefix("sha256:"), int(r["x-payload-length"])
                    whole = r["warc-type"] == "response"
                    if whole and (len(r["payload"]) != length or hashlib.sha256(r["payload"]).hexdigest() != digest):
                        raise ValueError(f"{archive.as_py()}: a payload doesn't match its digest")
                    told = (archive.as_py(), bare(r["warc-record-id"]), number(r["x-page-id"]), r["warc-target-uri"], r["warc-date"])
                    rows.append((*told, r["payload"] if whole else None, length, digest, r["warc-type"], number(r.get("x-refers-to-page")), bare(r.get("warc-refers-to"))))
                    held += len(r["payload"])
                    if held > 16 << 20:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    return archives.select("archive", "data").mapInArrow(run, _READ)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archive files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return read_archives(files.select(F.col("path").alias("archive"), F.col("content").alias("data")))


def archive_pages(pages: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """Write archives of pages (page_id, url, html) as files in ``folder`` and return the files' records, read back.

    A task that is repeated writes the same archives. Null html is an empty payload, a null url an empty field.
    Repeated rows and rows without page_id are records of their own; rows that repeat a response's page_id are
    responses too, and among equal payloads a row without page_id is response only where no row has one. Other
    columns are ignored; no row in, no record out.
    """
    path = folder or new_folder(pages.sparkSession, "warc")
    write_files(write_archives(pages, **settings), path)
    return read_files(pages.sparkSession, path)
