"""WARC archives in Zstandard: a dictionary in the leading skippable frame, a frame for each record."""

from __future__ import annotations

import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import fresh_path, maybe_in, stored

# Fixed values of the WARC and zstd formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


class WarcError(ValueError):
    pass


def open_shared(uri: str, mode: str):
    """A file in the shared folder, by its file: URI or through Arrow's file systems."""
    parts = urllib.parse.urlparse(uri)
    if parts.scheme in ("", "file"):
        return open(parts.path, mode)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if "w" in mode else system.open_input_stream(path)


def make_shared_dir(uri: str) -> None:
    parts = urllib.parse.urlparse(uri)
    if parts.scheme in ("", "file"):
        import os

        os.makedirs(parts.path, exist_ok=True)
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A response, or with ``refers_to`` a revisit, whose block has HTTP headers alone."""
    name = lambda i: f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}').urn}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~")))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(refers_to)), ("Refers-To-Page-ID", str(refers_to))]
    fields += [
        ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(payload).hexdigest()),
        ("WARC-Block-Digest", "sha1:" + hashlib.sha1(block).hexdigest()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, first: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(first):
        raise WarcError(f"no {first.decode()} headers")
    out: dict[str, str] = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon or not k or k != k.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        out[k.decode().lower()] = v.strip().decode()
    return out, rest


def parse(data: bytes) -> dict:
    """The fields of a record, once its headers, lengths and digests hold."""
    warc, rest = _headers(data, b"WARC/1.")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in warc:
            raise WarcError(f"no {name}")
    size = int(warc["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes, its header says {size}")
    block = rest[:size]
    if warc.get("warc-block-digest", (own := "sha1:" + hashlib.sha1(block).hexdigest())) != own:
        raise WarcError("the block's digest differs")
    http, payload = _headers(block, b"HTTP/")
    length, digest = int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")
    kind = warc["warc-type"]
    if kind == "response":
        if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("the payload's length or digest differs")
    elif kind != "revisit" or payload or "warc-refers-to" not in warc:
        raise WarcError(f"bad {kind} record")
    as_int = lambda name: int(warc[name]) if name in warc else None
    return {"page_id": as_int("page-id"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": as_int("refers-to-page-id"), "url": warc.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def write_archive(out, records: list[bytes], more: Iterator[bytes], dictionary_bytes: int = 32_768, level: int = 3) -> int:
    """Trains the dictionary on ``records``, the first of the archive; those and ``more`` follow
    as frames of their own. Without enough to train on there is no dictionary frame."""
    dictionary, n = None, 0
    if len(records) >= 16 and sum(map(len, records)) >= 8 * dictionary_bytes:
        try:
            dictionary = zstandard.train_dictionary(dictionary_bytes, records)
        except zstandard.ZstdError:
            dictionary = None
    if dictionary is not None:
        content = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
    press = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    for part in (records, more):
        for data in part:
            out.write(press.compress(data))
            n += 1
    return n


def read_archive(source, chunk: int = 65_536) -> Iterator[bytes]:
    """Each frame's content, decoded as a stream; a torn file is an error."""
    dictionary, data = None, source.read(max(8, chunk))
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + size:
            if not (new := source.read(chunk)):
                raise WarcError("the dictionary frame is torn")
            data += new
        content, data = data[8 : 8 + size], data[8 + size :]
        if content[:4] == ZSTD_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content)
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := source.read(chunk)):
        frame, parts = unpack.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := source.read(chunk)):
                raise WarcError("the last frame is torn")
        yield b"".join(parts)


def with_revisits(pages: DataFrame, min_bytes: int = 1000, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of at least ``min_bytes``, those
    without the largest id refer to it. Only digests are grouped, and they meet within a task
    first; payloads without a copy stay where they are. A payload with very many copies joins
    one row, which Spark can give to several tasks."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha1("payload"))))
    copies = rows.select("page_id", "digest").filter("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = stored(copies, "copies")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("largest")), F.col("largest")).alias("refers_to")
    joined = maybe_in(rows, "digest", copies).join(copies, "digest", "left").select("page_id", "url", "payload", refers)
    alone = maybe_in(rows, "digest", copies, inverse=True).select("page_id", "url", "payload", F.lit(None).cast(pages.schema[id].dataType).alias("refers_to"))
    return alone.unionAll(joined)


def write_warcs(rows: DataFrame, folder: str, archive_bytes: int = 64_000_000, sample_bytes: int = 2_000_000) -> DataFrame:
    """Archives of (page_id, url, payload, refers_to) under ``folder``; returns (path, n_records)
    of those whole. A name holds the attempt, so a repeated task never meets its own remains,
    and readers take only what is listed."""
    make_shared_dir(folder)

    def run(batches):
        from pyspark import TaskContext

        def records():
            for batch in batches:
                for a in range(0, batch.num_rows, 200):
                    for x in zip(*(c.slice(a, 200).to_pylist() for c in batch.columns)):
                        yield record(*x)

        context, source, k = TaskContext.get(), records(), 0
        while True:
            sample, size = [], 0
            for data in source:
                sample.append(data)
                size += len(data)
                if size >= sample_bytes:
                    break
            if not sample:
                return

            def rest():
                nonlocal size
                while size < archive_bytes and (data := next(source, None)) is not None:
                    size += len(data)
                    yield data

            path = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{k:04d}.warc.zst"
            with open_shared(path, "wb") as out:
                n = write_archive(out, sample, rest())
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})
            k += 1

    return stored(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, n_records long"), "warc-list")


def read_warcs(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the listed archives, a task for each archive, 10,000 at most."""
    schema = RECORDS if payloads else RECORDS.removesuffix(", payload binary")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches):
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, rows, size = 0, [], 0

                def flush(rows):
                    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)

                with open_shared(path, "rb") as source:
                    for data in read_archive(source):
                        rows.append(parse(data))
                        n, size = n + 1, size + len(data)
                        if size >= 4_000_000:
                            yield flush(rows)
                            rows, size = [], 0
                if n != expected:
                    raise WarcError(f"{path}: {n} records, {expected} were written")
                if rows:
                    yield flush(rows)

    tasks = max(1, min(10_000, archives.count()))
    return archives.select("path", "n_records").repartition(tasks).mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 1000, id: str = "page_id", url: str = "url", html: str = "html", payloads: bool = True) -> DataFrame:
    """Writes a record for each row of ``pages`` and reads all archives back.

    A null html is an empty payload; a null url or id leaves its header out, and reads back as
    null. Rows that repeat the largest id of equal payloads are all responses. Other columns
    aren't archived, whatever their names. A very long payload is a frame of its own, compressed
    and read as a stream; a dictionary comes from the payloads of a task's first 2 MB, none where
    they are too few. An empty table writes no archive and gives no rows.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return read_warcs(write_warcs(with_revisits(pages, min_bytes, id, url, html), folder), payloads)
