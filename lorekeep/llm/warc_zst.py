"""WARC archives in Zstandard with a shared dictionary: writer and streaming reader.

An archive starts with a skippable frame that holds the dictionary; every record is
one frame of its own.  The reader loads the dictionary from that frame, decodes
frame by frame in bounded memory and validates version line, header fields,
lengths and payload digests.

Archives are written by the tasks into the shared folder through pyarrow's file
systems, under names of their own for each attempt; only files that a finished
task reports in the manifest are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialise, scratch, utf8

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
TRAINED_MAGIC = b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
_READ = 1 << 16


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, whose length is that of the full payload, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; ValueError if it breaks the format, a length or its digest."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"malformed field {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as its header says")
    http, mark, payload = rest[:length].partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("no HTTP header")
    size = int(next(x.split(":", 1)[1] for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("the payload does not match its length or digest")
    if kind == "revisit" and payload:
        raise ValueError("a revisit holds a payload")
    return {"kind": kind, "id": fields["warc-record-id"], "refers_to": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"), "size": size, "digest": digest, "payload": payload}


def page_of(urn: str | None) -> int | None:
    value = urn[len("<urn:page:") : -1] if urn else "None"
    return None if value == "None" else int(value)


def dictionary(samples: list[bytes], size: int = 1 << 15) -> bytes:
    """A trained dictionary, or raw content where the samples are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (record(0, "", b"", base32_sha1(b""), None, False) + b"".join(samples))[:size]


def _loaded(data: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == TRAINED_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def read_records(stream) -> Iterator[bytes]:
    """Records of an open archive; one frame is in memory at a time."""
    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("truncated archive")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    data = stream.read(size)
    if len(data) != size:
        raise ValueError("truncated dictionary")
    decoder = zstandard.ZstdDecompressor(dict_data=_loaded(data))
    rest = b""
    while True:
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            chunk = rest or stream.read(_READ)
            rest = b""
            if not chunk:
                if parts:
                    raise ValueError("truncated frame")
                return
            parts.append(frame.decompress(chunk))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def write_archives(rows: DataFrame, folder: str, dict_bytes: bytes, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write (page_id, url, payload, first, revisit) rows; the manifest (file, records, bytes)."""
    fields = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        encoder = zstandard.ZstdCompressor(level=3, dict_data=_loaded(dict_bytes))
        out, name, count, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count]), pa.array([size])], schema=fields)

        for batch in batches:
            for block in blocks(batch, "payload", 4 << 20):
                for page, url, payload, first, revisit in zip(*(block.column(i).to_pylist() for i in range(5))):
                    if out is None:
                        name, count, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                        out = fs.open_output_stream(f"{base}/{name}")
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dict_bytes)) + dict_bytes)
                    frame = encoder.compress(record(page, url, payload, base32_sha1(payload), first, revisit))
                    out.write(frame)
                    count, size = count + 1, size + len(frame)
                    if size >= roll_bytes:
                        yield done()
                        out = None
        if out is not None:
            yield done()

    return materialise(rows.select("page_id", "url", "payload", "first", "revisit").mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, uri, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record in the manifest's files."""
    fields = [("page_id", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    ddl = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if with_payload:
        fields, ddl = [*fields, ("payload", pa.binary())], ddl + ", payload binary"
    schema = pa.schema(fields)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = pa.fs.FileSystem.from_uri(file)
                rows, seen, size = [], 0, 0
                with fs.open_input_stream(path) as stream:
                    for data in read_records(stream):
                        r = parse(data)
                        seen += 1
                        size += len(data)
                        row = (page_of(r["id"]), r["uri"], r["size"], r["digest"], r["kind"], page_of(r["refers_to"]))
                        rows.append((*row, r["payload"]) if with_payload else row)
                        if len(rows) >= 4096 or size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if seen != expected:
                    raise ValueError(f"{file} has {seen} records; {expected} were written")
                if rows:
                    yield batch_of(rows)

    spark = manifest.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(tasks, "file").mapInArrow(run, ddl)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, dictionary_pages: int = 400) -> DataFrame:
    """Write every page as a WARC record, read the archives back; the manifest of files.

    Of equal payloads of at least ``least_bytes`` bytes that with the smallest id is
    the response and the others are revisits of it; rows that share that smallest
    id are all responses, null ids come last.  Null payloads are empty.  The
    dictionary is trained on at most ``dictionary_pages`` pages, 16 KB of each.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), utf8(html_col).alias("payload"))
    sample = rows.orderBy(F.xxhash64("page_id"), "page_id").limit(dictionary_pages).select(F.substring("payload", 1, 16384).alias("p")).toArrow()
    dict_bytes = dictionary([p for p in sample.column("p").to_pylist() if p])
    keyed = rows.withColumn("key", F.struct(F.sha1("payload").alias("s"), F.octet_length("payload").alias("n"), F.xxhash64("payload").alias("x")))
    firsts = (
        keyed.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .filter((F.col("copies") > 1) & (F.col("key.n") >= least_bytes))
    )
    marked = keyed.join(firsts, "key", "left").select(
        "page_id", "url", "payload", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit")
    )
    return write_archives(marked, scratch(pages.sparkSession, "warc"), dict_bytes)
