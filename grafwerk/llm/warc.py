"""WARC archives compressed record by record against an embedded Zstandard dictionary.

The dictionary is trained on the beginnings (SAMPLE_CHARS characters, for the dictionary
alone) of about SAMPLE archived records and leads every file in a skippable frame; each record is a frame of its own behind it, so a reader needs nothing
but the file. Of records with equal payloads the one with the largest page id is a response,
the others are revisits that refer to it. Files go to the folder that all executors share
and are named by task and attempt: only files of tasks that succeeded are listed and read.

Defined results: a null html is an empty payload, a null url ``urn:unknown``; of rows that
repeat the largest page id all are responses; a null page id is smaller than any and stays
null; an empty table writes no file. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.shared import checkpoint, join_spread, lean, remove, sampled, shared_dir

#: Records and characters of each that the dictionary is trained on; its size; bytes of a file.
SAMPLE, SAMPLE_CHARS, DICTIONARY, FILE_BYTES = 400, 16_384, 65_536, 64 << 20
LEVEL = 3
#: Fixed values of the formats: the skippable frame's magic number, the profile of revisits.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in url) if url is not None else "urn:unknown"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; their plain content where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:] or b"WARC/1.1\r\n"


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, revisit. Groups are formed from digests, not pages;
    only digests that several rows share are joined back, and the pages of a digest that
    very many share are dealt over many tasks."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return join_spread(rows, shared, ["digest"], "page_id", "left").select("page_id", "url", "payload", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write .warc.zst files under a folder URI; returns path, records, bytes of each."""
    begins = pages.select("page_id", "url", F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_CHARS).alias("html"))
    few = sampled(begins, pages.count(), SAMPLE, "page_id", "url", "html").distinct().collect()
    dictionary = train([record(r["page_id"], r["url"], r["html"].encode(), None, False) for r in sorted(few, key=repr)])
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    @lean
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        kind = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_content_size=True)
        context, out, number, n, size = TaskContext.get(), None, 0, 0, 0
        row = lambda: pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "revisit"))):
                if out is None:
                    name = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{number}.warc.zst"
                    out, n = store.open_output_stream(name, compression=None), 0
                    size = out.write(leading_frame(dictionary))
                frame = packer.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py()))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= FILE_BYTES:
                    out.close()
                    out, number = None, number + 1
                    yield row()
        if out is not None:
            out.close()
            yield row()

    return checkpoint(mark_revisits(pages, min_bytes).mapInArrow(write, "path string, records long, bytes long"))


def parse(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of one archive stream, one record in memory."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary frame")
    kind = zstandard.ZstdCompressionDict(source.read(size), dict_type=zstandard.DICT_TYPE_AUTO)
    text = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=kind).stream_reader(source, read_across_frames=True), 1 << 16)
    while version := text.readline():
        if version != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts with {version[:20]!r}")
        head = {}
        while (line := text.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = text.read(int(head["content-length"]))
        if text.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, block


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if wanted,
    payload (null for revisits). Checks every response's digest and length."""

    def number(field: str | None) -> int | None:
        found = (field or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(found) if found else None

    @lean
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as source:
                    rows: list[tuple] = []
                    held = 0
                    for head, block in parse(source):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                        if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{head['warc-record-id']}: the payload is damaged")
                        rows.append((number(head["warc-record-id"]), head["warc-target-uri"], length, digest, kind, number(head.get("warc-refers-to")), *([payload if kind == "response" else None] if with_payload else [])))
                        held += len(block) if with_payload else 256
                        if held > 1 << 22:
                            yield pack(rows)
                            rows, held = [], 0
                    if rows:
                        yield pack(rows)

    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if with_payload else {})

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return archives.select("path").mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write all pages to a new folder beside the checkpoints, read the files back and, when
    what was read is kept in a checkpoint, delete them."""
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    folder = folder if ":" in folder else f"file://{folder}"
    back = checkpoint(read_archives(write_archives(pages, folder, min_bytes), folder, with_payload))
    remove(pages.sparkSession, folder)
    return back
