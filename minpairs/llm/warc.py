"""WARC archives, compressed record by record with a shared Zstandard dictionary.

The dictionary is trained on a bounded sample of records and stands at the head of
every archive in a skippable frame; each record is a frame of its own. Archives are
written by tasks straight into the shared folder under names no other attempt uses;
the stored manifest lists the files of the attempts that succeeded, so lost or
repeated tasks leave no trace in what is read back.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, hash_sample, scratch_path, stage, text_batches

DICTIONARY_MAGIC = 0x184D2A5D  # fixed value: skippable frame that holds a dictionary
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
# bounds of the dictionary's training sample (documented parameters): records, and characters of each, at a place chosen by hash
SAMPLE_RECORDS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 8192, 64 * 1024
ARCHIVE_BYTES = 64 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, keep_id: int | None, date: str) -> bytes:
    """A response record, or a revisit record without the payload if ``keep_id`` is another page."""
    uri = urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:x-page:{page_id}"
    revisit = keep_id is not None and keep_id != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{keep_id}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary, or none (empty) if the samples are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(records: DataFrame, folder: str, dictionary: bytes, date: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, html, keep_id`` rows; returns the manifest ``path, records, bytes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True)
        out, path, n, size, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, n, size))
                out = None

        for batch in batches:
            for page, url, html, keep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    path, n = f"{root}/{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(path, compression=None)
                    head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
                    out.write(head)
                    size = len(head)
                frame = packer.compress(record(page, url, (html or "").encode("utf-8", "surrogatepass"), keep, date))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))],
                                         names=["path", "records", "bytes"])

    return text_batches(records).select("page_id", "url", "html", "keep_id").mapInArrow(run, "path string, records long, bytes long")


def parse(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a decompressed archive."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


def open_archive(raw: pa.NativeFile) -> io.BufferedReader:
    """The decompressed records of an archive; its dictionary is taken from the leading frame."""
    import zstandard

    head, dictionary = raw.read(8), b""
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        dictionary, head = raw.read(struct.unpack("<II", head)[1]), b""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    source = io.BufferedReader(_Rest(head, raw))
    return io.BufferedReader(zstandard.ZstdDecompressor(dict_data=shared).stream_reader(source, read_across_frames=True), 1 << 16)


class _Rest(io.RawIOBase):
    """A stream with some bytes that were read already put back in front."""

    def __init__(self, head: bytes, raw):
        self.head, self.raw = head, raw

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.head or self.raw.read(len(buffer))
        n = min(len(data), len(buffer))
        buffer[:n] = data[:n]
        self.head = data[n:] if self.head else b""
        return n


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, html`` of every archived record.

    A response's payload is checked against its digest; ``html`` is null for revisits."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    names = [c.split()[0] for c in schema.split(", ")]
    number = lambda urn: None if urn is None or urn.endswith(":None>") else int(urn[1:-1].rpartition(":")[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        flush = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as raw:
                    rows, held = [], 0
                    for head, block in parse(open_archive(raw)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, found = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        if kind == "response" and (len(payload) != size or digest(payload) != found):
                            raise ValueError(f"{path}: payload of {head['warc-record-id']} does not match its digest")
                        rows.append((number(head["warc-record-id"]), head["warc-target-uri"], size, found, kind,
                                     number(head.get("warc-refers-to")), payload.decode("utf-8", "surrogatepass") if kind == "response" else None))
                        held += len(payload) + 100
                        if held > 8 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                    yield flush(rows)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, schema)


def archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
            folder: str | None = None, date: str = "2020-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, str]:
    """Archive all rows; returns the stored manifest and the folder.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the
    largest id is a response and the others revisit it.

    * null html: empty payload; null url: a ``urn:`` of the id; url characters that
      a header cannot hold are percent-encoded;
    * null ids: never the largest; rows of null ids only are all responses;
    * repeated rows: one record each; rows that share the largest id are all responses;
    * very long payloads: one record each, held once in memory while written;
    * empty table: no archive, an empty manifest; extra columns are ignored."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha2("html", 256)).withColumn("n", F.octet_length("html"))
    repeated = stage(rows.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("keep_id"), F.count("*").alias("copies"))
                     .where("copies > 1").select("sha", "n", "keep_id"), "repeated_payloads")
    room = F.greatest(F.char_length("html") - SAMPLE_CHARS, F.lit(0)) + 1
    part = F.substr("html", (F.pmod(F.xxhash64("sha", "page_id"), room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    picked = hash_sample(rows.select("page_id", "url", part.alias("html"), "sha"), SAMPLE_RECORDS, "sha", "page_id")
    samples = [record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), None, date) for r in picked.collect()]
    marked = rows.join(bounded(repeated), ["sha", "n"], "left")
    manifest = stage(write_archives(marked, folder, train_dictionary(samples), date, archive_bytes), "manifest")
    return manifest, folder
