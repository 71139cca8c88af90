"""WARC archives compressed record by record with an embedded dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary built from the archive's own first records; every record is then one
Zstandard frame made with it, so any record can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import drop, materialize, new_path, open_fs, put_file
from ._text import batches, utf8

#: Fixed values of the formats.
DICT_MAGIC = 0x184D2A5D
RAW_DICT_MIN = 8
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def escaped(url: str | None) -> str:
    """A URL as a header value: UTF-8 with line breaks percent-coded."""
    return (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id, url: str | None, digest: str) -> str:
    """Rows that are equal in all three share it; no other rows do."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {escaped(url)}')}>"


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to=None, refers_url: str | None = None) -> bytes:
    """A WARC/1.1 record; a revisit names the response by record id, URL, date and page."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {escaped(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    block = HTTP + payload
    if kind == "revisit":
        block = HTTP
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}", f"WARC-Refers-To-Target-URI: {escaped(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    """The warcinfo record that each archive starts with."""
    block = b"software: veldt\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length doesn't match")
    return fields, rest[:n]


def build_dictionary(samples: list[bytes], size: int):
    """Trained from the samples; raw content of the samples where they are too few to train."""
    import zstandard as zstd

    total = sum(map(len, samples))
    if len(samples) >= RAW_DICT_MIN and total >= 8 * size:
        try:
            return zstd.train_dictionary(size, samples, level=3)
        except zstd.ZstdError:
            pass
    raw = b"".join(s[: size // 4] for s in samples)[-size:].ljust(RAW_DICT_MIN, b" ")
    return zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Buffers records until the dictionary can be built, then compresses each alone."""

    def __init__(self, dict_size: int = 32 << 10, sample_bytes: int = 2 << 20, level: int = 3):
        self.dict_size, self.sample_bytes, self.level = dict_size, sample_bytes, level
        self.waiting, self.waiting_bytes, self.frames, self.size, self.packer, self.count = [], 0, [], 0, None, 0

    def add(self, raw: bytes) -> None:
        self.count += 1
        if self.packer:
            self._pack(raw)
            return
        self.waiting.append(raw)
        self.waiting_bytes += len(raw)
        if self.waiting_bytes >= self.sample_bytes:
            self._start()

    def _start(self) -> None:
        import zstandard as zstd

        most = max(1, self.sample_bytes // max(1, len(self.waiting)))
        d = build_dictionary([r[: max(most, 4096)] for r in self.waiting], self.dict_size)
        self.packer = zstd.ZstdCompressor(level=self.level, dict_data=d, write_checksum=True, write_content_size=True)
        raw = zstd.ZstdCompressor(level=9).compress(d.as_bytes())
        self.frames.append(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
        for r in self.waiting:
            self._pack(r)
        self.waiting = []

    def _pack(self, raw: bytes) -> None:
        self.frames.append(self.packer.compress(raw))
        self.size += len(self.frames[-1])

    def close(self, uri: str) -> None:
        if not self.packer:
            self._start()
        put_file(uri, lambda out: [out.write(f) for f in self.frames])


def read_archive(uri: str):
    """(fields, block) of each record, one at a time."""
    import zstandard as zstd

    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != DICT_MAGIC:
            raise ValueError("no dictionary frame")
        raw = zstd.ZstdDecompressor().decompress(f.read(n))
        trained = raw[:4] == b"\x37\xa4\x30\xec"
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_FULLDICT if trained else zstd.DICT_TYPE_RAWCONTENT)
        unpacker, data = zstd.ZstdDecompressor(dict_data=d), b""
        while True:
            one, out = unpacker.decompressobj(), []
            while not one.eof:
                if not data:
                    data = f.read(1 << 20)
                    if not data:
                        break
                out.append(one.decompress(data))
                data = b"" if not one.eof else one.unused_data
            if not one.eof:
                if any(out):
                    raise ValueError("archive ends inside a record")
                return
            yield parse_record(b"".join(out))


def keyed(pages: DataFrame) -> DataFrame:
    """``pages`` with the payload's SHA-1 (d) and length (n)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.withColumns({"d": F.unhex(F.sha1(payload)), "n": F.octet_length(payload)})


def first_copies(pages: DataFrame) -> DataFrame:
    """page_id, d, n, first, first_url for every id and payload that a smaller page_id has
    too; one row each, however often the row repeats.

    Payloads are told apart by SHA-1 and length.  Only digests that occur twice join
    back, so nothing but ids, URLs and digests is shuffled; a hot digest joins by an
    adaptive (splittable) join.
    """
    ids = materialize(keyed(pages.filter("page_id is not null")).select("page_id", F.coalesce("url", F.lit("")).alias("url"), "d", "n"), "digests")
    several = ids.groupBy("d", "n").agg(F.min(F.struct("page_id", "url")).alias("r"), F.max("page_id").alias("last")).filter("r.page_id < last")
    several = several.select("d", "n", F.col("r.page_id").alias("first"), F.col("r.url").alias("first_url"))
    copies = materialize(ids.drop("url").join(several, ["d", "n"]).filter(F.col("page_id") > F.col("first")).distinct(), "copies")
    drop(ids)
    return copies


def write_archives(pages: DataFrame, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write a record per row (null html: empty payload; null url: empty) and return the
    committed manifest: file, records.

    Of equal payloads that of the smallest page_id is a response and those of larger ids
    are revisits of it; rows that repeat the smallest id are responses too, and so are
    rows without an id.  Rows of one id may have different payloads; each is judged by
    its own.  Other columns are ignored.  A task holds one archive of up to
    ``archive_bytes``, which starts with a warcinfo record.
    """
    folder = new_path(pages.sparkSession, "warc")
    copies = first_copies(pages)
    todo = keyed(pages.select("page_id", "url", "html")).join(copies, ["page_id", "d", "n"], "left").select("page_id", "url", "html", "first", "first_url")

    def write(table_batches):
        task, seq, out = TaskContext.get(), 0, None

        def close():
            out.close(f"{folder}/{out.name}")
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{out.name}"], "records": pa.array([out.count - 1], pa.int64())})

        for b in batches(table_batches, column="html"):
            for page, url, html, first, first_url in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out = ArchiveWriter()
                    out.name = f"part-{task.partitionId():06d}-{seq:05d}-{task.taskAttemptId()}.warc.zst"
                    out.add(info_record(out.name))
                    seq += 1
                payload = utf8(html)
                out.add(record("response" if first is None else "revisit", page, url, payload, sha1_base32(payload), first, first_url))
                if out.size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    manifest = materialize(todo.mapInArrow(write, "file string, records long"), "warc-manifest")
    drop(copies)
    return manifest


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row per record as the archives have it.  A response's digest and size are
    taken from its payload and must agree with its header."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(table_batches):
        for b in table_batches:
            for file in b.column(0).to_pylist():
                cols = [[] for _ in range(6)]
                for fields, block in read_archive(file):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        payload = block[len(HTTP) :]
                        if (sha1_base32(payload), len(payload)) != (digest, size):
                            raise ValueError("payload doesn't match its digest")
                    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
                    url = fields["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    for c, v in zip(cols, (page and int(page), url, size, digest, fields["WARC-Type"], refers and int(refers))):
                        c.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file").repartition(n).mapInArrow(read, schema)
