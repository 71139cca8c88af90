"""Token-id output as directly addressable codes.

A shard file holds the ids of consecutive documents.  Every id is split into
chunks of ``chunk_bits`` bits; level k keeps the k-th chunk of all ids that have
one, a continuation bitmap says which of them go on, and a rank directory (ones
before every 512 bits) turns a place on one level into its place on the next.
So token i, or any slice, is read without decoding what precedes it.

File: ``VDAC`` magic, header length, JSON header (array names, dtypes, offsets),
then the arrays, each at a multiple of 8 bytes.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import materialize, new_path, open_fs, put_file
from ._text import batches, encoder

MAGIC = b"VDAC0001"
_BLOCK = 512


class Bitmap:
    """Packed bits with ranks kept for every 512 of them."""

    @staticmethod
    def pack(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.zeros(-(-max(len(bits), 1) // _BLOCK) * (_BLOCK // 64), np.uint64)
        raw = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(raw)] = raw
        per = np.bitwise_count(words).reshape(-1, _BLOCK // 64).sum(1, dtype=np.int64)
        return words, np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.uint64)

    @staticmethod
    def rank(words: np.ndarray, ranks: np.ndarray, at: int) -> int:
        """Ones before bit ``at``."""
        block, rest = divmod(at, _BLOCK)
        if block >= len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(words[-(_BLOCK // 64) :]).sum())
        base, w = int(ranks[block]), block * (_BLOCK // 64)
        full, odd = divmod(rest, 64)
        n = base + int(np.bitwise_count(words[w : w + full]).sum())
        return n + (int(words[w + full]) & ((1 << odd) - 1)).bit_count() if odd else n


def encode_ids(ids: np.ndarray, chunk_bits: int = 8) -> dict[str, np.ndarray]:
    """Arrays of all levels; ``chunk_bits`` is 8 or 16."""
    if chunk_bits not in (8, 16):
        raise ValueError("chunk_bits must be 8 or 16")
    kind, mask, out, level = (np.uint8 if chunk_bits == 8 else np.uint16), (1 << chunk_bits) - 1, {}, 0
    rest = np.asarray(ids, np.uint32)
    while True:
        more = rest >> np.uint32(chunk_bits) if chunk_bits < 32 else np.zeros_like(rest)
        go = more != 0
        out[f"chunk{level}"] = (rest & np.uint32(mask)).astype(kind)
        out[f"bits{level}"], out[f"rank{level}"] = Bitmap.pack(go)
        if not go.any():
            return out
        rest, level = more[go], level + 1


def write_shard(uri: str, doc_ids: np.ndarray, has_id: np.ndarray, ends: np.ndarray, ids: np.ndarray, chunk_bits: int = 8) -> None:
    """``ends``: where each document's ids end in ``ids``."""
    arrays = {"doc_id": np.asarray(doc_ids, np.int64), "has_id": np.asarray(has_id, np.uint8), "end": np.asarray(ends, np.uint64), **encode_ids(ids, chunk_bits)}
    table, at = {}, 0
    for name, a in arrays.items():
        table[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({"chunk_bits": chunk_bits, "tokens": len(ids), "arrays": table}).encode()
    head += b" " * (-len(head) % 8)

    def put(out):
        out.write(MAGIC + struct.pack("<Q", len(head)) + head)
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))

    put_file(uri, put)


class Shard:
    """Random access to a shard file; arrays are read when first asked for."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        n = struct.unpack("<Q", self.file.read_at(8, 8))[0]
        self.head, self.base = json.loads(self.file.read_at(n, 16)), 16 + n
        self.tokens, self.bits, self._kept = self.head["tokens"], self.head["chunk_bits"], {}

    def close(self) -> None:
        self.file.close()

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._kept:
            kind, n, at = self.head["arrays"][name]
            self._kept[name] = np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, self.base + at), kind)
        return self._kept[name]

    def part(self, name: str, a: int, b: int) -> np.ndarray:
        kind, _, at = self.head["arrays"][name]
        w = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at((b - a) * w, self.base + at + a * w), kind)

    def rank(self, level: int, at: int) -> int:
        """Ones before bit ``at`` of a level: one directory entry and at most one
        512-bit block are read."""
        n = self.head["arrays"][f"rank{level}"][1]
        block = min(at // _BLOCK, n - 1)
        words = self.part(f"bits{level}", block * 8, block * 8 + 8)
        return int(self.part(f"rank{level}", block, block + 1)[0]) + Bitmap.rank(words, np.zeros(1, np.uint64), at - block * _BLOCK)

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b: on every level they are one run of chunks."""
        out = np.zeros(b - a, np.uint32)
        places, level = np.arange(b - a), 0
        while b > a:
            chunk = self.part(f"chunk{level}", a, b)
            out[places] |= chunk.astype(np.uint32) << np.uint32(level * self.bits)
            if f"chunk{level + 1}" not in self.head["arrays"]:
                break
            words = self.part(f"bits{level}", a // 64, -(-b // 64))
            go = np.unpackbits(words.view(np.uint8), bitorder="little")[a % 64 : a % 64 + b - a].astype(bool)
            a = self.rank(level, a)
            places, b, level = places[go], a + int(go.sum()), level + 1
        return out

    def token(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        ends = self["end"]
        return self.slice(int(ends[k - 1]) if k else 0, int(ends[k]))


MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, chunk_bits: int = 8, shard_tokens: int = 1 << 20) -> DataFrame:
    """Encode whole texts (null: empty), append ``end_id`` to each and write shards
    in ascending doc_id order (null ids first; equal ids in no set order).

    Returns the manifest (one row a shard, ``part, seq`` in file order), read from
    a committed table: files of failed or repeated task attempts are in no manifest.
    Control strings inside texts get their special ids.  Extra columns are ignored.  A task holds at most ``shard_tokens`` ids, or one document.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def write(table_batches):
        enc, part, seq = encoder(tokenizer, kind), TaskContext.get().partitionId(), 0
        doc_ids, pieces, held = [], [], 0
        tail = np.array([end_id], "<u4").tobytes()

        def flush():
            nonlocal doc_ids, pieces, held, seq
            ids = np.frombuffer(b"".join(pieces), "<u4")
            uri = f"{folder}/part-{part:06d}-{seq:05d}-{TaskContext.get().taskAttemptId()}.vdac"
            write_shard(uri, [x or 0 for x in doc_ids], [x is not None for x in doc_ids], np.cumsum([len(p) // 4 for p in pieces]), ids, chunk_bits)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [uri], "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64())})
            doc_ids, pieces, held, seq = [], [], 0, seq + 1
            return row

        for b in batches(table_batches):
            for i, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                doc_ids.append(i)
                pieces.append(ids + tail)
                held += len(ids) // 4 + 1
                if held >= shard_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    return materialize(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32.  Only the totals of the writing tasks (as many as
    there are shuffle partitions) are summed up on the driver."""
    at, rows = 0, []
    for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toLocalIterator():
        rows.append((r.part, at))
        at += r.n
    bases = spark.createDataFrame(rows, "part int, base long")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    todo = manifest.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(bases), "part").select("file", (F.col("base") + F.col("before")).alias("base"))
    todo = todo.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))

    def read(table_batches):
        for b in table_batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(file)
                ends = shard["end"].astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc, step = [], 1 << 20
                k = 0
                while k < len(ends):  # slices of whole documents
                    last = max(k + 1, int(np.searchsorted(ends, starts[k] + step, "right")))
                    ids = shard.slice(int(starts[k]), int(ends[last - 1])).astype("<u4")
                    crc += [zlib.crc32(ids[s - starts[k] : e - starts[k]]) for s, e in zip(starts[k:last], ends[k:last])]
                    k = last
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(shard["doc_id"], mask=shard["has_id"] == 0), "start": pa.array(starts + base), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(crc, pa.int64()),
                })
                shard.close()

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
