"""Benchmark decontamination by n-gram windows.

Words are runs of letters and digits (ASCII lower-cased, all beyond ASCII kept).
A window is ``n`` consecutive words of a benchmark item, or all of an item that has
fewer.  The windows form a hash set that goes to every task; documents are scanned
in one pass, hits are verified word by word, and the words of every occurrence are hit.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import ALNUM, WordHashes, batches, fresh, mix, utf8

#: More benchmark bytes than this are not broadcast: items are then dealt out in groups.
BROADCAST_BYTES = 64 << 20
#: Bits of the filter of a larger benchmark's window hashes.
FILTER_BITS = 1 << 26

_FOLD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(ALNUM).split()


def item_windows(text: str | None, n: int) -> set[bytes]:
    words = words_of(text)
    size = min(n, len(words))
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


class Windows:
    """The hash set of all windows, and which items each one belongs to."""

    def __init__(self, items: list[tuple], n: int):
        self.items: dict[bytes, set] = defaultdict(set)
        for item, text in items:
            for w in item_windows(text, n):
                self.items[w].add(item)
        vocabulary = sorted({w for x in self.items for w in x.split(b" ")})
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        by = defaultdict(list)
        for x in self.items:
            words = x.split(b" ")
            by[len(words)].append(self.fold(np.array([[self.ids[w] for w in words]], np.uint64).T)[0])
        self.hashes = {k: np.unique(np.array(v, np.uint64)) for k, v in by.items()}

    @staticmethod
    def fold(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = mix((out ^ c) + _FOLD)
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit spans of word numbers (end exclusive), and items that occur."""
        get = self.ids.get
        ids = np.fromiter([get(w, 0) for w in words], np.uint64, len(words))
        known = ids != 0
        found: list[tuple[int, int]] = []
        items: set = set()
        if not known.any():
            return found, items
        sums = np.concatenate([[0], np.cumsum(known)])
        for size, hashes in self.hashes.items():
            if size > len(words):
                continue
            starts = np.flatnonzero(sums[size:] - sums[:-size] == size)
            if not len(starts):
                continue
            h = self.fold([ids[starts + k] for k in range(size)])
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for s in starts[hashes[at] == h].tolist():
                owners = self.items.get(b" ".join(words[s : s + size]))
                if owners:
                    items |= owners
                    found.append((s, s + size))
        return merge_spans(found), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given word spans (from a span's first to its last byte)."""
    if not spans:
        return text
    raw = utf8(text)
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _items(benchmark: DataFrame) -> tuple[list[tuple], bool]:
    """All items if their size is within the bound, else nothing and False."""
    size = benchmark.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)).first()[0] or 0
    if size > BROADCAST_BYTES:
        return [], False
    return [(r[0], r[1]) for r in benchmark.select("item_id", "text").collect()], True


def scan_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """All columns of ``docs`` and ``n_words, n_hit, hit_spans`` (array of word
    ranges), ``hit_items`` (sorted as strings), ``clean_text`` (text without the spans).

    Null texts have no words; null item texts give no windows; a null item_id never
    counts as an item but its windows still hit.  Repeated rows are handled one by one.
    A column of ``docs`` with one of these names is replaced.  A benchmark beyond
    ``BROADCAST_BYTES`` is never held whole: its windows meet the documents' n-grams in a
    join.  Empty tables give no hits.
    """
    added = ["n_words", "n_hit", "hit_spans", "hit_items", "clean_text"]
    docs = docs.drop(*added)
    items, fits = _items(benchmark)
    if not fits:
        return _scan_by_join(docs, benchmark, n)
    schema = docs.schema
    text_at = schema.names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kept: list[Windows] = []

    def run(table_batches):
        if not kept:
            kept.append(Windows(shared.value, n))
        windows = kept[0]
        for b in batches(table_batches):
            cols = [[] for _ in added]
            for text in b.column(text_at).to_pylist():
                words = words_of(text)
                spans, hit = windows.scan(words)
                for c, v in zip(cols, (len(words), sum(y - x for x, y in spans), [{"start": x, "end": y} for x, y in spans], sorted(str(i) for i in hit if i is not None), cut_words(text, spans) if spans else text)):
                    c.append(v)
            extra = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(cols[3], pa.list_(pa.string())), pa.array(cols[4], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*schema.names, *added])

    from pyspark.sql.types import StructType

    out = StructType.fromDDL("n_words long, n_hit long, hit_spans array<struct<start: long, end: long>>, hit_items array<string>, clean_text string")
    return docs.mapInArrow(run, StructType([*schema.fields, *out.fields]))


def _marks(hashes: DataFrame) -> np.ndarray:
    """A filter of fixed size over column ``h``: its bits are set by the tasks and put together
    here one task at a time.  Set bits may mean nothing; clear ones rule a hash out."""
    import zstandard

    def run(table_batches):
        flags = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in table_batches:
            bit = b.column(0).to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)
            np.bitwise_or.at(flags, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        if flags.any():
            yield pa.RecordBatch.from_pydict({"bits": pa.array([zstandard.ZstdCompressor(level=1).compress(flags.tobytes())], pa.binary())})

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in hashes.select("h").mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.bits)), np.uint8)
    return out


def _scan_by_join(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """The way for large benchmarks: the documents' n-grams of the benchmark's window sizes
    that a filter of the windows' hashes lets through meet the windows in a join, which
    compares the words, and the spans are merged per document."""
    from pyspark.sql.types import StructType

    from ._store import drop, materialize

    row, cut = fresh(docs, "row", "spans")
    keyed = materialize(docs.withColumn(row, F.expr("uuid()")), "decontaminate")

    def grams(id_name, sizes=None, marks=None):
        """Windows of items, or with ``sizes`` the n-grams of these sizes that ``marks`` allows."""

        def run(table_batches):
            hashes = WordHashes()
            for b in batches(table_batches):
                ids, words_at, cols = [], [], [[] for _ in range(3)]
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    words = words_of(text)
                    flat = hashes.of(words)
                    for size in {min(n, len(words))} - {0} if sizes is None else [x for x in sizes if x <= len(words)]:
                        h = Windows.fold([flat[k : len(flat) - size + 1 + k] for k in range(size)])
                        at = np.arange(len(h))
                        if marks is not None:
                            bit = h % np.uint64(FILTER_BITS)
                            at = np.flatnonzero((marks.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                        ids += [i] * len(at)
                        for c, x in zip(cols, (h[at].view(np.int64), at, np.full(len(at), size))):
                            c.append(x)
                        words_at.extend(b" ".join(words[k : k + size]) for k in at.tolist())
                if ids:
                    yield pa.RecordBatch.from_pydict({id_name: pa.array(ids, pa.string()), **{c: pa.array(np.concatenate(x), pa.int64()) for c, x in zip(("h", "at", "size"), cols)}, "gram": pa.array(words_at, pa.binary())})

        return run

    kind = "string, h long, at long, size long, gram binary"
    b = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(grams("item_id"), f"item_id {kind}").select("item_id", "h", "size", "gram").distinct()
    b = materialize(b, "windows")
    sizes = sorted(r.size for r in b.select("size").distinct().collect())  # n of them at most
    marks = docs.sparkSession.sparkContext.broadcast(_marks(b))
    d = keyed.select(row, "text").mapInArrow(grams(row, sizes, marks), f"`{row}` {kind}")
    hits = d.join(b, ["h", "size", "gram"])
    per = hits.groupBy(row).agg(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("end"))).alias(cut), F.array_sort(F.collect_set("item_id")).alias("hit_items"))
    per = materialize(per, "hits")
    drop(b)
    joined = keyed.join(per, row, "left").drop(row)
    names = joined.schema.names
    t, s = names.index("text"), names.index(cut)

    def finish(table_batches):
        for x in batches(table_batches):
            cols = [[] for _ in range(4)]
            for text, raw in zip(x.column(t).to_pylist(), x.column(s).to_pylist()):
                spans = merge_spans([(r["at"], r["end"]) for r in raw or []])
                for c, v in zip(cols, (len(words_of(text)), sum(e - a for a, e in spans), [{"start": a, "end": e} for a, e in spans], cut_words(text, spans) if spans else text)):
                    c.append(v)
            own = [x.column(i) for i in range(len(names)) if names[i] not in (cut, "hit_items")]
            items = pa.array([i or [] for i in x.column(names.index("hit_items")).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*own, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), items, pa.array(cols[3], pa.string())], names=[*[f for f in names if f not in (cut, "hit_items")], "n_words", "n_hit", "hit_spans", "hit_items", "clean_text"])

    out = StructType.fromDDL("n_words long, n_hit long, hit_spans array<struct<start: long, end: long>>, hit_items array<string>, clean_text string")
    return joined.mapInArrow(finish, StructType([*docs.schema.fields, *out.fields]))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, whole_documents: bool = True) -> DataFrame:
    """``docs`` without contaminated documents, or with only the hit spans cut out.  Nulls,
    repeated rows and empty tables as in ``scan_documents``."""
    scanned = scan_documents(docs, benchmark, n)
    if whole_documents:
        return scanned.filter("n_hit = 0").select(*docs.columns)
    return scanned.withColumn("text", F.col("clean_text")).select(*docs.columns)

