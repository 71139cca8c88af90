"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds the vocabulary (word hashes, counts).  Level k holds the n-grams of
order k below their contexts: the context's pointers give the range of its children, and
the node is found by a successor search for its word in that range.  Ids (made monotone by
the context's base) and child pointers are Elias-Fano sequences; an n-gram's smoothed share
and its context's weight are codes of one byte with a code book per file.  A level is cut
into files by ranges of contexts; they lie in the shared folder and are memory-mapped
where they are used.

Smoothing: interpolated absolute discounting down to the additive unigram base.  All
n-grams are kept; what is discounted is their context's weight, so every distribution
sums to one.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, new_path, open_fs, put_file
from ._text import batches, word_hashes

#: Stands for the end of a text among the words' hashes.
END = np.uint64(0xE9D5C3B1A7987F63)
DISCOUNT = 0.75
#: Of model files that a worker holds where the shared folder can't be memory-mapped.
HELD_BYTES = 256 << 20
#: Values that a file's arrays are made from at a time, and n-grams that are added up at once.
PIECE = 1 << 19


# ---- Elias-Fano -------------------------------------------------------------------

_STEP = 64


class EliasFanoBuilder:
    """A non-decreasing sequence of ``n`` values up to ``last``, below ``universe``, added
    piece by piece: packed low bits, high bits in unary, where every 64th one of them
    stands, and where each bucket of equal high bits begins.  Three low bits more than
    usual make buckets of about eight."""

    def __init__(self, n: int, universe: int, last: int):
        self.n, self.at = n, 0
        self.bits = max(0, min(63, (max(universe, 1) // max(n, 1)).bit_length() + 2))
        self.top = int(last) >> self.bits if n else 0
        self.low = np.zeros(n * self.bits // 64 + 2, np.uint64)
        self.high = np.zeros(-(-(self.top + n + 129) // 64), np.uint64)
        self.zero = np.zeros(self.top + 2, np.uint32 if n < 2**32 else np.uint64)
        self.one = np.zeros(-(-n // _STEP), np.uint64)

    def add(self, values: np.ndarray) -> None:
        for a in range(0, len(values), PIECE):
            self._add(np.asarray(values[a : a + PIECE], np.uint64))

    def _add(self, values: np.ndarray) -> None:
        i = np.arange(self.at, self.at + len(values))
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        if self.bits:
            low = values & np.uint64((1 << self.bits) - 1)
            at = i.astype(np.uint64) * np.uint64(self.bits)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(self.low, word, low << off)
            over = off + np.uint64(self.bits) > np.uint64(64)
            np.bitwise_or.at(self.low, word[over] + 1, low[over] >> (np.uint64(64) - off[over]))
        ones = high + i
        first, end = int(ones[0]) >> 6, (int(ones[-1]) >> 6) + 1
        flags = np.zeros((end - first) * 64, np.uint8)
        flags[ones - first * 64] = 1
        self.high[first:end] |= np.packbits(flags, bitorder="little").view(np.uint64)
        self.zero[high[0] + 1 : high[-1] + 2] += np.bincount(high - high[0]).astype(self.zero.dtype)
        skip = -self.at % _STEP
        self.one[(self.at + skip) // _STEP :][: len(ones[skip::_STEP])] = ones[skip::_STEP]
        self.at += len(values)

    def arrays(self, prefix: str = "") -> dict[str, np.ndarray]:
        zero = np.cumsum(self.zero, dtype=self.zero.dtype)  # ones before the h-th bucket
        return {prefix + "head": np.array([self.n, self.bits, self.top], np.uint64), prefix + "low": self.low, prefix + "high": self.high, prefix + "zero": zero, prefix + "one": self.one}


def ef_build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The arrays of a whole sequence."""
    out = EliasFanoBuilder(len(values), universe, int(values[-1]) if len(values) else 0)
    out.add(values)
    return out.arrays()


class EliasFano:
    def __init__(self, a: dict[str, np.ndarray], prefix: str):
        self.n, self.bits, self.top = (int(x) for x in a[prefix + "head"])
        self.low, self.high, self.zero, self.one = (a[prefix + x] for x in ("low", "high", "zero", "one"))

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> off
        out |= np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return out & np.uint64((1 << self.bits) - 1)

    def _select(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Bit position of the k-th (from 0) one at or after bit ``at``."""
        word, k = at >> 6, k.copy()
        w = self.high[word] & (~np.uint64(0) << (at & 63).astype(np.uint64))
        while True:
            c = np.bitwise_count(w).astype(np.int64)
            far = np.flatnonzero(k >= c)
            if not len(far):
                break
            k[far] -= c[far]
            word[far] += 1
            w[far] = self.high[word[far]]
        place = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            part = (w >> place.astype(np.uint64)) & np.uint64((1 << half) - 1)
            c = np.bitwise_count(part).astype(np.int64)
            up = k >= c
            k = np.where(up, k - c, k)
            place += np.where(up, half, 0)
        return word * 64 + place

    def get(self, i: np.ndarray) -> np.ndarray:
        at = self.one[i // _STEP].astype(np.int64)
        high = self._select(at, i % _STEP) - i
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self.lows(i)

    def find(self, keys: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of each key, -1 where it is not in the sequence (which has no repeats).
        With ``first`` and ``last``: the ranges (last exclusive) that are searched."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return out
        h = keys >> np.uint64(self.bits)
        here = np.flatnonzero(h <= np.uint64(self.top))
        h, low = h[here].astype(np.int64), keys[here] & np.uint64((1 << self.bits) - 1)
        a, b = self.zero[h].astype(np.int64), self.zero[h + 1].astype(np.int64)
        if first is not None:  # of the range, only those of equal high bits can be the key
            a = np.maximum(a, first[here])
            b = np.maximum(np.minimum(b, last[here]), a)
        end = b.copy()
        for _ in range(int((b - a).max(initial=0)).bit_length()):  # successor in the bucket
            mid = (a + b) >> 1
            less = (self.lows(np.minimum(mid, self.n - 1)) < low) & (mid < b)
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
        ok = a < end
        ok[ok] = self.lows(a[ok]) == low[ok]
        out[here[ok]] = a[ok]
        return out


# ---- files --------------------------------------------------------------------------


def save_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    table, at = {}, 0
    for name, a in arrays.items():
        table[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(table).encode()
    head += b" " * (-len(head) % 8)

    def put(out):
        out.write(b"VTRIE001" + struct.pack("<Q", len(head)) + head)
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))

    put_file(uri, put)


def load_arrays(uri: str) -> dict[str, np.ndarray]:
    """Memory-mapped where the shared folder is mounted, else read."""
    if uri.startswith("file:"):
        raw = np.memmap("/" + uri[5:].lstrip("/"), np.uint8, "r")
    else:
        fs, path = open_fs(uri)
        with fs.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    n = int(raw[8:16].view(np.uint64)[0])
    base = 16 + n
    return {k: raw[base + at : base + at + m * np.dtype(t).itemsize].view(t) for k, (t, m, at) in json.loads(bytes(raw[16:base])).items()}


class Codes:
    """One-byte codes into a book of the means of equally wide bins between ``low`` and
    ``high``, added piece by piece.  Where ``some`` is false the value is 0 and has the last code."""

    def __init__(self, low: float, high: float):
        self.low, self.scale = low, 255 / max(high - low, 1e-12)
        self.codes, self.count, self.sum = [], np.zeros(256, np.int64), np.zeros(256)

    def add(self, x: np.ndarray, some: np.ndarray | None = None) -> None:
        code = np.clip((x - self.low) * self.scale, 0, 254).astype(np.uint8)
        if some is not None:
            code[~some] = 255
            x = np.where(some, x, 0)
        self.codes.append(code)
        self.count += np.bincount(code, minlength=256)
        self.sum += np.bincount(code, x, 256)

    def arrays(self, prefix: str) -> dict[str, np.ndarray]:
        return {prefix + "code": np.concatenate(self.codes), prefix + "book": (self.sum / np.maximum(self.count, 1)).astype(np.float32)}


# ---- the model in a task -----------------------------------------------------------------


class Model:
    """Levels as (low context, first index, file) lists, loaded where used."""

    def __init__(self, bits: int, vocabulary: list, levels: list[list], tokens: int, words: int):
        self.bits, self.vocabulary, self.levels, self.tokens, self.words = bits, vocabulary, levels, tokens, words

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "files"}

    def _file(self, uri: str) -> dict:
        files = self.__dict__.setdefault("files", {})
        f = files.pop(uri, None)
        if f is None:
            a = load_arrays(uri)
            f = {**a, **{p: EliasFano(a, p + ".") for p in ("id", "child") if f"{p}.head" in a}}
            f["bytes"] = 0 if uri.startswith("file:") else sum(x.nbytes for x in a.values())
        files[uri] = f
        while sum(x["bytes"] for x in files.values()) > HELD_BYTES and len(files) > 1:  # the one unused for longest
            del files[next(iter(files))]
        return f

    def ranks(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1: not in training) and count of every token's hash."""
        order = np.argsort(tokens)
        sorted_ = tokens[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        h = sorted_[new]
        shard = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        rank, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for s, first, uri in self.vocabulary:
            mine = slice(*np.searchsorted(shard, (s, s + 1)))
            if mine.start < mine.stop:
                f = self._file(uri)
                at = f["id"].find(h[mine] & np.uint64((1 << (64 - self.bits)) - 1))
                ok = at >= 0
                rank[mine] = np.where(ok, at + first, -1)
                count[mine][ok] = f["count"][at[ok]]
        each = np.empty(len(tokens), np.int64)
        each[order] = np.cumsum(new) - 1
        return rank[each], count[each]

    def children(self, level: int, context: np.ndarray, word: np.ndarray, weights: bool = False):
        """For each (context index, word rank): index on the level (-1: none), log10
        probability, and log10 weight of the context (0 without children)."""
        index, prob, weight = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.zeros(len(context))
        files = self.levels[level]
        lows = np.array([f[0] for f in files] + [np.iinfo(np.int64).max])
        small = self.words < 2**31 and int(context.max(initial=0)) < 2**31
        order = np.argsort((context << np.int64(32)) | (word & np.int64(0xFFFFFFFF))) if small else np.lexsort((word, context))
        c, w = context[order], word[order]
        cuts = np.searchsorted(c, lows)  # neighbours in a file are looked up together
        for (low, first, uri), a, b in zip(files, cuts, cuts[1:]):
            if a == b:
                continue
            f, cs, ws = self._file(uri), c[a:b] - low, w[a:b]
            new = np.concatenate([[True], cs[1:] != cs[:-1]])  # equal contexts and pairs are looked up once
            own, at_own = cs[new], np.cumsum(new) - 1
            both = np.unique(np.concatenate([own, own + 1]))
            at_both = f["child"].get(both)
            place = np.searchsorted(both, own)
            from_, to = at_both[place], at_both[place + 1]  # own + 1 comes right after own
            if weights:
                weight[order[a:b]] = f["weight.book"][f["weight.code"][own]][at_own]
            one = new | np.concatenate([[True], ws[1:] != ws[:-1]])
            pick = np.flatnonzero(one & (ws >= 0) & (to > from_)[at_own])
            there, of = np.full(b - a, -1, np.int64), at_own[pick]
            there[pick] = f["id"].find(cs[pick].astype(np.uint64) * np.uint64(self.words) + ws[pick].astype(np.uint64), from_[of].astype(np.int64), to[of].astype(np.int64))
            there = there[one][np.cumsum(one) - 1]
            ok = np.flatnonzero(there >= 0)
            hit = order[a:b][ok]
            index[hit] = there[ok] + first
            if weights:
                prob[hit] = f["prob.book"][f["prob.code"][there[ok]]]
        return index, prob, weight

    def below(self, rank: np.ndarray, start: np.ndarray, end_rank: int, levels: int, weights: bool = False):
        """Level by level: every token's context (texts begin after an end; ``start`` is the
        token's place in its text), and for all but the last one's its children."""
        index, before = rank, end_rank
        for k in range(levels + 1):
            context = np.where(start >= 1, np.concatenate([[before], index[:-1]]), before)
            if k == levels:
                yield context, None, None
                return
            index, prob, weight = self.children(k, context, rank, weights)
            before = -1
            yield context, np.where(index >= 0, prob, np.nan), weight


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, one text after the other, and the texts' numbers of tokens."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts + 1)
    out = np.full(ends[-1], END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = words
    return out, counts + 1


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


# ---- training ------------------------------------------------------------------------------


def _vocabulary(docs: DataFrame) -> tuple[list, int, int, int]:
    """Files of level 1, hash bits that choose among them, N and V."""
    spark = docs.sparkSession

    def count(table_batches):
        held, n = [], 0

        def flush():
            nonlocal held, n
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held, n = [], 0
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for b in batches(table_batches):
            texts = [t for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if not is_held_out(d)]
            if texts:
                held.append(tokens_of(texts)[0])
                n += len(held[-1])
            if n >= 4 << 20:
                yield flush()
        if held:
            yield flush()

    uni = materialize(docs.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "unigrams")
    words, tokens = uni.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    bits, folder = max(0, (words >> 20).bit_length()), new_path(spark, "trie")
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)

    def build(t: pa.Table) -> pa.Table:
        s = t.column("shard")[0].as_py()
        h = np.asarray(t.column("h")).view(np.uint64) & np.uint64((1 << (64 - bits)) - 1)
        order = np.argsort(h)
        uri = f"{folder}/words-{s:05d}-{TaskContext.get().taskAttemptId()}"
        save_arrays(uri, {**{"id." + k: v for k, v in ef_build(h[order], 1 << (64 - bits)).items()}, "count": np.asarray(t.column("c"))[order]})
        return pa.table({"shard": pa.array([s], pa.int64()), "n": pa.array([len(h)], pa.int64()), "uri": [uri]})

    made = materialize(uni.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard long, n long, uri string"), "trie-files")
    files, at = [], 0
    for r in made.orderBy("shard").collect():  # one row a file
        files.append((r.shard, at, r.uri))
        at += r.n
    return files, bits, tokens, words


def _blob(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences by byte plane, and counts, compressed."""
    import zstandard

    gaps = np.diff(keys, prepend=np.uint64(0))
    z = zstandard.ZstdCompressor(level=1)
    a, b = z.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes()), z.compress(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())
    return struct.pack("<QQ", len(keys), len(a)) + a + b


def _unblob(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n, m = struct.unpack("<QQ", raw[:16])
    z = zstandard.ZstdDecompressor()
    gaps = np.ascontiguousarray(np.frombuffer(z.decompress(raw[16 : 16 + m]), np.uint8).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64), np.ascontiguousarray(np.frombuffer(z.decompress(raw[16 + m :]), np.uint8).reshape(8, n).T).view(np.uint64).ravel()


def _sum_sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts.astype(np.int64), first) if len(keys) else counts.astype(np.int64)


def _sum_blobs(blobs: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All blobs' keys with their summed counts.  Blobs are added up as they come, so that
    about twice the distinct keys are held, however many blobs there are."""
    keys, counts, held, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add():
        return _sum_sorted(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([counts, *(c.astype(np.int64) for _, c in held)]))

    for raw in blobs:
        held.append(_unblob(raw))
        n += len(held[-1][0])
        if n > max(PIECE, len(keys)):
            keys, counts = add()
            held, n = [], 0
    return add() if held else (keys, counts)


def level_arrays(pieces: Iterable[Iterable[bytes]], words: int, here: int) -> dict[str, np.ndarray]:
    """A file's arrays from the blobs of its pieces, in ascending order of their keys (context
    in the file times ``words`` plus word), for ``here`` contexts.  A context may lie in several
    pieces.  One piece is unpacked at a time; added up, they are kept as blobs."""
    total, some, kept, n = np.zeros(here), np.zeros(here, np.int32), [], 0
    for blobs in pieces:
        keys, counts = _sum_blobs(blobs)
        ctx = (keys // np.uint64(words)).astype(np.int64)
        own = slice(ctx[0], ctx[-1] + 1)
        total[own] += np.bincount(ctx - ctx[0], counts)
        some[own] += np.bincount(ctx - ctx[0]).astype(np.int32)
        kept += [_blob(keys[a : a + PIECE], counts[a : a + PIECE]) for a in range(0, len(keys), PIECE)]
        n, last = n + len(keys), int(keys[-1])
    del keys, counts, ctx

    def shares():
        for raw in kept:
            keys, counts = _unblob(raw)
            ctx = (keys // np.uint64(words)).astype(np.int64)
            yield keys, ctx, (counts - DISCOUNT) / total[ctx]

    weight, low, high = np.ones(here), np.inf, 0.0
    for _, ctx, share in shares():
        weight[ctx[0] : ctx[-1] + 1] -= np.bincount(ctx - ctx[0], share)
        low, high = min(low, share.min()), max(high, share.max())
    np.clip(weight, 1e-9, 1, out=weight)
    ids, prob = EliasFanoBuilder(n, here * words, last), Codes(*np.log10([low, high]))
    for keys, _, share in shares():
        ids.add(keys)
        prob.add(np.log10(share))
    kept.clear()
    child, weights = EliasFanoBuilder(here + 1, n + 1, n), Codes(*np.log10([weight.min(initial=1, where=some > 0), weight.max(initial=1e-9, where=some > 0)]))
    child.add(np.zeros(1, np.uint64))
    before = 0
    for a in range(0, here, PIECE):
        to = before + np.cumsum(some[a : a + PIECE], dtype=np.int64)
        child.add(to)
        weights.add(np.log10(weight[a : a + PIECE]), some[a : a + PIECE] > 0)
        before = to[-1]
    return ids.arrays("id.") | child.arrays("child.") | weights.arrays("weight.") | prob.arrays("prob.")


def placed(model: Model, texts: list):
    """Rank and count of every token, its place in its text, texts' ends and lengths."""
    tokens, lengths = tokens_of(texts)
    ends = np.cumsum(lengths)
    return *model.ranks(tokens), np.arange(len(tokens)) - np.repeat(ends - lengths, lengths), ends, lengths


def _add_level(docs: DataFrame, model: Model, order: int, contexts: int, flush_tokens: int = 3 << 20, shard_tokens: int = 6 << 20, pieces: int = 8, key_bits: int = 64) -> tuple[list, int]:
    """Count the n-grams of one order below their contexts and write the level's files.
    A file's n-grams come to the task that writes it in ``pieces`` ranges, one after the other."""
    spark = docs.sparkSession
    folder = new_path(spark, f"trie-{order}")
    shards = int(min(max(1, -(-model.tokens // shard_tokens)), max(1, contexts)))
    width = -(-max(contexts, 1) // shards)
    span = width * model.words  # keys of a shard
    group = max(1, min(shards, (2**key_bits - 1) // span))  # shards whose keys fit into 64 bits together
    edges = [k * span + min(p * -(-span // pieces), span) for k in range(group) for p in range(pieces)]

    def count(table_batches):
        end = int(model.ranks(np.array([END]))[0][0])
        edge = np.array(edges, np.uint64)
        held, n = {}, 0  # keys by group

        def flush():
            nonlocal n
            n, out = 0, []
            for g in sorted(held):
                keys = np.concatenate(held.pop(g))
                keys.sort()
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                counts, keys = np.diff(first, append=len(keys)), keys[first]
                cuts = np.append(np.searchsorted(keys, edge), len(keys))
                for i in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    k, p = divmod(i, pieces)
                    own = slice(cuts[i], cuts[i + 1])
                    out.append((g * group + k, p, _blob(keys[own] - np.uint64(k * span), counts[own])))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["shard", "piece", "blob"])

        for b in batches(table_batches, 4 << 20):
            texts = [t for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if not is_held_out(d)]
            if not texts:
                continue
            rank, _, start, _, _ = placed(model, texts)
            *_, (ctx, _, _) = model.below(rank, start, end, order - 2)
            ok = (ctx >= 0) & (rank >= 0)
            part, at = np.divmod(ctx[ok], group * width)
            keys = at.astype(np.uint64) * np.uint64(model.words) + rank[ok].astype(np.uint64)
            for g in np.unique(part).tolist():
                held.setdefault(g, []).append(keys[part == g])
            n += len(keys)
            if n >= flush_tokens:
                yield flush()
        if n:
            yield flush()

    def build(table_batches):
        rows = ((*x, blob) for b in table_batches for *x, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
        for s, own in groupby(rows, lambda r: r[0]):
            arrays = level_arrays(((r[2].as_py() for r in piece) for _, piece in groupby(own, lambda r: r[1])), model.words, min(width, contexts - s * width))
            uri = f"{folder}/level-{s:05d}-{TaskContext.get().taskAttemptId()}"
            save_arrays(uri, arrays)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([len(arrays["prob.code"])], pa.int64()), pa.array([uri])], names=["shard", "n", "uri"])

    blobs = docs.mapInArrow(count, "shard long, piece long, blob binary")
    made = materialize(blobs.repartition("shard").sortWithinPartitions("shard", "piece").mapInArrow(build, "shard long, n long, uri string"), "trie-files")
    files, at = [], 0
    for r in made.orderBy("shard").collect():  # one row a file
        files.append((r.shard * width, at, r.uri))
        at += r.n
    return files, at


def train(docs: DataFrame, order: int = 3) -> Model:
    """Train on the documents that are not held out; every n-gram of all of them counts.

    Null text: empty.  A null doc_id counts as the empty name.  Repeated rows count each
    time.  Other columns are ignored.  An empty table gives a model without words."""
    docs = docs.select("doc_id", "text")
    files, bits, tokens, words = _vocabulary(docs)
    model, contexts = Model(bits, files, [], tokens, words), words
    for n in range(2, order + 1):
        if not contexts:
            break
        level, contexts = _add_level(docs, model, n, contexts)
        model.levels.append(level)
    return model


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: its figures, the base score and the model's log10 probability.

    Null text: empty, so its only token is the end.  A null doc_id counts as the empty
    name.  Without training documents every word has the base's unknown probability.
    """

    def run(table_batches):
        end = int(model.ranks(np.array([END]))[0][0])
        n, v = model.tokens, model.words
        for b in batches(table_batches, 3 << 20):
            ids = b.column(0).to_pylist()
            rank, count, start, ends, lengths = placed(model, b.column(1).to_pylist())
            base = (count + 0.5) / (n + 0.5 * (v + 1))
            p = base.copy()
            for _, own, weight in model.below(rank, start, end, len(model.levels), weights=True):
                if own is not None:
                    p = 10.0**weight * p + np.where(np.isnan(own), 0, 10.0**own)
            cut = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            add = lambda x: np.add.reduceat(x, cut)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([is_held_out(i) for i in ids]), pa.array(lengths, pa.int64()), pa.array(add((count > 0).astype(np.int64))), pa.array([n] * len(ids), pa.int64()), pa.array(add(np.log10(base))), pa.array(add(np.log10(np.minimum(p, 1)))),
            ], names=[x.split()[0] for x in SCORES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCORES)
