"""Exact repeated byte strings with run-length (r-) indexes.

``RunLengthIndex`` sorts the suffixes of a block, run-compresses its Burrows-Wheeler
transform and keeps overlap samples at the ends of runs only.  The block's bytes are
streamed backwards over the runs (LF steps): within a run both neighbours of a suffix take
the same step, so the overlaps grow by one; at a run's end the sample tells the new one.
That gives matching statistics of every position.

A corpus is cut so that blocks are independent.  Every window of ``length`` bytes picks
an anchor, the least hash among its half-long substrings; equal windows pick equal
anchors, so all copies of a window lie around anchors of one hash.  Anchors that occur
once are done, anchors with all the same surroundings repeat as a whole, and only
surroundings that differ (ends of repeated passages) are put into blocks by anchor hash
and indexed.  Anchors with more surroundings than a block may hold are decided by
sorting them (``_hot_marks``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import drop, materialize
from ._text import batches, fresh, mix, spread, utf8
from .decontamination import merge_spans

_BASE, _MOD = 0x9E3779B97F4A7C15 | 1, 1 << 64
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Longer texts are scanned in overlapping pieces of this many bytes.
PIECE = 4 << 20
#: Surroundings of one anchor that a block may hold.
HOT = 4096
BLOCK_BYTES = 3 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of them."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, _MOD))):
            out = np.full(1 << (n - 1).bit_length(), b, np.uint64)
            out[0] = 1
            _POWERS[k] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place as a number, first byte highest; zeros follow the end."""
    wide = np.zeros(len(data) + 8, np.uint64)
    wide[: len(data)] = data
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | wide[k : k + len(data)]
    return out


class Rolling:
    """Hash of any substring of 8 bytes or more in constant time: a polynomial of its mixed
    8-byte pieces (of plain bytes, texts such as Thue-Morse words would collide)."""

    def __init__(self, data: np.ndarray, pieces: np.ndarray | None = None):
        pieces = grams(data) if pieces is None else pieces
        p, self.inv = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mix(pieces) * p[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size - 7] - self.sums[start]) * self.inv[start]

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size - 7 : n + size - 7] - self.sums[:n]) * self.inv[:n]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - have : len(x) - have + 1]) if have < w else m


def anchors(roll: Rolling, starts: np.ndarray, length: int) -> np.ndarray:
    """Places of the anchors of all windows that begin where ``starts`` is true (a flag
    for every place where a window has room)."""
    k = length // 2
    place = np.arange(len(roll.sums) - k, dtype=np.uint64)
    code = (mix(roll.all(k)) & ~np.uint64(0xFFFFFF)) | place  # of equal hashes the leftmost
    least = _sliding_min(code, length - k + 1)[: len(starts)]
    return np.unique(least[starts] & np.uint64(0xFFFFFF)).astype(np.int64)


class RunLengthIndex:
    """The r-index of a block: run heads, letters and LF images of its BWT, samples at both
    ends of every run, and every ``EVERY``-th place's rank, where streams begin."""

    EVERY = 512

    def __init__(self, data: np.ndarray):
        self.n = n = len(data)
        self.pieces = grams(data)
        self.roll = Rolling(data, self.pieces)
        sa = suffix_array(data)
        bwt = data[sa - 1]
        turn = bwt[1:] != bwt[:-1]
        turn |= (sa[1:] == 0) | (sa[:-1] == 0)  # nothing comes before the first byte
        self.heads = np.flatnonzero(np.concatenate([[True], turn]))
        self.letters, self.sizes = bwt[self.heads], np.diff(np.append(self.heads, n))
        # the step from a run's head: after all suffixes of smaller letters (of the last byte's
        # letter, the last byte alone is the first) and of this letter's runs before
        counted = np.where(sa[self.heads] == 0, 0, self.sizes)
        order = np.argsort(self.letters, kind="stable")
        self.step = np.empty(len(order), np.int64)
        self.step[order] = np.cumsum(counted[order]) - counted[order] + (self.letters[order] >= data[-1])
        head, tail = np.minimum(self.step, n - 1), np.minimum(self.step + self.sizes, n) - 1
        self.head_match, self.tail_match = self._before(sa, head), self._after(sa, tail)
        self.at = np.unique(np.append(np.arange(self.EVERY - 1, n, self.EVERY), n - 1))
        rank = np.empty(n, np.int64)
        rank[sa] = np.arange(n)
        self.rank = rank[self.at]
        self.first = self._before(sa, self.rank), self._after(sa, self.rank)

    def _before(self, sa: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Overlap of the suffixes of ranks ``r`` with those of the ranks before."""
        return np.where(r > 0, self._overlap(sa[r - (r > 0)], sa[r]), 0)

    def _after(self, sa: np.ndarray, r: np.ndarray) -> np.ndarray:
        there = r < self.n - 1
        return np.where(there, self._overlap(sa[r], sa[r + there]), 0)

    def _overlap(self, a: np.ndarray, b: np.ndarray, short: int = 255) -> np.ndarray:
        """Common prefix lengths: the first 8 bytes by themselves, the rest by bisection on
        substring hashes; most are short."""
        room = np.where(a == b, 0, self.n - np.maximum(a, b))
        differ = self.pieces[a] ^ self.pieces[b]
        same = np.zeros(len(a), np.int64)
        for k in range(1, 9):
            same += differ >> np.uint64(64 - 8 * k) == 0
        lo = np.minimum(same, room)
        go = np.flatnonzero((same == 8) & (room > 8))
        if not len(go):
            return lo
        x, y, most = a[go], b[go], room[go]
        deep = most > short
        deep[deep] = self.roll.of(x[deep], short + 1) == self.roll.of(y[deep], short + 1)
        low, high = np.where(deep, short + 1, 8), np.where(deep, most, np.minimum(most, short))
        on = np.arange(len(go))
        while len(on := on[low[on] < high[on]]):
            mid = (low[on] + high[on] + 1) // 2
            hit = self.roll.of(x[on], mid) == self.roll.of(y[on], mid)
            low[on], high[on] = np.where(hit, mid, low[on]), np.where(hit, high[on], mid - 1)
        lo[go] = low
        return lo

    def matching_statistics(self) -> np.ndarray:
        """For every place the longest string from there that also starts elsewhere.  All
        streams take their steps together."""
        best = np.zeros(self.n, np.int64)
        size = np.diff(self.at, prepend=-1)
        lane = np.argsort(-size)
        at, size, rank = self.at[lane], size[lane], self.rank[lane]
        before, after = (x[lane] for x in self.first)
        best[at] = np.maximum(before, after)
        for k in range(1, int(size[0])):
            if (m := int(np.searchsorted(-size, -k))) < len(rank):  # streams that have come to the next one's place
                at, size, rank, before, after = at[:m], size[:m], rank[:m], before[:m], after[:m]
            run = np.searchsorted(self.heads, rank, "right") - 1
            off = rank - self.heads[run]
            before = np.where(off == 0, self.head_match[run], before + 1)
            after = np.where(off == self.sizes[run] - 1, self.tail_match[run], after + 1)
            rank = self.step[run] + off
            best[at - k] = np.maximum(before, after)
        return best


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Prefix doubling from 8 bytes up, or tripling where three ranks fit into a key; only
    suffixes that are still tied are sorted again."""
    n = len(data)
    key = grams(data)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    k, steps = 8, 2 if n + 2 < 1 << 21 else 1
    tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))  # positions in order
    while len(tied):
        s = order[tied]
        code = rank[s]
        for j in range(1, steps + 1):
            at = s + j * k
            code = code * (n + 2) + np.where(at < n, rank[np.minimum(at, n - 1)] + 1, 0)
        inner = np.argsort(code)
        s, code = s[inner], code[inner]
        order[tied] = s
        new = np.concatenate([[True], code[1:] != code[:-1]])
        rank_new = np.maximum.accumulate(np.where(new, tied, 0))
        rank[s] = rank_new
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        k *= steps + 1
    return order


def repeated_spans(data: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Starts among ``valid`` (flags) whose ``length`` bytes also start elsewhere."""
    return np.flatnonzero(valid & (RunLengthIndex(data).matching_statistics() >= length))


# ---- the corpus -------------------------------------------------------------------------

_ANCHORS = "fp long, ctx long, doc long, at long, left int, size int, dup boolean"


def _anchor_rows(docs: DataFrame, length: int, flush_rows: int = 400_000) -> DataFrame:
    """Anchors of all texts.  Within a flush those with equal surroundings are sent once
    (``dup``); their places are marked at once (rows with ``size`` < 0: at, -size)."""
    from xxhash import xxh3_64_intdigest as digest

    k = length // 2
    side = length - k

    def scan(raw: np.ndarray, bounds: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """bounds: (first, last, base) of each text's bytes in raw; window starts lie in lo..hi."""
        starts = np.zeros(len(raw) - length + 1, bool)
        for a, b in zip(lo, hi):
            starts[a:b] = True
        roll = Rolling(raw)
        p = anchors(roll, starts, length)
        t = np.searchsorted(bounds[:, 0], p, "right") - 1
        a, b = np.maximum(bounds[t, 0], p - side), np.minimum(bounds[t, 1], p + k + side)
        view = memoryview(raw)
        own = np.fromiter((digest(view[i:j]) for i, j in zip(a.tolist(), b.tolist())), np.uint64, len(a))
        return mix(roll.of(p, k)), mix(own ^ mix(((p - a) << 32 | (b - a)).astype(np.uint64))), t, p, p - a, b - a

    def run(table_batches):
        held, n = [], 0

        def flush():
            nonlocal held, n
            fp, ctx, doc, at, left, size = (np.concatenate(x) for x in zip(*held))
            held, n = [], 0
            order = np.lexsort((at, doc, ctx, fp))
            fp, ctx, doc, at, left, size = (x[order] for x in (fp, ctx, doc, at, left, size))
            new = np.concatenate([[True], (fp[1:] != fp[:-1]) | (ctx[1:] != ctx[:-1])])
            first = np.flatnonzero(new)
            count = np.diff(np.concatenate([first, [len(fp)]]))
            dup = np.repeat(count > 1, count)
            out = [fp.view(np.int64)[new], ctx.view(np.int64)[new], doc[new], at[new], left[new], size[new], dup[new]]
            m_doc, m_at, m_size = doc[dup], (at - left)[dup], size[dup]
            if len(m_doc):  # merge marks within a text
                o = np.lexsort((m_at, m_doc))
                m_doc, m_at, m_end = m_doc[o], m_at[o], (m_at + m_size)[o]
                cut = np.concatenate([[True], (m_doc[1:] != m_doc[:-1]) | (m_at[1:] > m_end[:-1])])
                f = np.flatnonzero(cut)
                l = np.concatenate([f[1:] - 1, [len(cut) - 1]])
                out = [np.concatenate([x, y]) for x, y in zip(out, (mix((m_doc[f] ^ m_at[f]).astype(np.uint64)).view(np.int64), m_doc[f] * 0, m_doc[f], m_at[f], m_at[f] * 0, m_at[f] - m_end[l], np.zeros(len(f), bool)))]
            kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, bool)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(out, kinds)], names=["fp", "ctx", "doc", "at", "left", "size", "dup"])

        for b in batches(table_batches):
            short = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = utf8(text)
                if length <= len(raw) <= PIECE:
                    short.append((doc, raw))
                elif len(raw) > PIECE:
                    parts = []
                    for s in range(0, len(raw) - length + 1, PIECE):  # window starts s to e
                        e = min(s + PIECE, len(raw) - length + 1)
                        a, z = max(0, s - 2 * length), min(len(raw), e + 3 * length)
                        fp, ctx, _, p, left, size = scan(np.frombuffer(raw[a:z], np.uint8), np.array([[0, z - a]]), [s - a], [e - a])
                        parts.append((fp, ctx, np.full(len(p), doc, np.int64), p + a, left, size))
                    one = [np.concatenate(x) for x in zip(*parts)]
                    once = np.unique(one[3], return_index=True)[1]  # two pieces may see one place
                    held.append(tuple(x[once] for x in one))
                    n += len(once)
            if short:
                sizes = np.array([len(r) for _, r in short])
                ends = np.cumsum(sizes)
                bounds = np.stack([ends - sizes, ends], 1)
                fp, ctx, t, p, left, size = scan(np.frombuffer(b"".join(r for _, r in short), np.uint8), bounds, bounds[:, 0], ends - length + 1)
                held.append((fp, ctx, np.array([d for d, _ in short], np.int64)[t], p - bounds[t, 0], left, size))
                n += len(p)
            if n >= flush_rows:
                yield flush()
        if n:
            yield flush()

    return docs.mapInArrow(run, _ANCHORS)


def _classified(rows: DataFrame) -> DataFrame:
    """Marks (kind 0: doc, at, size) and surroundings to be indexed (kind 1; kind 2 where
    the anchor has too many for a block)."""
    ordered = Window.partitionBy("fp").orderBy("ctx", "doc", "at")
    whole = Window.partitionBy("fp")
    same = lambda f: F.coalesce(f("ctx").over(ordered) == F.col("ctx"), F.lit(False))
    w = rows.withColumns({"prev": same(F.lag), "next": same(F.lead)})
    w = w.withColumn("rep", F.col("dup") | F.col("prev") | F.col("next"))
    w = w.withColumns({"lo": F.min("ctx").over(whole), "hi": F.max("ctx").over(whole), "rows": F.count(F.lit(1)).over(whole), "open": F.max(~F.col("rep")).over(whole)})
    marks = F.when(F.col("size") < 0, F.struct(F.lit(0).alias("kind"), "doc", "fp", "at", F.lit(0).alias("left"), (-F.col("size")).alias("size"))).when(
        F.col("rep"), F.struct(F.lit(0).alias("kind"), "doc", "fp", (F.col("at") - F.col("left")).alias("at"), F.lit(0).alias("left"), F.col("size").alias("size"))
    )
    index = F.when(
        (F.col("size") > 0) & (F.col("lo") < F.col("hi")) & F.col("open") & ~F.col("prev"),
        F.struct(F.when(F.col("rows") > HOT, 2).otherwise(1).alias("kind"), "doc", "fp", "at", "left", "size"),
    )
    return w.select(F.explode(F.array_compact(F.array(marks, index))).alias("r")).select("r.*")


def _surroundings(docs: DataFrame, todo: DataFrame, length: int, blocks: int) -> DataFrame:
    """Bytes to be indexed, joined up within a text and block (kind 1: block, doc, at,
    data); the surroundings of hot anchors one by one (kind 2: block is the anchor's hash,
    at its place, left the bytes before it)."""
    k = length // 2
    per = todo.groupBy("doc").agg(F.collect_list(F.struct("kind", "fp", "at", "left", "size")).alias("w"))

    def run(table_batches):
        for b in batches(table_batches):
            out = [[] for _ in range(6)]
            for doc, text, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw, v = utf8(text), w.values
                kind, fp, at, left, size = (np.asarray(v.field(i)).astype(np.int64) for i in range(5))
                block = (fp.view(np.uint64) % np.uint64(blocks)).astype(np.int64)
                one = kind == 1
                for x in np.unique(block[one]).tolist():
                    mine = one & (block == x)
                    for s, e in merge_spans(list(zip((at - left)[mine].tolist(), (at - left + size)[mine].tolist()))):
                        for c, y in zip(out, (1, x, doc, s, raw[s:e])):
                            c.append(y)
                        out[5].append(0)
                for p in np.flatnonzero(~one).tolist():
                    for c, y in zip(out, (2, int(fp[p]), doc, int(at[p]), raw[int(at[p] - left[p]) : int(at[p] - left[p] + size[p])], int(left[p]))):
                        c.append(y)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["kind", "block", "doc", "at", "data", "left"])

    return docs.join(per, "doc").select("doc", "text", "w").mapInArrow(run, "kind int, block long, doc long, at long, data binary, left int")


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


_SIDES = "fp long, doc long, at long, lk binary, mid binary, rk binary, most int, skip_lo int, skip_hi int, marks array<struct<lo: int, hi: int>>"


def _hot_marks(segments: DataFrame, length: int) -> DataFrame:
    """Marks (doc, at, size) around anchors that have too many surroundings for a block.

    A window of such an anchor takes a bytes before it and the rest behind.  Sorted by what
    stands before (read backwards), neighbours show which windows repeat and how far left
    a repeated window can reach; sorted by what stands behind, how far right.  Windows
    within these bounds are counted by hash, each once per run of equal neighbours.
    Both sorts are by range, so an anchor's surroundings are dealt over all tasks; at the
    ends of a task's range, where a neighbour isn't seen, nothing is ruled out.
    """
    k = length // 2
    need = length - k

    def split(table_batches):
        for b in table_batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(5))))
            cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3][: r[4]][::-1] for r in rows], [r[3][r[4] : r[4] + k] for r in rows], [r[3][r[4] + k :] for r in rows]]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["fp", "doc", "at", "lk", "mid", "rk"])

    def neighbours(table_batches):
        """(row, row before, row after) of a sorted partition; None at its ends."""
        before = row = None
        for b in table_batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if row is not None:
                    yield row, before, r
                before, row = row, r
        if row is not None:
            yield row, before, None

    def compared(row, other, side):
        """Whether it is another anchor; common bytes on the sorted side; windows shared."""
        if other is None:
            return len(row[side]), None
        if other[0] != row[0] or other[4] != row[4]:
            return 0, None
        left, right = _common(row[3], other[3]), _common(row[5], other[5])
        lo, hi = max(0, need - right), min(left, need)
        return (left if side == 3 else right), ((lo, hi) if lo <= hi else None)

    def pack(rows, names, kinds):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    spans = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def by_left(table_batches):
        names = [x.split()[0] for x in _SIDES.split(", ")[:10]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), spans)
        out = []
        for row, before, after in neighbours(table_batches):
            (x, p), (y, q) = compared(row, before, 3), compared(row, after, 3)
            out.append((*row, max(x, y), *(p or (1, 0)), [{"lo": r[0], "hi": r[1]} for r in (p, q) if r]))
            if len(out) == 4096:
                yield pack(out, names, kinds)
                out = []
        if out:
            yield pack(out, names, kinds)

    def by_right(table_batches):
        names, kinds = ["h", "h2", "doc", "at", "size"], (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        out = []
        for row, before, after in neighbours(table_batches):
            (x, p), (y, q) = compared(row, before, 5), compared(row, after, 5)
            _, doc, at, lk, mid, rk, most, skip_lo, skip_hi, marks = row
            for lo, hi in [*((m["lo"], m["hi"]) for m in marks), *(r for r in (p, q) if r)]:
                out.append((None, None, doc, at - hi, hi - lo + length))
            left = lk[::-1]
            for a in range(max(0, need - max(x, y)), min(most, need) + 1):
                if not skip_lo <= a <= skip_hi:
                    d = hashlib.blake2b(left[len(left) - a :] + mid + rk[: need - a], digest_size=16).digest()
                    out.append((int.from_bytes(d[:8], "little", signed=True), d[8:], doc, at - a, length))
            if len(out) > 4096:
                yield pack(out, names, kinds)
                out = []
        if out:
            yield pack(out, names, kinds)

    n = max(1, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sides = segments.filter("kind = 2").select("block", "doc", "at", "data", "left").mapInArrow(split, "fp long, doc long, at long, lk binary, mid binary, rk binary")
    first = sides.repartitionByRange(n, "fp", "lk", "rk").sortWithinPartitions("fp", "lk", "rk", "doc", "at").mapInArrow(by_left, _SIDES)
    second = materialize(first.repartitionByRange(n, "fp", "rk", "lk").sortWithinPartitions("fp", "rk", "lk", "doc", "at").mapInArrow(by_right, "h long, h2 binary, doc long, at long, size long"), "hot")
    counted = second.filter("h is not null")
    several = counted.groupBy("h", "h2").agg(F.min(F.struct("doc", "at")).alias("lo"), F.max(F.struct("doc", "at")).alias("hi")).filter("lo < hi").select("h", "h2")
    return second.filter("h is null").select("doc", "at", "size").unionByName(counted.join(several, ["h", "h2"], "left_semi").select("doc", "at", "size"))


def _indexed(segments: DataFrame, length: int) -> DataFrame:
    """Marks (doc, at, size) from the blocks."""

    def emit(docs, ats, datas):
        sizes = np.array([len(d) for d in datas])
        flat = np.frombuffer(b"".join(d + b"\xff" for d in datas), np.uint8)  # 0xff is in no UTF-8 text
        first = np.cumsum(sizes + 1) - sizes - 1
        valid = np.zeros(len(flat), bool)
        for f, n in zip(first.tolist(), sizes.tolist()):
            valid[f : f + max(0, n - length + 1)] = True
        hit = repeated_spans(flat, valid, length)
        which = np.searchsorted(first, hit, "right") - 1
        place = hit - first[which] + ats[which]
        cut = np.concatenate([[True], (which[1:] != which[:-1]) | (hit[1:] > hit[:-1] + length)]) if len(hit) else np.zeros(0, bool)
        f = np.flatnonzero(cut)
        l = np.concatenate([f[1:] - 1, [len(hit) - 1]]).astype(np.int64) if len(f) else f
        return pa.RecordBatch.from_arrays([pa.array(docs[which[f]]), pa.array(place[f]), pa.array(place[l] + length - place[f])], names=["doc", "at", "size"])

    def run(table_batches):
        block, rows = None, [[], [], []]
        for b in table_batches:
            for k, doc, at, data in zip(*(b.column(i).to_pylist() for i in range(4))):
                if k != block and rows[0]:
                    yield emit(np.array(rows[0], np.int64), np.array(rows[1], np.int64), rows[2])
                    rows = [[], [], []]
                block = k
                for c, v in zip(rows, (doc, at, data)):
                    c.append(v)
        if rows[0]:
            yield emit(np.array(rows[0], np.int64), np.array(rows[1], np.int64), rows[2])

    n = max(1, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = segments.filter("kind = 1").select("block", "doc", "at", "data").repartition(n, "block").sortWithinPartitions("block", "doc", "at")
    return dealt.mapInArrow(run, "doc long, at long, size long")


def repeated_bytes(docs: DataFrame, length: int = 200) -> DataFrame:
    """Columns of ``docs`` (extra ones stay) and ``__spans``: maximal runs of bytes of the
    UTF-8 text that are covered by strings of ``length`` bytes which also start anywhere
    else, in another text or the same one.

    Null text is empty.  A repeated row is a copy like any other: its text repeats as a
    whole.  Matches never cross texts.  ``length`` is 16 or more.
    """
    spark = docs.sparkSession
    doc, d = fresh(docs, "doc", "d")
    keyed = docs.withColumn(doc, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    slim = spread(keyed, F.col(doc).alias("doc"), "text")
    found = materialize(_classified(_anchor_rows(slim, length)), "anchors")
    todo = found.filter("kind > 0")
    total = todo.filter("kind = 1").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    segments = materialize(_surroundings(slim, todo, length, max(1, -(-total // BLOCK_BYTES))), "segments")
    marks = found.filter("kind = 0").select("doc", "at", F.col("size").cast("long").alias("size")).unionByName(_indexed(segments, length))
    if not segments.filter("kind = 2").isEmpty():
        marks = marks.unionByName(_hot_marks(segments, length))
    marks = materialize(marks, "marks")
    drop(found, segments)
    per = marks.groupBy(F.col("doc").alias(d)).agg(F.collect_list(F.struct(F.col("at").alias("s"), (F.col("at") + F.col("size")).alias("e"))).alias("__spans"))
    return keyed.join(per, keyed[doc] == per[d], "left").drop(d, doc)


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    rows = repeated_bytes(docs.select("doc_id", "text"), length).select("doc_id", "text", "__spans")

    def run(table_batches):
        for b in batches(table_batches):
            out = [[] for _ in range(5)]
            for text, w in zip(b.column(1).to_pylist(), b.column(2)):
                raw, spans = utf8(text), []
                if w.is_valid:
                    v = w.values
                    spans = merge_spans(list(zip(v.field(0).to_pylist(), v.field(1).to_pylist())))
                kept, at = [], 0
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]]) if spans else raw
                for c, x in zip(out, (len(raw), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
