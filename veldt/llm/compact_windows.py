"""Near-duplicate passages by compact windows.

For a min-hash function over the word shingles of a text, a compact window (l, c, r)
stands for all passages that begin in l..c and end in c..r: their minimum is at c.
Splitting a range at its minimum (the root of its Cartesian tree) lists the windows of
all passages of at least ``t`` shingles; there are about 2n/t of them.  Windows with the
same minimum meet; for a pair of texts the intervals of passage starts are joined by a
and where enough functions agree the passages are verified: aligned runs of
equal shingles whose sets have a Jaccard similarity of at least the threshold.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import drop, materialize
from ._text import batches, fresh, mix, shingle_hashes, spread, utf8, whole_runs, word_hashes

FUNCTIONS = 4
ENOUGH = 2
#: Unmatched shingles that an aligned run may skip: two neighbouring edits.
GAP = 12
#: Shingles that a verifying task remembers.
HELD = 4_000_000
#: Classes of a key beyond which it is cut into blocks that meet pairwise.
BLOCK = 2048
#: Of a context's bitmap.
BITS = 1024


def shingle_lists(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Hashes of the n words at every position of each text; none for shorter texts."""
    flat, counts = word_hashes(texts)
    runs = shingle_hashes(flat, n) if len(flat) >= n else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    return [runs[e - k : max(e - k, e - n + 1)] for e, k in zip(ends.tolist(), counts.tolist())]


def shingles(text: str | None, n: int) -> np.ndarray:
    return shingle_lists([text], n)[0]


def windows(values: np.ndarray, sizes: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows of all ranges of at least ``t`` values in sequences that stand one
    after another: (sequence, first start, last start, minimum's place) within the sequence.

    The Cartesian tree's node c, of the range l..r, is a window if that has t values; its
    passages of t values start at max(l, c - t + 1) .. min(c, r - t + 1).  These are the
    runs of starts with one minimum, so sliding minima list the nodes without the tree.
    Starts next to each other that have equal minima are one run."""
    ends = np.cumsum(sizes)
    starts = np.maximum(sizes - t + 1, 0)
    none = np.zeros(0, np.int64)
    if not starts.any():
        return none, none, none, none
    low, span = values, 1
    while 2 * span <= t:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < t:
        low = np.minimum(low[: len(values) - t + 1], low[t - span :])
    seq = np.repeat(np.arange(len(sizes)), starts)  # of each start that has t values
    at = np.arange(len(seq)) - np.repeat(np.cumsum(starts) - starts, starts)
    flat = at + (ends - sizes)[seq]
    m = low[flat]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (seq[1:] != seq[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(m) - 1]])
    c = np.empty(len(first), np.int64)
    for k in range(0, len(first), 1 << 14):
        w = flat[first[k : k + (1 << 14)]]
        c[k : k + (1 << 14)] = values[w[:, None] + np.arange(t)].argmin(1)
    return seq[first], at[first], at[last], at[first] + c


def agreeing(rows: np.ndarray, enough: int) -> bool:
    """Whether a passage start lies in intervals (function, a, b) of enough functions."""
    events: dict[int, np.ndarray] = {}
    for f in np.unique(rows[:, 0]):
        own = rows[rows[:, 0] == f]
        own = own[np.argsort(own[:, 1])]
        ends = np.maximum.accumulate(own[:, 2])
        new = np.concatenate([[True], own[1:, 1] > ends[:-1]])
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(own) - 1]])
        events[int(f)] = np.stack([own[new, 1], ends[last]], 1)  # disjoint intervals of one function
    if len(events) < enough:
        return False
    all_ = np.concatenate(list(events.values()))
    at = np.concatenate([all_[:, 0] * 2, all_[:, 1] * 2 + 1])  # starts before ends at one place
    step = np.concatenate([np.ones(len(all_), np.int64), -np.ones(len(all_), np.int64)])
    return int(np.cumsum(step[np.argsort(at, kind="stable")]).max()) >= enough


def _similarity(u: np.ndarray, v: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two lists' sets."""
    sizes = []
    for s in (u, v):
        s = np.sort(s)
        sizes.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
    both = np.concatenate(sizes)
    both.sort()
    both = int((both[1:] == both[:-1]).sum())
    return both, len(sizes[0]) + len(sizes[1]) - both


def _new_places(y: np.ndarray, t: int) -> np.ndarray:
    """Whether the t - 1 shingles on both sides of a place haven't been seen earlier in y:
    a passage of t shingles around a place that was is there in y already."""
    edge = mix(np.arange(1, 2 * t - 1, dtype=np.uint64))
    v = mix(np.concatenate([edge[: t - 1], y, edge[t - 1 :]]))
    power = np.cumprod(np.full(len(v), 0x9E3779B97F4A7C15, np.uint64))
    inverse = np.cumprod(np.full(len(v), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * power, dtype=np.uint64)])
    context = (total[2 * t - 1 :] - total[: len(y)]) * inverse[: len(y)]
    out = np.zeros(len(y), bool)
    out[np.unique(context, return_index=True)[1]] = True
    return out


def fewest(s: np.ndarray, t: int) -> np.ndarray:
    """Number of distinct shingles of every passage of ``t``, by its start."""
    order = np.argsort(s, kind="stable")
    before = np.full(len(s), -1, np.int64)  # place of the same shingle before
    same = np.flatnonzero(s[order[1:]] == s[order[:-1]])
    before[order[same + 1]] = order[same]
    starts = np.arange(len(s) - t + 1)
    if not (before > np.arange(len(s)) - t).any():
        return np.full(len(starts), t)
    out = np.zeros(len(starts), np.int64)
    for k in range(t):
        out += before[k : k + len(starts)] < starts
    return out


def _stretched(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, t: int, percent: int, may: np.ndarray):
    """A run of under ``t`` shingles with as many unmatched ones at its edges as make
    ``t``, by the most similar choice; None if no choice is similar.  ``may``: the starts in
    x at which enough shingles are somewhere in y."""
    first = max(0, int(p[-1]) - t + 1)
    starts = first + np.flatnonzero(may[first : min(int(p[0]), len(x) - t) + 1])
    best = None
    for d in {int(q[0] - p[0]), int(q[-1] - p[-1])} if len(starts) else ():
        for a in starts.tolist():
            c, e = max(0, a + d), min(len(y), a + d + t)
            both, all_ = _similarity(x[a : a + t], y[c:e]) if c < e else (0, 1)
            if 100 * both >= percent * all_ and (best is None or both / all_ > best[4]):
                best = (a, a + t - 1, c, e - 1, both / all_)
    return best


def places(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of y by shingle, and the shingles in that order."""
    order = np.argsort(y, kind="stable")
    return order, y[order]


def passages(x: np.ndarray, y: np.ndarray, t: int, percent: int, known: tuple | None = None) -> list[tuple[int, int, int, int, float]]:
    """(x first, x last, y first, y last, similarity) of passages of x of at least ``t``
    shingles whose sets are similar to a passage of y; shingle numbers, last inclusive.

    Matches with the first occurrence in y are followed over any drift; those with all
    occurrences within bands of diagonals."""
    order, ys = known or places(y)
    lo, n = np.searchsorted(ys, x), np.searchsorted(ys, x, "right")
    n -= lo
    p = np.flatnonzero(n)
    if len(p) < 1 or (p[-1] - p[0] + 1 < t and 2 * len(p) < t):
        return []
    hits = np.concatenate([[0], np.cumsum(n > 0)])
    may = None
    q = order[lo[p]]
    turn = np.flatnonzero((np.diff(p) > GAP) | (np.abs(np.diff(q - p)) > GAP)) + 1
    runs = [(p[a:b], q[a:b]) for a, b in zip([0, *turn], [*turn, len(p)])]
    if len(runs) > 1 or n.max() > 1:
        if n.max() > 1:
            new = _new_places(y, t)
            order = order[new[order]]
            ys = y[order]
            lo, n = np.searchsorted(ys, x), np.searchsorted(ys, x, "right")
            n -= lo
        ap = np.repeat(np.arange(len(x)), n)
        aq = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        for shift in (0, GAP):  # diagonals at most GAP apart are in one band of one of both
            band = (aq - ap + len(x) + shift) // (2 * GAP)
            at = np.lexsort((aq, ap, band))
            bp, bq, band = ap[at], aq[at], band[at]
            turn = np.concatenate([[0], np.flatnonzero((np.diff(band) != 0) | (np.diff(bp) > GAP)) + 1, [len(bp)]])
            some = np.flatnonzero(np.diff(turn) >= t // 2)
            runs += [(bp[turn[i] : turn[i + 1]], bq[turn[i] : turn[i + 1]]) for i in some]
    out, todo = set(), sorted(runs, key=lambda r: r[0][-1] - r[0][0])  # the longest first
    upto = np.full(len(x), -1)  # the last place of what has been told from here or before

    def tell(*r) -> None:
        out.add(r)
        upto[r[0] : r[1] + 1] = np.maximum(upto[r[0] : r[1] + 1], r[1])

    while todo:
        p, q = todo.pop()
        if upto[p[0]] >= p[-1]:
            continue
        if p[-1] - p[0] + 1 < t:
            if 2 * len(p) >= t and len(x) >= t:
                if may is None:
                    may = 100 * (hits[t:] - hits[:-t]) >= percent * fewest(x, t)
                if best := _stretched(x, y, p, q, t, percent, may):
                    tell(*best)
            continue
        a, b, c, d = int(p[0]), int(p[-1]), int(q.min()), int(q.max())
        both, all_ = _similarity(x[a : b + 1], y[c : d + 1])
        if 100 * both >= percent * all_:
            if 100 * (d - c + 1) >= percent * t:  # else x repeats what y has once
                tell(a, b, c, d, both / all_)
        else:
            cut = int(np.argmax(np.maximum(np.diff(p), np.abs(np.diff(q)))) + 1)
            todo += [(p[:cut], q[:cut]), (p[cut:], q[cut:])]
    kept, reach, best = [], -1, None  # the fewest that tell the same places of x
    for r in sorted(out, key=lambda r: (r[0], -r[1], -r[4], r[2])):
        if r[0] > reach + 1 and best and best[1] > reach:
            kept.append(best)
            reach, best = best[1], None
        if r[1] > reach and (not best or r[1] > best[1]):
            best = r
    if best and best[1] > reach:
        kept.append(best)
    return kept


def _rows(docs: DataFrame, n: int, t: int) -> DataFrame:
    def run(table_batches):
        seeds = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for b in batches(table_batches):
            sets = shingle_lists(b.column(1).to_pylist(), n)
            flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
            ids = np.asarray(b.column(0))
            for f, seed in enumerate(seeds):
                v = mix(flat ^ seed)
                doc, first, last, c = windows(v, sizes, t)
                if len(doc):
                    key = v[(np.cumsum(sizes) - sizes)[doc] + c] ^ np.uint64(f)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc]), pa.array(np.full(len(doc), f, np.int8)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(c.astype(np.int32))], names=["key", "doc", "f", "a", "b", "c"])

    return docs.mapInArrow(run, "key long, doc long, f byte, a int, b int, c int")


def _with_hub(rows: DataFrame) -> DataFrame:
    """Rows of keys that several documents have, with the smallest of them."""
    key = Window.partitionBy("key")
    return rows.withColumns({"hub": F.min("doc").over(key), "__last": F.max("doc").over(key)}).filter("hub < __last").drop("__last")


def _candidates(rows: DataFrame) -> DataFrame:
    """(doc, hub) where enough functions agree on a passage start."""

    def run(table_batches):
        for b in table_batches:
            x, y = [], []
            for doc, hub, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                v = part.values
                if agreeing(np.stack([np.asarray(v.field(i)).astype(np.int64) for i in range(3)], 1), ENOUGH):
                    x.append(doc)
                    y.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["doc", "hub"])

    pairs = rows.filter("doc <> hub").groupBy("doc", "hub").agg(F.collect_list(F.struct("f", "a", "b")).alias("w")).filter(F.size(F.array_distinct(F.transform("w", lambda r: r["f"]))) >= ENOUGH)
    return pairs.mapInArrow(run, "doc long, hub long")


def meetings(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows (function, a, b, c, key) of one document, where windows of all functions
    have passage starts in common: their joint key, first and last of these starts, and
    first and last of the minima."""
    own = [rows[rows[:, 0] == f] for f in range(FUNCTIONS)]
    a, b, first, last, key = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    for f, v in enumerate(own):
        v = v[np.argsort(v[:, 1])]  # disjoint: a start has one window a function
        if not f:
            a, b, first, last, key = v[:, 1], v[:, 2], v[:, 3], v[:, 3], v[:, 4].view(np.uint64)
            continue
        lo, hi = np.searchsorted(v[:, 2], a), np.searchsorted(v[:, 1], b, "right")
        n = np.maximum(hi - lo, 0)
        i = np.repeat(np.arange(len(a)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        a, b, first, last = np.maximum(a[i], v[j, 1]), np.minimum(b[i], v[j, 2]), np.minimum(first[i], v[j, 3]), np.maximum(last[i], v[j, 3])
        key = mix(mix(key[i]) ^ v[j, 4].view(np.uint64))
    return key, a, b, first, last


def _joint(rows: DataFrame) -> DataFrame:
    """(key, doc, a, b, lo, hi): the joint keys of all functions within documents."""

    def run(table_batches):
        for b in table_batches:
            out = [[] for _ in range(6)]
            for doc, part in zip(b.column(0).to_pylist(), b.column(1)):
                v = part.values
                k, *at = meetings(np.stack([np.asarray(v.field(i)).astype(np.int64) for i in range(5)], 1))
                for col, x in zip(out, (k.view(np.int64), np.full(len(k), doc, np.int64), *at)):
                    col.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(out, [pa.int64()] * 2 + [pa.int32()] * 4)], names=["key", "doc", "a", "b", "lo", "hi"])

    several = F.collect_list(F.struct("f", "a", "b", "c", "key"))
    return rows.groupBy("doc").agg(several.alias("w"), F.count_distinct("f").alias("n")).filter(F.col("n") == FUNCTIONS).select("doc", "w").mapInArrow(run, "key long, doc long, a int, b int, lo int, hi int")


class Stretches:
    """Hashes of any stretches of a list of shingles."""

    def __init__(self, y: np.ndarray):
        power = np.cumprod(np.full(len(y), 0x9E3779B97F4A7C15, np.uint64))
        self.inverse = np.cumprod(np.full(len(y) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(y) * power, dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of shingles a..b-1."""
        return mix((self.total[b] - self.total[a]) * self.inverse[a] ^ (b - a).astype(np.uint64))


def _open(joint: DataFrame, spans: DataFrame, n: int, t: int) -> DataFrame:
    """``joint`` with a mark on rows that found passages (of any partners) leave open.
    Passages at most GAP shingles apart are one stretch; a row is explained if a stretch has
    all its minima, or all but GAP shingles of all its passages."""
    own = spans.select(F.col("doc_id").alias("doc"), F.col("start").alias("s"), (F.col("end") - n).alias("t")).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("s", "t"))).alias("spans"))

    def longer(out, x):
        last = F.try_element_at(out, F.lit(-1))
        more = F.struct(last["s"].alias("s"), F.greatest(last["t"], x["t"]).alias("t"))
        near = (F.size(out) > 0) & (x["s"] <= last["t"] + GAP + 1)
        return F.when(near, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(out, F.array(x)))

    seen = own.select("doc", F.aggregate("spans", F.expr("cast(array() as array<struct<s: bigint, t: bigint>>)"), longer).alias("spans"))
    before, behind = lambda x: F.greatest(x["s"] - F.col("a"), F.lit(0)), lambda x: F.greatest(F.col("b") + (t - 1) - x["t"], F.lit(0))
    inside = F.exists("spans", lambda x: (x["s"] <= F.col("lo")) & (x["t"] >= F.col("hi")) | (before(x) <= GAP) & (behind(x) <= GAP) & (before(x) + behind(x) <= GAP))
    return joint.hint("merge").join(seen, "doc", "left").select("key", "doc", "a", "b", "first", (~F.coalesce(inside, F.lit(False))).alias("open"))


def fewest_in(s: np.ndarray, a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Least number of distinct shingles of the passages of ``t`` that start at a..b."""
    few = fewest(s, t)
    return np.minimum.reduceat(np.append(few, t), np.stack([a, b + 1], 1).ravel())[::2]


def alike(tile, block, doc, is_open, bits, sizes, few, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (later, earlier), sorted by (tile, doc): the later one open, of other
    documents, of other blocks (-1: any), whose bitmaps allow similar passages of so many
    distinct shingles."""
    found = []
    live, d = np.arange(len(tile) - 1), 1
    while len(live):
        live = live[live + d < len(tile)]
        live = live[tile[live + d] == tile[live]]
        x, y = live + d, live
        may = is_open[x] & (doc[x] != doc[y]) & ((block[x] < 0) | (block[x] != block[y]))
        x, y = x[may], y[may]
        for k in range(0, len(x), 1 << 14):
            u, v = x[k : k + (1 << 14)], y[k : k + (1 << 14)]
            p, q = bits[u], bits[v]
            most = np.minimum(sizes[u] - np.bitwise_count(p & ~q).sum(1, dtype=np.int64), sizes[v] - np.bitwise_count(q & ~p).sum(1, dtype=np.int64))
            ok = most * (100 + percent) >= percent * (few[u] + few[v])
            found.append(np.stack([u[ok], v[ok]]))
        d += 1
    return tuple(np.concatenate(found, 1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _contexts(rows: DataFrame, texts: DataFrame, n: int, t: int) -> DataFrame:
    """``rows`` with what their passages have: a hash of it all (ctx), a bitmap of the
    shingles, their number, and the least number of distinct ones in a passage."""

    def run(table_batches):
        for batch in batches(table_batches):
            for doc, s, part in zip(batch.column(0).to_pylist(), shingle_lists(batch.column(1).to_pylist(), n), batch.column(2)):
                v = part.values
                key, a, b = (np.asarray(v.field(i)).astype(np.int64) for i in range(3))
                there = np.flatnonzero(b + t <= len(s))  # else another text of that id
                if not len(there):
                    continue
                a, b = a[there], b[there]
                bits, sizes = np.zeros((len(a), BITS // 8), np.uint8), np.zeros(len(a), np.int32)
                for k, (i, j) in enumerate(zip(a.tolist(), (b + t).tolist())):
                    own = np.unique(s[i:j])
                    flat = np.zeros(BITS, np.uint8)
                    flat[(own & np.uint64(BITS - 1)).astype(np.int64)] = 1
                    bits[k], sizes[k] = np.packbits(flat, bitorder="little"), len(own)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(a), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key[there]), pa.array(np.full(len(a), doc, np.int64)), v.field(3).take(pa.array(there)), pa.array(Stretches(s).of(a, b + t).view(np.int64)), raw, pa.array(sizes), pa.array(fewest_in(s, a, b, t).astype(np.int32))], names=["key", "doc", "open", "ctx", "bits", "size", "few"])

    own = rows.groupBy("doc").agg(F.collect_list(F.struct("key", "a", "b", "open")).alias("w"))
    return texts.hint("merge").join(own, "doc").select("doc", "text", "w").mapInArrow(run, "key long, doc long, open boolean, ctx long, bits binary, size int, few int")


def _partners(rows: DataFrame, texts: DataFrame, n: int, t: int, percent: int) -> DataFrame:
    """(doc, hub), hub earlier, that explain the open rows of each key if anything does.
    Rows of equal contexts are a class: its later documents meet its first one, which has
    the same passage.  Of the first ones, those whose bitmaps allow a similar passage
    meet; keys of many classes are dealt in blocks that meet pairwise."""
    by = Window.partitionBy("key")
    left = rows.withColumns({"first": F.min("doc").over(by), "last": F.max(F.when(F.col("open"), F.col("doc"))).over(by)}).filter("first < last and (open and doc > first or doc < last)")
    left = materialize(_contexts(left, texts, n, t), "contexts")
    classes = left.groupBy("key", "ctx").agg(F.min(F.struct("doc", "open", "bits", "size", "few")).alias("r"), F.max("doc").alias("last"), F.max("open").alias("any"))
    classes = materialize(classes, "classes")
    same = left.filter("open").join(classes.filter("any and r.doc < last").select("key", "ctx", F.col("r.doc").alias("hub")), ["key", "ctx"]).filter("hub < doc").select("doc", "hub").distinct()
    same = materialize(same, "same")
    drop(left)
    heads = classes.select("key", "r.*").withColumn("blocks", F.ceil(F.count("*").over(by) / BLOCK).cast("int"))
    many = F.col("blocks") > 1
    heads = heads.withColumn("block", F.when(many, F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).otherwise(F.lit(-1)))
    pair = lambda o: F.struct(F.least(o, "block").alias("p"), F.greatest(o, "block").alias("q"))
    one = F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("q"))
    tiles = heads.withColumn("meet", F.explode(F.when(many, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).otherwise(F.array(one))))
    tiles = tiles.select(F.xxhash64("key", "meet.p", "meet.q").alias("tile"), F.when(F.col("meet.p") == F.col("meet.q"), F.lit(-1)).otherwise(F.col("block")).alias("block"), "doc", "open", "size", "few", "bits")
    tiles = tiles.repartition("tile").sortWithinPartitions("tile", "doc")

    def run(table_batches):
        sent = set()
        for r in whole_runs(table_batches):
            tile, block, doc, is_open, size, few = (r.column(i).to_numpy() for i in range(6))
            bits = np.frombuffer(b"".join(r.column(6).to_pylist()), np.uint64).reshape(len(tile), BITS // 64)
            x, y = alike(tile, block, doc, is_open, bits, size.astype(np.int64), few.astype(np.int64), percent)
            pairs = np.unique(np.stack([doc[x], doc[y]]), axis=1).T.tolist()
            new = [p for p in map(tuple, pairs) if p not in sent]  # neighbouring keys have the same pairs
            sent.update(new) if len(sent) < 1_000_000 else sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], names=["doc", "hub"])

    pairs = materialize(tiles.mapInArrow(run, "doc long, hub long").unionByName(same).distinct(), "pairs")
    drop(classes, same)
    return pairs


def _verified(pairs: DataFrame, texts: DataFrame, n: int, t: int, percent: int) -> DataFrame:
    # by merge at every size: pairs grow with the corpus, and texts are never broadcast
    x, y = texts.select("doc", F.col("text").alias("tx")), texts.select(F.col("doc").alias("hub"), F.col("text").alias("ty"))
    both = pairs.hint("merge").join(x, "doc").hint("merge").join(y, "hub").select("doc", "hub", "tx", "ty")

    def run(table_batches):
        kept, room = {}, HELD
        last = (None, None)

        def of(text):
            """Shingles of a text; those met lately are remembered."""
            nonlocal room
            out = kept.pop(text, None)
            if out is None:
                out = shingles(text, n)
                room -= len(out) + 100
            kept[text] = out
            while room < 0 and len(kept) > 1:
                room += len(kept.pop(next(iter(kept)))) + 100
            return out

        for batch in batches(table_batches, column="tx"):
            out = [[] for _ in range(7)]
            for doc, hub, tx, ty in zip(*(c.to_pylist() for c in batch.columns)):
                if last[0] != ty:
                    y = of(ty)
                    last = (ty, y, places(y))
                x, y = of(tx), last[1]
                if len(x) and len(y):
                    for a, b, c, d, j in passages(x, y, t, percent, last[2]):
                        for col, v in zip(out, (doc, a, b + n, hub, c, d + n, j)):  # words, end exclusive
                            col.append(v)
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "start", "end", "first_doc_id", "first_start", "first_end", "similarity"])

    return materialize(both.mapInArrow(run, "doc_id long, start long, end long, first_doc_id long, first_start long, first_end long, similarity double"), "passages")


def near_duplicate_passages(docs: DataFrame, n: int = 5, min_words: int = 50, percent: int = 80) -> DataFrame:
    """A row per longest passage of a document that is near a passage of an earlier one
    (smaller doc_id), with one such document: doc_id, start, end (words, end exclusive), first_doc_id, first_start,
    first_end, similarity (of the passages' sets of ``n``-word shingles).

    Every document is compared with the first document of each window key it shares.
    Windows of two functions that meet at a passage start have a joint key; where no
    found passage holds both minima, a document is compared with every earlier document of
    the joint key.
    Null, empty and short texts have no passages.  Rows without an id are ignored; rows
    that repeat an id are texts of one document and not compared with each other.
    Passages repeated inside one document are not looked for.  Other columns are ignored.
    """
    t = min_words - n + 1
    docs = spread(docs.filter("doc_id is not null"), F.col("doc_id").cast("long").alias("doc"), "text")
    rows = materialize(_with_hub(_rows(docs, n, t)), "windows")
    pairs = materialize(_candidates(rows), "pairs")
    texts = materialize(docs.join(rows.select("doc").distinct().hint("merge"), "doc", "left_semi"), "texts")
    found = _verified(pairs, texts, n, t, percent)
    # the first of each joint key, then the first open one, explain most of what is left
    key = Window.partitionBy("key")
    joint = materialize(_joint(rows).withColumns({"first": F.min("doc").over(key), "__last": F.max("doc").over(key)}).filter("first < __last").drop("__last"), "joint")
    drop(rows)
    for hub in (F.col("first"), F.min(F.when(F.col("doc") > F.col("first"), F.col("doc"))).over(key)):
        new = _open(joint, found, n, t).filter("open").withColumn("hub", hub).filter("hub < doc").select("doc", "hub").distinct()
        more = materialize(new.hint("merge").join(pairs, ["doc", "hub"], "left_anti"), "pairs")
        pairs = pairs.unionByName(more)
        found = found.unionByName(_verified(more, texts, n, t, percent))
    # and every open row meets all earlier documents of its key
    rest = materialize(_partners(_open(joint, found, n, t), texts, n, t, percent).hint("merge").join(pairs, ["doc", "hub"], "left_anti"), "pairs")
    drop(joint)
    found = found.unionByName(_verified(rest, texts, n, t, percent))
    # of a document's passages those that lie in no other one; of equal ones one
    wide = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), F.desc("similarity"), "first_doc_id", "first_start").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("__upto", F.max("end").over(wide)).filter("__upto is null or end > __upto").drop("__upto")


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def remove_passages(docs: DataFrame, n: int = 5, min_words: int = 50, percent: int = 80) -> DataFrame:
    """``docs`` without the later copies of near-duplicate passages: the words of each
    are cut from the text, the first occurrence stays.  Documents of which no word is
    left go; documents without such passages stay as they are."""
    from .decontamination import merge_spans

    d, cut = fresh(docs, "d", "spans")
    spans = near_duplicate_passages(docs, n, min_words, percent).groupBy(F.col("doc_id").alias(d)).agg(F.collect_set(F.struct("start", "end")).alias(cut))
    joined = docs.join(spans, docs["doc_id"] == F.col(d), "left").drop(d)
    names = joined.columns
    at, where = names.index("text"), names.index(cut)

    def run(table_batches):
        for b in batches(table_batches):
            keep, texts = [], []
            for text, raw in zip(b.column(at).to_pylist(), b.column(where).to_pylist()):
                if raw:
                    data = utf8(text)
                    words = [m.span() for m in _WORD.finditer(data)]
                    parts, place = [], 0
                    for s, e in merge_spans([(r["start"], r["end"]) for r in raw]):
                        if s < len(words):
                            parts.append(data[place : words[s][0]])
                            place = words[min(e, len(words)) - 1][1]
                    text = b"".join([*parts, data[place:]]).decode("utf-8", "surrogatepass")
                keep.append(not raw or bool(text.strip(" \t\n\x0b\x0c\r")))
                texts.append(text)
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names)) if i != where]
            yield pa.RecordBatch.from_arrays(cols, names=[x for x in names if x != cut]).filter(pa.array(keep))

    return joined.mapInArrow(run, docs.schema)
