"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersection.

Two documents link when ``100 * |A and B| >= percent * |A or B|`` for their sets of
distinct word shingles.  Equal sets are one class.  A link needs a shingle in common
among the first ``n - ceil(percent n / 100) + 1`` of each set, in one order of all
shingles (rare ones first, by a count-min sketch of fixed size), so classes meet in
tiles, one per such shingle.  Within a tile rows stand by set size, and only sizes in
the same band (ratio at least percent/100) meet; bitmaps of hashed shingles bound the
overlap from above, and what is left is decided by intersecting the sorted sets.

Large groups of near copies would meet in many tiles at once.  So classes are first
compared with the tile's hub (its smallest class), best-voted hub first, then
with the likeliest class of another component; once classes are known to be in one
component, tiles skip them.
What is left is done in full.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import connected_components
from ._store import drop, materialize
from ._text import batches, fresh, mix, shingle_hashes, whole_runs, word_hashes

SKETCH = 1 << 20
#: Rows of a shingle's tile beyond which it is cut into blocks that meet pairwise.
BLOCK = 4096
HUB_ROUNDS = 2
#: First shared shingles of a prefix: a pair is looked at in the tile of the first that both
#: have among these (else in every common tile), and these tiles have the wider bitmaps.
FIRST = 8
#: Bits a shingle, and the most bits, of a class's two bitmaps in tiles: a long text is in many,
#: so its bitmap there must not grow with it too.  Pairs are tried by whole ones afterwards.
ROOMS = ((2, 1 << 12), (8, 1 << 14))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (64 bit) of every whole text."""
    flat, counts = word_hashes(texts)
    runs = shingle_hashes(flat, n) if len(flat) >= n else flat
    out, at = [], 0
    for k in counts.tolist():
        out.append(np.unique(runs[at : at + k - n + 1] if k >= n else shingle_hashes(flat[at : at + k], n)))
        at += k
    return out


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """64-bit digests of sets without empty ones, as signed longs."""
    sizes = np.array([len(s) for s in sets])
    sums = np.add.reduceat(mix(np.concatenate(sets) + np.uint64(0xD6E8FEB86659FD93)), np.cumsum(sizes) - sizes, dtype=np.uint64)
    return mix(mix(sums) ^ sizes.astype(np.uint64)).view(np.int64)


def needed(a, b, percent: int):
    """Smallest overlap that links sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def bitmap(s: np.ndarray, room: int, most: int) -> np.ndarray:
    """One bit per shingle at its hash modulo a power of two of at least ``room`` times the
    set's size, but ``most`` (a fuller bitmap bounds the overlap less closely)."""
    bits = 64
    while bits < min(most, room * len(s)):
        bits *= 2
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    flat = np.zeros(bits, np.uint8)
    flat[at] = 1
    return np.packbits(flat, bitorder="little").view(np.uint64)


def _describe(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, th (text hash), n, cid of every row; and per task a sketch of shingle counts."""

    def run(table_batches):
        import zstandard

        sketch, known = np.zeros(SKETCH, np.uint32), {}
        for b in batches(table_batches):
            ths = b.column(1).to_pylist()
            if len(known) > 500_000:
                known.clear()
            new = {th: text for th, text in zip(ths, b.column(2).to_pylist()) if th not in known}  # equal texts once a task
            sets = shingle_sets(list(new.values()), n)
            full = [s for s in sets if len(s)]
            ids = iter(class_ids(full).tolist() if full else ())
            known.update({th: (len(s), next(ids) if len(s) else None) for th, s in zip(new, sets)})
            if full:
                np.add.at(sketch, (np.concatenate(full) >> np.uint64(44)).astype(np.int64), np.uint32(1))
            found = [known[th] for th in ths]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.nulls(len(ths), pa.binary())], names=["doc_id", "th", "n", "cid", "sketch"])
        if sketch.any():
            raw = zstandard.ZstdCompressor(level=1).compress(sketch.tobytes())
            one = lambda v, t: pa.array([v], t)
            yield pa.RecordBatch.from_arrays([one(None, pa.int64()), one(None, pa.int64()), one(None, pa.int64()), one(None, pa.int64()), one(raw, pa.binary())], names=["doc_id", "th", "n", "cid", "sketch"])

    return materialize(docs.mapInArrow(run, "doc_id long, th long, n long, cid long, sketch binary"), "sets")


def _merged_sketch(described: DataFrame) -> np.ndarray:
    """Sum of the tasks' sketches: partly on the executors, then one at a time here
    (each has the same fixed size)."""
    rows = described.filter("sketch is not null").select("sketch")
    n = max(1, int(rows.count() ** 0.5))

    def add(table_batches):
        import zstandard

        total = None
        for b in table_batches:
            for raw in b.column(0).to_pylist():
                one = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint32)
                total = one.astype(np.uint64) if total is None else total + one
        if total is not None:
            raw = zstandard.ZstdCompressor(level=1).compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict({"sketch": pa.array([raw], pa.binary())})

    import zstandard

    total = np.zeros(SKETCH, np.uint64)
    for r in rows.repartition(n).mapInArrow(add, "sketch binary").toLocalIterator():
        total += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.sketch)), np.uint32)
    return total


def _levels(total: np.ndarray) -> np.ndarray:
    """0 for counts that may be noise of the sketch, else by powers of two."""
    noise = 2 * total.mean() + 6 * total.mean() ** 0.5 + 8
    return np.where(total <= noise, 0, np.clip(np.log2(np.maximum(total, 1)), 0, 31)).astype(np.uint64)


def prefix(s: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the common order (by level, then by mixed hash), in it."""
    k = len(s) + (-percent * len(s) // 100) + 1
    order = (levels[(s >> np.uint64(44)).astype(np.int64)] << np.uint64(58)) | (mix(s) >> np.uint64(6))
    part = np.argpartition(order, k - 1)[:k] if k < len(s) else np.arange(len(s))
    return s[part[np.argsort(order[part])]]


def _texts(docs: DataFrame, described: DataFrame, levels, n: int, percent: int) -> DataFrame:
    """A row of every class: cid, text, n (set size), prefix (in the common order), two
    bitmaps of so many bits a shingle (sig2, sig8), and the whole one (sig; null where sig8 is)."""
    classes = described.filter("cid is not null").groupBy("cid").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("z"), "th")).alias("r"))
    reps = classes.select("cid", "r.*")
    own = docs.withColumns({"d": F.coalesce("doc_id", F.lit(0)), "z": F.col("doc_id").isNull()}).join(reps, ["d", "z", "th"])
    own = own.dropDuplicates(["d", "z", "th"]).select("cid", "text")  # of rows that repeat one

    def run(table_batches):
        for b in batches(table_batches):
            sets = shingle_sets(b.column(1).to_pylist(), n)
            parts = [prefix(s, levels.value, percent) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            sigs = [pa.array([bitmap(s, room, most).tobytes() for s in sets], pa.binary()) for room, most in ROOMS]
            room, most = ROOMS[1]
            sigs.append(pa.array([bitmap(s, room, 1 << 62).tobytes() if room * len(s) > most else None for s in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64))), *sigs], names=["cid", "text", "n", "prefix", "sig2", "sig8", "sig"])

    return materialize(own.mapInArrow(run, "cid long, text string, n int, prefix array<long>, sig2 binary, sig8 binary, sig binary"), "texts")


def _tiles(texts: DataFrame, percent: int) -> DataFrame:
    """Prefix shingles shared by sets of sizes in one band: token, cid, n, pos."""
    rows = texts.select("cid", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "cid", "n", "pos")
    by = "over (partition by token order by n, cid)"
    near = f"{percent} * lead(n) {by} <= 100 * n or {percent} * n <= 100 * lag(n) {by}"
    return materialize(rows.selectExpr("*", f"coalesce({near}, false) as near").filter("near").drop("near"), "tiles")


def _likely(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose whole bitmaps leave room for a link."""
    t = texts.select("cid", "n", F.coalesce("sig", "sig8").alias("sig"))
    side = lambda x: t.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.select("a", "b").hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(table_batches):
        for b in table_batches:
            keep = []
            for x, y, p, q in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                while len(p) > len(q):
                    p = p[: len(p) // 2] | p[len(p) // 2 :]
                while len(q) > len(p):
                    q = q[: len(q) // 2] | q[len(q) // 2 :]
                most = min(x - int(np.bitwise_count(p & ~q).sum(dtype=np.int64)), y - int(np.bitwise_count(q & ~p).sum(dtype=np.int64)))
                keep.append(most >= needed(x, y, percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(both.mapInArrow(run, "a long, b long"), "likely")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those (a, b) that link, by intersection of the sorted sets.  b's side comes in
    runs of equal b; a hub of very many pairs is split over tasks by the adaptive join."""
    t = texts.select("cid", "text")
    with_a = pairs.join(t.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(t.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(table_batches):
        kept = {}

        def of(c, text):
            if c not in kept:
                if len(kept) > 256:
                    kept.clear()
                kept[c] = shingle_sets([text], n)[0]
            return kept[c]

        for batch in batches(table_batches, column="ta"):
            out = []
            first = shingle_sets(batch.column(2).to_pylist(), n)
            for a, b, x, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), first, batch.column(3).to_pylist()):
                y = of(b, tb)
                m = np.concatenate([x, y])
                m.sort()
                both = int((m[1:] == m[:-1]).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return materialize(both.mapInArrow(run, "a long, b long"), "links")


def _near_labels(links: DataFrame) -> DataFrame:
    """id, label: classes of one label are in one component, but a component may have
    several: the smallest neighbour, that one's smallest neighbour, and so on a few steps."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label")), "near")
    out = near
    for _ in range(3):
        step = near.select(F.col("id").alias("label"), F.col("label").alias("to"))
        out = out.join(step, "label").select("id", F.col("to").alias("label"))
    out = materialize(out, "labels")
    drop(near)
    return out


def _labelled(tiles: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return tiles.withColumn("label", F.col("cid"))
    return tiles.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def _hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """For every class the hub of another component that most of its tiles vote for."""
    hub = rows.groupBy("token").agg(F.min(F.struct("cid", "n", "label")).alias("hub"))
    votes = rows.join(hub, "token").filter(F.col("label") != F.col("hub.label"))
    votes = votes.filter(F.lit(percent) * F.greatest("n", "hub.n") <= F.lit(100) * F.least("n", "hub.n"))
    votes = votes.groupBy(F.col("cid").alias("a"), F.col("hub.cid").alias("b")).count()
    return votes.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))


def tile_pairs(token, block, label, size, pos, sigs, first, percent: int, best: bool = False):
    """Pairs of row numbers that may link by their bitmaps, of rows sorted by (token, size): same
    token, other label, other block (-1: any), sizes of one band, places (``pos``, in the common
    order) that a link's first common shingle can have, no earlier tile in common that their
    first shingles show.  ``best``: of each row only the pair with most room."""
    room, partner = np.full(len(token), -1, np.int64), np.zeros(len(token), np.int64)
    found = []
    width = np.array([len(s) for s in sigs]) // 8
    flat = {}
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        m = np.frombuffer(b"".join(sigs[r] for r in rows), np.uint64).reshape(len(rows), w)
        flat[int(w)] = (m, rows)
    place = np.zeros(len(sigs), np.int64)
    for m, rows in flat.values():
        place[rows] = np.arange(len(rows))

    def folded(rows, w):
        """Bitmaps of ``rows`` at width w, which is their own or a smaller one."""
        out = np.empty((len(rows), w), np.uint64)
        for own in np.unique(width[rows]).tolist():
            pick = width[rows] == own
            x = flat[own][0][place[rows[pick]]]
            while x.shape[1] > w:
                x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
            out[pick] = x
        return out

    live, d = np.arange(len(token) - 1), 1
    while len(live):
        live = live[live + d < len(token)]
        other = live + d
        live = live[(token[other] == token[live]) & (percent * size[other] <= 100 * size[live])]
        other = live + d
        may = (label[live] != label[other]) & ((block[live] < 0) | (block[live] != block[other]))
        # what stands before a pair's first common shingle is in one of them only: it leaves no link beyond these places
        may &= np.minimum(size[live] - pos[live], size[other] - pos[other]) >= needed(size[live], size[other], percent)
        a, b = live[may], other[may]
        for s in range(0, len(a), 1 << 13):
            u, v = a[s : s + (1 << 13)], b[s : s + (1 << 13)]
            both = (first[1][u][:, :, None] == first[1][v][:, None, :]) & (first[0][v] < 1 << 31)[:, None, :]
            seen = (both.any(2) & (first[0][u] < pos[u][:, None])).any(1)
            u, v = u[~seen], v[~seen]
            low = np.minimum(width[u], width[v])
            for w in np.unique(low):
                x, y = u[low == w], v[low == w]
                p, q = folded(x, int(w)), folded(y, int(w))
                most = np.minimum(size[x] - np.bitwise_count(p & ~q).sum(1, dtype=np.int64), size[y] - np.bitwise_count(q & ~p).sum(1, dtype=np.int64))
                spare = most - needed(size[x], size[y], percent)
                ok = spare >= 0
                if not ok.any():
                    continue
                x, y, spare = x[ok], y[ok], spare[ok]
                if not best:
                    found.append(np.stack([x, y]))
                    continue
                order = np.argsort(spare)  # of equal rows the last one assigned has most room
                for own, other_ in ((x[order], y[order]), (y[order], x[order])):
                    more = spare[order] > room[own]
                    room[own[more]], partner[own[more]] = spare[order][more], other_[more]
        d += 1
    if best:
        own = np.flatnonzero(room >= 0)
        found = [np.stack([own, partner[own]])]
    return np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)


def _tile_pairs(tiles: DataFrame, labels: DataFrame | None, texts: DataFrame, percent: int, best: bool) -> DataFrame:
    """Candidate pairs of the tiles that still hold several components.  ``best``: of the classes' first tiles only, and of each
    class in them the likeliest pair; what these don't link is left to all pairs."""
    rows = _labelled(tiles, labels)
    several = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo < hi").select("token", "rows")
    left = materialize(rows.join(several, "token"), "left")
    cids = materialize(left.select("cid").distinct(), "cids")
    first = tiles.join(cids, "cid").groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "token"))), 1, FIRST).alias("first"))
    early = F.col("pos") <= F.element_at("first", -1)["pos"]
    rows = left.join(first, "cid")
    if best:
        rows = rows.filter(early).join(texts.select("cid", F.col("sig8").alias("sig")), "cid")
    else:
        rows = rows.join(texts.select("cid", "sig2", "sig8"), "cid").withColumn("sig", F.when(early, F.col("sig8")).otherwise(F.col("sig2")))
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.when(F.col("rows") > BLOCK, F.pmod(F.xxhash64("cid"), blocks).cast("int")).otherwise(F.lit(-1))
    tile = F.when(F.col("rows") > BLOCK, F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, "block").alias("p"), F.greatest(o, "block").alias("q")))).otherwise(F.array(F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("q"))))
    rows = rows.withColumn("block", own).withColumn("tile", F.explode(tile))
    rows = rows.select(F.xxhash64("token", "tile.p", "tile.q").alias("tile"), F.when(F.col("tile.p") == F.col("tile.q"), F.lit(-1)).otherwise(F.col("block")).alias("block"), "cid", "label", "n", "pos", "sig", "first")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "tile").sortWithinPartitions("tile", "n")

    def run(table_batches):
        for t in whole_runs(table_batches):
            tile, block, cid, label, size, pos = (np.asarray(t.column(i)).astype(np.int64) for i in range(6))
            lists = t.column(7).combine_chunks()
            there = np.arange(FIRST) < np.asarray(pc.list_value_length(lists))[:, None]
            first = np.zeros((2, *there.shape), np.int64)
            first[0][~there] = 1 << 31  # after every place
            for k in range(2):
                first[k][there] = np.asarray(lists.flatten().field(k))
            x, y = tile_pairs(tile, block, label, size, pos, t.column(6).to_pylist(), first, percent, best)
            a, b = np.minimum(cid[x], cid[y]), np.maximum(cid[x], cid[y])
            pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), pa.array(pairs[0])], names=["a", "b"])

    pairs = materialize(rows.mapInArrow(run, "a long, b long").distinct(), "pairs")
    drop(left, cids)
    return pairs


def components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``docs``: doc_id, th (xxhash64 of the text), n_shingles, label (of the
    component, null without words), component_id (smallest doc_id reachable by links,
    the row's own included).

    Null text and text without words: the empty set, linked with nothing, so the
    component is the row itself.  Fewer than ``n`` words: one shingle, the whole sequence.
    Repeated rows are equal sets.  A null doc_id is linked as any other but never names a
    component unless all its members are null.  Sets are compared by 64-bit hashes of
    shingles.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    described = _describe(docs, n)
    levels = spark.sparkContext.broadcast(_levels(_merged_sketch(described)).astype(np.uint64))
    texts = _texts(docs, described, levels, n, percent)
    tiles = _tiles(texts, percent)
    links, tested, labels = [], [], None

    def settle(pairs: DataFrame, last: bool = False) -> None:
        """Verify pairs not seen before and bring the labels up to date."""
        nonlocal labels
        if tested:
            pairs = pairs.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        likely = _likely(pairs, texts, percent)
        new = _verified(likely, texts, n, percent)
        drop(likely)
        tested.append(pairs)
        links.append(new)
        if not last and not new.isEmpty():
            old, labels = labels, _near_labels(reduce(DataFrame.unionByName, links))
            if old is not None:
                drop(old)

    for k in range(HUB_ROUNDS):
        settle(_hub_pairs(_labelled(tiles.filter(F.pmod("token", F.lit(8)) == k), labels), percent))
    for best in (True, False):
        pairs = _tile_pairs(tiles, labels, texts, percent, best)
        settle(pairs, last=not best)
        drop(pairs)
    drop(tiles, texts, *tested)
    drop(*([labels] if labels is not None else []))
    labels = connected_components(reduce(DataFrame.unionByName, links))
    drop(*links)
    rows = described.filter("n is not null").select("doc_id", "th", F.col("n").alias("n_shingles"), "cid")
    # classes first, then rows: a component of very many rows or classes is never one task's
    classes = rows.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
    classes = materialize(_labelled(classes, labels), "classes")
    least = materialize(classes.groupBy("label").agg(F.min("least").alias("least")), "least")
    whole = materialize(classes.select("cid", "label").join(least, "label"), "components")
    drop(classes, least, labels)
    out = rows.join(whole, "cid", "left").select("doc_id", "th", "n_shingles", "label", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    out._veldt_tables = (described, whole)
    return out


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each linked group stays: that of the smallest doc_id (null ids last;
    of repeated rows one).  Rows without words have no group and all stay."""
    th, d, h, one, k = fresh(docs, "th", "d", "h", "one", "k")
    keyed = docs.withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    found = components(docs, n, percent)
    c = materialize(found, "components")
    drop(*found._veldt_tables)
    own = c.filter(F.col("label").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = own.groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("r")).select(F.col("r.doc_id").alias(d), F.col("r.th").alias(h))
    empty = c.filter("label is null").select(F.col("doc_id").alias(d), F.col("th").alias(h)).distinct().withColumn(one, F.lit(False))
    stay = first.withColumn(one, F.lit(True)).unionByName(empty)
    out = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(th) == F.col(h)))
    if c.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
        return out.select(*docs.columns)
    repeated = Window.partitionBy(d, h).orderBy(th)
    return out.withColumn(k, F.row_number().over(repeated)).filter(~F.col(one) | (F.col(k) == 1)).select(*docs.columns)
