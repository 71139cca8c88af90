"""Packing by minimum bin slack.

Documents become pieces of at most ``capacity`` ids.  For the next sequence a
subset-sum program over the multiset of remaining lengths runs on one integer as
a bitset (bit s: some chosen lengths add up to s); the largest reachable sum is
the least slack, and walking back through the stages gives how often each length
is used.  The pattern repeats while its counts last.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import batches, encoder, spread

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def least_slack(counts: dict[int, int], capacity: int, must: int | None = None) -> dict[int, int]:
    """How often to use each length so that the sum comes closest to ``capacity``
    without going over; ``must`` is used at least once.

    Lengths are added from the longest, each count in powers of two, and the
    program stops as soon as the capacity itself is reachable.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, stages = 1 << (must or 0), []
    left = dict(counts)
    if must:
        left[must] -= 1
    for length in sorted(left, reverse=True):
        n, times = min(left[length], capacity // length), 1
        while n > 0:
            k = min(times, n)
            stages.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            n, times = n - k, times * 2
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(stages):
        if not before >> at & 1:
            used[length] += k
            at -= length * k
    if must:
        used[must] += 1
    return used


def pack_lengths(lengths: list[int], capacity: int, keep_open: bool = False) -> tuple[list[list[int]], list[int]]:
    """Indexes of ``lengths`` (1 to capacity each) by sequence.  With ``keep_open``
    the pieces of sequences that are not full stay behind (second result) to be
    packed with later ones."""
    where: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        where[lengths[i]].append(i)
    full, rest = [[i] for i in where.pop(capacity, [])], []
    counts = {n: len(v) for n, v in where.items()}
    while counts:
        use = least_slack(counts, capacity, max(counts))
        whole = sum(n * k for n, k in use.items()) == capacity
        for _ in range(min(counts[n] // k for n, k in use.items())):
            items = [where[n].pop() for n, k in use.items() for _ in range(k)]
            if whole or not keep_open:
                full.append(items)
            else:
                rest += items
        counts = {n: len(v) for n, v in where.items() if v}
    return full, sorted(rest)


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, capacity: int = 2048, window_tokens: int = 1 << 20, with_ids: bool = False, plain_controls: bool = False) -> DataFrame:
    """Encode whole texts (null: empty), append ``end_id`` and pack everything.

    No shuffle, unless a large input has fewer partitions than there are cores: each partition is packed by itself in windows of
    ``window_tokens`` ids (the bound of a task's memory); what doesn't fill a sequence
    moves on to the next window, so only a partition's last sequences can have slack.
    Sequence ids are
    the partition number times 2^40 plus a counter; a lost task repeats the same ids.
    Control strings inside texts get their special ids; with ``plain_controls`` they are
    ordinary text.  A null doc_id stays null; repeated rows are documents of their own; ``with_ids`` adds
    the column ``ids`` (array of int).
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(table_batches):
        enc, tail = encoder(tokenizer, kind, plain_controls), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        items: list[tuple] = []  # doc_id, start, bytes, document's ids
        held = 0

        def flush(last):
            nonlocal items, held, sequence
            groups, rest = pack_lengths([len(x[2]) // 4 for x in items], capacity, keep_open=not last)
            cols = [[] for _ in range(8)]
            for g in groups:
                at = 0
                for i in g:
                    doc, start, raw, total = items[i]
                    for c, v in zip(cols, (doc, start, len(raw) // 4, zlib.crc32(raw), total, sequence, at, raw)):
                        c.append(v)
                    at += len(raw) // 4
                sequence += 1
            items = [items[i] for i in rest]
            held = sum(len(x[2]) for x in items) // 4
            if not cols[0]:
                return
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            out = {n: pa.array(c, pa.int64()) for n, c in zip(names, cols)}
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(cols[2])])
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(cols[7]), "<i4")))
            yield pa.RecordBatch.from_pydict(out)

        for b in batches(table_batches):
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                raw = ids + tail
                n = len(raw) // 4
                for s in range(0, n, capacity):
                    items.append((doc, s, raw[4 * s : 4 * (s + capacity)], n))
                held += n
                if held >= window_tokens:
                    yield from flush(False)
        if items:
            yield from flush(True)

    return spread(docs, F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
