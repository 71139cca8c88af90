"""The n-gram trie: sequences, normalisation and scores."""

import math
import re
import tracemalloc
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow.parquet as pq

from veldt.llm import ngram_trie as nt


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((0, 10), (1, 1), (1, 2**40), (5, 5), (1000, 1500), (3000, 2**60), (5000, 10**6)):
        v = np.unique(rng.integers(0, top, n).astype(np.uint64))
        if n == 5000:
            v = np.unique(np.concatenate([v[v < 1000], v[v > 900_000]]))
        ef = nt.EliasFano({"x." + k: a for k, a in nt.ef_build(v, top).items()}, "x.")
        assert (ef.get(np.arange(len(v))) == v).all()
        q = np.unique(np.concatenate([v, rng.integers(0, top, 2000).astype(np.uint64), np.array([0, top - 1, top + 5], np.uint64)]))
        at = ef.find(q)
        lo = rng.integers(0, len(v) + 1, len(q))
        hi = np.minimum(len(v), lo + rng.integers(0, 40, len(q)))
        assert (ef.find(q, lo, hi) == np.where((at >= lo) & (at < hi), at, -1)).all()
        assert (at[np.isin(q, v)] == np.arange(len(v))).all() and (at[~np.isin(q, v)] == -1).all()
    runs = np.repeat(np.arange(50, dtype=np.uint64) * np.uint64(3), rng.integers(0, 200, 50))
    ef = nt.EliasFano({"x." + k: a for k, a in nt.ef_build(runs, 151).items()}, "x.")
    assert (ef.get(np.arange(len(runs))) == runs).all()


def brute(docs, order):
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
    held = {d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, _ in docs}
    grams = [Counter() for _ in range(order)]
    for d, t in docs:
        if not held[d]:
            w = split(t)
            for i in range(len(w)):
                for k in range(order):
                    if i - k >= -1:
                        grams[k][tuple((["\n"] + w)[i - k + 1 : i + 2])] += 1
    uni = grams[0]
    n, v = sum(uni.values()), len(uni)
    kept = grams
    total = [Counter() for _ in range(order)]
    mass = [Counter() for _ in range(order)]
    for k in range(1, order):
        for g, c in grams[k].items():
            total[k][g[:-1]] += c
        for g, c in kept[k].items():
            mass[k][g[:-1]] += (c - nt.DISCOUNT) / total[k][g[:-1]]

    def p(g):
        if len(g) == 1:
            return (uni[g] + 0.5) / (n + 0.5 * (v + 1))
        k, ctx = len(g) - 1, g[:-1]
        low = p(g[1:])
        return (1 - mass[k][ctx]) * low + ((kept[k][g] - nt.DISCOUNT) / total[k][ctx] if g in kept[k] else 0)

    out = {}
    for d, t in docs:
        w = split(t)
        full = ["\n", *w]
        s = sum(math.log10(p(tuple(full[max(0, i + 2 - order) : i + 2]))) for i in range(len(w)))
        out[d] = (held[d], len(w), sum(uni[x,] > 0 for x in w), n, sum(math.log10(p((x,))) for x in w), s)
    return out, p, uni


def test_scores(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()] + [(10**6, None), (10**6 + 1, ""), (None, "word Word  wörd \x1c"), (10**6 + 3, "a " * 3000)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, score string")
    for order in (1, 2, 3):
        want, _, _ = brute(docs, order)
        got = {r.doc_id: tuple(r)[1:] for r in nt.score(df, nt.train(df, order)).collect()}
        assert set(got) == set(want)
        for d, w in want.items():
            g = got[d]
            assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9)
            assert abs(g[5] - w[5]) <= 0.02 * w[1] + 1e-6 if order > 1 else math.isclose(g[5], w[5], rel_tol=1e-9)
    held = [d for d, w in want.items() if w[0]]
    assert sum(got[d][5] for d in held) > sum(got[d][4] for d in held)
    assert nt.score(df.limit(0), nt.train(df.limit(0))).count() == 0
    none = nt.score(df.filter("doc_id = 1000001"), nt.train(df.limit(0))).first()
    assert none.train_tokens == 0 and none.n_known == 0


def test_distributions_sum_to_one(spark):
    docs = [(i, "a b c a b d a b c e") for i in (0, 1, 2)] + [(4, "b b b a c c")]
    assert not any(nt.is_held_out(d) for d, _ in docs)
    pairs = {p for _, t in docs for p in zip(["", *t.split()], [*t.split(), ""])}
    model = nt.train(spark.createDataFrame(docs, "doc_id long, text string"))
    rank, count = model.ranks(nt.tokens_of(["a b c d e"])[0])
    assert sorted(rank.tolist()) == list(range(6)) == list(range(model.words))
    base = (np.append(count, 0) + 0.5) / (model.tokens + 0.5 * (model.words + 1))  # the last: never seen
    every, seen = np.append(rank, -1), set()
    for first in [*rank.tolist(), -1]:
        index, own, weight = model.children(0, np.full(7, first), every, weights=True)
        p = 10.0**weight * base + np.where(index >= 0, 10.0**own, 0)
        assert math.isclose(p.sum(), 1, rel_tol=1e-6) and (index[-1] == -1)
        for context in index[index >= 0].tolist():
            i3, own3, weight3 = model.children(1, np.full(7, context), every, weights=True)
            assert math.isclose((10.0**weight3 * p + np.where(i3 >= 0, 10.0**own3, 0)).sum(), 1, rel_tol=1e-6)
            seen.add(context)
    assert len(seen) == len(pairs)  # all of them, those that occur once too


def test_default_order_counts_trigrams(spark):
    df = spark.createDataFrame([(i, "a b c d e") for i in range(40)], "doc_id long, text string")
    assert len(nt.train(df).levels) == 2


def test_files_are_made_piece_by_piece():
    """A file's arrays take less memory than its blobs unpacked, with contexts that lie in several pieces."""
    rng = np.random.default_rng(5)
    words, here, n_pieces, n_blobs, each = 500_000, 3, 8, 30, 25_000
    span = -(-here * words // n_pieces)
    pieces = []
    for p in range(n_pieces):
        top = min((p + 1) * span, here * words)
        found = [np.unique(rng.integers(p * span, top, each, np.uint64), return_counts=True) for _ in range(n_blobs)]
        pieces.append([nt._blob(*x) for x in found])
    entries = n_pieces * n_blobs * each
    tracemalloc.start()
    got = nt.level_arrays(map(iter, pieces), words, here)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * entries

    keys, counts = nt._sum_sorted(*(np.concatenate(x) for x in zip(*(nt._unblob(b) for p in pieces for b in p))))
    assert counts.sum() == entries
    ctx = (keys // np.uint64(words)).astype(np.int64)
    share = (counts - nt.DISCOUNT) / np.bincount(ctx, counts)[ctx]
    for k, v in nt.ef_build(keys, here * words).items():
        assert got["id." + k].dtype == v.dtype and (got["id." + k] == v).all()
    for k, v in nt.ef_build(np.concatenate([[0], np.cumsum(np.bincount(ctx))]), len(keys) + 1).items():
        assert (got["child." + k] == v).all()
    assert np.abs(got["prob.book"][got["prob.code"]] - np.log10(share)).max() <= np.ptp(np.log10(share)) / 255 + 1e-6
    assert np.allclose(got["weight.book"][got["weight.code"]], np.log10(1 - np.bincount(ctx, share)), atol=1e-2)


def test_small_files_and_pieces_score_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(rng.choice(list("abcdefg"), 30, p=[0.6, 0.2, 0.08, 0.05, 0.04, 0.02, 0.01]))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want, _, _ = brute(docs, 3)
    for small in ({"shard_tokens": 1, "flush_tokens": 50, "pieces": 3}, {"shard_tokens": 300, "flush_tokens": 50, "pieces": 50, "key_bits": 8}):
        with monkeypatch.context() as m:
            m.setattr(nt, "_add_level", partial(nt._add_level, **small))
            got = {r.doc_id: tuple(r)[1:] for r in nt.score(df, nt.train(df)).collect()}
        for d, w in want.items():
            assert got[d][:4] == w[:4] and abs(got[d][5] - w[5]) <= 0.02 * w[1] + 1e-6
