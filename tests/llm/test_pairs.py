"""Operators on pairs of documents, against brute force."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from veldt.llm import ngram_join


def brute_sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(n, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    return out


def brute_components(ids, texts, n, percent):
    sets = brute_sets(texts, n)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    seen = set()
    for group in by.values():
        for x in range(len(group)):
            for y in range(x):
                i, j = group[x], group[y]
                if (i, j) in seen or 100 * min(len(sets[i]), len(sets[j])) < percent * max(len(sets[i]), len(sets[j])):
                    continue
                seen.add((i, j))
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, d in enumerate(ids)}


def near_texts(seed, n_base=12, copies=14):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "one", "One", "one two", "a b c d", "A b  c\nd"]
    for _ in range(n_base):
        base = rng.choices(vocab, k=rng.choice([12, 40, 150, 400]))
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], ["new%d" % rng.randrange(99)], [t[i], "x"]])
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("n,percent,block", [(3, 90, 4096), (5, 80, 4)])
def test_components(spark, n, percent, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = near_texts(n)
    ids = random.Random(1).sample(range(10_000), len(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id long, text string, label string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df, n, percent).collect()}
    assert got == brute_components(ids, texts, n, percent)


def test_components_on_the_tables(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    from veldt.llm import queries

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_ngram_join(spark, sf).collect()}
    assert got == brute_components([d["doc_id"] for d in docs], [d["text"] for d in docs], 3, 90)


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, "a"), (2, long + " more", "b"), (2, long + " more", "b"), (7, None, "c"), (7, None, "c"), (9, "", "d"), (2, "another text that is not like it", "e"), (None, long, "f"), (None, "alone without an id", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sorted((r.doc_id or 0, r.label) for r in ngram_join.keep_one(df).collect())
    assert got == [(0, "g"), (2, "b"), (2, "e"), (7, "c"), (7, "c"), (9, "d")]
    assert ngram_join.keep_one(df.limit(0)).count() == 0 and ngram_join.keep_one(df).columns == df.columns


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    levels = np.zeros(ngram_join.SKETCH, np.uint64)
    for _ in range(300):
        base = rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([base[rng.random(len(base)) > 0.1], rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)])) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(ngram_join.prefix(a, levels, 80), ngram_join.prefix(b, levels, 80)))


def test_tiles_pair_only_where_a_first_common_shingle_can_stand():
    rng = np.random.default_rng(5)
    levels = np.zeros(ngram_join.SKETCH, np.uint64)

    def pairs(sets):
        parts = [{int(x): k for k, x in enumerate(ngram_join.prefix(s, levels, 80))} for s in sets]
        rows = sorted((t, len(sets[i]), i, parts[i][t]) for t in set(parts[0]) & set(parts[1]) for i in (0, 1))
        token, size, i, pos = (np.array([r[k] for r in rows], np.uint64).astype(np.int64) for k in range(4))
        first = np.zeros((2, len(rows), ngram_join.FIRST), np.int64)
        first[0] = 1 << 31
        sigs = [ngram_join.bitmap(sets[k], 2, 64).tobytes() for k in i]
        return ngram_join.tile_pairs(token, np.full(len(rows), -1), i, size, pos, sigs, first, 80).shape[1] if rows else 0

    linked = 0
    for _ in range(300):
        base = rng.integers(0, 2**63, rng.integers(20, 200)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([base[rng.random(len(base)) > 0.08], rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            linked += 1
            assert pairs((a, b))
    assert linked > 50
    # of 100 shingles the first 15 are each set's own: 85 of 115 in common are no link, and bitmaps of 64 bits can't tell
    own = [rng.integers(0, 2**63, 15).astype(np.uint64) for _ in range(2)]
    common = rng.integers(0, 2**63, 85).astype(np.uint64)
    levels[(common >> np.uint64(44)).astype(np.int64)] = 5
    assert pairs([np.unique(np.concatenate([x, common])) for x in own]) == 0


def test_pages_of_one_template_are_no_candidates(spark, monkeypatch):
    counts = []

    def counted(*args, old=ngram_join._tile_pairs):
        out = old(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_tile_pairs", counted)
    template, other = ([f"{x}{i}" for i in range(200)] for x in "tz")
    texts = [" ".join([f"p{k}x{i}" for i in range(30)] + rest) for k in range(24) for rest in (template, [f"{w}k{k}" for w in other])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80).collect()}
    assert got == brute_components(range(len(texts)), texts, 5, 80)
    assert sum(counts) == 0
