"""Compact windows against all passages."""

import random

import numpy as np

import pyarrow.parquet as pq

from veldt.llm import compact_windows as cw


def test_windows_stand_for_every_passage():
    rng = np.random.default_rng(1)
    for sizes, top, t in (((40, 0, 7, 12), 1000, 5), ((60,), 6, 7), ((30, 2), 1, 3), ((12, 3), 100, 13), ((25, 9), 4, 1), ((50, 50), 3, 46)):
        parts = [rng.integers(0, top, n).astype(np.uint64) for n in sizes]
        seen = {}
        for seq, a, b, c in zip(*(x.tolist() for x in cw.windows(np.concatenate(parts), np.array(sizes), t))):
            assert c >= a and parts[seq][c] == parts[seq][a : a + t].min()
            for i in range(a, b + 1):
                assert (seq, i) not in seen
                seen[seq, i] = parts[seq][c]
        assert seen == {(k, i): v[i : i + t].min() for k, v in enumerate(parts) for i in range(len(v) - t + 1)}
    assert not len(cw.windows(np.zeros(0, np.uint64), np.zeros(0, int), 3)[0])


def test_agreeing():
    rows = lambda *r: np.array(r, np.int64)
    assert cw.agreeing(rows((0, 1, 5), (1, 5, 9)), 2) and not cw.agreeing(rows((0, 1, 5), (1, 6, 9)), 2)
    assert not cw.agreeing(rows((0, 1, 5), (0, 2, 9), (0, 3, 4)), 2)


def text(rng, n, tag):
    return [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]


def test_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(3)
    rows, planted = [], {}
    for p in range(12):
        passage = text(rng, 70, "p")
        for k in range(4):
            own = list(passage)
            if k == 3:
                own[rng.randrange(60)] = "edited"
            rows.append((p * 10 + k, " ".join(text(rng, rng.randrange(40), "a") + own + text(rng, rng.randrange(300), "b"))))
            planted[p * 10 + k] = p * 10
    for i in range(40):
        rows.append((1000 + i, " ".join(text(rng, 200, "c"))))
    shared = text(rng, 30, "s")  # too short to count
    rows += [(2000 + i, " ".join(text(rng, 80, "d") + shared + text(rng, 80, "e"))) for i in range(10)]
    whole = " ".join(text(rng, 90, "w"))
    rows += [(3000, whole), (3001, whole), (3002, whole.upper()), (3001, whole), (None, whole), (4000, None), (4001, ""), (4002, "x " * 5000), (4003, "x " * 4000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, end string")
    got = cw.near_duplicate_passages(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.first_doc_id < r.doc_id and r.similarity >= 0.8 and r.end - r.start >= 50
    later = {d for d, f in planted.items() if d != f}
    assert set(by) == later | {3001, 3002, 4003}
    for d in later:
        assert max(r.end - r.start for r in by[d]) >= 45 and all(r.first_doc_id // 10 == d // 10 for r in by[d])
    out = {}
    for r in cw.remove_passages(df).collect():
        out.setdefault(r.doc_id, []).append(r.text)
    assert set(out) == {r[0] for r in rows} - {3001, 3002, 4003}
    before = dict(rows)
    assert all(out[d] == [before[d]] for d in out if d not in later and d is not None)
    assert all(len(out[d][0].split()) <= len(before[d].split()) - 65 for d in later)
    assert cw.near_duplicate_passages(df.limit(0)).count() == 0


def test_partners_behind_frequent_shingles(spark):
    rng = random.Random(5)
    rows, pairs = [], set()
    for i in range(10):
        a, b = text(rng, 30, "a"), text(rng, 30, "b")  # each half is frequent and too short to count
        for k in range(4):
            rows += [(i * 10 + k, " ".join(text(rng, 60, "u") + a + text(rng, 60, "v"))), (i * 10 + 5 + k, " ".join(text(rng, 60, "u") + b + text(rng, 60, "v")))]
        rows += [(1000 + i * 2 + k, " ".join(text(rng, 60, "u") + a + b + text(rng, 60, "v"))) for k in range(2)]
        pairs.add((1001 + i * 2, 1000 + i * 2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.first_doc_id) for r in cw.near_duplicate_passages(df).collect()} == pairs


def similar_starts(x, y, t, percent):
    """Starts in x of t shingles that are similar to t of y, by all pairs."""
    sets = [set(y[j : j + t].tolist()) for j in range(len(y) - t + 1)]
    own = [set(x[i : i + t].tolist()) for i in range(len(x) - t + 1)]
    return {i for i, u in enumerate(own) if any(100 * len(u & v) >= percent * len(u | v) for v in sets)}


def covers(x, y, t, percent):
    got = cw.passages(x, y, t, percent)
    for a, b, c, d, j in got:
        u, v = set(x[a : b + 1].tolist()), set(y[c : d + 1].tolist())
        assert b - a + 1 >= t and abs(len(u & v) / len(u | v) - j) < 1e-12 and 100 * j >= percent
    return got


def test_passages_against_all_pairs():
    rng = random.Random(9)
    of = lambda words: cw.shingles(" ".join(words), 5)
    p = text(rng, 60, "p")
    cases = [
        (p, [*p[28:33], *text(rng, 40, "z"), *p]),  # one middle shingle earlier in y
        (p, [*p[:30], *text(rng, 40, "z"), *p[20:], *text(rng, 9, "z"), *p]),  # a teaser and a part first
        (p[:50], [*p[:46], "edit", *p[47:50], *text(rng, 30, "z")]),  # an edit near the end
        (p[:50], [*p[:3], "edit", *p[4:50]]),
        (p, [*p[:30], "more", *p[30:]]),
    ]
    for u, v in cases:
        x, y = of([*text(rng, 70, "l"), *u, *text(rng, 70, "m")]), of([*text(rng, 33, "n"), *v, *text(rng, 50, "o")])
        assert similar_starts(x, y, 46, 80) and covers(x, y, 46, 80)
    for _ in range(60):  # words of few kinds, lines that repeat, pieces of x in y
        words = text(rng, 40, "w")
        x = [rng.choice(words) for _ in range(rng.randrange(60, 160))]
        y = [rng.choice(words) for _ in range(30)]
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(len(x) - 20)
            y += x[a : a + rng.randrange(5, 90)] + [rng.choice(words) for _ in range(rng.randrange(6))]
        x, y = of(x), of(y)
        want, got = similar_starts(x, y, 46, 80), covers(x, y, 46, 80)
        assert bool(want) <= bool(got)
        assert all(any(a < i + 46 and i <= b for a, b, *_ in got) for i in want)


def told(spans, i, t):
    """Whether the t shingles from i lie in spans (of shingles) but for GAP of them."""
    return t - len(set(range(i, i + t)) & {k for a, b in spans for k in range(a, b)}) <= cw.GAP


def test_tables_against_all_pairs(spark, sf):
    """Every passage that an earlier document has too is told; of similar ones nine in ten."""
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    n, t, percent = 5, 46, 80
    docs = {r["doc_id"]: cw.shingles(r["text"], n) for r in sorted(rows, key=lambda r: r["doc_id"])}
    spans = {}
    for r in cw.near_duplicate_passages(df).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end - n + 1))
        assert r.first_doc_id < r.doc_id
        x, y = docs[r.doc_id][r.start : r.end - n + 1], docs[r.first_doc_id][r.first_start : r.first_end - n + 1]
        u, v = set(x.tolist()), set(y.tolist())
        assert len(x) >= t and 100 * len(u & v) >= percent * len(u | v)
    seen, equal = set(), 0
    for d, s in docs.items():
        at = np.arange(max(0, len(s) - t + 1))
        own = cw.Stretches(s).of(at, at + t).tolist()
        for i in [i for i, h in enumerate(own) if h in seen][::7]:
            equal += 1
            assert told(spans.get(d, []), i, t), (d, i)
        seen.update(own)
    found = similar = 0
    ids = list(docs)
    sets = {d: set(docs[d].tolist()) for d in ids}
    for k, d in enumerate(ids):
        for e in ids[:k]:
            if len(sets[d] & sets[e]) >= 37 and 0 < len(docs[d]) * len(docs[e]) < 60_000:
                for i in similar_starts(docs[d], docs[e], t, percent):
                    similar += 1
                    found += told(spans.get(d, []), i, t)
    assert equal > 100 and similar > 100 and found >= 0.9 * similar
