"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from veldt.llm import queries
from veldt.llm import run_length_index as rl


def brute(texts, length):
    seen, out = {}, []
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        for i in range(len(r) - length + 1):
            k = r[i : i + length]
            seen[k] = seen.get(k, 0) + 1
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_and_matches():
    rng = random.Random(1)
    for n, letters in ((1, "a"), (50, "ab"), (300, "a"), (400, "abc"), (700, "abcdefgh")):
        part = "".join(rng.choices(letters, k=n))
        data = (part + part[: n // 2] + "".join(rng.choices(letters, k=20)) + "z").encode()
        d = np.frombuffer(data, np.uint8)
        sa = rl.suffix_array(d)
        assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        m = rl.RunLengthIndex(d).matching_statistics()
        lcp = lambda a, b: next((k for k, (x, y) in enumerate(zip(data[a:], data[b:])) if x != y), len(data) - max(a, b))
        place = {s: i for i, s in enumerate(sa.tolist())}
        for i in range(len(data)):
            near = [sa[j] for j in (place[i] - 1, place[i] + 1) if 0 <= j < len(data)]
            assert m[i] == max((lcp(i, int(j)) for j in near), default=0)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    w = rng.integers(97, 123, 200).astype(np.uint8)
    places = []
    for _ in range(20):
        a, b = rng.integers(97, 123, rng.integers(0, 90)).astype(np.uint8), rng.integers(97, 123, 50).astype(np.uint8)
        d = np.concatenate([a, w, b])
        flags = np.zeros(len(d) - 199, bool)
        flags[len(a)] = True
        places.append(int(rl.anchors(rl.Rolling(d), flags, 200)[0]) - len(a))
    assert len(set(places)) == 1 and 0 <= places[0] <= 100


def test_tables(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op2_substring_dedup(spark, sf).collect()}
    want = brute([d["text"] for d in docs], 200)
    assert all(got[d["doc_id"]] == w for d, w in zip(docs, want)) and any(w[1] for w in want)


@pytest.mark.parametrize("hot,piece,block", [(4096, 4 << 20, 3 << 20), (2, 700, 2000)])
def test_planted(spark, monkeypatch, hot, piece, block):
    monkeypatch.setattr(rl, "HOT", hot)
    monkeypatch.setattr(rl, "PIECE", piece)
    monkeypatch.setattr(rl, "BLOCK_BYTES", block)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdé \n", k=n))
    shared = [word(n) for n in (90, 180, 200, 201, 230, 400, 900)]
    texts = [None, "", "a" * 100, "a" * 150, "b" * 199, "c" * 200, "d" * 201, "e" * 5000, "xy" * 1500, word(199), "\0" * 250, "\0" * 150]
    for k in range(40):
        texts.append(word(rng.randrange(300)) + rng.choice(shared) + word(rng.randrange(300)) + rng.choice(shared) + word(rng.randrange(50)))
    long = word(3000)
    texts += [long, long, long[:1500] + "!" + long[1500:], long[1000:1150], long[2000:2250], word(2500) + long[500:720] + word(900)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x"), (None, shared[-1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rl.remove_repeats(df).collect())
    want = sorted((i if i is not None else -1, *w) for (i, _, _), w in zip(rows, brute([r[1] for r in rows], 200)))
    assert got == want
    assert rl.remove_repeats(df.limit(0)).count() == 0
