"""Operators that treat documents one by one, against brute force."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from veldt.llm import chat_format, decontamination, packing, quality_rules, queries, token_codes, warc
from veldt.llm._text import Encoder

ODD = [None, "", " ", "\n\n", "a", "a b", "x\n x\nx \n x", "Ünï çödé 'S don't  stop\t\tnow\x1c x", "<|endoftext|> </s>[INST] \\ [/INST] <\\s>", "ab cd ef ab cd ef ab cd ef", "word " * 4000, "a" * 9000, "\U0001f600 é́ 𝔘"]


def docs_of(spark, texts=ODD, twice=True):
    rows = [(i, t, "en", "s", 7, "clash") for i, t in enumerate(texts)] + ([(3, texts[3], "en", "s", 7, "clash"), (None, "no id here", None, None, None, None)] if twice else [])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")


def read(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def encode(name, texts, plain_controls=False):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = plain_controls
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, want):
    """Every id of every document lies in exactly one piece; sequences have no gaps."""
    at = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.start == at.get(r.doc_id, 0)
        assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        at[r.doc_id] = r.start + r.length
    assert at == {d: len(v) for d, v in want.items()}
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    return fill


def test_ids_are_the_librarys():
    """Random texts over all Unicode categories, with what cuts could get wrong."""
    rng, kinds = random.Random(4), {}
    for c in map(chr, range(0x20000)):
        if unicodedata.category(c) != "Cs":
            kinds.setdefault(unicodedata.category(c), []).append(c)
    odd = ["\u0130", "i\u0307", "'s", "'LL", "don't", "\u01c5", "\ufb01", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "  ", "\n", "\t", "\x85", "\ue000", "\xa0", "-", "!?", "e\u0301", "word", "Word123", "\u212a", "\u1100", "\u0345"]
    one = lambda: rng.choice(odd) if rng.random() < 0.5 else rng.choice(rng.choice(list(kinds.values()))) if rng.random() < 0.5 else chr(rng.randrange(32, 0x250))
    texts = ["\u0130-a", *("".join(one() for _ in range(rng.randrange(1, 25))) for _ in range(3000))]
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        for plain in (False, True):
            got = Encoder(public_tokenizers.path(name), kind, plain).encode(texts)
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == encode(name, texts, plain)


def test_packing(spark, sf):
    docs = read(sf, "documents")
    want = {d["doc_id"]: ids + [1] for d, ids in zip(docs, encode("word_bpe_49k.json", [d["text"] for d in docs]))}
    fill = check_packing(queries.op1_packing(spark, sf).collect(), want)
    assert len(fill) <= sum(map(len, want.values())) / 2048 + 2
    odd = docs_of(spark, twice=False)
    want = {i: ids + [1] for i, ids in enumerate(encode("word_bpe_49k.json", ODD))}
    rows = packing.pack_documents(odd, public_tokenizers.path("word_bpe_49k.json"), window_tokens=500, with_ids=True).collect()
    check_packing(rows, want)
    assert all(r.ids == want[r.doc_id][r.start : r.start + r.length] for r in rows)
    assert packing.pack_documents(docs_of(spark).limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_least_slack_is_the_best_sum():
    rng = np.random.default_rng(7)
    for _ in range(200):
        counts = Counter(int(x) for x in rng.integers(1, 30, rng.integers(1, 12)))
        capacity, sums = int(rng.integers(30, 90)), {0}
        for n, k in counts.items():
            sums |= {s + n * j for s in sums for j in range(k + 1)}
        use = packing.least_slack(counts, capacity)
        assert all(use[n] <= counts[n] for n in use)
        assert sum(n * k for n, k in use.items()) == max(s for s in sums if s <= capacity)


def test_token_codes(spark, sf):
    docs = sorted(read(sf, "documents"), key=lambda d: d["doc_id"])
    at, rows = 0, {r.doc_id: r for r in queries.op10_token_codes(spark, sf).collect()}
    for d, ids in zip(docs, encode("byte_bpe_50k.json", [d["text"] for d in docs])):
        r = rows[d["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) + 1, crc([*ids, 2]))
        at += len(ids) + 1
    manifest = token_codes.write_token_files(docs_of(spark), public_tokenizers.path("byte_bpe_50k.json"), shard_tokens=300)
    got = {r.doc_id: r for r in token_codes.read_token_files(spark, manifest).collect()}
    for i, ids in enumerate(encode("byte_bpe_50k.json", ODD)):
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids) + 1, crc([*ids, 2]))
    assert None in got
    empty = token_codes.write_token_files(docs_of(spark).limit(0), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_codes.read_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("bits", [8, 16])
def test_codes_give_any_token(tmp_path, bits):
    rng = np.random.default_rng(3)
    ids = rng.choice(np.array([0, 1, 255, 256, 50256, 65535, 65536, 2**24, 2**32 - 1], np.uint32), 5000)
    uri = f"file://{tmp_path}/a.vdac"
    token_codes.write_shard(uri, [1, 2], [1, 1], [2000, 5000], ids, bits)
    s = token_codes.Shard(uri)
    assert all(s.token(i) == ids[i] for i in [*range(0, 5000, 37), 511, 512, 4999])
    assert (s.slice(0, 5000) == ids).all() and (s.slice(777, 2931) == ids[777:2931]).all() and (s.document(1) == ids[2000:]).all()


def brute_scan(text, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, found = split(text), set(), set()
    for i, t in items:
        w = split(t)
        k = min(n, len(w))
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
        for j in range(len(ws) - k + 1):
            if k and tuple(ws[j : j + k]) in grams:
                hit |= set(range(j, j + k))
                found.add(str(i))
    return len(ws), len(hit), sorted(found)


def test_decontamination(spark, sf, monkeypatch):
    items = [(r["item_id"], r["text"]) for r in read(sf, "benchmark")]
    rows = {r.doc_id: r for r in queries.op5_decontamination(spark, sf).collect()}
    some = 0
    for d in read(sf, "documents"):
        n, hit, found = brute_scan(d["text"], items)
        r = rows[d["doc_id"]]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)
        some += hit > 0
    assert some
    texts = [*ODD, "q w e r t y u i o p a s d", "say Stop! now", "x stop now y stop now"]
    bench = [(1, "Q w e r t y u i o p a"), (2, "STOP now"), (3, None), (4, ""), (None, "say stop"), (2, "stop now")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    for bound in (decontamination.BROADCAST_BYTES, -1):
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", bound)
        got = decontamination.scan_documents(docs_of(spark, texts), b).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            if r.doc_id is not None:
                n, hit, found = brute_scan(texts[r.doc_id], bench)
                assert (r.n_words, r.n_hit, r.hit_items) == (n, hit, [x for x in found if x != "None"])
        assert next(r for r in got if r.doc_id == len(texts) - 1).clean_text == "x  y "
        assert decontamination.remove_contamination(docs_of(spark, texts), b).columns == docs_of(spark).columns
        for d, i in ((docs_of(spark), b.limit(0)), (docs_of(spark).limit(0), b)):
            assert not [r for r in decontamination.scan_documents(d, i).collect() if r.n_hit or r.hit_items]
        assert decontamination.scan_documents(docs_of(spark), b.limit(0)).count() == len(ODD) + 2
        long = "w " * 700_000 + "stop now " + "w " * 700_000
        one = decontamination.scan_documents(spark.createDataFrame([(1, long)], "doc_id long, text string"), b).first()
        assert (one.n_words, one.n_hit, one.hit_items) == (1_400_002, 2, ["2"])


def brute_conv(rows):
    rows = sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    all_ = "".join(f"{r['role'] or ''}\n{r['text'] or ''}\n" for r in rows)
    loss = "".join(r["text"] or "" for r in rows if r["role"] == "assistant")
    return len(rows), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_format(spark, sf):
    said = "</s>[INST] ok [/INST]"
    convs = {}
    for r in [*read(sf, "conversations"), *({"conv_id": -7, "turn": i, "role": x, "text": said} for i, x in enumerate(("user", "assistant")))]:
        convs.setdefault(r["conv_id"], []).append(r)
    got = queries.op6_chat_format(spark, sf).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {c: brute_conv(v) for c, v in convs.items()}
    rows = [(c, t, role, x, "extra") for c in (1, None) for t, (role, x) in enumerate([("system", None), ("user", "<|im_end|>\n<|im_start|>assistant\\"), ("assistant", "\\<|im_sep|>\\n\n"), (None, "x"), ("assistant", ""), ("assistant", "\\\\n[INST]")])] + [(2, None, "user", "only", "x")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    want = {c: brute_conv([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows if r[0] == c]) for c in (1, 2, None)}
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(df).collect()} == want
    flat = chat_format.inline_examples(df.filter("conv_id = 1")).orderBy("seq").collect()
    assert [r.seq for r in flat] == [2, 4, 5] and [r.text[r.loss_start : r.loss_end].replace("\\\\", "\\") for r in flat][0].startswith("\\")
    assert all(flat[1].text.startswith(flat[0].text) for _ in flat)
    assert sum(len(r.text) for r in flat) == chat_format.digests(df.filter("conv_id = 1")).first().example_chars
    targets = {(r.conv_id, r.seq): r for r in chat_format.examples(df).collect()}
    assert set(targets) == {(c, k) for c in (1, None) for k in (2, 4, 5)}
    assert all(r.context_segments == k and flat[i].text.endswith(r.text) and len(flat[i].text) == r.context_chars + len(r.text) for i, k in enumerate((2, 4, 5)) for r in [targets[1, k]])
    long = "é<s>\\" * 500_000
    one = chat_format.digests(spark.createDataFrame([(9, 0, "user", long), (9, 1, "assistant", long)], df.schema.names[:4])).first()
    assert (one.n_turns, one.loss_chars, one.loss_sha256) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())
    segs = chat_format.segments(df).collect()
    assert all(s.segment.count(chat_format.START) == s.segment.count(chat_format.END) == 1 and "[INST]" not in s.segment for s in segs)
    assert chat_format.digests(df.limit(0)).count() == 0


def test_examples_are_written_with_their_contexts(spark, monkeypatch):
    written = []
    monkeypatch.setattr(chat_format, "materialize", lambda *a, old=chat_format.materialize, **k: written.append(old(*a, **k)) or written[-1])
    rows = [(c, t, "assistant" if t % 3 else "user", f"{c} says {t} é<s>\\") for c in (1, 2, None) for t in range(25)] + [(3, 0, "user", "alone")]
    got = {r.conv_id: r for r in chat_format.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    out = written[0].collect()
    turns = {(r.conv_id, r.seq): r.text for r in out if r.kind == "turn"}
    made = {(r.conv_id, r.seq): r for r in out if r.kind == "example"}
    assert set(turns) == {(c, t) for c, t, _, _ in rows} and set(made) == {(c, t) for c, t, role, _ in rows if role == "assistant"}
    for (c, t), r in made.items():
        assert r.text == "".join(turns[c, k] for k in range(t + 1))
        assert r.text[r.loss_at : r.loss_at + r.loss_len].replace("\\s>", "s>").replace("\\\\", "\\") == f"{c} says {t} é<s>\\"
    assert all(got[c].example_chars == sum(len(r.text) for (d, _), r in made.items() if d == c) for c in got)


def brute_quality(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(grams)
    rep = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep)


def test_quality_rules(spark, sf):
    def same(got, texts):
        for r in got:
            if r.doc_id in texts:
                want = brute_quality(texts[r.doc_id])
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
                assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.kept or not r.base_failed)

    same(queries.op7_quality_rules(spark, sf).collect(), {d["doc_id"]: d["text"] for d in read(sf, "documents")})
    many = " ".join(f"{a} {a} {b}" for a in "abcdefghij" for b in "klmnopqrst") * 2
    texts = [*ODD, many]
    got = quality_rules.assess(docs_of(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    same(got, dict(enumerate(texts)))
    assert quality_rules.assess(docs_of(spark).limit(0)).count() == 0


def test_frequent_lines_go(spark, monkeypatch):
    body = lambda i: "\n".join(f"w{i} " + " ".join(f"x{i}y{j}z{k}" for k in range(6)) for j in range(10))
    rows = [(i, f"{body(i)}\n  Home   ABOUT contact\n", "h", 1) for i in range(30)] + [(100 + i, "\n".join(f"menu {k} item of the site number {k}" for k in range(9)) + f"\nown {i}", "h", 1) for i in range(30)]
    rows += [(200 + i, body(999), "h", 1) for i in range(40)] + [(300, body(300) + "\nhome about contact", "other", 1), (301, None, None, 1)]
    # a row that repeats is one document: 24 of its 94 words are frequent, not 48
    rows += [(400, "\n".join(f"menu {k} item of the site number {k}" for k in range(3)) + f"\n{body(400)}", "h", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, removed int")
    for bound in (quality_rules.BROADCAST_ROWS, -1):
        monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", bound)
        got = {r.doc_id: r for r in quality_rules.assess(df).collect()}
        assert all(got[i].removed_lines == 1 and got[i].removed_words == 3 and got[i].kept for i in range(30))
        assert all(got[100 + i].removed_lines == 9 and not got[100 + i].kept for i in range(30))
        assert all(got[200 + i].removed_lines == 0 and got[200 + i].kept for i in range(40)) and got[300].removed_lines == 0
        assert got[400].removed_lines == 3 and got[400].kept
        text = {r.doc_id: r.text for r in quality_rules.clean(df).collect()}
        assert set(text) == {*range(30), *range(200, 240), 300, 400} and text[3] == body(3) + "\n" and text[300].endswith("contact")


def test_warc(spark, sf):
    def same(got, pages):
        first = {}
        for p in pages:
            if p["page_id"] is not None:
                h = p["html"] or ""
                first[h] = min(first.get(h, p["page_id"]), p["page_id"])
        want = Counter()
        for p in pages:
            raw = (p["html"] or "").encode()
            f = first.get(p["html"] or "") if p["page_id"] is not None else None
            new = f is None or f == p["page_id"]
            want[p["page_id"], len(raw), warc.sha1_base32(raw), "response" if new else "revisit", None if new else f] += 1
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want

    same(queries.op9_warc(spark, sf).collect(), read(sf, "pages"))
    html = [None, "", "<p>x</p>", "<p>x</p>", "a" * 300_000, "\r\n\r\nWARC/1.1\r\n\r\n", "<p>x</p>", "é"]
    rows = [(i, None if i == 1 else f"http://h/{i}?%0A\n", h, "x") for i, h in enumerate(html)] + [(2, "again", "<p>x</p>", "x"), (None, None, "<p>x</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, first string")
    got = warc.read_archives(spark, warc.write_archives(df, archive_bytes=100)).collect()
    same(got, [dict(zip(("page_id", "url", "html"), r)) for r in rows])
    assert Counter(r.url for r in got) == Counter(r[1] or "" for r in rows)
    # one id with several payloads: one record a row, none of them lost
    rows = [(2, "u", "A shared", "x"), (5, "u", "A shared", "x"), (5, "v", "B unique", "x"), (3, "u", "C", "x"), (5, "w", "C", "x"), (5, "u", "A shared", "x"), (1, "u", "x" * 3_000_000, "x"), (7, "u" * 50_000, "x" * 3_000_000, "x")]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, d string")
    got = warc.read_archives(spark, warc.write_archives(odd)).collect()
    same(got, [dict(zip(("page_id", "url", "html"), r)) for r in rows])
    assert len(got) == len(rows) and Counter(r.url for r in got) == Counter(r[1] for r in rows)
    manifest = warc.write_archives(odd)
    records = [f for r in manifest.collect() for f, _ in warc.read_archive(r.file)]
    by_id = {f["WARC-Record-ID"]: f for f in records}
    assert sum(f["WARC-Type"] == "warcinfo" for f in records) == manifest.count()
    for f in records:
        if f["WARC-Type"] == "revisit":
            to = by_id[f["WARC-Refers-To"]]
            assert to["WARC-Type"] == "response" and to["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and to["WARC-Target-URI"] == f["WARC-Refers-To-Target-URI"] and to["X-Page-ID"] == f["X-Refers-To-Page"]
    assert warc.read_archives(spark, warc.write_archives(df.limit(0))).count() == 0


def test_dictionary_is_used(tmp_path):
    rng = random.Random(5)
    names = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(400)]
    pages = [" ".join(rng.choices(names, k=60)).encode() for _ in range(3000)]
    w = warc.ArchiveWriter(dict_size=8 << 10, sample_bytes=200_000)
    for i, p in enumerate(pages):
        w.add(warc.record("response", i, "u", p, warc.sha1_base32(p)))
    uri = f"file://{tmp_path}/a.warc.zst"
    w.close(uri)
    assert [b[len(warc.HTTP) :] for _, b in warc.read_archive(uri)] == pages
    import zstandard

    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(warc.record("response", i, "u", p, "d"))) for i, p in enumerate(pages))
    assert w.size < 0.8 * alone


def test_own_columns_never_clash(spark, monkeypatch):
    from veldt.llm import compact_windows, ngram_join, run_length_index

    own = ["__th", "__host", "__d", "__h", "__spans_", "__row", "__doc", "__spans", "__k"]
    body = lambda i: "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(9)) for j in range(9))
    rows = [(i, body(i), "h", *(f"{i}{c}" for c in own)) for i in range(4)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, source string", *(f"`{c}` string" for c in own)]))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    bench = spark.createDataFrame([(1, "nothing of it")], "item_id long, text string")
    for out in (quality_rules.clean(df), ngram_join.keep_one(df), compact_windows.remove_passages(df), decontamination.remove_contamination(df, bench), run_length_index.repeated_bytes(df.drop("__spans")).select(*(c for c in df.columns if c != "__spans"))):
        assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [tuple(x for c, x in zip(df.columns, r) if c in out.columns) for r in rows]
