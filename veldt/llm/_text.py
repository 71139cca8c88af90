"""Text primitives shared by the operators: word splitting, hashing and memoised
tokenisation.  All of them work on whole texts."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

#: A-Z to a-z on UTF-8 bytes; nothing else changes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Also everything of ASCII that is neither letter nor digit becomes a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


_GOLD = 0x9E3779B97F4A7C15
_FOLD = np.uint64(_GOLD)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Whether a byte is white space, and masks that keep the first k of 8 bytes.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, one after the other, and how many
    each text has.  Words are hashed 8 bytes at a time, all of the batch together."""
    raws = [utf8(t) for t in texts]
    data = b"".join([b" ", b" ".join(raws), b" " * 9]).translate(LOWER)
    space = _SPACE[np.frombuffer(data, np.uint8)]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, size = turn[::2], turn[1::2] - turn[::2]
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = mix((eight[start] & _MASK[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64)))
    k, long = 8, np.flatnonzero(size > 8)
    while len(long):
        h[long] = mix(h[long] ^ (eight[start[long] + k] & _MASK[np.minimum(size[long] - k, 8)])) + _FOLD
        k += 8
        long = long[size[long] > k]
    ends = np.cumsum([len(r) + 1 for r in raws])  # each text begins behind the space before it
    return h, np.diff(np.searchsorted(start, ends, "right"), prepend=0)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, in text order; one hash of the whole
    sequence if there are fewer, none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = mix(words[: len(words) - n + 1] + _FOLD)
    for k in range(1, n):
        out = mix((out ^ words[k : len(words) - n + 1 + k]) + np.uint64(_GOLD * (k + 1) & (1 << 64) - 1))
    return out


class Encoder:
    """Token ids of whole texts by a public tokenizer of the ``tokenizers`` library.

    Texts are cut where the tokenizer's own pre-tokenisation always cuts, every
    distinct piece goes through the library once and is remembered (a bounded
    memory), and a text for which the cuts aren't certain goes through whole.
    The ids are those of encoding the whole text without added special tokens.  Control
    strings inside texts get their special ids, as the library does it, or are ordinary
    text with ``plain_controls``.
    """

    #: White space on which the library and Python may differ, and the pieces' separator.
    _ODD = re.compile("[\x1c-\x1f\x85\ue000]")

    def __init__(self, path: str, kind: str, plain_controls: bool = False, limit: int = 900_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_controls
        self.kind, self.limit = kind, limit
        controls = [] if plain_controls else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.controls = re.compile("|".join(map(re.escape, controls)), re.IGNORECASE) if controls else None
        #: A run of letters that ends before ASCII that is no letter, else all up to
        #: white space.  In byte-level vocabularies a space belongs to what follows it.
        run = rf"[{self._letters()}]+(?=[\x00-@\[-`{{-\x7f]|\Z)"
        self.bytes, self.words = re.compile(rf" ?{run}| ?\S+|\n(?=\S)"), re.compile(rf"{run}|\S+")
        self.memo = {"\n": self._ids("\n").tobytes()}
        if kind == "byte":
            self.gap, self.sep = "\n", self._ids("\n")
        else:
            self.gap, self.sep = " \ue000 ", self._ids("\ue000")

    def _letters(self) -> str:
        """Latin letters that are nothing but letters after the tokenizer's normalisation
        (the lower case of U+0130 has a combining mark, which joins what follows it)."""
        norm = self.tok.normalizer.normalize_str if self.tok.normalizer else str
        return "".join(c for c in map(chr, range(0x250)) if c.isalpha() and norm(c).isalpha())

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pieces(self, text: str) -> list[str] | None:
        if self._ODD.search(text) or (self.controls and self.controls.search(text)):
            return None
        if self.kind != "byte":
            return self.words.findall(text)
        pieces = self.bytes.findall(text)
        return pieces if sum(map(len, pieces)) == len(text) else None

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids = np.array(self.tok.encode_batch_fast([self.gap.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            k = len(self.sep)
            hit = ids[: len(ids) - k + 1] == self.sep[0] if len(ids) >= k else np.zeros(0, bool)
            for j in range(1, k):
                hit &= ids[j : len(ids) - k + 1 + j] == self.sep[j]
            cuts = np.flatnonzero(hit)
            if len(cuts) != len(part) - 1:  # a piece looks like the separator
                for p in part:
                    self.memo[p] = self._ids(p).tobytes()
                continue
            raw, a = ids.tobytes(), 0
            for p, b in zip(part, [*cuts.tolist(), len(ids)]):
                self.memo[p] = raw[4 * a : 4 * b]
                a = b + k

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: none)."""
        cut = [self._pieces(t) if t else [] for t in texts]
        memo, full = self.memo, len(self.memo) >= self.limit
        new = [p for p in set(chain.from_iterable(ps for ps in cut if ps)) if p not in memo]
        if new:
            self._learn(new)
        get = memo.__getitem__
        out = [b"".join(map(get, ps)) if ps is not None else self._ids(t).tobytes() for t, ps in zip(texts, cut)]
        if full:  # the first pieces stay: they are the frequent ones
            for p in new:
                del memo[p]
        return out


_ENCODERS: dict[tuple[str, str, bool], Encoder] = {}


def encoder(path: str, kind: str, plain_controls: bool = False) -> Encoder:
    """The worker process's own encoder; later tasks go on with what it remembers."""
    key = (path, kind, plain_controls)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def fresh(df, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, made of these."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def spread(df, *columns, piece: int = 4 << 20):
    """``df``'s columns.  If it has fewer partitions than there are cores (a few large files),
    rows are dealt over as many as there are pieces of this many bytes, at most the cores."""
    spark = df.sparkSession
    cores, size = spark.sparkContext.defaultParallelism, int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n, out = min(cores, -(-size // piece)), df.select(*columns)
    return out if n <= 1 or out.rdd.getNumPartitions() >= cores else out.repartition(n)


def batches(table_batches, limit: int = 1 << 20, column: str = "text"):
    """Re-cut Arrow batches so that the named text column holds about ``limit``
    bytes each (a longer text comes alone)."""
    import pyarrow.compute as pc

    for b in table_batches:
        if not b.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64))
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield b.slice(at, end - at)
            at = end


def whole_runs(table_batches):
    """Tables of sorted batches, cut so that equal values of the first column stay together."""
    import pyarrow as pa

    held = None
    for b in table_batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        key = t.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        held = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if held is not None:
        yield held
