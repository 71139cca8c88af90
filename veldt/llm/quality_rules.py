"""Quality rules from cross-document line frequency; DataFrame expressions only.

Normalised lines are hashed together with their host, the distinct documents (texts)
of each are counted, lines above the host's limit are removed, and documents of which
too little is left are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize
from ._text import fresh

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent lines are broadcast up to so many rows (16 bytes each); beyond it they are joined by shuffle, salted.
BROADCAST_ROWS = 1 << 20
SALTS = 16
#: Up to so many repeated windows a text is scanned against their list, else its windows are sorted.
FEW = 48


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def spaced(text: Column) -> Column:
    """White space other than line ends as spaces."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(" ")) if c != "\n" else text
    return text


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.replace(spaced(text), F.lit("\n"), F.lit(" ")), " "), "")


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(" " + SPACES)) != ""


def normalised(text: Column) -> Column:
    """Lower case, single spaces between words; lines stay lines (trim them)."""
    out = spaced(F.lower(text))
    return F.when(F.instr(out, "  ") > 0, F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def count_of(text: Column, chars: str) -> Column:
    """Occurrences of the given characters."""
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0))


def _covered(places: Column) -> Column:
    """Words in the 3-word windows that start at the given ascending places."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more."""

    def of_hashes(h: Column) -> Column:
        def by_list(twice: Column) -> Column:
            return _covered(F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(twice, F.get(h, i))))

        def by_sort(pairs: Column) -> Column:
            near = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
            twice = F.filter(pairs, lambda x, k: near(x, k - 1) | near(x, k + 1))
            return _covered(F.sort_array(F.transform(twice, lambda x: x["i"])))

        def of_sorted(s: Column) -> Column:
            twice = F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1) == x, F.lit(False))))
            pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            return let(twice, lambda t: F.when(F.size(t) <= FEW, by_list(t)).otherwise(let(pairs, by_sort)))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(h), of_sorted))

    hashes = F.slice(F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))), F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0)))
    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(hashes, of_hashes))


def text_stats(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    t = F.coalesce(text, F.lit(""))

    def of_words(ws: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), has_word)
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.aggregate(ws, F.lit(0), lambda n, w: n + F.length(w)).cast("long").alias("word_chars"),
            count_of(t, SYMBOLS).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(ws).cast("long").alias("n_repeat_words"),
        )

    return let(words(t), of_words)


def _keys(docs: DataFrame) -> DataFrame:
    """Rows of equal id, host and text have one verdict, so these are the key."""
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


def _lines(keys: DataFrame) -> DataFrame:
    """A row per line with a word: its place, host-line hash, number of words."""
    lines = F.filter(F.transform(F.split(normalised(F.col("text")), "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(F.col("host"), x).alias("hl"), (count_of(x, " ") + 1).alias("w")))
    return keys.select("doc_id", "host", "th", F.posexplode(hashed).alias("at", "line")).select("doc_id", "host", "th", "at", "line.*")


def frequent_lines(docs: DataFrame, min_docs: int = 20, max_share: float = 0.1) -> DataFrame:
    """Nulls as empty texts and names; rows and texts that repeat count once.
    Host-line hashes in more than ``min_docs`` distinct texts of their host and more
    than ``max_share`` of them: ``hl, n_docs`` and, for the second test, ``host_docs`` by
    host (second result)."""
    keys = _keys(docs)
    counts = _lines(keys).select("hl", "th").groupBy("hl").agg(F.count_distinct("th").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    hosts = keys.groupBy("host").agg(F.count_distinct("th").alias("host_docs")).withColumn("most", F.greatest(F.lit(min_docs).cast("double"), F.col("host_docs") * F.lit(max_share)))
    return materialize(counts, "frequent-lines"), materialize(hosts, "hosts")


def removed_lines(docs: DataFrame, min_docs: int = 20, max_share: float = 0.1, with_hashes: bool = False) -> DataFrame:
    """Per (doc_id, host, th) with lines above the limits: removed_lines,
    removed_words and, if asked for, the hashes."""
    counts, hosts = frequent_lines(docs, min_docs, max_share)
    lines = _lines(_keys(docs))
    if counts.count() <= BROADCAST_ROWS:
        hit = lines.join(F.broadcast(counts), "hl")
    else:
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = lines.withColumn("salt", F.pmod(F.col("th"), F.lit(SALTS)).cast("int")).join(salted, ["hl", "salt"])
    hit = hit.join(F.broadcast(hosts) if hosts.count() <= BROADCAST_ROWS else hosts, "host").filter(F.col("n_docs") > F.col("most"))
    aggs = [F.count(F.lit(1)).alias("removed_lines"), F.sum("w").alias("removed_words")] + ([F.collect_set("hl").alias("removed")] if with_hashes else [])
    once = hit.select("doc_id", "host", "th", "at", "hl", "w").distinct()  # rows that repeat are one document
    return once.groupBy("doc_id", "host", "th").agg(*aggs)


def assess(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_docs: int = 20, max_share: float = 0.1, max_removed: float = 0.5) -> DataFrame:
    """A row per document: doc_id, the text figures, removed_lines, removed_words,
    base_failed and kept (not failed, and at most ``max_removed`` of its words removed).

    Null text: no words, so it fails.  Null source: the host of the empty name.
    Repeated rows are one text and don't raise a line's count; each returns its row.
    """
    stats = _keys(docs).select("doc_id", "host", "th", text_stats(F.col("text")).alias("s")).select("doc_id", "host", "th", "s.*")
    cut = removed_lines(docs, min_docs, max_share).select(F.col("doc_id").alias("__d"), F.col("host").alias("__h"), F.col("th").alias("__t"), "removed_lines", "removed_words")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = stats.join(cut, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("host") == F.col("__h")) & (F.col("th") == F.col("__t")), "left")
    return (
        out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("removed_lines", "removed_words")})
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= F.col("n_words") * max_removed))
        .drop("host", "th", "__d", "__h", "__t")
    )


def clean(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_docs: int = 20, max_share: float = 0.1, max_removed: float = 0.5) -> DataFrame:
    """The kept documents with all their columns; lines above the limits are gone from ``text``.
    Nulls and repeated rows as in ``assess``."""
    host, th, figures, d, h, t, w, r = fresh(docs, "host", "th", "figures", "d", "h", "t", "w", "r")
    cut = removed_lines(docs, min_docs, max_share, with_hashes=True).select(F.col("doc_id").alias(d), F.col("host").alias(h), F.col("th").alias(t), F.col("removed_words").alias(w), F.col("removed").alias(r))
    own = docs.withColumns({host: F.coalesce("source", F.lit("")), th: F.xxhash64(F.coalesce("text", F.lit("")))})
    # a generator: filters on its columns stay above it, so the figures are computed once
    own = own.select("*", F.inline(F.array(F.struct(text_stats(F.col("text")).alias(figures)))))
    own = own.filter((F.col(f"{figures}.n_words") >= min_words) & (100 * F.col(f"{figures}.n_repeat_words") <= max_repeat_percent * F.col(f"{figures}.n_words")))
    out = own.join(cut, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(host) == F.col(h)) & (F.col(th) == F.col(t)), "left")
    out = out.filter(F.coalesce(w, F.lit(0)) <= F.col(f"{figures}.n_words") * max_removed)
    stay = F.filter(F.split("text", "\n"), lambda x: ~(has_word(x) & F.array_contains(r, F.xxhash64(F.col(host), F.btrim(normalised(x))))))
    return out.withColumn("text", F.when(F.col(r).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))).select(*docs.columns)
